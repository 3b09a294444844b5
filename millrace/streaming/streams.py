"""Streams: change mirrors batch by batch, windows over event time, and totals with a state for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cdc, keyed


def files(spark: SparkSession, path: str, like: DataFrame, kind: str = "parquet", each: int = 1) -> DataFrame:
    """A stream of the files of a folder, with the columns of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", each).format(kind).load(path)


def mirror(changes: DataFrame, target: str, keys: list[str], checkpoint: str, order: list[str], transform=None, buckets: int = 64):
    """Applies change events to a keyed table, batch by batch; offsets move on only after a batch is written.

    ``order`` settles several changes of a key within a batch.  A batch rewrites the buckets that its keys fall into and no other file.
    ``transform`` runs on each batch alone, so aggregates in it are of that batch; ``totals`` keeps them over all batches.  Applying a batch twice
    leaves the same table.  ``keyed.read`` reads it.
    """

    def apply(batch: DataFrame, _: int) -> None:
        held = transform(batch) if transform else batch
        keyed.merge(target, cdc.latest(held, keys, order), keys, buckets)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(df: DataFrame, ts: str, width: str, keys: list[str], late: str = "0 seconds", slide: str | None = None) -> DataFrame:
    """Counts by event-time window, which slides if ``slide`` is given."""
    held = df.withWatermark(ts, late) if df.isStreaming else df
    return held.groupBy(F.window(ts, width, slide) if slide else F.window(ts, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], late: str = "0 seconds") -> DataFrame:
    """Counts by session: events of a key with less than ``gap`` between them."""
    held = df.withWatermark(ts, late) if df.isStreaming else df
    return held.groupBy(F.session_window(ts, gap).alias("session"), *keys).agg(F.count("*").alias("n")).select(F.col("session.start").alias("start"), F.col("session.end").alias("end"), *keys, "n")


def unique_events(df: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """The first event of each key; state older than ``late`` is dropped."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)

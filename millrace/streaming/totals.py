"""Running totals of a stream, a state for each key; idle keys expire by event time."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Kinds of rows that come out.
UPDATED, EXPIRED = "updated", "expired"


class _Totals(StatefulProcessor):
    def __init__(self, keys: list[str], values: list[str], ts: str, idle_ms: int):
        self.keys, self.values, self.ts, self.idle_ms = keys, values, ts, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = ", ".join(f"s{k} double, c{k} long" for k in range(len(self.values)))
        self.state = handle.getValueState("totals", f"n long, last long{', ' if fields else ''}{fields}")

    def _row(self, key, held, kind: str):
        import pandas as pd

        named = dict(zip(self.keys, key, strict=True)) | {"n": [held[0]], "last": [pd.Timestamp(held[1], unit="us")]}
        for k, v in enumerate(self.values):
            # A sum of nothing but nulls is null, as in SQL.
            named[f"sum_{v}"] = [held[2 + 2 * k] if held[3 + 2 * k] else None]
        return pd.DataFrame(named | {"kind": [kind]})

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        held = list(self.state.get()) if self.state.exists() else [0, -(2**62)] + [0.0, 0] * len(self.values)
        for pdf in rows:
            held[0] += len(pdf)
            at = pdf[self.ts].dropna()
            if len(at):
                held[1] = max(held[1], int(at.max().value // 1000))
            for k, v in enumerate(self.values):
                fit = pdf[v].dropna().astype(float)
                held[2 + 2 * k] += float(fit.sum())
                held[3 + 2 * k] += len(fit)
        self.state.update(tuple(held))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(held[1] // 1000 + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._row(key, held, UPDATED)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        if self.state.exists():
            held = list(self.state.get())
            self.state.clear()
            yield self._row(key, held, EXPIRED)

    def close(self) -> None:
        pass


def running(stream: DataFrame, keys: list[str], values: list[str], ts: str, late: str = "0 seconds", idle_seconds: int | None = None) -> DataFrame:
    """For each trigger the keys it changed, with totals over all triggers so far: keys, n, last (latest time), sum_<value>, kind.

    The state of a key is one row, in RocksDB below the checkpoint, so a restart goes on where it was.  With ``idle_seconds`` a key whose events lie that far
    behind the watermark gives its totals once more, as ``expired``, and starts from nothing; without it keys stay.  Null keys are a key; null values don't count in
    sums, null times don't move ``last``.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    if idle_seconds is None:  # nothing expires: Spark's own aggregate keeps the same row for each key, without a call of Python for it
        sums = [F.sum(F.col(v).cast("double")).alias(f"sum_{v}") for v in values]
        return stream.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.col(ts).cast("timestamp")).alias("last"), *sums).withColumn("kind", F.lit(UPDATED))
    kinds = dict(stream.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", n long, last timestamp, " + "".join(f"`sum_{v}` double, " for v in values) + "kind string"
    rows = stream.select(*keys, *[F.col(v).cast("double").alias(v) for v in values], F.col(ts).cast("timestamp").alias(ts)).withWatermark(ts, late)
    return rows.groupBy(*keys).transformWithStateInPandas(_Totals(keys, values, ts, idle_seconds * 1000), schema, "Update", "EventTime")


def keep(stream: DataFrame, target: str, keys: list[str], checkpoint: str, **options):
    """Keeps ``running`` totals (``options`` are its arguments) in a keyed table, batch by batch; expired keys leave it."""
    from ..operators import cdc, keyed

    def apply(batch: DataFrame, _: int) -> None:
        # A key that expires in a batch may also begin anew in it: what it begins with counts.
        code = F.when(F.col("kind") == EXPIRED, "D").otherwise("U")
        latest = cdc.latest(batch.withColumn("__order", F.when(F.col("kind") == EXPIRED, 0).otherwise(1)), keys, ["__order"]).drop("__order")
        keyed.merge(target, latest.withColumn(cdc.OPCODE, code).drop("kind"), keys)

    return running(stream, keys, **options).writeStream.foreachBatch(apply).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

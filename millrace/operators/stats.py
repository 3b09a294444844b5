"""Run statistics: anomalies, trends, buckets, ranges of keys, drift, catalogue search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def anomalies(df: DataFrame, series: list[str], order: list[str], value: str, history: int = 20, least: int = 5) -> DataFrame:
    """``df`` with mean, stddev and severity (none, warning, critical) against the ``history`` rows before, per series."""
    w = Window.partitionBy(*series).orderBy(*order).rowsBetween(-history, -1)
    v = F.col(value).cast("double")
    df = df.withColumns({"points": F.count(v).over(w), "mean": F.avg(v).over(w), "stddev": F.stddev_pop(v).over(w)})
    z = F.abs(v - F.col("mean")) / F.col("stddev")
    severity = (
        F.when(F.col("points") < least, "none").when(F.col("stddev") == 0, F.when(v == F.col("mean"), "none").otherwise("warning"))
        .when(z >= 3, "critical").when(z >= 2, "warning").otherwise("none")
    )
    return df.withColumn("severity", severity)


def trend(df: DataFrame, order: str, n: int = 50) -> DataFrame:
    """The last ``n`` rows, oldest first."""
    return df.orderBy(F.desc(order)).limit(min(max(n, 1), 500)).orderBy(order)


def bucket_seconds(lookback: int, target: int = 60, least: int = 1) -> int:
    """Width of buckets that cut ``lookback`` seconds into ``target`` of them, and ``least`` at least."""
    return max(lookback // target, least)


def buckets(df: DataFrame, ts: str, values: list[str], seconds: int) -> DataFrame:
    """Means of fixed-width buckets that start at the first sample, cut to whole numbers for whole-number columns; empty ones are left out."""
    first = df.agg(F.min(F.unix_micros(F.col(ts).cast("timestamp"))).alias("__first"))
    at = F.floor((F.unix_micros(F.col(ts).cast("timestamp")) - F.col("__first")) / (seconds * 1_000_000))
    mean = lambda v: F.floor(F.avg(v)).cast("long") if isinstance(df.schema[v].dataType, T.IntegralType) else F.avg(v)
    # One row, the first sample's time.
    return df.crossJoin(F.broadcast(first)).groupBy(at.alias("bucket")).agg(*[mean(v).alias(v) for v in values])


def merge_columns(known: DataFrame, found: DataFrame) -> DataFrame:
    """A catalogue of columns after another look: (dataset, name) stay for ever, types are the newest, other fields are kept.

    known: dataset, name, type and what people have added; found: dataset, name, type.
    """
    new = found.select("dataset", "name", F.col("type").alias("__type")).dropDuplicates(["dataset", "name"])
    joined = known.join(new, ["dataset", "name"], "full")
    return joined.select(*[F.coalesce("__type", "type").alias("type") if c == "type" else F.col(c) for c in known.columns])


def lineage_edges(specs: DataFrame) -> DataFrame:
    """source, target: edges of a lineage graph from specifications: a resource to its pipeline, a pipeline to its resources.

    specs: pipeline_id, sources and sinks (arrays of connector, identifier).  Equal edges are one; null identifiers have none.
    """
    resource = F.concat(F.lit("resource::"), F.col("x.connector"), F.lit("::"), F.col("x.identifier"))
    pipeline = F.concat(F.lit("pipeline::"), F.col("pipeline_id"))
    read = specs.select("pipeline_id", F.explode("sources").alias("x")).select(resource.alias("source"), pipeline.alias("target"))
    made = specs.select("pipeline_id", F.explode("sinks").alias("x")).select(pipeline.alias("source"), resource.alias("target"))
    return read.unionByName(made).dropna().distinct()


def key_ranges(df: DataFrame, key: str, n: int) -> list[tuple]:
    """Lower-inclusive, upper-exclusive ranges of a whole-number key, the last one open; other keys give one range."""
    if not isinstance(df.schema[key].dataType, T.IntegralType):
        return [(None, None)]
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None:
        return []
    width = -(-(high - low + 1) // n)
    starts = list(range(low, high + 1, width))
    return [(a, b) for a, b in zip(starts, [*starts[1:], None], strict=True)]


def drift(old: T.StructType, new: T.StructType) -> list[str]:
    """Changes of columns, sorted: ``+a``, ``-b``, ``c: old→new``; order doesn't count."""
    a, b = ({f.name: f.dataType.simpleString() for f in s} for s in (old, new))
    changed = [f"{c}: {a[c]}→{b[c]}" for c in a if c in b and a[c] != b[c]]
    return sorted([f"+{c}" for c in b if c not in a] + [f"-{c}" for c in a if c not in b] + changed)


def search(df: DataFrame, text: str = "", fields: list[str] = (), exact: dict | None = None, tag: str | None = None) -> DataFrame:
    """Rows of a catalogue that have ``text`` in any of ``fields``, in any case, and all the exact values."""
    out = df
    if text:
        hit = F.lit(False)
        for f in fields:
            hit = hit | F.contains(F.lower(F.coalesce(F.col(f), F.lit(""))), F.lower(F.lit(text)))
        out = out.filter(hit)
    for c, v in (exact or {}).items():
        out = out.filter(F.col(c) == v)
    return out.filter(F.array_contains("tags", tag)) if tag else out

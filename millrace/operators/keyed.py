"""Tables kept by key: rows are dealt to buckets by the hash of their key, a merge rewrites the buckets it changes and no other file."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SpecError
from . import cdc

BUCKET = "__bucket"
#: Kept beside the buckets; Spark doesn't read names that begin with an underscore.
ABOUT = "_keyed.json"


def _file(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def about(spark: SparkSession, path: str) -> dict | None:
    """Keys and number of buckets of a table, None if there is none."""
    fs, at = _file(spark, f"{path}/{ABOUT}")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _bucket(keys: list[str], n: int):
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(n)).cast("int")


def _with_rows(spark: SparkSession, path: str) -> list[int]:
    """Buckets that have a folder."""
    fs, at = _file(spark, path)
    return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(at) if s.getPath().getName().startswith(f"{BUCKET}="))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table, with all columns that merges have brought; null where a file lacks one.  The schema is kept beside the files, so none is opened to learn it."""
    held = about(spark, path)
    if held is None:
        raise SpecError(f"no keyed table at {path}")
    return _stored(spark, path, held).drop(BUCKET)


def _stored(spark: SparkSession, path: str, held: dict) -> DataFrame:
    schema = f"{held['schema']}, {BUCKET} int"
    return spark.read.schema(schema).parquet(path) if _with_rows(spark, path) else spark.createDataFrame([], schema)


def _remember(spark: SparkSession, path: str, held: dict) -> None:
    fs, at = _file(spark, f"{path}/{ABOUT}")
    out = fs.create(at, True)
    try:
        out.write(json.dumps(held).encode())
    finally:
        out.close()


def merge(path: str, changes: DataFrame, keys: list[str], buckets: int = 64) -> list[int]:
    """Merges ``changes``, which may have opcodes, into the table at ``path``, made with ``buckets`` buckets if it isn't there; returns the buckets rewritten.

    Only the buckets that a changed key falls into are read and written: each is replaced as a whole when all are written, and a bucket that
    loses its last row loses its folder.  Upserts apply before deletes; of several upserts of a key any one stays, so settle their order
    first (``cdc.latest``).  New columns are added; values of known ones are cast to the table's types, and what can't be raises.  Merging the same changes again leaves the same rows, so a merge that was broken off is simply repeated.  The driver sees
    the numbers of buckets; choose as many as make a bucket one task's work.
    """
    spark = changes.sparkSession
    held = about(spark, path)
    if held and held["keys"] != keys:
        raise SpecError(f"the table has the keys {held['keys']}")
    n = held["buckets"] if held else buckets
    dealt = changes.withColumn(BUCKET, _bucket(keys, n)).persist()
    try:
        touched = sorted(r[0] for r in dealt.select(BUCKET).distinct().collect())
        parts = cdc.split(dealt)
        given = (parts[0] if parts else dealt).drop(BUCKET).schema
        known = spark.createDataFrame([], held["schema"]).columns if held else []
        more = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given if f.name not in known)
        if not held or more:
            held = {"keys": keys, "buckets": n, "schema": ", ".join(x for x in (held["schema"] if held else "", more) if x)}
            _remember(spark, path, held)
        if not touched:
            return []
        there = set(_with_rows(spark, path)) & set(touched)
        existing = _stored(spark, path, held).filter(F.col(BUCKET).isin(touched))
        upserts, deletes = parts or (dealt, None)
        upserts = upserts.dropDuplicates(keys)
        gone = upserts.select(*keys) if deletes is None else upserts.select(*keys).unionByName(deletes.select(*keys))
        new = upserts if deletes is None else cdc.without(upserts, deletes, keys)
        rows = cdc.without(existing, gone, keys).unionByName(new, allowMissingColumns=True)
        rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in existing.schema])
        rows.repartition(len(touched), BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
        _drop_emptied(spark, path, keys, there, deletes, held)
        return touched
    finally:
        dealt.unpersist()


def _drop_emptied(spark: SparkSession, path: str, keys: list[str], there: set[int], deletes: DataFrame | None, held: dict) -> None:
    """Deletes the folders of buckets whose rows are all gone: a bucket without rows isn't written, so its old files are still there."""
    if deletes is None or not there:
        return
    stale = _stored(spark, path, held).filter(F.col(BUCKET).isin(sorted(there)))
    known = deletes.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    for r in stale.join(known, same, "left_semi").select(BUCKET).distinct().collect():
        fs, at = _file(spark, f"{path}/{BUCKET}={r[0]}")
        fs.delete(at, True)

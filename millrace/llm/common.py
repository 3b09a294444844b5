"""Helpers that several operators share: tables, shared folders, small column idioms."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space, as in the contracts of several queries.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``; only a local session, where that is unset, gets a
    temporary folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = getattr(spark, "_millrace_folder", None) or tempfile.mkdtemp(prefix="spark-")
        spark._millrace_folder = folder
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used, deleted when the session's JVM ends."""
    path = f"{shared_folder(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    fs, at = _file(spark, path)
    fs.deleteOnExit(at)
    _made(spark).append(path)
    return path


def _file(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _made(spark: SparkSession) -> list[str]:
    """Paths that ``new_path`` has given in this application."""
    context = spark.sparkContext
    if not hasattr(context, "_millrace_made"):
        context._millrace_made = []
    return context._millrace_made


def forget(spark: SparkSession, since: int, *kept: DataFrame) -> None:
    """Deletes the folders made since ``mark`` gave ``since``, but for those of ``kept``, which ``written`` has given: nothing reads them again."""
    made, held = _made(spark), {df._millrace_path for df in kept}
    for path in made[since:]:
        if path not in held:
            fs, at = _file(spark, path)
            fs.delete(at, True)
    made[since:] = [path for path in made[since:] if path in held]


def mark(spark: SparkSession) -> int:
    return len(_made(spark))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, even where lambdas mention it again and again."""
    return F.transform(F.array(value), body)[0]


def text_key(text: Column) -> list[Column]:
    """96 bits of hash that stand for a text: two of 3e10 different texts share them with a chance of 1e-8."""
    return [F.xxhash64(text).alias("__k1"), F.hash(text).alias("__k2")]


def with_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """``df`` with ``new`` columns last; a column of ``df`` that has the name of a new one is replaced by it."""
    return df.select(*[df[c] for c in df.columns if c.lower() not in {n.lower() for n in new}], *[c.alias(n) for n, c in new.items()])


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``df``, written, with a dense rank from 0 in the given order: range partitions, each counted, and offsets.

    What the driver sees is a number for each partition.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    held = written(placed.withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", 33)
    counts = sorted((r.p, r.n) for r in held.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    known = spark.createDataFrame(offsets, "__p long, __o long")
    return held.withColumn("__p", part).join(F.broadcast(known), "__p").withColumn(name, F.col("__o") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__p", "__o", "__at")

"""Session with the settings that the operators expect."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf) -> SparkSession:
    """A session with ANSI casts, UTC and adaptive plans; partition counts are the cluster's unless given."""
    builder = SparkSession.builder.appName("millrace")
    if master:
        builder = builder.master(master)
    wanted = {"spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    if shuffle_partitions:
        wanted["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in (wanted | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, which all executors share, deleted when the application ends; a local session without it gets a temporary folder."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = getattr(context, "_millrace_scratch", None) or tempfile.mkdtemp(prefix="spark-")
        context._millrace_scratch = folder
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path

"""Connectors by name: Spark's own readers and writers, and a few in Python.

Names that need a server or a driver map to the Spark format that reads them; using one whose package is missing raises
Spark's own error.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SpecError
from ..operators import cdc
from ..session import scratch
from . import rest, sqlite, values

# Connector names and the Spark formats that read them.
FILES = ("csv", "json", "parquet", "orc", "text")
JDBC = ("postgres", "mysql", "mssql", "synapse", "oracle", "redshift", "snowflake", "bigquery", "databricks", "clickhouse", "duckdb", "hana", "teradata", "vertica", "odbc", "starburst", "pgvector")
FORMATS = {"kafka": "kafka", "deltalake": "delta", "iceberg": "iceberg", "ailake": "parquet"}
CHANGES = ("deltalake-cdc", "iceberg-cdc")
# Codec names.
CODECS = {"none": "none", "snappy": "snappy", "gzip": "gzip", "lz4": "lz4", "lz4_raw": "lz4_raw", "zstd": "zstd", "brotli": "brotli"}
NARROW = {"bigint": "bigint", "int": "bigint", "smallint": "bigint", "tinyint": "bigint", "double": "double", "float": "double", "boolean": "boolean"}


def names() -> list[str]:
    return sorted({*FILES, *JDBC, *FORMATS, *CHANGES, "rest", "sqlite", "webhook"})


def _one(config: dict, key: str, default: str) -> str:
    value = config.get(key, default)
    if len(value) != 1 or not value.isascii():
        raise SpecError(f"{key} is one ASCII character")
    return value


def narrowed(df: DataFrame) -> DataFrame:
    """Columns as long, double, boolean or text, as the row-wise connectors have them."""
    return df.select(*[df[c].cast(NARROW.get(t, "string")).alias(c) for c, t in df.dtypes])


infer_json, _as, _fields = values.infer, values.fitted, values.fields


def json_rows(spark: SparkSession, rows: list[dict], schema: str | None = None) -> DataFrame:
    """A DataFrame of rows that a service has sent; what doesn't fit its column is null."""
    schema = schema or infer_json(rows[:1000])
    fields = _fields(schema)
    return spark.createDataFrame([tuple(_as(r.get(n), t) for n, t in fields) for r in rows], schema)


def read_json(spark: SparkSession, path: str, sample: int = 1000) -> DataFrame:
    """JSON lines typed by ``infer_json`` over the first lines; parsing is Spark's."""
    first = [json.loads(r.value) for r in spark.read.text(path).filter("trim(value) <> ''").limit(sample).collect()]
    return spark.read.schema(infer_json(first)).option("primitivesAsString", "false").json(path)


def read_rest(spark: SparkSession, config: dict) -> DataFrame:
    """Rows of a paginated JSON service: ``url``, ``rows_path``, ``pagination`` (none, offset, cursor), ``max_pages``.

    Where ``total_path`` says how many rows there are, tasks fetch the offset pages; a cursor leads from page to page, and so the driver
    follows it.  More than ``max_pages`` pages raise.
    """
    kind, size, most, seconds = config.get("pagination", "none"), config.get("page_size", 100), config.get("max_pages", 1000), config.get("timeout_seconds", 30)
    offset, limit = config.get("offset_param", "offset"), config.get("limit_param", "limit")

    def page(number: int, cursor=None):
        ask = {"offset": {offset: number * size, limit: size}, "cursor": {config.get("cursor_param", "cursor"): cursor} if cursor else {}}.get(kind, {})
        return rest.get(config["url"], ask, seconds, config.get("retries", 3), config.get("retry_backoff_seconds", 1))

    body = page(0)
    rows, cursor, number = rest.dig(body, config.get("rows_path")) or [], rest.dig(body, config.get("cursor_path")), 0
    schema = config.get("schema") or infer_json(rows)
    if kind == "offset" and config.get("total_path"):
        pages = -(-int(rest.dig(body, config["total_path"]) or 0) // size)
        if pages > most:
            raise SpecError(f"{pages} pages are more than {most}")

        def fetch(batches):
            import pandas as pd

            fields = _fields(schema)
            for pdf in batches:
                for number in pdf["id"]:
                    found = rest.dig(page(int(number)), config.get("rows_path")) or []
                    yield pd.DataFrame([[_as(r.get(n), t) for n, t in fields] for r in found], columns=[n for n, _ in fields], dtype=object)

        return spark.range(0, max(1, pages), 1, max(1, min(pages, 64))).mapInPandas(fetch, schema)
    while (kind == "offset" and len(rows) == (number + 1) * size) or (kind == "cursor" and cursor is not None):
        number += 1
        if number >= most:
            raise SpecError(f"more than {most} pages")
        body = page(number, cursor)
        found, cursor = rest.dig(body, config.get("rows_path")) or [], rest.dig(body, config.get("cursor_path"))
        rows += found
    return json_rows(spark, rows, schema)


def ready(spark: SparkSession) -> SparkSession:
    """``spark`` with the library's data sources, ``millrace_sqlite`` and ``millrace_rest``, and with filters pushed to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (sqlite.SqliteSource, rest.RestSource):
        spark.dataSource.register(source)
    return spark


def read_sqlite(spark: SparkSession, config: dict) -> DataFrame:
    """A table or view of an SQLite file that all executors can open: tasks read ranges of its row numbers, filters reach the file.  What has no row numbers is one task."""
    reader = ready(spark).read.format("millrace_sqlite").options(path=config["path"], table=config["table"], rows_per_task=config.get("rows_per_task", 100_000))
    return (reader.schema(config["schema"]) if config.get("schema") else reader).load()


def write_sqlite(df: DataFrame, config: dict) -> None:
    """Inserts, or with ``primary_key`` upserts and deletes by opcode, in one transaction; the driver applies what tasks have staged in the shared folder."""
    keys = config.get("primary_key") or []
    staging = config.get("staging") or scratch(df.sparkSession, "staging").removeprefix("file://")
    writer = ready(df.sparkSession) and df.write.format("millrace_sqlite").mode(config.get("mode", "append"))
    writer.options(path=config["path"], table=config["table"], primary_key=keys if isinstance(keys, str) else ",".join(keys), staging=staging).save()


def read_changes(spark: SparkSession, connector: str, config: dict) -> DataFrame:
    """Change events of a lakehouse table, with opcodes: Delta's change feed, or what was appended to an Iceberg table."""
    path, options = config.get("path"), config.get("options", {})
    if connector == "deltalake-cdc":
        reader = spark.read.format("delta").option("readChangeFeed", "true").option("startingVersion", config.get("starting_version", 0))
        return cdc.from_change_feed(reader.options(**options).load(path))
    return spark.read.format("iceberg").options(**options).load(path).withColumn(cdc.OPCODE, F.lit("I"))


def read(spark: SparkSession, connector: str, config: dict) -> DataFrame:
    path = config.get("path")
    if connector == "csv":
        options = {"header": config.get("has_header", True), "sep": _one(config, "delimiter", ","), "quote": _one(config, "quote", '"'), "escape": _one(config, "escape", '"')}
        if config.get("schema"):
            return spark.read.options(**options).schema(config["schema"]).csv(path)
        return narrowed(spark.read.options(**options, inferSchema=True, preferDate=False).csv(path))
    if connector == "json":
        return read_json(spark, path)
    if connector in FILES:
        return spark.read.format(connector).load(path)
    if connector == "rest":
        return read_rest(spark, config)
    if connector == "sqlite":
        return read_sqlite(spark, config)
    if connector in JDBC:
        options = {"url": config["url"], "dbtable": config["table"], **config.get("options", {})}
        if config.get("partition_column"):
            options |= {"partitionColumn": config["partition_column"], "lowerBound": config["lower"], "upperBound": config["upper"], "numPartitions": config.get("partitions", 8)}
        return spark.read.format("jdbc").options(**options).load()
    if connector in CHANGES:
        return read_changes(spark, connector, config)
    if connector in FORMATS:
        return spark.read.format(FORMATS[connector]).options(**config.get("options", {})).load(*([path] if path else []))
    raise SpecError(f"{connector!r} can't be read here" if connector in names() else f"no connector {connector!r}")


def write(df: DataFrame, connector: str, config: dict) -> None:
    """Writes ``df``; with ``primary_key`` a folder of Parquet or CSV files is merged, else ``mode`` (overwrite by default) holds."""
    path, mode = config.get("path"), config.get("mode", "overwrite")
    if len(set(df.columns)) != len(df.columns):
        raise SpecError("two columns have the same name")
    options = {}
    if connector == "csv":
        options = {"header": True, "sep": _one(config, "delimiter", ",")}
    if connector == "parquet":
        codec = config.get("compression", "snappy")
        if codec not in CODECS:
            raise SpecError(f"no codec {codec!r}")
        options = {"compression": CODECS[codec]}
    if connector in ("csv", "parquet") and config.get("primary_key"):
        keys = config["primary_key"]
        return cdc.merge_files(path, df, [keys] if isinstance(keys, str) else keys, connector, **options)
    if connector in ("csv", "parquet"):
        return df.write.mode(mode).options(**options).format(connector).save(path)
    if connector in FILES:
        return df.write.mode(mode).format(connector).save(path)
    if connector == "kafka":
        return df.select(F.to_json(F.struct("*")).alias("value")).write.format("kafka").options(**config["options"]).save()
    if connector in JDBC:
        return df.write.mode(config.get("mode", "append")).format("jdbc").options(url=config["url"], dbtable=config["table"], **config.get("options", {})).save()
    if connector in FORMATS:
        return df.write.mode(mode).format(FORMATS[connector]).options(**config.get("options", {})).save(*([path] if path else []))
    if connector == "sqlite":
        return write_sqlite(df, config)
    if connector == "webhook":
        url, each = config["url"], config.get("per_row", False)

        def post(rows):
            import urllib.request

            body = [json.loads(r.row) for r in rows]
            for part in body if each else [body] if body else []:
                ask = urllib.request.Request(url, json.dumps(part).encode(), {"Content-Type": "application/json"})
                urllib.request.urlopen(ask, timeout=30).close()

        return df.select(F.to_json(F.struct("*")).alias("row")).foreachPartition(post)
    raise SpecError(f"{connector!r} can't be written here" if connector in names() else f"no connector {connector!r}")

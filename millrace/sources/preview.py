"""First looks at a source: its first rows as JSON, and SQL over these alone."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sqlstage
from . import registry

ROWS, MOST = 50, 500


def rows_of(df: DataFrame, limit: int = ROWS) -> list[dict]:
    """The first ``limit`` rows (1 to 500) as JSON has them: null fields are left out, times are text."""
    n = min(max(limit, 1), MOST)
    if not df.columns:
        return [{}] * df.limit(n).count()
    return [json.loads(r.row) for r in df.limit(n).select(F.to_json(F.struct("*")).alias("row")).collect()]


def query_data(spark: SparkSession, node: dict, sql: str | None = None) -> str:
    """The first 500 rows of a source as a JSON list, or what ``sql`` makes of these rows, named as the node is: counts in it are of the sample.

    ``node``: name, connector and config.  Rows of the result beyond 500 are left out.
    """
    sample = registry.read(spark, node["connector"], node.get("config", {})).limit(MOST)
    if sql and sql.strip():
        sample = sqlstage.transform({node.get("name") or "source0": sample}, sql)
    return json.dumps(rows_of(sample, MOST), ensure_ascii=False)

"""Data quality checks: one aggregate over the table, and one more for each column whose values have to differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SpecError

SHOWN = 10
SCHEMA = "column string, check string, status string, message string, violation_count long, sample_size long"


def _violation(check: dict, c):
    kind = check["kind"]
    if kind == "not_null":
        return F.sum(F.when(c.isNull(), 1).otherwise(0))
    if kind == "min":
        return F.sum(F.when(c < check["min"], 1).otherwise(0))
    if kind == "max":
        return F.sum(F.when(c > check["max"], 1).otherwise(0))
    if kind == "accepted_values":
        return F.sum(F.when(c.isNotNull() & ~c.cast("string").isin([str(v) for v in check["values"]]), 1).otherwise(0))
    raise SpecError(f"no check {kind!r}")


def _examples(df: DataFrame, column: str, check: dict) -> str:
    """Up to ten offending values, for checks that have failed."""
    c = F.col(column)
    if check["kind"] == "unique":
        rows = df.filter(c.isNotNull()).groupBy(c.cast("string").alias("v")).count().filter("count > 1").orderBy("v").limit(SHOWN)
    elif check["kind"] == "accepted_values":
        rows = df.filter(c.isNotNull() & ~c.cast("string").isin([str(v) for v in check["values"]])).select(c.cast("string").alias("v")).distinct().orderBy("v").limit(SHOWN)
    else:
        return ""
    return ": " + ", ".join(r.v for r in rows.collect())


def run_checks(df: DataFrame, checks: list[dict], examples: bool = True) -> DataFrame:
    """column, check, status (pass or fail), message, violation_count, sample_size: a row for each check.

    checks: ``{"column", "check": {"kind", ...}}``.  Without rows all but ``row_count`` pass; an unknown column fails.
    """
    wanted = [F.count("*").alias("n")]
    for i, x in enumerate(checks):
        if x["check"]["kind"] not in ("row_count", "unique") and x["column"] in df.columns:
            wanted.append(_violation(x["check"], F.col(x["column"])).alias(f"c{i}"))
    found = df.agg(*wanted).first().asDict()
    # Counted by value, which tasks do before the shuffle; several distinct counts in one aggregate would repeat every row.
    for column in {x["column"] for x in checks if x["check"]["kind"] == "unique" and x["column"] in df.columns}:
        each = df.filter(F.col(column).isNotNull()).groupBy(column).agg((F.count("*") - 1).alias("more"))
        more = each.agg(F.sum("more")).first()[0] or 0
        found |= {f"c{i}": more for i, x in enumerate(checks) if x["check"]["kind"] == "unique" and x["column"] == column}
    n, rows = found["n"], []
    for i, x in enumerate(checks):
        column, check = x.get("column", ""), x["check"]
        kind = check["kind"]
        if kind == "row_count":
            fine = check.get("min", 0) <= n and (check.get("max") is None or n <= check["max"])
            rows.append((column, kind, "pass" if fine else "fail", f"{n} rows", n, n))
        elif n == 0:
            rows.append((column, kind, "pass", "no rows", 0, 0))
        elif column not in df.columns:
            rows.append((column, kind, "fail", f"column {column} not found", None, n))
        else:
            bad = found[f"c{i}"] or 0
            more = _examples(df, column, check) if bad and examples else ""
            rows.append((column, kind, "fail" if bad else "pass", f"{bad} violations{more}" if bad else "ok", bad, n))
    return df.sparkSession.createDataFrame(rows, SCHEMA)

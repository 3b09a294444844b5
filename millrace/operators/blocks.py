"""Clean blocks: each a function from one DataFrame to the next, named by its kind."""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SpecError
from ..functions.text import title_case

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,127}")
CASTS = {"int": "bigint", "float": "double", "text": "string", "date": "date", "boolean": "boolean"}


def _column(df: DataFrame, name):
    if not isinstance(name, str) or not IDENTIFIER.fullmatch(name):
        raise SpecError(f"not a column name: {name!r}")
    if name not in df.columns:
        raise SpecError(f"no column {name!r}")
    return df[name]


def _columns(df: DataFrame, names, empty: bool = False) -> list[str]:
    if not names and not empty:
        raise SpecError("columns are missing")
    for n in names:
        _column(df, n)
    return list(names)


def literal(value: str, kind: T.DataType):
    """A literal typed by its column; text that doesn't fit a number raises."""
    if value is None:
        raise SpecError("a value is missing")
    if isinstance(kind, T.NumericType):
        try:
            number = float(value)
        except ValueError as e:
            raise SpecError(f"{value!r} is no number") from e
        return F.lit(int(value)) if re.fullmatch(r"[+-]?\d+", str(value)) else F.lit(number)
    return F.lit(str(value)).cast(kind)


def filter_rows(df, column, operator, value=None):
    c = _column(df, column)
    if operator in ("is_null", "is_not_null"):
        return df.filter(c.isNull() if operator == "is_null" else c.isNotNull())
    if value is None:
        raise SpecError(f"filter {operator} needs a value")
    if operator in ("contains", "starts_with"):
        return df.filter(c.cast("string").like(("%" if operator == "contains" else "") + str(value) + "%"))
    v = literal(value, df.schema[column].dataType)
    tests = {"eq": c == v, "ne": c != v, "gt": c > v, "lt": c < v, "gte": c >= v, "lte": c <= v}
    if operator not in tests:
        raise SpecError(f"no operator {operator!r}")
    return df.filter(tests[operator])


def select_columns(df, mode, columns):
    names = _columns(df, columns)
    if mode not in ("keep", "drop"):
        raise SpecError(f"no mode {mode!r}")
    return df.select(*names) if mode == "keep" else df.select(*[c for c in df.columns if c not in names])


def rename(df, **spec):
    old, new = spec["from"], spec["to"]
    c = _column(df, old)
    if not IDENTIFIER.fullmatch(new):
        raise SpecError(f"not a column name: {new!r}")
    return df.select(*[x for x in df.columns if x != old], c.alias(new))


def cast(df, column, data_type):
    if data_type not in CASTS:
        raise SpecError(f"no type {data_type!r}")
    return df.withColumn(column, _column(df, column).cast(CASTS[data_type]))


def trim(df, columns):
    return df.withColumns({c: F.trim(df[c]) for c in _columns(df, columns)})


def replace_text(df, column, find, replace):
    return df.withColumn(column, F.replace(_column(df, column), F.lit(find), F.lit(replace)))


def fill_nulls(df, column, strategy, value=None, fallback_column=None):
    c = _column(df, column)
    if strategy == "value":
        return df.withColumn(column, F.coalesce(c, literal(value, df.schema[column].dataType)))
    if strategy == "other_column":
        return df.withColumn(column, F.coalesce(c, _column(df, fallback_column)))
    if strategy == "column_average":
        mean = df.agg(F.avg(column).alias("__mean"))  # one row
        return df.crossJoin(F.broadcast(mean)).withColumn(column, F.coalesce(c.cast("double"), F.col("__mean"))).drop("__mean")
    raise SpecError(f"no strategy {strategy!r}")


def drop_nulls(df, columns):
    return df.dropna("any", subset=_columns(df, columns))


def dedupe(df, columns=(), order_by=None):
    """Distinct rows, or one row for each key; ``order_by`` chooses which, else any."""
    if not columns:
        return df.distinct()
    names = _columns(df, columns)
    if not order_by:
        return df.dropDuplicates(names)
    packed = F.struct(*[F.col(c) for c in [*order_by, *[c for c in df.columns if c not in order_by]]])
    return df.groupBy(*names).agg(F.min(packed).alias("__row")).select(*[F.col(f"__row.{c}").alias(c) for c in df.columns])


def change_case(df, column, mode):
    c = _column(df, column)
    modes = {"upper": F.upper, "lower": F.lower, "title": title_case}
    if mode not in modes:
        raise SpecError(f"no mode {mode!r}")
    return df.withColumn(column, modes[mode](c))


def computed_column(df, output, left, operator, right):
    a, b = _column(df, left), _column(df, right)
    whole = all(isinstance(df.schema[c].dataType, T.IntegralType) for c in (left, right))
    made = {
        "add": lambda: a + b, "subtract": lambda: a - b, "multiply": lambda: a * b,
        "divide": lambda: F.expr(f"`{left}` div `{right}`") if whole else a / b,
        "concat": lambda: F.concat(a.cast("string"), b.cast("string")),
    }
    if operator not in made:
        raise SpecError(f"no operator {operator!r}")
    return df.select(*[c for c in df.columns if c != output], made[operator]().alias(output))


def sort(df, column, direction="asc"):
    c = _column(df, column)
    return df.orderBy(c.asc_nulls_last() if direction == "asc" else c.desc_nulls_first())


def aggregate(df, group_by=(), aggregations=()):
    keys = _columns(df, group_by, empty=True)
    if not keys and not aggregations:
        raise SpecError("nothing to aggregate")
    if not aggregations:
        return df.select(*keys).distinct()
    made = {"sum": F.sum, "avg": F.avg, "count": F.count, "count_distinct": F.countDistinct, "min": F.min, "max": F.max}
    return df.groupBy(*keys).agg(*[made[a["function"]](_column(df, a["column"])).alias(a["output"]) for a in aggregations])


KINDS = {"filter": filter_rows, "select_columns": select_columns, "rename": rename, "cast": cast, "trim": trim, "replace_text": replace_text, "fill_nulls": fill_nulls, "drop_nulls": drop_nulls, "dedupe": dedupe, "change_case": change_case, "computed_column": computed_column, "sort": sort, "aggregate": aggregate}


def apply(df: DataFrame, block: dict) -> DataFrame:
    kind = block.get("kind")
    if kind not in KINDS:
        raise SpecError(f"no block {kind!r}")
    try:
        return KINDS[kind](df, **{k: v for k, v in block.items() if k not in ("kind", "name")})
    except (TypeError, KeyError) as e:
        raise SpecError(f"{kind}: {e}") from e


def chain(df: DataFrame, blocks: list[dict]) -> DataFrame:
    """Blocks one after the other; of the sorts only the last counts, and it comes at the end."""
    if not blocks:
        raise SpecError("no blocks")
    sorts = [b for b in blocks if b.get("kind") == "sort"]
    out = functools.reduce(apply, [b for b in blocks if b.get("kind") != "sort"], df)
    return apply(out, sorts[-1]) if sorts else out


def preview(df: DataFrame, blocks: list[dict], limit: int = 50) -> DataFrame:
    """Blocks over the first rows only, so averages and aggregates are of these."""
    return chain(df.limit(min(max(limit, 1), 500)), blocks)

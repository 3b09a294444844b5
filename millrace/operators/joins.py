"""Joins that equality alone doesn't make: the latest row before another in time, and intervals that overlap."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import SpecError


def asof(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str], order: list[str] | None = None, strict: bool = False, slices: int = 64) -> DataFrame:
    """``left`` with the ``values`` of the last row of ``right`` of the same keys that is not later (``strict``: that is earlier) in ``time``; null without one.

    Both sides have ``keys`` and ``time``.  Of rows of ``right`` at one time the one that is largest by ``order`` counts.  Rows of ``left`` come
    back once each, those with a null key or time without values; rows of ``right`` with a null key or time are never met.

    Both sides are put together and cut at ``slices`` - 1 quantiles of time.  In a slice the last row of ``right`` is carried along by a window; what a slice
    begins with is the last row of the slices before, of which a key has one each.  So a hot key is many tasks, unless its rows have one time.
    """
    if clash := {c for c in values if c in left.columns} | ({"__side", "__slice", "__right"} & {*left.columns, *right.columns}):
        raise SpecError(f"both sides have {sorted(clash)}")
    known, alone = right.dropna(subset=[*keys, time]), F.lit(False)
    for c in [*keys, time]:
        alone = alone | left[c].isNull()
    unmet, left = left.filter(alone), left.filter(~alone)
    micros = lambda df: df.select(_number(df, time).alias("t"))
    cuts = micros(left).unionByName(micros(known)).approxQuantile("t", [k / slices for k in range(1, slices)], 0.01) if slices > 1 else []
    cuts = sorted(set(cuts))
    at = lambda df: functools.reduce(lambda n, c: n + F.when(_number(df, time) > c, 1).otherwise(0), cuts, F.lit(0))
    ranked = [F.col(c) for c in order or []]
    rows = left.select(*keys, time, F.struct(*[left[c] for c in left.columns]).alias("__row"), F.lit(None).cast(_type(known, values)).alias("__right"), F.lit(0 if strict else 1).alias("__side"), at(left).alias("__slice"), F.lit(None).cast(_type(known, order or [])).alias("__order"))
    met = known.select(*keys, time, F.lit(None).cast(_type(left, left.columns)).alias("__row"), F.struct(*values).alias("__right"), F.lit(1 if strict else 0).alias("__side"), at(known).alias("__slice"), (F.struct(*ranked) if ranked else F.lit(None).cast(_type(known, []))).alias("__order"))
    both = rows.unionByName(met)
    along = Window.partitionBy(*keys, "__slice").orderBy(time, "__side", "__order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = both.withColumn("__met", F.last("__right", ignorenulls=True).over(along)).filter("__row IS NOT NULL").select(*keys, "__slice", "__row", "__met")
    # One row for each key and slice.
    ends = met.groupBy(*keys, "__slice").agg(F.max_by("__right", F.struct(time, "__order")).alias("__end"))
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    wanted = held.filter("__met IS NULL").select(*keys, "__slice").distinct().withColumn("__asked", F.lit(True))
    carried = wanted.join(ends, [*keys, "__slice"], "full").withColumn("__before", F.last("__end", ignorenulls=True).over(before)).filter("__asked")
    out = held.join(carried.select(*keys, "__slice", "__before"), [*keys, "__slice"], "left")
    found = F.coalesce("__met", "__before")
    out = out.select("__row.*", *[found[c].alias(c) for c in values])
    return out.unionByName(unmet.select("*", *[F.lit(None).cast(known.schema[c].dataType).alias(c) for c in values]))


def _type(df: DataFrame, columns: list[str]):
    return df.select(F.struct(*[df[c] for c in columns]).alias("x") if columns else F.struct(F.lit(0).alias("x")).alias("x")).schema["x"].dataType


def _number(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(df[c].cast("timestamp")).cast("double")
    return (F.unix_date(df[c]) if kind == "date" else df[c]).cast("double")


#: Bins that an interval's level has for its length, and rows of a bin that meet as many of the other side in a task.
FINE, BLOCK = 4, 4096
#: The shortest level, in powers of two of the median length; shorter intervals are in it.
SHORTEST = -8


def intervals(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str]) -> DataFrame:
    """Each pair of rows whose closed intervals overlap, once; ends are numbers, dates or times, and column names of the two sides differ.

    Of two intervals that overlap, one holds the other's start: the right one the left's, or the left one a start that is later than its own.  So starts
    are looked up in the other side's intervals, in bins of a quarter of an interval's level, the power of two of its length in units of the median
    length.  An interval lies in five bins at most, a start in one of each level, and most of what meets in a bin is a pair.  Crowded bins are dealt in
    blocks of about ``BLOCK`` rows, each pair of blocks to be met in any task.  Rows with a null or unordered end (start behind end) meet nothing.
    """
    if clash := {c for c in left.columns if c in right.columns}:
        raise SpecError(f"both sides have {sorted(clash)}")
    ends = lambda df, names: df.withColumns({f"__{x}": _number(df, c) for x, c in zip(("a", "b"), names, strict=True)}).filter("__a <= __b")
    sides = [ends(left, left_ends), ends(right, right_ends)]
    lengths = sides[0].selectExpr("__b - __a AS n").unionByName(sides[1].selectExpr("__b - __a AS n")).filter("n > 0")
    unit = (lengths.approxQuantile("n", [0.5], 0.05) or [1.0])[0]
    level = F.greatest(F.ceil(F.log2((F.col("__b") - F.col("__a")) / unit)), F.lit(SHORTEST)).cast("int")
    sides = [s.withColumn("__level", F.when(F.col("__b") > F.col("__a"), level).otherwise(SHORTEST)) for s in sides]
    columns = [*left.columns, *right.columns]
    return _held(sides[0], sides[1], unit, True).select(columns).unionByName(_held(sides[1], sides[0], unit, False).select(columns))


def _held(starts: DataFrame, held_by: DataFrame, unit: float, first: bool) -> DataFrame:
    """Rows of ``starts`` with those of ``held_by`` whose intervals hold their start; unless ``first``, not if both start together."""
    levels = sorted(r[0] for r in held_by.select("__level").distinct().collect())  # as many as lengths have binary orders of magnitude
    wide = lambda m: unit * 2.0**m / FINE
    bins = [F.struct(F.lit(m).alias("m"), F.floor(F.col("__a") / wide(m)).alias("bin")) for m in levels]
    kind = "array<struct<m:int,bin:bigint>>"
    points = starts.withColumn("__p", F.col("__a")).withColumn("__x", F.explode(F.array(*bins) if bins else F.array().cast(kind)))
    points = points.select(*_own(starts), "__p", F.col("__x.m").alias("__m"), F.col("__x.bin").alias("__bin"))
    width = F.lit(unit / FINE) * F.pow(F.lit(2.0), F.col("__level"))
    spans = held_by.select(*_own(held_by), "__a", "__b", F.col("__level").alias("__m"), F.explode(F.sequence(F.floor(F.col("__a") / width), F.floor(F.col("__b") / width))).alias("__bin"))
    place = ["__m", "__bin"]
    blocks = lambda df, name: df.groupBy(*place).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    sizes = blocks(points, "__i").join(blocks(spans, "__j"), place)

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in one block of its bin, once for each block of the other side's."""
        hashable = [F.col(c) for c, t in df.dtypes if "map<" not in t and "variant" not in t]
        met = df.join(sizes, place).withColumn(own, F.pmod(F.xxhash64(*hashable), F.col(own)).cast("int"))
        # By number, as a few rows may make many pairs: small partitions are not to be put together.
        return met.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).repartition(parts, *place, "__i", "__j")

    parts = int(starts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = dealt(points, "__i", "__j").join(dealt(spans, "__j", "__i"), [*place, "__i", "__j"])
    return pairs.filter("__a <= __p AND __p <= __b" if first else "__a < __p AND __p <= __b")


def _own(df: DataFrame) -> list[Column]:
    return [df[c] for c in df.columns if c not in ("__a", "__b", "__level")]

"""Change events: a column of opcodes, I, U or D, that travels with the rows."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

OPCODE = "__opcode"


def checked(df: DataFrame) -> DataFrame:
    """``df``; reading a null or unknown opcode raises."""
    good = F.coalesce(F.col(OPCODE).isin("I", "U", "D"), F.lit(False))
    return df.withColumn(OPCODE, F.when(good, F.col(OPCODE)).otherwise(F.raise_error(F.concat(F.lit("bad opcode: "), F.coalesce(F.col(OPCODE), F.lit("null"))))))


def split(df: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Upserts and deletes without the opcode; None if there is no opcode column."""
    if OPCODE not in df.columns:
        return None
    held = checked(df)
    return held.filter(F.col(OPCODE) != "D").drop(OPCODE), held.filter(F.col(OPCODE) == "D").drop(OPCODE)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key.  One struct for each key and task is shuffled, so hot keys are no problem."""
    rest = [c for c in df.columns if c not in order]
    found = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__row"))
    return found.select(*[F.col(f"__row.{c}").alias(c) for c in df.columns])


def without(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` whose key none of ``others`` has; nulls in keys are equal to each other."""
    known = others.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = functools.reduce(lambda a, b: a & b, [rows[k].eqNullSafe(known[f"__{k}"]) for k in keys])
    return rows.join(known, same, "left_anti")


def merge(existing: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows whose key doesn't change, then the upserts; a null key is a key like any other.

    Deletes apply after upserts: a key that ``changes`` both upsert and delete is gone.  Columns are matched by name; those that one side
    lacks are null there.
    """
    parts = split(changes)
    if not parts:
        return without(existing, changes, keys).unionByName(changes, allowMissingColumns=True)
    upserts, deletes = parts
    touched = upserts.select(*keys).unionByName(deletes.select(*keys))
    return without(existing, touched, keys).unionByName(without(upserts, deletes, keys), allowMissingColumns=True)


def insert_if_absent(existing: DataFrame, rows: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Existing rows and the new ones whose key isn't there yet, the last of each key."""
    new = latest(rows, keys, order) if order else rows.dropDuplicates(keys)
    return existing.unionByName(without(new, existing, keys))


def from_change_feed(df: DataFrame, kind: str = "_change_type") -> DataFrame:
    """A change feed's kinds as opcodes, those of tables, of documents (replace) and of first copies (read, snapshot); rows before an update are left out, and reading an unknown kind raises.

    The feed's other columns stay, so that ``latest`` can settle the order by its version.
    """
    code = F.when(F.col(kind).isin("insert", "read", "snapshot"), "I").when(F.col(kind).isin("update_postimage", "update", "replace", "upsert"), "U").when(F.col(kind) == "delete", "D")
    code = code.otherwise(F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce(F.col(kind), F.lit("null")))))
    return df.filter(~F.col(kind).eqNullSafe(F.lit("update_preimage"))).withColumn(OPCODE, code).drop(kind)


def coerced(df: DataFrame, types: dict[str, str]) -> tuple[DataFrame, Observation]:
    """Text columns of change events as the target's types, and what couldn't be read: null, counted by column when the result is used.

    ``types``: bigint, int, double, boolean, date, timestamp, decimal and so on, or string.  Booleans are written true, false, t, f, in any case.  A
    column that the events lack is null in all rows.  The observation has ``<column>`` for each column that isn't text.
    """
    seen, out, lost = Observation(), {}, []
    for c, kind in types.items():
        if c not in df.columns:
            out[c] = F.lit(None).cast(kind)
            continue
        text = F.trim(F.col(c).cast("string"))
        if kind == "string":
            out[c] = F.col(c).cast("string")
            continue
        if kind == "boolean":
            out[c] = F.when(F.lower(text).isin("t", "true"), True).when(F.lower(text).isin("f", "false"), False)
        else:
            out[c] = text.try_cast(kind)
        lost.append((c, F.col(c).isNotNull() & out[c].isNull()))
    marked = df.withColumns({f"__lost_{c}": bad for c, bad in lost}).withColumns(out)
    if lost:
        marked = marked.observe(seen, *[F.sum(F.col(f"__lost_{c}").cast("long")).alias(c) for c, _ in lost])
    return marked.drop(*[f"__lost_{c}" for c, _ in lost]), seen


def ordered_changes(changes: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Changes with their number within the key."""
    return changes.withColumn("change", F.row_number().over(Window.partitionBy(*keys).orderBy(position)))


def _renamed(fs, old, new) -> None:
    if not fs.rename(old, new):
        raise OSError(f"{old} can't be renamed to {new}")


def read_named(spark, path: str, like, **options) -> DataFrame:
    """CSV files with a header as ``merge`` needs them: columns by the header's names, typed as those of ``like`` where it has them and as text where it doesn't."""
    held = spark.read.options(**(options | {"header": True, "multiLine": True})).csv(path)
    types = {f.name: f.dataType for f in like}
    return held.select(*[held[c].cast(types[c]).alias(c) if c in types else held[c] for c in held.columns])


def merge_files(path: str, changes: DataFrame, keys: list[str], kind: str = "parquet", **options) -> None:
    """Merges into a folder of files: writes a sibling folder, then swaps the names.  All files are rewritten; ``keyed.merge`` rewrites few.

    CSV files are read by their header.  A rename that fails raises and leaves the table as it was, under its name; the old files go last.
    """
    spark = changes.sparkSession
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = split(changes)
    if not fs.exists(at):
        (parts[0] if parts else changes).write.options(**options).format(kind).save(path)
        return
    new, old = (jvm.org.apache.hadoop.fs.Path(f"{path}-{x}-{uuid.uuid4().hex}") for x in ("new", "old"))
    like = (parts[0] if parts else changes).schema
    existing = read_named(spark, path, like, **options) if kind == "csv" else spark.read.options(**options).format(kind).load(path)
    merge(existing, changes, keys).write.options(**options).format(kind).save(new.toString())
    _renamed(fs, at, old)
    try:
        _renamed(fs, new, at)
    except Exception:
        _renamed(fs, old, at)
        raise
    fs.delete(old, True)

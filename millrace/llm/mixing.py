"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same fractional number of copies, target / size of the source.  Whole copies are
certain.  Fractions are settled in pairs: mass moves at random from one document to the other, weighed by their
sizes so that the words taken don't change, until one of them is integral.  Cells of a source settle their documents side by
side and leave one open; the open ones meet in larger cells, level by level, up to one for the source.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, ranked, table, written

WEIGHTS = (1, 2, 3)
MOST = 3  # copies
CELL = 4096  # documents that settle together
FAN = 64  # cells that meet in one of the next level
COINS = 32  # documents of various sizes that a source keeps for its last words


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, documents, rank, target: shares by weight, none above ``most`` times the source's size.

    Sources rank by code point, null last, and weigh ``weights``, repeating.  What is above goes to the others by weight,
    again and again; each round is one aggregate over the table of sources.
    """
    found = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    found = ranked(found, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    found = found.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(most))
    share, capped = 0.0, -1
    while True:
        full = F.col("most") < F.lit(share) * F.col("weight")
        x = found.agg(F.sum("source_size"), F.sum(F.when(full, F.col("most"))), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.count(F.when(full, 1))).first()
        total, held, open_weight, now = x[0] or 0, x[1] or 0.0, x[2] or 0.0, x[3]
        if now == capped or not open_weight:
            break
        share, capped = (total - held) / open_weight, now
    return found.withColumn("target", F.least("most", F.lit(share) * F.col("weight"))).drop("weight", "most")


def settle(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> int:
    """Moves mass between fractions ``p`` in place until one open document is left at most; its place, or -1.

    size * p keeps its sum, and each p its expectation.
    """
    draws, at = rng.random(len(p)).tolist(), -1
    ps, ss = p.tolist(), size.tolist()
    for j in range(len(ps)):
        if not 0.0 < ps[j] < 1.0:
            continue
        if at < 0:
            at = j
            continue
        i = at
        r = ss[i] / ss[j]
        up, down = min(1 - ps[i], ps[j] / r), min(ps[i], (1 - ps[j]) / r)
        if draws[j] * (up + down) < down:
            a, b = ps[i] + up, ps[j] - up * r
        else:
            a, b = ps[i] - down, ps[j] + down * r
        ps[i], ps[j] = (x if 1e-9 < x < 1 - 1e-9 else float(round(x)) for x in (a, b))
        at = j if 0.0 < ps[j] < 1.0 else i if 0.0 < ps[i] < 1.0 else -1
    p[:] = ps
    return at


def close(size: np.ndarray, p: np.ndarray) -> None:
    """Rounds what is open in place, largest first, each so that the words taken stay nearest to what was due."""
    due = 0.0
    for i in np.argsort(-size, kind="stable").tolist():
        if 0.0 < p[i] < 1.0:
            up, down = due + (1 - p[i]) * size[i], due - p[i] * size[i]
            p[i], due = (1.0, up) if abs(up) < abs(down) else (0.0, down)


def numbered(docs: DataFrame, key: str = "doc_id", extra: list[str] = ()) -> DataFrame:
    """key, source, size, __h and __n: rows numbered in the order of a hash, equal ones one after the other, so that numbers deal any rows evenly."""
    sizes = docs.select(key, "source", words(F.col("text")).alias("size"), F.xxhash64(key, "text").alias("__h"), *extra)
    sizes = written(sizes.withColumn("__i", F.monotonically_increasing_id()), "sizes")
    return ranked(sizes, F.col("source"), F.col("__h"), F.col("__i"), name="__n").drop("__i")


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = 0, key: str = "doc_id", carry: list[str] = ()) -> DataFrame:
    """Copies of documents: key, size, source_size, target, taken, copies and the columns in ``carry``; others are left out.

    docs: key, source, text.  size counts words; a null or empty text has none and is never taken, and a source without words takes nothing.
    Draws follow from the seed and the rows alone, so reruns agree; repeated rows are documents of their own, dealt to all cells like others, and
    which of equal ones is taken makes no difference.  A null source is a source.  Texts of any length are counted as a whole; no documents give no rows.
    """
    extra = list(carry)
    sizes = numbered(docs, key, extra)
    due = targets(sizes, weights, most)
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # Division leaves a few units of the last place beyond a whole number of copies.
    each = F.when(F.abs(each - F.round(each)) < 1e-9, F.round(each)).otherwise(each)
    rows = (
        sizes.withColumnRenamed("source", "__source").join(due, F.col("__source").eqNullSafe(F.col("source")))
        .select(key, "size", "source_size", "target", "__h", *extra, "rank", F.floor(each).alias("copies"), F.when(F.col("size") > 0, each - F.floor(each)).otherwise(0.0).alias("p"),
                F.pmod("__n", F.ceil(F.col("documents") / CELL)).cast("long").alias("cell"))
    )
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in rows.columns) + ", coin boolean"

    def settled(level: int, last: bool):
        def of(pdf):
            pdf = pdf.sort_values(["size", "__h"], ascending=[False, True], ignore_index=True)
            size, p = pdf["size"].to_numpy(np.float64), pdf["p"].to_numpy(np.float64).copy()
            coin = pdf["coin"].to_numpy(bool).copy() if "coin" in pdf else np.zeros(len(pdf), bool)
            if not level and pdf["cell"].iat[0] == 0:
                fit = np.flatnonzero((p > 0) & (size > 0))
                coin[fit[1::2] if len(fit) <= 2 * COINS else fit[np.linspace(1, len(fit) - 1, COINS).astype(int)]] = True
            mine = np.flatnonzero(~coin)
            part = p[mine]
            settle(size[mine], part, np.random.default_rng([seed, level, int(pdf["rank"].iat[0]), int(pdf["cell"].iat[0])]))
            p[mine] = part
            if last:
                close(size, p)
            return pdf.assign(p=p, coin=coin)

        return of

    cells = due.agg(F.max(F.ceil(F.col("documents") / CELL))).first()[0] or 1
    done, level = [], 0
    while True:
        out = written(rows.groupBy("rank", "cell").applyInPandas(settled(level, cells <= 1), schema), f"level{level}")
        is_open = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(out.filter(~is_open))
        if cells <= 1:
            break
        rows = out.filter(is_open).withColumn("cell", F.floor(F.col("cell") / FAN))
        cells, level = -(-cells // FAN), level + 1
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    copies = F.col("copies") + F.col("p").cast("long")
    return rows.select(key, "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), *extra)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, each as often as the mix takes it; null and empty texts are never taken."""
    held = written(docs.withColumn("__row", F.monotonically_increasing_id()), "docs")
    taken = mix(held, carry=["__row"]).select("__row", "copies").filter("copies > 0")
    return held.join(taken, "__row").withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)

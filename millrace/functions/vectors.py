"""Distances between array columns and the nearest rows to a query."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def cosine(a: Column, b: Column) -> Column:
    """Similarity; 0 if either vector has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def nearest(df: DataFrame, vector: str, query: list[float], k: int = 5, metric: str = "l2", tie: str | None = None) -> DataFrame:
    """The ``k`` rows nearest to ``query`` with their ``distance``; each task keeps ``k`` rows."""
    q = F.array(*[F.lit(float(x)) for x in query])
    distance = {"l2": l2, "cosine": lambda a, b: 1 - cosine(a, b), "dot": lambda a, b: -dot(a, b)}[metric](F.col(vector), q)
    order = [F.col("distance")] + ([F.col(tie)] if tie else [])
    return df.withColumn("distance", distance).orderBy(*order).limit(k)


METRICS = ("l2", "cosine")


def _matrix(lists: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = lists.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def _near(q: np.ndarray, x: np.ndarray, size: np.ndarray, k: int, metric: str) -> list[np.ndarray]:
    """For each of ``q`` the numbers of rows of ``x`` that may be among its ``k`` nearest: by a matrix product, and all within its rounding of the k-th."""
    everything = np.arange(len(x))
    if len(x) <= k:
        return [everything] * len(q)
    lengths = np.sqrt((q * q).sum(axis=1))
    with np.errstate(all="ignore"):
        d, slack = q @ x.T, np.full(len(q), 1e-10)
        if metric == "l2":
            d *= -2
            d += size * size
            d += (lengths * lengths)[:, None]
            slack = 1e-11 * (lengths + size.max()) ** 2
        else:
            both = lengths[:, None] * size
            d = np.maximum(1 - np.where(both == 0, 0.0, d / np.where(both == 0, 1.0, both)), 0.0)
        bound = np.partition(d, k - 1, axis=1)[:, k - 1] + slack
        sure = np.isfinite(d).all(axis=1) & np.isfinite(bound)
    return [np.flatnonzero(row <= b) if ok else everything for row, b, ok in zip(d, bound, sure, strict=True)]


def _best(q_ids, q, ids, x, k: int, metric: str, key: str) -> pa.RecordBatch:
    """The ``k`` rows of ``x`` nearest to each of ``q``, ties by id."""
    size, found = np.sqrt((x * x).sum(axis=1)), ([], [], [])
    for i, v, some in zip(q_ids, q, _near(q, x, size, k, metric), strict=True):
        part = x[some]
        if metric == "l2":
            d = np.sqrt(((part - v) ** 2).sum(axis=1))
        else:
            both = size[some] * np.sqrt((v * v).sum())
            d = np.maximum(1 - np.where(both == 0, 0.0, (part * v).sum(axis=1) / np.where(both == 0, 1.0, both)), 0.0)
        near = np.arange(len(d)) if len(d) <= k else np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
        best = near[np.lexsort((ids[some[near]], d[near]))[:k]]
        for column, part in zip(found, (np.full(len(best), i), ids[some[best]], d[best]), strict=True):
            column.append(part)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, t)) for c, t in zip(found, (np.int64, np.int64, np.float64), strict=True)], names=["query", key, "distance"])


def _scored(pairs: DataFrame, key: str, k: int, metric: str) -> DataFrame:
    """query, key, distance: the ``k`` best of each query over rows q, r, blocks of (id, v)."""
    if metric not in METRICS:
        raise ValueError(f"no metric {metric!r}")

    def score(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                (qi, q), (ri, r) = (((e := batch.column(c).slice(i, 1).flatten()).field("id").to_numpy(zero_copy_only=False), _matrix(e.field("v"))) for c in (0, 1))
                yield _best(qi, q, ri, r, k, metric, key)

    near = pairs.select("q", "r").repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(score, f"query long, `{key}` long, distance double")
    order = Window.partitionBy("query").orderBy("distance", key)
    return near.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= k).drop("__n")


def _rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL")


def nearest_to_each(df: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5, metric: str = "l2", block: int = 1024) -> DataFrame:
    """query, key, distance: for each row of ``queries`` the ``k`` nearest rows of ``df`` by l2 or cosine, ties by the whole-number key.

    Vectors have one length; rows without one are left out.  Rows are dealt to blocks of about ``block`` by id and vector, and each
    block of rows meets each block of queries, which is a task's work and keeps ``k`` rows for each query; these are merged by query.
    """
    def blocks(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
        rows = _rows(rows, key, vector)
        n = max(1, -(-rows.count() // block))
        return rows.groupBy(F.pmod(F.xxhash64("id", "v"), F.lit(n)).alias("b")).agg(F.collect_list(F.struct("id", "v")).alias(name)), n

    q, n = blocks(queries, "q")
    r, _ = blocks(df, "r")
    # Blocks of queries are numbered, so that rows meet each of them by an equal key.
    return _scored(r.select("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("b")).join(q, "b"), key, k, metric)


def centroids(df: DataFrame, vector: str, lists: int, sample: int = 20_000, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """``lists`` centres (fewer if there are fewer vectors) of at most ``sample`` vectors, those with the smallest hash, by k-means in the driver."""
    held = df.select(F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL").orderBy(F.xxhash64("v")).limit(sample).toArrow()
    x = _matrix(held.column("v").combine_chunks())
    x = np.unique(x, axis=0) if len(x) else x
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:lists]]
    for _ in range(rounds if len(x) else 0):
        near = _closest(x, c, 1)[:, 0]
        total, n = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), len(c))])
    return c


def _closest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the ``k`` centres nearest to each row, by l2, nearest first."""
    out = np.empty((len(x), k), np.int64)
    square = (c * c).sum(axis=1)
    for at in range(0, len(x), 1024):
        d = square - 2 * x[at : at + 1024] @ c.T
        out[at : at + 1024] = np.argmin(d, axis=1)[:, None] if k == 1 else np.argsort(d, axis=1, kind="stable")[:, :k]
    return out


class InvertedLists:
    """An index for approximate nearest rows: every vector is in the list of its nearest centre, and a search reads the lists whose centres are nearest to the query.

    Centres come from a bounded sample (``centroids``), lists from all rows, written as a table partitioned by list.  ``probes`` is what reaches ``recall`` at ``k``
    against the exact search for a bounded sample of rows as queries; with all lists probed the search is exact, so the recall is always reached.  For cosine,
    vectors are scaled to length one first.
    """

    def __init__(self, df: DataFrame, key: str, vector: str, path: str, metric: str = "l2", lists: int | None = None, k: int = 10, recall: float = 0.95, tested: int = 64):
        if metric not in METRICS:
            raise ValueError(f"no metric {metric!r}")
        self.key, self.metric, self.spark = key, metric, df.sparkSession
        rows = self._scaled(_rows(df, key, vector))
        n = rows.count()
        self.centres = centroids(rows, "v", lists or max(1, min(4096, int(np.sqrt(n)))))
        self._listed(rows, 1).select("id", "v", F.col("lists")[0].alias("list")).write.partitionBy("list").parquet(path)
        self.table = self.spark.read.schema("id long, v array<double>, list long").parquet(path)
        self.probes, self.measured = self._calibrated(rows, k, recall, tested)

    def _scaled(self, rows: DataFrame) -> DataFrame:
        if self.metric != "cosine":
            return rows
        size = F.sqrt(dot(F.col("v"), F.col("v")))
        return rows.withColumn("v", F.when(size == 0, F.col("v")).otherwise(F.transform("v", lambda x: x / size)))

    def _listed(self, rows: DataFrame, probes: int) -> DataFrame:
        """``rows`` (id, v) with the numbers of their nearest ``probes`` lists."""
        centres = self.centres

        def assign(batches):
            for batch in batches:
                near = _closest(_matrix(batch.column(1)), centres, probes) if batch.num_rows else np.zeros((0, probes), np.int64)
                yield batch.append_column("lists", pa.FixedSizeListArray.from_arrays(pa.array(near.ravel()), probes).cast(pa.list_(pa.int64())))

        return rows.mapInArrow(assign, "id long, v array<double>, lists array<long>")

    def search(self, queries: DataFrame, vector: str, k: int = 10, probes: int | None = None, block: int = 4096) -> DataFrame:
        """query, key, distance: ``k`` near rows for each of ``queries``.  Queries and rows meet by list, in blocks of about ``block`` rows; a large list is many blocks."""
        probes = max(1, min(probes or self.probes, len(self.centres)))
        if not len(self.centres):
            return self.spark.createDataFrame([], f"query long, `{self.key}` long, distance double")
        asked = self._listed(self._scaled(_rows(queries, self.key, vector)), probes).select("id", "v", F.explode("lists").alias("list"))
        sizes = self.table.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        dealt = self.table.join(sizes, "list").groupBy("list", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).alias("b")).agg(F.collect_list(F.struct("id", "v")).alias("r"))
        counts = asked.groupBy("list").agg(F.ceil(F.count("*") / 256).cast("int").alias("blocks"))
        asked = asked.join(counts, "list").groupBy("list", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).alias("c")).agg(F.collect_list(F.struct("id", "v")).alias("q"))
        return _scored(dealt.join(asked, "list"), self.key, k, self.metric)

    def _calibrated(self, rows: DataFrame, k: int, recall: float, tested: int) -> tuple[int, float]:
        some = rows.orderBy(F.xxhash64("id")).limit(tested).withColumnRenamed("id", self.key).persist()
        try:
            exact = {(r["query"], r[self.key]) for r in nearest_to_each(rows.withColumnRenamed("id", self.key), some, self.key, "v", k, self.metric).collect()}
            probes = max(1, len(self.centres) // 16)
            while True:
                found = {(r["query"], r[self.key]) for r in self.search(some, "v", k, probes).collect()}
                share = len(found & exact) / max(1, len(exact))
                if share >= recall or probes >= len(self.centres):
                    return probes, share
                probes = min(2 * probes, len(self.centres))
        finally:
            some.unpersist()

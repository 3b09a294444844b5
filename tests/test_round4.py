"""Work that grows with the tables: spread over tasks, bounded in memory, the same rows as a plain version gives."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import vectors
from millrace.operators import joins, keyed, textstages
from millrace.streaming import streams, totals


def test_crowded_intervals(spark, monkeypatch):
    """Intervals that all overlap: each pair once, and no task has more than half of them."""
    monkeypatch.setattr(joins, "BLOCK", 256, raising=False)
    a = spark.range(2000).selectExpr("id AS i", "CAST(id % 7 AS double) AS a", "CAST(id % 7 + 100 AS double) AS b")
    b = spark.range(1000).selectExpr("id AS j", "CAST(id % 3 AS double) AS c", "CAST(id % 3 + 9 AS double) AS d")
    pairs = joins.intervals(a, b, ("a", "b"), ("c", "d"))
    assert pairs.distinct().count() == 2_000_000
    by_task = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(by_task) == 2_000_000 and max(by_task) < 1_000_000


def test_hashed_words_once():
    """Vectors are those of a loop over all words."""
    import hashlib

    texts = ["a b a", "", None, "Tea tea MILK", " ".join(f"w{k % 97}" for k in range(5000))]
    for dimension in (1, 16):
        want = np.zeros((len(texts), dimension), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                want[i, h % dimension] += 1 if h >> 63 else -1
            if n := float(np.sqrt((want[i] ** 2).sum())):
                want[i] /= n
        assert np.array_equal(textstages.hash_embed(texts, dimension), want)
    assert textstages.hash_embed([], 4).shape == (0, 4)


def test_embedding_in_slices(spark):
    """An embedder gets a bounded amount of text at once, or one longer text; vectors stay beside their texts."""

    def embedder(texts, dimension):
        assert len(texts) == 1 or sum(map(len, texts)) <= 1_000_000
        return [[float(len(t))] * dimension for t in texts]

    df = spark.range(0, 60, 1, 1).selectExpr("id", "repeat('x', CAST(CASE WHEN id = 7 THEN 1500000 ELSE id * 2000 END AS int)) AS t")
    found = {r.id: r.v for r in textstages.embed(df, "t", "v", 2, embedder).select("id", "v").collect()}
    assert found == {i: [1_500_000.0 if i == 7 else i * 2000.0] * 2 for i in range(1, 60)}


def test_semantic_chunks_without_shuffles(spark):
    df = spark.createDataFrame([(k, "One two. One two. Three." if k % 3 else None) for k in range(50)], "id long, t string")
    chunks = textstages.semantic_chunks(df, "t", 8, 0.5)
    assert "Exchange" not in chunks._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in chunks.collect()) == sorted((k, *c) for k in range(50) if k % 3 for c in (("One two. One two.", 0), ("Three.", 1)))


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_near_rows(metric):
    """Few rows of a block get their exact distance, and the nearest of them are the nearest of all, ties by id."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(1000, 16)), np.zeros((3, 16))])
    x = np.concatenate([x, x[:200], 1e-3 * x[:50]])
    ids, q, k = rng.permutation(len(x)), x[::40], 10
    size = np.sqrt((x * x).sum(axis=1))
    assert all(len(some) < 100 for v, some in zip(q, vectors._near(q, x, size, k, metric), strict=True) if v.any() or metric == "l2")
    found = vectors._best(np.arange(len(q)), q, ids, x, k, metric, "id").to_pandas()
    for i, v in enumerate(q):
        both = size * np.sqrt((v * v).sum())
        d = np.sqrt(((x - v) ** 2).sum(axis=1)) if metric == "l2" else np.maximum(1 - np.where(both == 0, 0.0, (x * v).sum(axis=1) / np.where(both == 0, 1.0, both)), 0.0)
        best = np.lexsort((ids, d))[:k]
        mine = found[found["query"] == i]
        assert mine["id"].tolist() == ids[best].tolist() and mine["distance"].tolist() == d[best].tolist()
    x[5, 0] = np.nan
    assert len(vectors._best(np.arange(1), q[:1], ids, x, k, metric, "id").to_pandas()) == k


def test_totals_without_expiry(spark, tmp_path):
    """Spark's own aggregate keeps them over a restart; null keys, values and times."""
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "t", "c"))
    like = spark.createDataFrame([], "k string, v double, ts timestamp")
    like.write.parquet(source)
    read = streams.files(spark, source, like)
    assert "TransformWithState" not in totals.running(read, ["k"], ["v"], "ts")._jdf.queryExecution().logical().toString()

    def step(*rows):
        made = spark.createDataFrame([(k, v, at and f"2024-01-01 {at}") for k, v, at in rows], "k string, v double, ts string").withColumn("ts", F.to_timestamp("ts"))
        made.coalesce(1).write.mode("append").parquet(source)
        totals.keep(streams.files(spark, source, like), target, ["k"], checkpoint, values=["v"], ts="ts").awaitTermination()
        return {r.k: (r.n, r.sum_v, r.last and r.last.strftime("%H:%M")) for r in keyed.read(spark, target).collect()}

    assert step(("a", 1.5, "00:10:00"), ("a", None, "00:00:00"), (None, 2.0, "00:05:00"), ("b", None, None)) == {"a": (2, 1.5, "00:10"), None: (1, 2.0, "00:05"), "b": (1, None, None)}
    assert step(("a", 2.0, "00:01:00")) == {"a": (3, 3.5, "00:10"), None: (1, 2.0, "00:05"), "b": (1, None, None)}

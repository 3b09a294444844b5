"""What the findings of round 3 asked for: passages that op2 counts, training text of op10."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import by_row, docs, texts  # noqa: F401

from millrace.llm import attention, lm_scoring, suffix_dedup, tokens


@pytest.mark.parametrize("words,word_kmer", [(51, 16), (12, 4)])
def test_counted_passages(docs, words, word_kmer):  # noqa: F811
    """Passages are counted as brute force finds them; what is removed is the same with and without."""
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    spans = [(k, [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)]) for k, (_, t) in enumerate(rows)]
    seen: dict = {}
    for k, at in spans:
        w = [rows[k][1][a:b] for a, b in at]
        for i in range(len(w) - words + 1):
            seen.setdefault(tuple(w[i : i + words]), []).append((k, at[i][0], at[i + words - 1][1]))
    gone = [np.zeros(len(t), bool) for _, t in rows]
    for found in seen.values():
        for k, lo, hi in found if len(found) > 1 else []:
            gone[k][lo:hi] = True
    want = [(i, int((np.diff(g.astype(int), prepend=0) == 1).sum()), int(g.sum())) for (i, _), g in zip(rows, gone, strict=True)]
    assert any(n for _, n, _ in want)
    found = suffix_dedup.repeats(docs, words=words, word_kmer=word_kmer, passages=True).persist()
    assert by_row(found, "doc_id", "n_passages", "n_passage_bytes") == sorted(want, key=repr)
    fixed = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert by_row(found, *fixed) == by_row(suffix_dedup.repeats(docs), *fixed)


def test_short_passages_are_counted(spark):
    """Two texts share 51 words of under 400 bytes: nothing is removed by the contract, the passage is counted."""
    rng = np.random.default_rng(5)
    some = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))
    shared = some(51)
    rows = [("a", f"{some(30)} {shared} {some(30)}"), ("b", f"{some(40)} {shared}"), ("c", some(120))]
    found = suffix_dedup.repeats(spark.createDataFrame(rows, "doc_id string, text string"), words=suffix_dedup.WORDS, passages=True)
    assert by_row(found, "doc_id", "n_removed", "n_passages", "n_passage_bytes") == [("a", 0, 1, len(shared)), ("b", 0, 1, len(shared)), ("c", 0, 0, 0)]


def test_contexts_go_out_in_parts(docs, monkeypatch):  # noqa: F811
    """However little a task holds of a batch's contexts, the rows are the same."""
    fixed = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = by_row(suffix_dedup.repeats(docs, window=60, kmer=15), *fixed)
    monkeypatch.setattr(suffix_dedup, "HELD", 0)
    assert by_row(suffix_dedup.repeats(docs, window=60, kmer=15), *fixed) == want


def test_all_training_text_is_learnt(spark, monkeypatch):
    """Each training text gives its windows once, and more often only where the texts are few."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join("".join(rng.choice(list("abcdefg"), 4)) for _ in range(int(n)))) for i, n in enumerate(rng.integers(0, 300, 300))]
    parts = lm_scoring.encoded(spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.col("text").cast("binary"), F.lit(False)), tokens.default_path(), "doc_id").persist()
    ids = [np.array(r.ids) for r in parts.collect()]
    encode = tokens.encoder(tokens.default_path())
    assert sorted(map(tuple, ids)) == sorted(map(tuple, encode([t for _, t in rows])))
    counts = np.bincount(np.concatenate(ids).astype(int), minlength=encode.size) + 0.1
    windows = len(attention.windows(np.array([len(x) + 1 for x in ids]))[0])
    for few, times in ((0, 1), (10**9, lm_scoring.ROUNDS)):
        monkeypatch.setattr(lm_scoring, "LEARNT", few)
        assert lm_scoring.fit(parts.select("ids"), 3, counts, counts, sum(len(t) for _, t in rows))["learnt"] == times * windows


def test_gradient():
    """Against differences of the loss."""
    rng, m = np.random.default_rng(2), {n: w.astype(np.float64) for n, w in attention.start(24).items()}
    x, y, weight = rng.integers(0, 2 * attention.INPUTS, (3, attention.T)), rng.integers(0, 24, (3, attention.T)), (rng.random((3, attention.T)) < 0.8).astype(np.float32)
    x[:, 5:9] = 7  # an input that stands often
    out = {n: np.empty_like(w) for n, w in attention.start(24).items()}
    attention.gradient({n: w.astype(np.float32) for n, w in m.items()}, x, y, weight, out)
    loss = lambda: -(attention.log_softmax_at(attention.forward(m, x)["logits"], y)[0] * weight).sum() / weight.sum()
    for n, w in m.items():
        at = (7, 3) if n == "E" else tuple(k // 2 for k in w.shape)
        old, e = w[at], 1e-4
        w[at] = old + e
        up = loss()
        w[at] = old - e
        down, w[at] = loss(), old
        assert abs((up - down) / (2 * e) - out[n][at]) < 1e-4 + 0.01 * abs(out[n][at]), n


def test_gradient_in_blocks():
    """However many windows go together, the gradient is the same; exponents beyond bounds give no infinities."""
    rng, m = np.random.default_rng(4), attention.start(24)
    x, y, weight = rng.integers(0, 2 * attention.INPUTS, (70, attention.T)), rng.integers(0, 24, (70, attention.T)), (rng.random((70, attention.T)) < 0.8).astype(np.float32)
    found = []
    for together in (70, 32, 3):
        out = {n: np.empty_like(w) for n, w in m.items()}
        attention.gradient(m, x, y, weight, out, together)
        found.append(out)
    assert all(np.allclose(a[n], found[0][n], rtol=1e-3, atol=1e-6) for a in found[1:] for n in m)
    attention.gradient({n: w * 100 for n, w in m.items()}, x, y, weight, out)
    assert all(np.isfinite(w).all() for w in out.values())


def test_packed_ids(spark):
    """Ids packed into bytes are those of the array, and so are the runs that tasks make of them."""
    rows = [(0, "One two"), (1, ""), (2, "é 日本 <|endoftext|> x"), (3, "a" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.col("text").cast("binary"), F.lit(False))
    plain, packed = (lm_scoring.encoded(docs, tokens.default_path(), "doc_id", packed=p).orderBy("doc_id").select("ids") for p in (False, True))
    assert [np.frombuffer(r.ids, lm_scoring.PACKED).tolist() for r in packed.collect()] == [r.ids for r in plain.collect()]
    assert tokens.encoder(tokens.default_path()).size <= lm_scoring.END
    runs = [[r.tolist() for b in df.toArrow().to_batches() for r in lm_scoring.runs_of(b)] for df in (plain, packed)]
    assert runs[0] == runs[1] and sum(map(len, runs[0])) > 4

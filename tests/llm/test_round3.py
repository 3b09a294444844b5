"""Winnowing, the conversation trie and spelling variants against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from millrace.llm import conversation_trie as trie
from millrace.llm import jaccard_join, mixing, spelling, token_output, tokens, url_filter, winnowing

LICENCE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# Winnowing.
def plain_hits(docs, items):
    found = defaultdict(set)
    for item, text in items:
        w = re.findall(LICENCE_WORD, lowered(text))
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            found[tuple(w[i : i + n])].add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w = re.findall(LICENCE_WORD, lowered(text))
        hit, ids = set(), set()
        for n in {len(k) for k in found}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in found:
                    hit.update(range(i, i + n))
                    ids |= found[tuple(w[i : i + n])]
        spans = []
        for i in sorted(hit):
            if spans and spans[-1][1] == i:
                spans[-1][1] = i + 1
            else:
                spans.append([i, i + 1])
        out.append((doc, len(w), len(hit), len(ids), sorted(ids), [tuple(s) for s in spans], bool(hit)))
    return sorted(out, key=repr)


def hits(spark, docs, items, **names):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    rows = winnowing.decontaminate(d, i, **names).select("doc_id", "n_words", "n_hit", "n_items", "item_ids", "spans", "contaminated").collect()
    return sorted([(*r[:4], list(r.item_ids), [tuple(s) for s in r.spans], r.contaminated) for r in rows], key=repr)


def contaminated_texts(seed):
    rng = random.Random(seed)
    words = ["Alpha", "bETA", "ça", "Éa", "éa", "x1", "delta", "eta"]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(k, " ".join(some(rng.randint(8, 30)))) for k in range(12)] + [(3, "one more row of item three with words enough for two whole windows"), (None, " ".join(some(14))), (20, None), (21, ""), (22, "?!"), (23, "Rare pair"), (24, "lone")]
    docs = []
    for k in range(40):
        w = some(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            source = rng.choice([t for _, t in items if t]).split()
            a = rng.randint(0, len(source))
            w += source[a : a + rng.randint(1, 25)] + some(rng.randint(0, 4))
        docs.append((rng.choice([k, k, None]), rng.choice([" ", ", ", "\n"]).join(w)))
    docs += [(7, None), (8, ""), (9, "..."), docs[3], docs[3], (50, "the LONE word"), (51, "rare pair rare pair"), (52, "É" * 40)]
    return docs, items


@pytest.mark.parametrize("sent", [10**6, 0])
def test_winnowing(spark, sent, monkeypatch):
    """Against windows compared one by one, with fingerprints sent to all tasks and with both sides shuffled."""
    monkeypatch.setattr(winnowing, "SENT", sent)
    docs, items = contaminated_texts(sent)
    found = hits(spark, docs, items)
    assert found == plain_hits(docs, items)
    assert sum(r[2] > 0 for r in found) > 5


def test_winnowing_guarantee(spark):
    """Any ten words that two texts share have a fingerprint in common, wherever they stand; far fewer are kept than there are words."""
    rng = random.Random(5)
    passage = [f"p{rng.random()}" for _ in range(10)]
    texts = [" ".join([f"a{rng.random()}" for _ in range(rng.randint(0, 30))] + passage + [f"b{rng.random()}" for _ in range(rng.randint(0, 30))]) for _ in range(30)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(winnowing.fingerprints(winnowing.words_of(F.col("text")), 10).alias("f"), F.size(winnowing.words_of(F.col("text"))).alias("n"))
    rows = df.collect()
    assert set.intersection(*[{x.h for x in r.f} for r in rows])
    assert sum(len(r.f) for r in rows) < 0.5 * sum(r.n for r in rows)


def test_winnowing_edges(spark):
    docs, items = [(1, "a b c d e f g h i j k"), (1, "a b c d e f g h i j k"), (2, None)], [(1, "a b c d e f g h i j")]
    assert hits(spark, docs, []) == plain_hits(docs, []) and hits(spark, [], items) == []
    long = [(1, "w " * 120_000), (2, " ".join(f"w{k}" for k in range(30_000))), (3, "x" * 1_000_000)]
    big = [(1, "w " * 40_000), (2, " ".join(f"w{k}" for k in range(20_000)))]
    found = {r[0]: r for r in hits(spark, long, big)}
    assert (found[1][2], found[2][2], found[3][2]) == (120_000, 20_000, 0)
    # Columns of the input stay; those named like a result are replaced.
    held = spark.createDataFrame([(1, docs[0][1], "mine", 9)], "doc_id long, text string, extra string, N_HIT int")
    out = winnowing.decontaminate(held, spark.createDataFrame(items, "item_id long, text string")).first()
    assert (out.extra, out.n_hit, out.n_words, out.spans[0].end) == ("mine", 10, 11, 10)


# The conversation trie.
def plain_trie(rows, rebuilt=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own[c].append((turn is not None, turn or 0, role, digest, text))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuilt else 0
        base = c - int(np.fmod(c, 20))
        made[c] = own.get(base, [])[:h] + turns[h:] if rebuilt else turns
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[c] for c in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[c] for c in children[p])
    out = []
    for p, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(made[c]) == len(p))))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def nodes_of(spark, rows, rebuilt=True, **options):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return sorted([tuple(r) for r in trie.prefix_trie((trie.rebuilt_paths if rebuilt else trie.plain_paths)(df), **options).collect()], key=repr)


def chats(seed):
    rng = random.Random(seed)
    texts = ["Hello there", "  two\twords ", "", None, "what is it", "x"]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(texts)) for c in range(-25, 90) if rng.random() < 0.9 for t in range(rng.randint(1, 6))]
    rows += [(5, None, "user", "x"), (5, None, "user", "x"), (5, 1, "user", "tie"), (5, 1, "user", "other tie"), (None, 1, "user", "nobody's"), rows[0], rows[0]]
    rows += [(c, t, "user", "same") for c in (1001, 1002, 1003) for t in range(40)]  # longer than segments below
    rows += [(1040, t, "user", f"turn {t}") for t in range(70)] + [(1041, t, "user", f"turn {t}") for t in range(50)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rebuilt", [True, False])
@pytest.mark.parametrize("segment", [7, 256])
def test_trie(spark, rebuilt, segment):
    """Against prefixes as tuples; with segments of seven turns, long conversations are several shards' work."""
    rows = chats(segment)
    assert nodes_of(spark, rows, rebuilt, segment=segment) == plain_trie(rows, rebuilt)


def test_trie_collisions(spark):
    """Digests that stand for two prefixes are found: with four tiny primes nothing is returned, and one pair of powers is as good as another."""
    rows = chats(1)
    paths = trie.written(trie.plain_paths(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), "paths")
    tiny = np.array([5, 5, 5, 5], np.uint64)
    assert trie._with_powers(paths, tiny, 256, 0) is None
    with pytest.raises(ValueError, match="different prefixes"):
        trie.prefix_trie(paths, tiny)
    both = [sorted(map(tuple, trie._with_powers(paths, trie.PRIMES, 256, seed).collect()), key=repr) for seed in (0, 1)]
    assert both[0] == both[1] == plain_trie(rows, False)


def test_perfect_hash():
    rng = np.random.default_rng(3)
    hi, lo = rng.integers(0, 50, 20_000), rng.integers(0, 2**62, 20_000)
    table = trie.PerfectHash(hi, lo)
    assert sorted(table.slots(hi, lo)) == list(range(20_000))
    assert (table.slots(hi, lo + 1) == -1).all() and len(trie.PerfectHash(hi[:0], lo[:0]).slots(hi, lo)) == 20_000
    with pytest.raises(ValueError, match="equal"):
        trie.PerfectHash(np.array([1, 1]), np.array([2, 2]))


def test_trie_edges(spark):
    assert nodes_of(spark, []) == []
    one = [(3, 0, "user", "word " * 200_000)]
    assert nodes_of(spark, one, False) == plain_trie(one, False)
    # A node's end holds many conversations: their ids come to the hash in blocks.
    many = [(c, 0, "user", "the same") for c in range(9000)]
    assert nodes_of(spark, many, False) == plain_trie(many, False)


# Spelling variants.
def plain_words(docs):
    n = Counter()
    for doc, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n, ratio=10):
    form, count = {}, {}
    for w in n:
        near = [u for u in n if is_near(w, u)]
        count[w] = len(near)
        best = min(near, key=lambda u: (-n[u], u), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def found_variants(spark, n, **options):
    return sorted([tuple(r) for r in spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"), **options).collect()], key=repr)


def some_words(seed, size=300):
    rng = random.Random(seed)
    n = {}
    while len(n) < size:
        w = "".join(rng.choice("abé") for _ in range(rng.randint(3, 9)))
        for v in (w, w[:2] + w[3:], w[:1] + "b" + w[1:], w[:-1] + "÷", w + w[-1]):
            n[v] = rng.choice([1, 2, 3, 20, 30, 300, 3000, 10**6])
    return n


@pytest.mark.parametrize("size", [7, 50, 100_000])
def test_variants(spark, size, monkeypatch):
    """Against all pairs of words; small ranges have borders inside families of words."""
    monkeypatch.setattr(spelling, "RANGE", size)
    monkeypatch.setattr(spelling, "PAIRS", 40 * size)
    n = some_words(size)
    assert found_variants(spark, n) == plain_variants(n)
    assert any(r[1] and r[2] != r[1] for r in plain_variants(n))


@pytest.mark.parametrize("cut", [1, 2, 3, 10])
def test_trie_numbers(cut):
    """Equal prefixes have equal numbers and others don't, whatever the ranges' borders are."""
    words = sorted(some_words(9)) + ["é" * 50, "é" * 51]
    words = sorted(set(words))
    ranges = [(k, words[i : i + cut]) for k, i in enumerate(range(0, len(words), cut))]
    borders = spelling._borders([(k, r[0], r[-1]) for k, r in ranges])
    known = {}
    for k, r in ranges:
        nodes, ends = spelling.number(r, k, *borders[k], last=k == ranges[-1][0])
        for w, a, b in zip(r, ends, ends[1:], strict=False):
            assert b - a == len(w) + 1
            for i, x in enumerate(nodes[a:b]):
                assert known.setdefault(w[:i], x) == x
    assert len(set(known.values())) == len(known)


def test_variants_edges(spark):
    assert found_variants(spark, {}) == [] and found_variants(spark, {"abcdefg": 2}) == [("abcdefg", None, "abcdefg", 2, 0, None)]
    long = {"a" * 20_000: 30, "a" * 19_999: 3, "a" * 10_000 + "b" + "a" * 9_999: 2, "zzzzzzz": 5}
    assert [(len(w), f and len(f), len(r), *rest) for w, f, r, *rest in found_variants(spark, long)] == [(len(w), f and len(f), len(r), *rest) for w, f, r, *rest in plain_variants(long)]
    with pytest.raises(ValueError, match="frequent"):
        found_variants(spark, long, ratio=1)
    held = spark.createDataFrame([(None, 5, "x"), ("abcdefg", 2, "y")], "word string, n long, place string")
    assert [tuple(r) for r in spelling.variants(held).collect()] == [("abcdefg", None, "abcdefg", 2, 0, None)]


def test_counted(spark):
    docs = [(1, "Abcdefgh abcdefgh, ÀBCDEFG àbcdefg÷× zzzzzzz"), (1, "Abcdefgh abcdefgh"), (None, "kkkkkkkk " * 40), (None, None), (3, "")] + [(k, "Wordsome wordsome othersome ÉTERNELLE éternelle") for k in range(200)]
    held = spelling.counted(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.word: r.n for r in held.collect()} == plain_words(docs)
    assert len(plain_words(docs)) > 8


def test_queries(spark):
    """The registered queries over their whole tables."""
    c = duckdb.connect()
    rows = c.execute(f"SELECT conv_id, turn, role, text FROM '{oracle.DATA}/conversations.parquet'").fetchall()
    assert sorted(map(tuple, trie.op12_conversation_trie(spark, oracle.DATA).collect()), key=repr) == plain_trie(rows)
    docs = c.execute(f"SELECT doc_id, text FROM '{oracle.DATA}/documents.parquet'").fetchall()
    words = plain_words(docs)
    found = {r.word: r for r in spelling.op13_spelling_variants(spark, oracle.DATA).collect()}
    assert {w: r.n for w, r in found.items()} == words
    rng = random.Random(0)
    for w in rng.sample(sorted(words), 150):
        assert found[w].n_near == sum(is_near(w, u) for u in words if abs(len(u) - len(w)) < 2)


# The Jaccard join's prefixes and the mix's cells.
def test_pages_of_a_template(spark, monkeypatch):
    """Pages of one template, too different to be links, meet below prefixes in a bounded number of rounds and form no region; near copies among them are found."""
    rng = np.random.default_rng(2)
    frame = [f"f{k}" for k in range(60)]
    texts = [" ".join(frame + [f"w{x}" for x in rng.integers(0, 10**6, 38)]) for _ in range(1500)]
    texts += [texts[k].rsplit(" ", 1)[0] + " other" for k in range(0, 60, 2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made, write = [], jaccard_join.written
    monkeypatch.setattr(jaccard_join, "FEW", 16)
    monkeypatch.setattr(jaccard_join, "written", lambda df, name: made.append(name) or write(df, name))
    found = {r.doc_id: r for r in jaccard_join.jaccard_join(docs).collect()}
    assert made.count("leads") == 2
    assert {i for i, r in found.items() if r.n_links} == {*range(0, 60, 2), *range(1500, 1530)}
    assert all(found[1500 + k].class_id == 2 * k for k in range(30))


def test_equal_rows_fill_all_cells(spark):
    """Numbers deal 40,000 equal rows, and rows without id and text, evenly; they don't depend on how rows are dealt to tasks."""
    rows = spark.range(40_000).select(F.lit(5).alias("doc_id"), F.lit("s").alias("source"), F.lit("same words").alias("text"))
    rows = rows.unionByName(spark.range(2000).select(F.lit(None).cast("int").alias("doc_id"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("text")))
    cells = [r.n for r in mixing.numbered(rows).groupBy("source", F.pmod("__n", F.lit(10)).alias("c")).agg(F.count("*").alias("n")).collect()]
    assert sorted(cells) == [200] * 10 + [4000] * 10
    some = spark.createDataFrame([(k % 7, "ab"[k % 2], f"w {k % 50}") for k in range(500)], "doc_id long, source string, text string")
    both = [sorted(map(tuple, mixing.numbered(df).collect()), key=repr) for df in (some, some.repartition(7, "text"))]
    assert both[0] == both[1]


def test_order_of_rows_alone(spark, tmp_path):
    """Two splits of the same rows give the same slots, rows that are equal thousands of times among them, and those fill all shards."""
    rows = [(k if k % 9 else None, f"text {k} " * (k % 40)) for k in range(900)] + [(7, "often " * 30)] * 3000 + [(None, None)] * 500 + [(8, "twice")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = []
    for k, held in enumerate((df.repartition(3), df.repartition(11, "text"), df.orderBy(F.desc("doc_id")).coalesce(1))):
        found = token_output.training_order(held, tokens.default_path(), 3, 16, str(tmp_path / f"s{k}"), shard_records=64)
        made.append([(r.slot, r.shard, r.doc_id, r.piece, r.ids_crc32) for r in sorted(found.collect(), key=lambda r: r.slot)])
    assert made[0] == made[1] == made[2] and [r[0] for r in made[0]] == list(range(len(made[0])))
    fixed = [r for r in made[0] if r[2] == 7]
    assert len({r[1] for r in fixed}) == len({r[1] for r in made[0]})  # in every shard
    sizes = [n for _, _, n in token_output.shard_files(spark, str(tmp_path / "s0"), 16)]
    assert max(sizes) < 1.8 * sum(sizes) / len(sizes)


# The pipeline.
def plain_cut(rows):
    """Texts without what stands elsewhere too: strings of 400 bytes, passages of 51 words and whole copies; for plain ASCII."""
    seen, spans = Counter(), []
    for i, t in enumerate(rows):
        at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        w = t.split()
        found = [(s, s + 400, t[s : s + 400]) for s in range(len(t) - 399)] + [(at[k][0], at[k + 50][1], tuple(w[k : k + 51])) for k in range(len(w) - 50)]
        seen.update(x for *_, x in found)
        spans += [(i, *x) for x in found]
    gone = [np.zeros(len(t), bool) for t in rows]
    for i, lo, hi, x in spans:
        if seen[x] > 1:
            gone[i][lo:hi] = True
    return ["".join(c for c, g in zip(t, gone[i], strict=True) if not g) for i, t in enumerate(rows)]


def corpus(spark, folder, rows, labels=()):
    made = [(i, t, "en", s, len(t or ""), "mine", 7) for i, t, s in rows]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, kept string, size int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline_stages(spark, tmp_path):
    """Nulls, repeated rows, near copies, shared passages and clashing columns, stage by stage, the third against a plain version."""
    rng = random.Random(3)
    some = lambda n: [rng.choice("abcdefgh") + str(rng.randint(0, 9999)) for _ in range(n)]
    passage, base = some(60), some(120)
    rows = [(k, " ".join(some(rng.randint(30, 90)) + (passage if k % 5 == 0 else []) + some(20)), ["a", "b", None][k % 3]) for k in range(60)]
    rows += [(100 + k, " ".join(base[: 40 + k] + ["new"] + base[41 + k :]), "a") for k in range(6)] + [rows[1], rows[1], (None, rows[2][1], "b"), (None, None, None), (200, "", "a"), (201, "too short", "a"), (202, "again and " * 80, "b")]
    sf = corpus(spark, tmp_path, rows, [(1, 1, 0), (201, 0, 0), (999, 0, 1)])
    docs, columns, held = spark.read.parquet(f"{sf}/documents.parquet"), None, []
    for name, stage in corpus_pipeline.STAGES:
        columns = columns or docs.columns
        docs = trie.written(stage(spark, docs, sf), "stage")
        held.append(docs.collect())
        assert name == "best-fit packing" or docs.columns == columns, name
    quality, one, cut, mixed, packed = held
    assert Counter((r.doc_id, r.text) for r in quality) == Counter((i, t) for i, t, _ in rows if t and len(t.split()) >= 10 and not t.startswith("again"))
    assert sorted((r.doc_id for r in one), key=repr) == sorted([*range(60), 100], key=repr) and {r.kept for r in one} == {"mine"}
    texts = [r.text for r in one]
    assert Counter(zip((r.doc_id for r in one), plain_cut(texts), strict=True)) == Counter((r.doc_id, r.text) for r in cut)
    assert all(" ".join(passage[:51]) not in r.text for r in cut) and all(r.n_chars == len(r.text) for r in cut)
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in cut} and len([r for r in packed if r.piece == 0]) == len(mixed) > 0
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, whole.select("doc_id", "piece", "length", "ids_crc32").collect()), key=repr) == sorted(((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed), key=repr)


@pytest.mark.parametrize("rows", [[], [(1, None, None), (2, "short", "a"), (None, "", "b")]])
def test_pipeline_of_nothing(spark, tmp_path, rows):
    """No documents, and documents that are all rejected."""
    assert corpus_pipeline.run(spark, corpus(spark, tmp_path, rows)).count() == 0


def test_long_urls(spark):
    pages = spark.createDataFrame([(1, "http://" + "a." * 20_000 + "net/es/" + "p/" * 300_000), (2, "http://net/es/")], "page_id long, url string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    assert {r.page_id: (r.rule, r.verdict) for r in url_filter.url_verdicts(pages, rules).collect()} == {1: ("net/es/", "block"), 2: ("net/es/", "block")}

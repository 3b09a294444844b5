"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

Every text has a label path in each of TREES prefix tries: minima of random hashes over its word shingles.  A path is one number, so
that numbers sort as the trie does and a shift shortens a prefix by a label.  Texts meet at DEPTH labels first: whoever is a near copy of the smallest text
there is settled, and only the others' prefixes are shortened, down to the length at which pairs at the threshold share one in some tree with the
target recall.  There texts are compared by their signatures, with the smallest of them again and then with each other, in blocks where they are many.  Links so found connect regions, and any similar pair that shares a prefix is within one (see ``linked``).

Tasks verify the pairs of a region exactly: shared shingles come from products of incidence matrices, block by block, so a large region
is many tasks and no pair is ever a row.  In a large region, what is so near to its first text that any two must be similar needs no
comparison with its like.  Exact copies are one text from the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, mark, table, text_key, written
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
TREES, DEPTH, RECALL = 40, 10, 0.999
LABEL = 8  # bits of a label in a path and a signature
# Shares of equal labels: that settle a text with the smallest one, that link it to that, and that link texts compared with each other.
SETTLED, LINKED, CLOSE = 0.96, 0.54, 0.6
FEW = 512  # texts below a prefix whose signatures meet in one task
BLOCK = 1024  # texts of a region that one task compares with as many
COLUMNS = 2048  # shingles of an incidence matrix at a time
PRIME = np.uint64(0x9E3779B97F4A7C15)


def depth_for(similarity: float, trees: int, deepest: int, recall: float) -> int:
    """The longest prefix that finds pairs of this similarity with this recall."""
    depth = deepest
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """Different hashes (64 bit) of the runs of ``n`` words; a shorter text is one run, one without words has none.

    Words are what ASCII white space separates, as they are.
    """
    import xxhash

    words = text.split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if not len(h):
        return h
    size = min(n, len(h))
    out = h[: len(h) - size + 1].copy()
    for k in range(1, size):
        out = out * PRIME + h[k : len(h) - size + 1 + k]
    return np.unique(_mix(out + np.uint64(size)))


def forest_paths(texts: list[bytes], trees: int, deepest: int, depth: int, seed: int = 1, n: int = SHINGLE) -> tuple[list[np.ndarray], list[bytes]]:
    """For each text its label path in each tree and the labels themselves; nothing for texts without words.

    A path has a hash of the tree and the first ``depth`` labels in front, and then label after label up to ``deepest``.
    """
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**32, trees * deepest, np.uint32) | np.uint32(1)
    b = rng.integers(0, 2**32, trees * deepest, np.uint32)
    step = 256
    buffer = np.empty((step, trees * deepest), np.uint32)
    least = np.empty((len(texts), trees * deepest), np.uint32)
    have = np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        s = (shingles(text, n) >> np.uint64(32)).astype(np.uint32)
        if not len(s):
            continue
        have[i], low = True, None
        for at in range(0, len(s), step):
            part = buffer[: len(s[at : at + step])]
            np.multiply(s[at : at + step, None], a, out=part)
            part += b
            now = part.min(axis=0)
            low = now if low is None else np.minimum(low, now)
        least[i] = low
    path = np.zeros((len(texts), trees), np.uint64) + np.arange(1, trees + 1, dtype=np.uint64)
    labels = least.reshape(len(texts), trees, deepest)
    for k in range(depth):
        path = _mix(path * PRIME + labels[:, :, k])
    short = (_mix(labels[:, :, depth:].astype(np.uint64)) & np.uint64((1 << LABEL) - 1)).astype(np.uint64)
    path >>= np.uint64(1 + LABEL * (deepest - depth))
    for k in range(deepest - depth):
        path = path << np.uint64(LABEL) | short[:, :, k]
    signature = (_mix(least.astype(np.uint64)) & np.uint64((1 << LABEL) - 1)).astype(np.uint8)
    keys = path.astype(np.int64)
    return [keys[i] if have[i] else keys[i, :0] for i in range(len(texts))], [signature[i].tobytes() if have[i] else b"" for i in range(len(texts))]


def similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Matrix of the pairs (left, right) whose Jaccard similarity reaches the threshold; sets without elements match none."""
    sizes = np.array([len(s) for s in sets], np.float64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, many = np.unique(flat, return_inverse=True, return_counts=True)
    shared = many > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(left), len(right)), np.float32)
    place_l, place_r = np.full(len(sets), -1), np.full(len(sets), -1)
    place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, (at, at + COLUMNS))
        o, c = owner[lo:hi], column[lo:hi] - at
        m = [np.zeros((len(side), COLUMNS), np.float32) for side in (left, right)]
        for x, place in zip(m, (place_l, place_r), strict=True):
            fit = place[o] >= 0
            x[place[o[fit]], c[fit]] = 1
        both += m[0] @ m[1].T
    union = sizes[left][:, None] + sizes[right][None, :] - both
    return (both > 0) & (both >= similarity * union - 1e-9)


def _roots(close: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each row of a symmetric matrix with a full diagonal."""
    root = np.arange(len(close))
    while True:
        now = np.where(close, root[None, :], len(root)).min(axis=1)
        now = now[now]
        if np.array_equal(now, root):
            return root
        root = now


def linked(rows: DataFrame, signatures: DataFrame, shift: int, few: int | None = None) -> DataFrame:
    """u, v: texts whose signatures agree.

    rows: path, t; signatures: t, labels; ``shift`` bits shorten a path to the final prefix.  The smallest text of a path leads, and one that agrees with it in
    SETTLED of the labels is done in this tree; the other texts' prefixes are shortened.  Below a final prefix the smallest leads again, and what doesn't settle
    with it is compared with each other, in blocks of ``few``.

    Let x and y be similar, 1 - J <= 0.2, and share a final prefix.  If neither settles they are compared.  If x settles with z, then 1 - J(x, z) <= 0.08 but for
    chance (four deviations of 400 labels), and twice that if z, the leader of x's path, has settled too: so J(y, z) >= 0.64, and y agrees with z in
    LINKED of the labels, or in CLOSE where z is compared as x's leader.  Both x and y are linked to z.  Pages of one template, less alike than that, aren't linked.
    """
    few, found = few or FEW, []

    def compared(pdf):
        import pandas as pd

        pdf = pdf.sort_values("t", ignore_index=True)
        x, t, own = np.stack([np.frombuffer(v, np.uint8) for v in pdf["labels"]]), pdf["t"].to_numpy(), pdf["block"].to_numpy()
        close = np.eye(len(x), dtype=bool)
        lo, hi = pdf["lo"].iat[0], pdf["hi"].iat[0]
        for i in np.flatnonzero(own == lo):
            others = np.flatnonzero(own == hi) if lo != hi else np.arange(i + 1, len(x))
            close[i, others] = (x[i] == x[others]).mean(axis=1) >= CLOSE
        out = pd.DataFrame({"u": t, "v": t[_roots(close | close.T)]})
        return out[out["u"] != out["v"]]

    def led(rows: DataFrame) -> DataFrame | None:
        """``rows`` (prefix, t, and more) without leaders and what has settled with them; None if no prefix has two texts."""
        leads = written(rows.groupBy("prefix").agg(F.min("t").alias("lead"), F.count("*").alias("n")).filter("n > 1").drop("n"), "leads")
        if leads.isEmpty():
            return None
        below = rows.join(leads, "prefix").filter("t <> lead")
        both = below.select("t", "lead").distinct().join(signatures, "t").join(signatures.select(F.col("t").alias("lead"), F.col("labels").alias("others")), "lead")

        def agree(batches):
            for batch in batches:
                x, y = (np.frombuffer(b"".join(v.as_buffer() for v in batch.column(c)), np.uint8).reshape(batch.num_rows, -1) for c in (2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((x == y).mean(axis=1))], names=["t", "lead", "share"])

        tested = written(both.select("t", "lead", "labels", "others").mapInArrow(agree, "t long, lead long, share double"), "tested")
        found.append(tested.filter(F.col("share") >= LINKED).select(F.col("t").alias("u"), F.col("lead").alias("v")))
        return below.join(tested.filter(F.col("share") < SETTLED), ["t", "lead"]).select(rows.columns)

    def prefixes(df: DataFrame) -> DataFrame:
        return df.select(F.shiftright("path", shift).alias("prefix"), "t")

    deep = rows.select(F.col("path").alias("prefix"), "path", "t")
    left = led(deep)
    if left is None:
        rows = written(prefixes(rows), "below")
    else:  # leaders stay, and what has no other text on its path
        gone = deep.join(written(left.select("path", "t"), "unsettled"), ["path", "t"], "left_anti")
        leads = gone.groupBy("path").agg(F.min("t").alias("t"))
        rows = written(prefixes(leads.unionByName(left.select("path", "t"))), "below")
    left = led(rows)
    if left is not None:
        left = written(left, "below")
        sizes = written(left.groupBy("prefix").agg(F.count("*").alias("n")).filter("n > 1").select("prefix", F.ceil(F.col("n") / few).cast("int").alias("blocks")), "sizes")
        each = left.join(sizes, "prefix").withColumn("block", F.pmod(F.xxhash64("t"), F.col("blocks")).cast("int"))
        each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        each = each.select("prefix", "t", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")).join(signatures, "t")
        found.append(written(each.groupBy("prefix", "lo", "hi").applyInPandas(compared, "u long, v long"), "compared"))
    out = found[0] if found else signatures.select(F.col("t").alias("u"), F.col("t").alias("v")).limit(0)
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def classes(docs: DataFrame, similarity: float = SIMILARITY, n: int = SHINGLE, trees: int = TREES, deepest: int = DEPTH, recall: float = RECALL, block: int = BLOCK, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each different text: __k1, __k2 (its key), rep (smallest id), class_id, n_links, n_copies.

    class_id is the smallest id of all documents connected by links and equal texts; n_links counts the other different
    texts that are similar; n_copies counts the other documents with the same text.  Texts without words are linked to
    none; a text of fewer than ``n`` words is one shingle.  A null text is empty; ids may be null, and a class whose ids are all null has
    the id null.  Texts of any length are compared as a whole: a task holds ``2 * block`` of them at most.  No documents give no rows.
    """
    depth, since = depth_for(similarity, trees, deepest, recall), mark(docs.sparkSession)
    raw = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(key).alias("id"), *text_key(raw), raw.alias("text"))

    def label(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                paths, labels = forest_paths([x.as_buffer().to_pybytes() for x in part.column(3)], trees, deepest, depth, n=n)
                offsets = np.cumsum([0, *map(len, paths)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(paths))), pa.array(labels, pa.binary())], names=["id", "__k1", "__k2", "paths", "labels"])

    kind = docs.schema[key].dataType.simpleString()
    labelled = keyed.withColumn("text", F.col("text").cast("binary")).mapInArrow(label, f"id {kind}, __k1 long, __k2 int, paths array<long>, labels binary")
    different = labelled.groupBy("__k1", "__k2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("paths").alias("paths"), F.first("labels").alias("labels"))
    different = written(different.withColumn("t", F.monotonically_increasing_id()), "texts")

    # Only paths whose shortest prefix another text has go on.
    shift = LABEL * (deepest - depth)
    paths = different.select("t", F.explode("paths").alias("path")).withColumn("short", F.shiftright("path", shift))
    met = written(paths.groupBy("short").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "met")
    shared = written(paths.join(met, "short").select("t", "path"), "shared")
    signatures = written(different.join(shared.select("t").distinct(), "t").select("t", "labels"), "signatures")
    stars = components(linked(shared, signatures, shift))

    ends = stars.select(F.col("u").alias("t"), F.col("v").alias("region")).unionByName(stars.select(F.col("v").alias("t"), F.col("v").alias("region")).distinct())
    sizes = written(ends.groupBy("region").agg(F.count("*").alias("size")), "sizes")
    members = written(ends.join(sizes, "region").join(different.drop("paths", "labels", "n"), "t"), "members")
    texts = keyed.join(members.hint("shuffle_hash"), ["__k1", "__k2"]).filter(F.col("id").eqNullSafe(F.col("rep")))
    texts = texts.groupBy("t").agg(F.first("region").alias("region"), F.first("size").alias("size"), F.first(F.col("text").cast("binary")).alias("text"))
    texts = written(texts, "members_texts")

    # Of a large region, the texts within half of the distance from its first one: any two of them are similar.
    large = texts.filter(F.col("size") > block)
    first = large.filter("t = region").select("region", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / block).cast("int") - 1)).alias("part"), F.lit(True).alias("first"), "t", "text")
    dealt = large.withColumn("part", F.pmod(F.xxhash64("t"), F.ceil(F.col("size") / block)).cast("int"))

    def near(pdf):
        sets = [shingles(bytes(x), n) for x in pdf["text"]]
        lead = int(np.flatnonzero(pdf["first"])[0])
        shared = np.array([np.intersect1d(x, sets[lead], assume_unique=True).size for x in sets])
        union = np.array([len(x) for x in sets]) + len(sets[lead]) - shared
        return pdf[["t"]].assign(core=shared >= (1 + similarity) / 2 * union + 1e-9)[~pdf["first"]]

    core = dealt.select("region", "part", F.lit(False).alias("first"), "t", "text").unionByName(first).groupBy("region", "part").applyInPandas(near, "t long, core boolean")
    core = written(core.filter("core"), "core")
    held = texts.join(core, "t", "left").withColumn("core", F.coalesce("core", F.lit(False)))
    sides = written(held.groupBy("region", "core").agg(F.count("*").alias("k")).groupBy("region").agg(F.coalesce(F.sum(F.when(F.col("core"), F.col("k"))), F.lit(0)).alias("cores"), F.coalesce(F.sum(F.when(~F.col("core"), F.col("k"))), F.lit(0)).alias("rest")), "sides")
    held = held.join(sides, "region").withColumns({"rests": F.ceil(F.col("rest") / block).cast("int"), "blocks": F.ceil(F.col("rest") / block).cast("int") + F.ceil(F.col("cores") / block).cast("int")})
    own = F.when(F.col("core"), F.col("rests") + F.pmod(F.xxhash64("t"), F.col("blocks") - F.col("rests"))).otherwise(F.pmod(F.xxhash64("t"), F.col("rests"))).cast("int")
    # Core blocks come last and meet the others only.
    others = F.when(F.col("core"), F.when(F.col("rests") > 0, F.sequence(F.lit(0), F.col("rests") - 1))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = held.withColumn("block", own).select("t", "region", "block", "text", "cores", "core", "blocks", F.explode(others).alias("other"))
    pairs = pairs.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other")

    def verify(pdf):
        pdf = pdf.drop_duplicates("t").sort_values("t", ignore_index=True)
        sets = [shingles(bytes(x), n) for x in pdf["text"]]
        own = pdf["block"].to_numpy()
        lo, hi = pdf["lo"].iat[0], pdf["hi"].iat[0]
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        found = similar(sets, left, right, similarity)
        close = np.eye(len(sets), dtype=bool)
        close[np.ix_(left, right)] |= found
        close |= close.T
        t = pdf["t"].to_numpy()
        return pdf[["t", "blocks"]].assign(links=close.sum(axis=1) - 1, root=t[_roots(close)])

    # Few bytes, much work: as many tasks as there are partitions.
    pairs = pairs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "region", "lo", "hi")
    verified = pairs.groupBy("region", "lo", "hi").applyInPandas(verify, "t long, blocks int, links long, root long")
    # The first text is in the core, if there is one.
    alike = held.filter("core").select("t", "blocks", (F.col("cores") - 1).alias("links"), F.col("region").alias("root"))
    verified = written(verified.unionByName(alike), "verified")
    links = verified.groupBy("t").agg(F.sum("links").alias("links"), F.min("root").alias("root"), F.max("blocks").alias("blocks"))
    across = verified.filter("blocks > 1 AND t <> root").select(F.col("t").alias("u"), F.col("root").alias("v"))
    if not across.isEmpty():  # a region of several blocks is connected by what its tasks found
        links = links.join(components(across).select(F.col("u").alias("t"), F.col("v").alias("top")), "t", "left").withColumn("root", F.when(F.col("blocks") > 1, F.coalesce("top", "t")).otherwise(F.col("root"))).drop("top")
    known = different.drop("paths", "labels").join(links.drop("blocks"), "t", "left").withColumn("root", F.coalesce("root", "t"))
    known = written(known, "known")
    lowest = written(known.filter("links > 0").groupBy("root").agg(F.min("rep").alias("lowest")), "lowest")
    forget(docs.sparkSession, since, known, lowest)
    out = known.join(lowest, "root", "left")
    return out.select("__k1", "__k2", "rep", F.when(F.coalesce(F.col("links"), F.lit(0)) > 0, F.col("lowest")).otherwise(F.col("rep")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"), (F.col("n") - 1).alias("n_copies"))


def jaccard_join(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """One row a document: key, class_id, n_links, n_copies (see ``classes``); repeated rows come back each, other columns are left out."""
    found = classes(docs, text=text, key=key, **options)
    rows = docs.select(key, *text_key(F.coalesce(F.col(text), F.lit(""))))
    return rows.join(found, ["__k1", "__k2"], "left").select(key, "class_id", "n_links", "n_copies")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class; one of several rows with that id and text.

    Null and empty texts are one text, and so one class; a null id counts as larger than any other.
    """
    kept = classes(docs).filter(F.col("rep").eqNullSafe(F.col("class_id"))).select("__k1", "__k2", "rep")
    keys = text_key(F.coalesce("text", F.lit("")))
    rows = docs.select("*", *keys).join(kept.hint("shuffle_hash"), ["__k1", "__k2"]).filter(F.col("doc_id").eqNullSafe(F.col("rep")))
    return rows.dropDuplicates(["__k1", "__k2"]).select(*docs.columns)

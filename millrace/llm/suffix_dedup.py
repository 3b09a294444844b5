"""Removal of byte strings that stand anywhere else, by column-wise construction over many contexts at once.

Inserting one symbol of every document each round over a whole collection takes as many rounds as the longest document has
bytes, and each reads all that was built before.  So the collection is split first, without losing a match: in every
window of WINDOW bytes the smallest hash of KMER bytes is its anchor, so equal windows hold equal anchors at the same
place.  Anchors that occur once are dismissed; the others bring the bytes around them, and contexts of the same anchor are a
collection of their own.  There, each round inserts the next column to the left, one symbol of every context: a stable sort by
symbol updates the order of suffixes (the Burrows-Wheeler transform's) and range minima update the common prefixes.  A window
repeats where it shares WINDOW bytes with a neighbour in that order.  Many anchors' contexts go through the rounds
together, as parts of one table, streamed from sorted shuffle files.

Words go through the same: symbols are then whole words, and a passage repeats where WORDS of them do.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, mark, new_path, table, text_key, written
from .tokens import few_rows

WINDOW, KMER = 400, 100
#: Words of a passage (any of over 50) that the pipeline's stage removes and op2 counts, and of an anchor.
WORDS, WORD_KMER = 51, 16
#: Contexts that go through the rounds together, unless one anchor has more.
TOGETHER = 8192
SENT = 1_000_000  # digests that a task remembers
HELD = 4_000_000  # bytes of contexts that a task holds before they go out, or those of one anchor
BASE = 0x9E3779B97F4A7C15
PAD = 256  # stands beyond the ends of a text


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64))]) for b in (BASE, pow(BASE, -1, 2**64)))


def _slide(v: np.ndarray, width: int, op, filler) -> np.ndarray:
    """``op`` over every run of ``width`` values: prefixes and suffixes of blocks."""
    n = len(v)
    blocks = np.concatenate([v, np.full(-n % width, filler, v.dtype)]).reshape(-1, width)
    before = op.accumulate(blocks, axis=1).ravel()
    after = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(after[: n - width + 1], before[width - 1 : n])


def _mix(v: np.ndarray) -> np.ndarray:
    v ^= v >> np.uint64(32)
    v *= np.uint64(0xD6E8FEB86659FD93)
    v ^= v >> np.uint64(32)
    return v


def _sums(values: np.ndarray, power: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return sums


def _symbols(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)


def word_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words between ASCII white space start and end."""
    raw = np.frombuffer(text, np.uint8)
    edges = np.diff(((raw != 32) & ((raw < 9) | (raw > 13))).astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def anchors(text: bytes, powers, window: int = WINDOW, kmer: int = KMER, words: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Places whose hash of ``kmer`` bytes, or words, is the smallest of some window, and these hashes."""
    power, inverse = powers
    values = _symbols(text)
    if words:
        start, stop = word_places(text)
        sums = _sums(values, power)
        values = _mix((sums[stop] - sums[start]) * inverse[start])
    n = len(values)
    if n < window:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sums = _sums(values, power)
    v = _mix((sums[kmer:] - sums[:-kmer]) * inverse[: n - kmer + 1])
    width = window - kmer + 1
    least = _slide(v, width, np.minimum, np.uint64(2**64 - 1))
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), width, np.maximum, np.uint64(0)) == v)
    return at, v[at].astype(np.int64)


def repeated_windows(columns: np.ndarray, group: np.ndarray, window: int, pad: int = PAD) -> np.ndarray:
    """Whether the window that starts at a column stands in another context of the same group.

    columns: symbols up to ``pad``, a row for each column and a place for each context; group: non-decreasing.  Returns a row for each
    start.  Columns are inserted from the last to the first; ``order`` is that of the suffixes from the
    current column, group by group, and ``prefix`` what each has in common with the one before it.
    """
    width, m = columns.shape
    out = np.zeros((width - window + 1, m), bool)
    order, prefix, base = np.arange(m), np.zeros(m, np.int32), group.astype(np.int64) * (pad + 1)
    for c in range(width - 1, -1, -1):
        key = base + columns[c, order]
        if (key[1:] >= key[:-1]).all():  # the order stays
            prefix[1:] = np.where(key[1:] == key[:-1], prefix[1:] + 1, 0)
        else:
            place = np.argsort(key, kind="stable")
            key = key[place]
            now = np.zeros(m, np.int32)
            same = np.flatnonzero(key[1:] == key[:-1]) + 1
            first, last = place[same - 1], place[same]
            near = last == first + 1
            now[same[near]] = prefix[last[near]] + 1
            if not near.all():
                a, b = first[~near] + 1, last[~near] + 1
                bounds = np.stack([a, b], axis=1).ravel()
                padded = np.append(prefix, np.int32(0))  # so that a range may end at the end
                now[same[~near]] = np.minimum.reduceat(padded, bounds)[::2] + 1
            order, prefix = order[place], now
        if c <= width - window:
            shared = prefix >= window
            shared[:-1] |= shared[1:]
            out[c, order[shared]] = True
    return out


def _runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last+1 of the runs of True in each row of a matrix."""
    edges = np.diff(np.pad(marks, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    rows, first = np.nonzero(edges == 1)
    return rows, first, np.nonzero(edges == -1)[1]


def _store(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` as a bucketed table in the shared folder, so that later joins on ``keys`` don't shuffle it again."""
    spark = df.sparkSession
    name = f"millrace_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(parts, *keys).option("path", new_path(spark, "texts")).option("compression", "zstd").saveAsTable(name)
    held = spark.read.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalogue's entry; the files stay, and the plan has read what it needs of the entry
    return held


def _spans(texts: DataFrame, window: int, kmer: int, words: bool = False) -> DataFrame:
    """__k1, __k2, lo, hi: strings of ``window`` bytes, or words, that stand anywhere else, joined where they overlap in a context."""
    lead = window - kmer  # symbols before the anchor in a context
    width = lead + window
    keys, since = ["__k1", "__k2"], mark(texts.sparkSession)

    def find(batches):
        powers = _powers(1 << 16)
        for batch in few_rows(batches):
            row, hashes, places = [], [], []
            for i, x in enumerate(batch.column(2)):
                raw = x.as_buffer().to_pybytes()
                if len(raw) + 1 > len(powers[0]):
                    powers = _powers(2 * len(raw))
                at, h = anchors(raw, powers, window, kmer, words)
                order = np.argsort(h, kind="stable")
                cuts = np.flatnonzero(np.diff(h[order])) + 1
                for part in np.split(order, cuts) if len(order) else []:
                    row.append(i)
                    hashes.append(h[part[0]])
                    places.append(at[part])
            offsets = pa.array(np.cumsum([0, *map(len, places)]).astype(np.int32))
            flat = pa.array(np.concatenate(places).astype(np.int32) if places else np.empty(0, np.int32))
            pick = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), pa.array(hashes, pa.int64()), pa.ListArray.from_arrays(offsets, flat)], names=[*keys, "h", "at"])

    found = written(texts.filter(F.length("text") >= (2 * window - 1 if words else window)).select(*keys, "text").mapInArrow(find, "__k1 long, __k2 int, h long, at array<int>"), "anchors")
    often = found.groupBy("h").agg(F.sum(F.size("at")).alias("n")).filter("n > 1").select("h")
    wanted = found.join(often, "h").groupBy(*keys).agg(F.collect_list(F.struct("h", "at")).alias("anchors"))
    near = texts.select(*keys, "text").join(wanted.hint("shuffle_hash"), keys)

    def surround(batches):
        """Contexts of a text's anchors, equal ones once; of those that the text has twice, also the bytes they cover.

        The bytes of a context go out with its first text in a task; after that its digest stands for it.
        """
        import xxhash

        sent: set[int] = set()
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int64())

        def rows(batch, out):
            pick = pa.array(out[0], pa.int64())
            columns = [pa.array(c, k) for c, k in zip(out[1:], kinds, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), *columns], names=[*keys, "h", "p", "context", "lo", "hi", "digest"])

        for batch in few_rows(batches):
            out: list[list] = [[] for _ in range(7)]
            held = 0
            if len(sent) > SENT:
                sent.clear()
            for i in range(batch.num_rows):
                raw = batch.column(2)[i].as_buffer().to_pybytes()
                split = raw.split() if words else raw
                size = len(split)
                padded = b"" if words else b"\0" * lead + raw + b"\0" * window
                for entry in batch.column(3)[i].values.to_pylist():
                    seen: dict[bytes, list[int]] = {}
                    for p in entry["at"]:
                        ends = bytes([p < lead, size - p < window])  # a context at an edge isn't one inside
                        if words:  # its place in the columns too, as nothing stands for what is missing
                            context = max(0, lead - p).to_bytes(4, "little") + min(width, lead + size - p).to_bytes(4, "little") + b" ".join(split[max(0, p - lead) : p + window])
                        else:
                            context = padded[p : p + width]
                        seen.setdefault(ends + context, []).append(p)
                    for context, places in seen.items():
                        lo, hi = max(0, lead - places[0]), min(width, lead + size - places[0])
                        if len(places) > 1 and hi - lo >= window:
                            first = np.sort(np.array(places)) - lead + lo
                            new = np.flatnonzero(np.diff(first, prepend=first[0] - width - 1) > hi - lo)  # runs that touch are one
                            last = np.append(first[new[1:] - 1], first[-1]) + hi - lo
                            for begin, end in zip(first[new].tolist(), last.tolist(), strict=True):
                                for column, value in zip(out, (i, None, begin, None, begin, end, None), strict=True):
                                    column.append(value)
                        digest = xxhash.xxh3_64_intdigest(context + lo.to_bytes(4, "little") + hi.to_bytes(4, "little")) - (1 << 63)
                        for column, value in zip(out, (i, entry["h"], places[0], None if digest in sent else context[10 if words else 2 :], lo, hi, digest), strict=True):
                            column.append(value)
                        held += len(context)
                        sent.add(digest)
                    if held > HELD:
                        yield rows(batch, out)
                        out, held = [[] for _ in range(7)], 0
            yield rows(batch, out)

    contexts = written(near.mapInArrow(surround, "__k1 long, __k2 int, h long, p int, context binary, lo int, hi int, digest long"), "contexts")
    forget(texts.sparkSession, since, contexts)

    def rounds(batches):
        held: list[pa.RecordBatch] = []

        def insert(rows: pa.Table):
            h, p, lo, hi = (rows.column(c).to_numpy() for c in ("h", "p", "lo", "hi"))
            new = np.diff(h, prepend=~h[:1]) != 0
            group = np.cumsum(new) - 1
            alone = np.bincount(group)[group] < 2
            pick = np.flatnonzero(~alone)
            if not len(pick):
                return None
            joined = rows.column("context").take(pa.array(pick)).combine_chunks()
            lo, hi, p = lo[pick], hi[pick], p[pick]
            column = np.arange(width)
            inside = (column >= lo[:, None]) & (column < hi[:, None])
            if words:
                given = pa.array(b" ".join(x.as_buffer() for x in joined).split(b" "), pa.large_binary()).dictionary_encode()
                pad = len(given.dictionary)
                symbols = np.full(inside.shape, pad, np.int32)
                symbols[inside] = given.indices.to_numpy()
            else:
                pad = PAD
                symbols = np.frombuffer(b"".join(x.as_buffer() for x in joined), np.uint8).reshape(len(pick), width).astype(np.int16)
                symbols[~inside] = pad
            marks = repeated_windows(np.ascontiguousarray(symbols.T), group[pick], window, pad).T
            start = np.arange(lead + 1)
            marks &= (start >= lo[:, None]) & (start + window <= hi[:, None])
            row, first, last = _runs(marks)
            where = pa.array(pick[row])
            begin = p[row] - lead + first
            return pa.RecordBatch.from_arrays([rows.column("__k1").take(where).combine_chunks(), rows.column("__k2").take(where).combine_chunks(), pa.array(begin.astype(np.int32)), pa.array((begin + last - first - 1 + window).astype(np.int32))], names=[*keys, "lo", "hi"])

        def whole(last: bool):
            """The groups that are complete, if they are many enough."""
            nonlocal held
            rows = pa.Table.from_batches(held)
            h = rows.column("h").to_numpy()
            cut = len(h) if last else int(np.searchsorted(h, h[-1]))
            held = [] if last else rows.slice(cut).to_batches()
            while cut:
                size = cut
                if cut > 2 * TOGETHER:  # at the end of a group
                    size = int(np.searchsorted(h[:cut], h[TOGETHER], side="right"))
                if (found := insert(rows.slice(0, size))) is not None:
                    yield found
                rows, h, cut = rows.slice(size), h[size:], cut - size

        have = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            have += batch.num_rows
            # Nothing is put together again and again while a group goes on.
            if have >= 2 * TOGETHER and held[0].column("h")[0] != batch.column("h")[-1]:
                yield from whole(False)
                have = sum(b.num_rows for b in held)
        if held and sum(b.num_rows for b in held):
            yield from whole(True)

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = contexts.filter("context IS NOT NULL").drop("digest").repartition(parts, "h").sortWithinPartitions("h")
    # What two texts surround alike is repeated as a whole.
    alike = contexts.filter("h IS NOT NULL").groupBy("h", "digest").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    shared = contexts.filter(F.col("hi") - F.col("lo") >= window).select(*keys, "h", "digest", "p", "lo", "hi").join(alike, ["h", "digest"])
    shared = shared.select(*keys, (F.col("p") - lead + F.col("lo")).alias("lo"), (F.col("p") - lead + F.col("hi")).alias("hi"))
    return dealt.mapInArrow(rounds, "__k1 long, __k2 int, lo int, hi int").unionByName(shared).unionByName(contexts.filter("h IS NULL").select(*keys, "lo", "hi"))


def dedup(docs: DataFrame, window: int = WINDOW, kmer: int = KMER, text: str = "text", keep: bool = True, words: int | None = None, word_kmer: int = WORD_KMER, passages: bool = False) -> DataFrame:
    """A row for each different text: __k1, __k2, n_bytes, n_removed, n_spans, kept_sha256, and kept if ``keep``.  With ``passages``, n_passages and n_passage_bytes too.

    kept is what is left as text, without the bytes of characters that a cut has broken.

    Removed is each byte covered by a string of ``window`` bytes that starts anywhere else too, in the same text or another
    row; a text that several rows have is removed as a whole if it is long enough.  With ``words``, so is each
    byte from the first to the last of that many words in a row that stand anywhere else, whatever white space is between them; with ``passages``, these
    stay, and their maximal runs and the bytes of these are counted in columns of their own.  Null and
    empty texts count as empty, other columns are left out, and no documents give no rows.  Memory: a task holds one text and ``2 * window - kmer`` bytes, or words, for each different context of its most
    frequent anchor.
    """
    keys = ["__k1", "__k2"]
    raw = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(*text_key(raw), raw.cast("binary").alias("text")).groupBy(*keys).agg(F.first("text").alias("text"), F.count("*").alias("n"))
    texts = _store(texts, keys)
    spans = _spans(texts, window, kmer).withColumn("words", F.lit(False))
    if words:
        spans = spans.unionByName(_spans(texts, words, word_kmer, True).withColumn("words", F.lit(True)))
    spans = spans.groupBy(*keys).agg(F.collect_list(F.struct("lo", "hi", "words")).alias("spans"))

    def cut(batches):
        def covered_bytes(lo, hi, size):
            gone = np.cumsum(np.bincount(lo, minlength=size + 1).astype(np.int64) - np.bincount(hi, minlength=size + 1))[:size] > 0
            return gone, int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))

        fields = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.string())] * keep
        fields += [("n_passages", pa.int64()), ("n_passage_bytes", pa.int64())] * passages
        for batch in few_rows(batches):
            out: list[list] = [[] for _ in fields]
            for x, n, covered in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4), strict=True):
                raw = x.as_buffer().to_pybytes()
                kept, removed, runs, found, found_bytes = raw, 0, 0, 0, 0
                lo, hi, by_word = (covered.values.field(k).to_numpy(zero_copy_only=False) for k in range(3)) if covered.is_valid else (np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, bool))
                enough = False
                if words and (n > 1 or by_word.any()):
                    start, stop = word_places(raw)
                    enough = n > 1 and len(start) >= words
                    lo, hi = lo.copy(), hi.copy()
                    lo[by_word], hi[by_word] = start[lo[by_word]], stop[hi[by_word] - 1]
                    if passages and enough:
                        found, found_bytes = 1, int(stop[-1] - start[0])
                    elif passages:
                        _, found_bytes, found = covered_bytes(lo[by_word], hi[by_word], len(raw))
                if passages:
                    lo, hi, enough = lo[~by_word], hi[~by_word], False
                if n > 1 and (len(raw) >= window or enough):
                    kept, removed, runs = b"", len(raw), 1
                elif len(lo):
                    gone, removed, runs = covered_bytes(lo, hi, len(raw))
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                row = (len(raw), removed, runs, hashlib.sha256(kept).hexdigest(), *[kept.decode("utf-8", "ignore")] * keep, *[found, found_bytes] * passages)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, (_, t) in zip(out, fields, strict=True))], names=[*keys, *(f for f, _ in fields)])

    schema = "__k1 long, __k2 int, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * keep + ", n_passages long, n_passage_bytes long" * passages
    return texts.select(*keys, "text", "n").join(spans.hint("shuffle_hash"), keys, "left").mapInArrow(cut, schema)


def repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """One row a document: key, n_bytes, n_removed, n_spans, kept_sha256, and what ``passages`` counts; repeated rows come back each, other columns are left out."""
    found = dedup(docs, text=text, keep=False, **options)
    return docs.select(key, *text_key(F.coalesce(F.col(text), F.lit("")))).join(found, ["__k1", "__k2"], "left").drop("__k1", "__k2")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of WINDOW bytes are removed, as the contract has it; passages of WORDS words, most of which are shorter, are counted beside."""
    return repeats(table(spark, sf_dir, "documents"), words=WORDS, passages=True)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated strings of WINDOW bytes and passages of WORDS words; every row comes back once.

    A null text stays null, what repeated rows share is removed from each, and bytes of a character that a cut leaves behind go too.  n_chars
    follows the text where ``docs`` has it; other columns stay.
    """
    found = dedup(docs, words=WORDS).select("__k1", "__k2", F.col("n_removed").alias("__n"), F.col("kept").alias("__kept"))
    rows = docs.select("*", *text_key(F.coalesce("text", F.lit("")))).join(found, ["__k1", "__k2"])
    rows = rows.withColumn("text", F.when(F.col("__n") == 0, F.col("text")).otherwise(F.col("__kept")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)

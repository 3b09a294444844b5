"""Training-order materialisation of token ids in fixed-stride binary shards.

Every sequence has a number that follows from its document, its place in it and, where many rows are equal, the row's number among them: so neither
files nor tasks have a part in the order.  A keyed Feistel network, walking its cycles back into the range of numbers, permutes all of them; a shard is an
equal range of permuted numbers, so one shuffle moves every id once, into range partitions that are as large as each other.  A partition is sorted by permuted number and streams into a file of records with a
fixed stride: a header and the ids, padded.  A sequence's global slot is the number of records before it, which file
sizes tell; so slots turn into shards and byte offsets, and reading goes on from any slot.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, table
from .tokens import EOS, default_path, encoder, few_rows, in_slices

LENGTH = 512  # ids of a sequence
SHARD_RECORDS = 8192  # records of a shard, about: a task reads a shard's file as one value
NUMBERS = 10**18  # that sequences have; two in 10**12 or so share one, and stand side by side
# Rows that are equal more often than a share of all rows, and a share of a shard, get numbers among themselves; at most 1 / HOT rows can be that often.
HOT, HOT_SHARD = 10_000, 16
COPIES = 256  # equal rows that a task cuts at a time
ROUNDS = 4
# A record's header, little-endian: document, slot in the shard, shard, piece, number of ids (the top bit says that the document has no id), their CRC-32.
HEADER = [("doc", "<i8"), ("slot", "<i8"), ("shard", "<u4"), ("piece", "<u4"), ("n", "<u4"), ("crc", "<u4")]
HEADER_SIZE = 32
NO_ID = np.uint32(1 << 31)


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(numbers: np.ndarray, n: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """A keyed permutation of 0..n-1, applied to ``numbers``: a balanced Feistel network over the next power of four.

    What falls outside goes through again until it is inside (cycle-walking), fewer than four times on average.
    """
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = _mix64(np.uint64(key & (2**64 - 1)) + np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = numbers.astype(np.uint64)
    left = np.arange(len(out))
    while len(left):
        x = out[left]
        a, b = x >> shift, x & mask
        for k in keys:
            a, b = b, a ^ (_mix64(b + k) & mask)
        out[left] = x = a << shift | b
        left = left[x >= n]
    return out.astype(np.int64)


def record_type(length: int) -> np.dtype:
    return np.dtype([*HEADER, ("ids", "<u2", (length,))])


def _dealt(docs: DataFrame, rows: int, shard_records: int, text: str, doc: str) -> DataFrame:
    """doc_id, __text, h1, h2, k, copies: rows with a hash of 128 bits, those that are often equal once for every ``COPIES`` of them, k the number of the first."""
    raw = docs.select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    raw = raw.withColumns({"h1": F.xxhash64(key, "__text"), "h2": F.xxhash64(F.lit(1), key, "__text")})
    often = max(shard_records // HOT_SHARD, rows // HOT, 1)
    hot = raw.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") > often).collect()  # HOT rows at most, but in small tables
    once = {"k": F.lit(0).cast("long"), "copies": F.lit(1).cast("long")}
    if not hot:
        return raw.withColumns(once)
    known = F.broadcast(docs.sparkSession.createDataFrame([(r.h1, r.h2, r.n) for r in hot], "h1 long, h2 long, n long"))
    many = raw.join(known, ["h1", "h2"]).groupBy("h1", "h2").agg(F.first("doc_id").alias("doc_id"), F.first("__text").alias("__text"), F.first("n").alias("n"))
    many = many.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))))
    many = many.withColumn("copies", F.least(F.col("n") - F.col("k"), F.lit(COPIES))).repartition("h1", "h2", "k")
    columns = ["doc_id", "__text", "h1", "h2", "k", "copies"]
    return raw.join(known.drop("n"), ["h1", "h2"], "left_anti").withColumns(once).select(columns).unionByName(many.select(columns))


def sequences(docs: DataFrame, path: str, shards: int, key: int, length: int = LENGTH, text: str = "text", doc: str = "doc_id", rows: int | None = None, shard_records: int = SHARD_RECORDS) -> DataFrame:
    """doc_id, piece, shard, place, ids: whole documents with EOS as runs of at most ``length`` ids (16 bit), and their permuted number.

    A null text is empty, and so one id long; repeated rows are documents of their own.  A vocabulary of more than 65,536 ids raises ValueError.
    """
    eos = np.array([EOS], np.uint32)
    rows = docs.count() if rows is None else rows
    width = -(-NUMBERS // shards)

    def cut(batches):
        encode = encoder(path)
        if encode.size > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        for batch in few_rows(batches):
            texts = batch.column(1).to_pylist()
            h1, h2, first, copies = (batch.column(c).to_numpy() for c in (2, 3, 4, 5))
            for at, some in in_slices(texts):
                row, piece, parts = [], [], []
                for i, ids in enumerate(encode(some), at):
                    ids = np.concatenate([ids, eos]).astype("<u2")
                    for p, s in enumerate(range(0, len(ids), length)):
                        row.append(i)
                        piece.append(p)
                        parts.append(ids[s : s + length].tobytes())
                row, piece, parts = np.array(row), np.array(piece), pa.array(parts, pa.binary())
                for c in range(int(copies[row].max()) if len(row) else 0):
                    here = np.flatnonzero(copies[row] > c)
                    r, p = row[here], piece[here]
                    number = _mix64(_mix64(h1[r].view(np.uint64) + p.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ _mix64(h2[r].view(np.uint64) + (first[r] + c).astype(np.uint64)))
                    place = permute(number % np.uint64(NUMBERS), NUMBERS, key)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(r)), pa.array(p.astype(np.int32)), pa.array((place // width).astype(np.int32)), pa.array(place), parts.take(pa.array(here))],
                        names=["doc_id", "piece", "shard", "place", "ids"],
                    )

    return _dealt(docs, rows, shard_records, text, doc).mapInArrow(cut, "doc_id long, piece int, shard int, place long, ids binary")


def write_shards(docs: DataFrame, path: str, tokenizer: str, key: int = 0, length: int = LENGTH, shard_records: int = SHARD_RECORDS) -> int:
    """Writes ``docs`` to ``path``, a file for each shard that has records, and returns the number of shards.

    Files go through Spark's text writer, which commits whole tasks only and reaches any store; its line end is the last
    byte of every record.  The order follows from ``key`` and the rows alone, however they are split or sorted.  No documents give no files.
    """
    size = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    records = (size[0] or 0) // (2 * length) + size[1]  # about: an id has two bytes or more in most texts
    shards = max(1, -(-records // shard_records))
    kind = record_type(length)

    def pack(batches):
        given = 0
        for batch in few_rows(batches):
            n = batch.num_rows
            out, ids = np.zeros(n, kind), [x.as_buffer() for x in batch.column(3)]
            size = np.fromiter((x.size // 2 for x in ids), np.int64, n)
            no_id = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            out["doc"] = batch.column(0).fill_null(0).to_numpy()
            out["slot"] = given + np.arange(n)
            out["shard"], out["piece"] = batch.column(2).to_numpy(), batch.column(1).to_numpy()
            out["n"] = size.astype(np.uint32) | np.where(no_id, NO_ID, np.uint32(0))
            out["crc"] = np.fromiter(map(zlib.crc32, ids), np.uint32, n)
            padded = np.zeros(n * length, "<u2")
            padded[np.repeat(np.arange(n) * length - np.cumsum(size) + size, size) + np.arange(size.sum())] = np.frombuffer(b"".join(ids), "<u2")
            out["ids"] = padded.reshape(n, length)
            given += n
            offsets = np.arange(n + 1, dtype=np.int32) * kind.itemsize
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(out)])], names=["record"])

    dealt = sequences(docs, tokenizer, shards, key, length, rows=size[1], shard_records=shard_records)
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("place", "doc_id", "piece", "ids")
    rows = dealt.select("doc_id", "piece", "shard", "ids").mapInArrow(pack, "record binary")
    rows.select(F.col("record").cast("string").alias("record")).write.option("compression", "none").text(path)
    return shards


def shard_files(spark: SparkSession, path: str, length: int = LENGTH) -> list[tuple[str, int, int]]:
    """(file, first global slot, records) of each shard in order: a row a shard from file sizes, without a look inside."""
    stride = record_type(length).itemsize + 1
    found = spark.read.format("binaryFile").load(path).select("path", "length").collect()
    files, first = [], 0
    for name, size in sorted((r["path"], r["length"]) for r in found):
        files.append((name, first, size // stride))
        first += size // stride
    return files


def read_shards(spark: SparkSession, files: list[tuple[str, int, int]], length: int = LENGTH, start: int = 0) -> DataFrame:
    """doc_id, piece, shard, slot, byte_offset, n_tokens, ids_crc32 and ids of the records from global slot ``start`` on.

    files: what ``shard_files`` gives, or some of it.  Whole files become arrays of records; a checksum that differs raises.
    """
    kind = np.dtype([*record_type(length).descr, ("end", "u1")])
    first = {name: slot for name, slot, n in files if slot + n > start}
    schema = "doc_id long, piece int, shard int, slot long, byte_offset long, n_tokens int, ids_crc32 long, ids binary"
    if not first:
        return spark.createDataFrame([], schema)

    def parse(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                records = np.frombuffer(content.as_buffer(), kind)
                skip = max(0, start - first[name])
                for at in range(skip, len(records), 1024):
                    part = records[at : at + 1024]
                    n = (part["n"] & ~NO_ID).astype(np.int64)
                    ids = [x[: 2 * k] for x, k in zip((r.tobytes() for r in part["ids"]), n.tolist(), strict=True)]
                    if (wrong := np.flatnonzero(np.fromiter(map(zlib.crc32, ids), np.uint32, len(ids)) != part["crc"])).size:
                        raise ValueError(f"shard {part['shard'][0]}, slot {part['slot'][wrong[0]]}: the checksum differs")
                    doc = pa.array(part["doc"].astype(np.int64), mask=(part["n"] & NO_ID) > 0)
                    slot = part["slot"].astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [doc, *(pa.array(x) for x in (part["piece"].astype(np.int32), part["shard"].astype(np.int32), first[name] + slot, slot * kind.itemsize, n.astype(np.int32), part["crc"].astype(np.int64))), pa.array(ids, pa.binary())],
                        names=[f.split()[0] for f in schema.split(", ")],
                    )

    return spark.read.format("binaryFile").load(list(first)).select("path", "content").mapInArrow(parse, schema)


def training_order(docs: DataFrame, tokenizer: str, key: int = 0, length: int = LENGTH, path: str | None = None, shard_records: int = SHARD_RECORDS) -> DataFrame:
    """Writes shards and reads them back: doc_id, piece, n_tokens, ids_crc32, shard, slot (global, from 0), byte_offset.

    A row a sequence; other columns of ``docs`` are left out.  Null ids stay null, equal ids and repeated rows are documents
    of their own, texts of any length are cut, and no documents give no rows.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "shards")
    write_shards(docs, path, tokenizer, key, length, shard_records)
    return read_shards(spark, shard_files(spark, path, length), length).select("doc_id", "piece", "n_tokens", "ids_crc32", "shard", "slot", "byte_offset")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order(table(spark, sf_dir, "documents").select("doc_id", "text"), default_path(), key=20240607)

"""Best-fit packing by the sum-of-squares rule.

Tasks tokenize whole documents and keep only lengths and checksums.  Full pieces fill a sequence each.  The shorter ones
are dealt by hash into cells of bounded size, and each cell is packed on its own: documents, longest first, go where the
squared counts of open bins per residual gap become smallest.  A cell leaves a few open bins at its end, so large cells waste
almost nothing, and any number of cells is packed side by side.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .tokens import EOS, default_path, encoder, few_rows, in_slices

CAPACITY = 1024
#: About so many short pieces are packed together.
CELL = 20_000


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, piece, start, length, ids_crc32: documents as token ids with EOS at their end, cut where longer than ``capacity``.

    Only the first piece may be shorter than ``capacity``.  A null or empty text is one id long, repeated rows come back each, other columns
    are left out, and no documents give no rows.  A task holds the ids of one text, or of some 1,000,000 characters.
    """
    eos = np.array([EOS], np.uint32)

    def cut(batches):
        encode = encoder(path)
        for batch in few_rows(batches):
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            rows, piece, start, length, crc = [], [], [], [], []
            for at, some in in_slices(texts):
                for i, ids in enumerate(encode(some), at):
                    ids = np.concatenate([ids, eos]).astype("<u4")
                    n, s, p = len(ids), 0, 0
                    while s < n:
                        e = min(n, s + ((n - 1) % capacity + 1 if not s else capacity))
                        rows.append(i)
                        piece.append(p)
                        start.append(s)
                        length.append(e - s)
                        crc.append(zlib.crc32(ids[s:e]))
                        s, p = e, p + 1
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=[key, "piece", "start", "length", "ids_crc32"],
            )

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("__text")).mapInArrow(cut, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, in the order given.

    Placing a piece of s in a bin with gap g changes the sum of squares by 1 - 2 N(g), and by 2 N(g - s) + 1 for the gap
    that it leaves; a closed bin (gap 0) counts nothing.  A new bin is one more choice, taken only if no open one has room.
    """
    counts = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        have = counts[s:capacity]
        left = 2 * counts[: capacity - s] + 1
        left[:1] = 0
        change = np.where(have > 0, left - 2 * have, np.iinfo(np.int64).max) if s < capacity else have
        best = int(change.argmin()) if len(change) else 0
        if len(change) and have[best] > 0:
            gap = s + best
            b = open_bins[gap].pop()
            counts[gap] -= 1
        else:
            gap, b = capacity, made
            made += 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            counts[gap - s] += 1
            open_bins[gap - s].append(b)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, cell: int = CELL, key: str = "doc_id") -> DataFrame:
    """``pieces`` with sequence_id and offset: gapless sequences of at most ``capacity`` tokens.

    pieces: key, piece, length and others; written to the shared folder first, so that numbers of rows stay the same.
    Repeated rows are packed each; no rows give no rows.  Columns named sequence_id or offset are replaced, and __row and __cell left out.
    """
    pieces = pieces.select(*[c for c in pieces.columns if c.lower() not in ("sequence_id", "offset", "__row", "__cell")])
    held = written(pieces.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    short = held.filter(F.col("length") < capacity)
    cells = max(1, round(short.count() / cell))
    columns = [c for c in held.columns if c != "__row"]
    full = held.filter(F.col("length") == capacity).select(*columns, (-1 - F.col("__row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def packed(pdf):
        # Longest first; rows break ties, so that a task that runs again gives the same.
        pdf = pdf.sort_values(["length", "__row"], ascending=[False, True], ignore_index=True)
        bins, offset = sum_of_squares(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=bins * cells + pdf["__cell"], offset=offset)[names]

    names = [*columns, "sequence_id", "offset"]
    schema = ", ".join(f"`{c}` {held.schema[c].dataType.simpleString()}" for c in columns) + ", sequence_id long, offset long"
    dealt = short.withColumn("__cell", F.pmod(F.xxhash64("__row"), F.lit(cells)))
    return dealt.groupBy("__cell").applyInPandas(packed, schema).unionByName(full)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(table(spark, sf_dir, "documents"), default_path()))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed: one row a piece, of null and empty texts and repeated rows too."""
    return pack(token_pieces(docs, default_path()))

"""A trie of conversation prefixes, its nodes in perfectly hashed tables of flat arrays.

A prefix's digest is a sum, over its turns, of the turn's digest times a power for its depth, modulo four primes of 31 bits.  Sums
can be taken piece by piece: a conversation is cut into segments of ``SEGMENT`` turns, which are spread over shards, so no conversation,
however long, and no prefix, however common, is one task's.  In a shard the distinct digests get slots of a minimal perfect hash,
which keeps the digest of each slot and so notices what isn't its own; counts are scattered into arrays by slot.  Shards' counts of a
prefix are added up; a digest that stands for two different nodes (another depth, parent or turn) is found there, and everything is done again
with other powers.

Sums over subtrees start where each node is first owned: by its smallest conversation.  A shard adds its owned values along the parent slots, from
the deepest nodes up; what a conversation owns in later segments is added where its segment ends; sums of all shards are added by digest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, ranked, table, written

SEGMENT = 256
#: Rows that a shard holds, about.
SHARD = 100_000
#: Characters of a block of ids, of which one hash reads a row.
BLOCK = 65_536
# The four largest primes below 2 to the 31st.
PRIMES = np.array([2147483647, 2147483629, 2147483587, 2147483579], np.uint64)
NODE = ["hi", "lo"]
LAST = np.iinfo(np.int64).max


class PerfectHash:
    """Slots 0 to n - 1 for n distinct pairs of integers: what is alone at its place in a level's table stays there, the rest goes to the next level."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        left, placed = np.arange(len(hi)), 0
        self.hi, self.lo = np.empty_like(hi), np.empty_like(lo)
        while len(left):
            if len(self.levels) == 99:
                raise ValueError("two keys are equal")
            size = 2 * len(left)
            place = self._place(hi[left], lo[left], len(self.levels), size)
            alone = np.bincount(place, minlength=size)[place] == 1
            taken = np.zeros(size, bool)
            taken[place[alone]] = True
            rank = np.cumsum(taken) - 1 + placed
            self.levels.append((size, taken, rank))
            slots = rank[place[alone]]
            self.hi[slots], self.lo[slots] = hi[left[alone]], lo[left[alone]]
            placed += len(slots)
            left = left[~alone]

    @staticmethod
    def _place(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = hi.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (lo.view(np.uint64) + np.uint64(level * 0x632BE5AB + 1)) * np.uint64(0xC2B2AE3D27D4EB4F)
            for shift in (30, 27, 31):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
            return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)

    def slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The slot of each pair, -1 for pairs that have none: a slot is given only where its own digest is the one asked for."""
        out, left = np.full(len(hi), -1), np.arange(len(hi))
        for level, (size, taken, rank) in enumerate(self.levels):
            place = self._place(hi[left], lo[left], level, size)
            here = taken[place]
            out[left[here]] = rank[place[here]]
            left = left[~here]
        known = out >= 0
        known[known] = (self.hi[out[known]] == hi[known]) & (self.lo[out[known]] == lo[known])
        return np.where(known, out, -1)


def _distinct(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((lo, hi))
    hi, lo = hi[order], lo[order]
    new = np.ones(len(hi), bool)
    new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    return hi[new], lo[new]


def _column(rows, name: str) -> np.ndarray:
    return rows.column(name).to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows.column(name).to_numpy()


def _powers(d: np.ndarray, seed: int, primes: np.ndarray) -> list[np.ndarray]:
    """A base of each prime to the power of each depth."""
    out = []
    for j, p in enumerate(primes):
        base = int.from_bytes(hashlib.blake2b(f"{seed}:{j}".encode(), digest_size=8).digest(), "little") % (int(p) - 3) + 2
        power, square, rest = np.ones(len(d), np.uint64), base, d.astype(np.uint64)
        while rest.any():
            power = np.where(rest & np.uint64(1), power * np.uint64(square) % p, power)
            square, rest = square * square % int(p), rest >> np.uint64(1)
        out.append(power)
    return out


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, t, w: turns with a digest of role and text, of 128 bits of SHA-256, and the text's words.

    Null roles and texts are empty; turns without a conversation's id belong to none and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("t"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("w"))
    return written(rows, "turns")


def placed(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with their global ``rank``, and conversations with their first rank (start) and number of turns (n).

    Turns of a conversation go by turn, null first, then role, then digest; equal rows are turns of their own.
    """
    rows = ranked(turns.withColumn("__i", F.monotonically_increasing_id()), F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("t"), F.col("__i")).drop("turn", "role", "__i")
    return rows, written(rows.groupBy("conv_id").agg(F.min("rank").alias("start"), F.count("*").alias("n")), "conversations")


def _paths(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, d, len, t, w: the root (depth 0) and the turns of each of ``convs`` (conv_id, len), from ``rows`` (conv_id, d from 1, t, w)."""
    root = convs.select("conv_id", F.lit(0).cast("long").alias("d"), "len", F.unhex(F.lit("00" * 16)).alias("t"), F.lit(0).cast("long").alias("w"))
    return rows.join(convs, "conv_id").select("conv_id", "d", "len", "t", "w").unionByName(root)


def plain_paths(conversations: DataFrame) -> DataFrame:
    """Each conversation's own turns."""
    rows, convs = placed(turns_of(conversations))
    return _paths(rows.join(convs, "conv_id").select("conv_id", (F.col("rank") - F.col("start") + 1).alias("d"), "t", "w"), convs.select("conv_id", F.col("n").alias("len")))


def rebuilt_paths(conversations: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations that share their first turns: c begins with the first h turns of c - c % every, then come its own after its first h; h is crc32(c) % most."""
    rows, convs = placed(turns_of(conversations))
    first = (F.col("conv_id") - F.col("conv_id") % every).alias("base")
    at = rows.join(convs, "conv_id").select("conv_id", (F.col("rank") - F.col("start")).alias("pos"), "t", "w")
    heads = written(at.filter((F.col("conv_id") % every == 0) & (F.col("pos") < most - 1)), "heads").withColumnRenamed("conv_id", "base")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    info = convs.select("conv_id", "n", first, h).join(heads.groupBy("base").agg(F.count("*").alias("had")), "base", "left")
    taken = F.least("h", F.coalesce("had", F.lit(0)))
    info = written(info.select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "rebuilt")
    own = at.join(info, "conv_id").filter("pos >= h").select("conv_id", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("d"), "t", "w")
    front = info.join(heads, "base").filter("pos < h").select("conv_id", (F.col("pos") + 1).alias("d"), "t", "w")
    return _paths(own.unionByName(front), info.select("conv_id", "len"))


def prefix_trie(paths: DataFrame, primes: np.ndarray = PRIMES, segment: int = SEGMENT) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each distinct prefix.

    paths: conv_id, d, len, t, w as ``plain_paths`` gives them: depths 0 to len of each conversation, each once.  conv_id is a node's smallest member; with depth it
    names the node.  n_leaves counts nodes without children in the node's subtree, itself included; saved_tokens sums (members - 1) times words over
    the subtree; ends_sha256 is of the ascending ids of members that end there.  No conversations give no rows.
    """
    paths = written(paths, "paths")
    for seed in range(9):
        found = _with_powers(paths, primes, segment, seed)
        if found is not None:
            return found
    raise ValueError("digests stand for different prefixes whatever the powers")


def _with_powers(paths: DataFrame, primes: np.ndarray, segment: int, seed: int) -> DataFrame | None:
    spark = paths.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-paths.count() // SHARD))
    shard = lambda seg: F.pmod(F.xxhash64("conv_id", seg), F.lit(shards)).alias("shard")
    seg = F.floor(F.col("d") / segment).cast("long")
    xs, os = [f"x{j}" for j in range(4)], [f"o{j}" for j in range(4)]

    def with_terms(batches):
        for b in batches:
            parts = np.frombuffer(b.column(3).cast(pa.binary(16)).buffers()[1], np.uint32)[4 * b.column(3).offset :][: 4 * b.num_rows].reshape(-1, 4).astype(np.uint64)
            powers = _powers(_column(b, "d"), seed, primes)
            for j, p in enumerate(primes):
                b = b.append_column(xs[j], pa.array((parts[:, j] % p * powers[j] % p).astype(np.int64)))
            yield b

    schema = "conv_id long, d long, len long, t binary, w long, " + ", ".join(f"{x} long" for x in xs)
    terms = paths.select("conv_id", "d", "len", "t", "w").mapInArrow(with_terms, schema).withColumn("seg", seg)
    # Only conversations of several segments have anything before a segment; there is a row for each of their segments.
    sums = terms.filter(F.col("len") >= segment).groupBy("conv_id", "seg").agg(*[F.sum(x).alias(x) for x in xs])
    before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(sums.select("conv_id", "seg", *[(F.coalesce(F.sum(x).over(before), F.lit(0)) % int(p)).alias(o) for x, o, p in zip(xs, os, primes, strict=True)]), "offsets")
    held = terms.join(offsets, ["conv_id", "seg"], "left").select(*terms.columns, *[F.coalesce(o, F.lit(0)).alias(o) for o in os], shard("seg"))

    def count(key, rows):
        conv, d = _column(rows, "conv_id"), _column(rows, "d")
        order = np.lexsort((d, conv))
        rows, conv, d = rows.take(pa.array(order)), conv[order], d[order]
        new = np.ones(len(d), bool)
        new[1:] = (conv[1:] != conv[:-1]) | (d[1:] // segment != d[:-1] // segment)
        starts = np.flatnonzero(new)[np.cumsum(new) - 1]
        here, above = [], []
        for x, o, p in zip(xs, os, primes.astype(np.int64), strict=True):
            term = _column(rows, x)
            total = np.cumsum(term)
            now = (total - (total - term)[starts] + _column(rows, o)) % p
            here.append(now)
            above.append((now - term) % p)
        hi, lo = here[0] << 32 | here[1], here[2] << 32 | here[3]
        phi, plo = (np.where(d == 0, -1, a << 32 | b) for a, b in ((above[0], above[1]), (above[2], above[3])))
        slots = PerfectHash(*_distinct(hi, lo))
        at, n = slots.slots(hi, lo), len(slots.hi)
        t = np.frombuffer(rows.column("t").combine_chunks().cast(pa.binary(16)).buffers()[1], np.int64)[: 2 * len(d)].reshape(-1, 2)
        of = {"depth": d, "phi": phi, "plo": plo, "t1": t[:, 0], "t2": t[:, 1], "w": _column(rows, "w")}
        first, mixed, flat = np.full(n, LAST), np.zeros(n, bool), {}
        np.minimum.at(first, at, conv)
        for name, value in of.items():
            flat[name] = np.zeros(n, np.int64)
            flat[name][at] = value
            mixed[at[flat[name][at] != value]] = True
        ends = d == _column(rows, "len")
        m = int(ends.sum())
        shard_of = np.full(n + m, key[0].as_py())
        nothing = np.zeros(m, np.int64)
        out = {"shard": shard_of, "ends": np.r_[np.zeros(n, bool), np.ones(m, bool)], "hi": np.r_[slots.hi, hi[ends]], "lo": np.r_[slots.lo, lo[ends]]}
        out |= {name: np.r_[value, nothing] for name, value in flat.items()}
        out |= {"n": np.r_[np.bincount(at, minlength=n), nothing], "conv_id": np.r_[first, conv[ends]], "mixed": np.r_[mixed, nothing.astype(bool)]}
        return pa.table(out)

    same = ["depth", "phi", "plo", "t1", "t2"]
    schema = "shard long, ends boolean, hi long, lo long, " + ", ".join(f"{x} long" for x in same) + ", w long, n long, conv_id long, mixed boolean"
    local = written(held.groupBy("shard").applyInArrow(count, schema), "local_nodes")
    unlike = F.max("mixed")
    for x in same:
        unlike = unlike | (F.min(x) != F.max(x))
    nodes = local.filter("NOT ends").groupBy(*NODE).agg(*[F.min(x).alias(x) for x in same], F.min("w").alias("w"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), unlike.alias("mixed"))
    nodes = written(nodes, "nodes")
    if not nodes.filter("mixed").isEmpty():
        return None
    below = nodes.filter("depth > 0").groupBy(F.col("phi").alias("hi"), F.col("plo").alias("lo")).agg(F.count("*").alias("n_children"))
    # What each node adds to its own and all subtrees above it.
    held = nodes.join(below, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    info = written(held.select(*NODE, "depth", "phi", "plo", "conv_id", "n", "n_children", ((F.col("n") - 1) * F.col("w")).alias("saved"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves")), "node_values")
    sums = _subtrees(local.filter("NOT ends"), info, offsets, shard, segment)
    ends = _ended(local.filter("ends").select(*NODE, "conv_id"))
    above = info.select(F.col("hi").alias("phi"), F.col("lo").alias("plo"), F.col("conv_id").alias("parent_conv_id"))
    out = info.select(*NODE, "depth", "phi", "plo", "conv_id", "n", "n_children").join(sums, NODE, "left").join(ends, NODE, "left").join(above, ["phi", "plo"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(nothing)).alias("ends_sha256"))


def _subtrees(local: DataFrame, info: DataFrame, offsets: DataFrame, shard, segment: int) -> DataFrame:
    """hi, lo, n_leaves, saved_tokens: sums over subtrees, added up in shards along parent slots, deepest nodes first."""
    values = info.select(*NODE, F.col("conv_id").alias("owner"), "saved", "leaves")
    mine = F.col("conv_id") == F.col("owner")  # one shard holds a conversation's node at a depth
    rows = local.select("shard", *NODE, "depth", "phi", "plo", "conv_id").join(values, NODE)
    rows = rows.select("shard", F.lit(False).alias("carried"), *NODE, "depth", "phi", "plo", *[F.when(mine, F.col(x)).otherwise(0).alias(x) for x in ("saved", "leaves")])
    # What a conversation owns from a segment on is carried to the node before the segment, whose digest is the segment's offset.
    owned = info.filter(F.col("depth") >= segment).groupBy("conv_id", F.floor(F.col("depth") / segment).cast("long").alias("seg")).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    on = Window.partitionBy("conv_id").orderBy(F.desc("seg"))
    carried = offsets.filter("seg > 0").join(owned, ["conv_id", "seg"], "left")
    carried = carried.select("conv_id", (F.col("seg") - 1).alias("seg"), (F.shiftleft("o0", 32) + F.col("o1")).alias("hi"), (F.shiftleft("o2", 32) + F.col("o3")).alias("lo"), *[F.sum(F.coalesce(x, F.lit(0))).over(on).alias(x) for x in ("saved", "leaves")])
    nothing = F.lit(0).cast("long")
    carried = carried.filter("saved <> 0 OR leaves <> 0").select(shard("seg"), F.lit(True).alias("carried"), *NODE, nothing.alias("depth"), nothing.alias("phi"), nothing.alias("plo"), "saved", "leaves")

    def add_up(rows):
        carried = _column(rows, "carried").astype(bool)
        hi, lo, phi, plo, depth = (_column(rows, c)[~carried] for c in ("hi", "lo", "phi", "plo", "depth"))
        table = PerfectHash(hi, lo)
        at, n = table.slots(hi, lo), len(hi)
        parent = np.empty(n, np.int64)
        # A segment's first nodes add to nothing here, even where their parents are in the shard too: that is what is carried.
        parent[at] = np.where(depth % segment == 0, -1, table.slots(phi, plo))
        more = table.slots(_column(rows, "hi")[carried], _column(rows, "lo")[carried])
        if (more < 0).any():
            raise ValueError("a segment's end is not in its shard")
        flat = {}
        for c in ("saved", "leaves"):
            flat[c] = np.zeros(n, np.int64)
            flat[c][at] = _column(rows, c)[~carried]
            np.add.at(flat[c], more, _column(rows, c)[carried])
        order = at[np.argsort(-depth, kind="stable")]
        for level in np.split(order, np.flatnonzero(np.diff(-np.sort(-depth))) + 1):
            level = level[parent[level] >= 0]
            for values in flat.values():
                np.add.at(values, parent[level], values[level])
        return pa.table({"hi": table.hi, "lo": table.lo, **flat})

    sums = rows.unionByName(carried).groupBy("shard").applyInArrow(add_up, "hi long, lo long, saved long, leaves long")
    return written(sums.groupBy(*NODE).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")), "subtrees")


def _ended(ends: DataFrame) -> DataFrame:
    """hi, lo, sha: the hash of all ids of a node in order.  Ranges of sorted ids become blocks of text first, so that a hash reads few rows."""
    spark = ends.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def blocks(batches):
        held, size, node = [], 0, None
        for b in batches:
            out = []
            for hi, lo, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if held and (node != (hi, lo) or size > BLOCK):
                    out.append((*node, held[0], ",".join(map(str, held))))
                    held, size = [], 0
                node = (hi, lo)
                held.append(c)
                size += 20
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["hi", "lo", "first", "ids"])
        if held:
            yield pa.RecordBatch.from_pylist([{"hi": node[0], "lo": node[1], "first": held[0], "ids": ",".join(map(str, held))}])

    def hashed(batches):
        sha, node = None, None
        for b in batches:
            out = []
            for hi, lo, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if node != (hi, lo):
                    if sha:
                        out.append((*node, sha.hexdigest()))
                    sha, node = hashlib.sha256(ids.encode()), (hi, lo)
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["hi", "lo", "sha"])
        if sha:
            yield pa.RecordBatch.from_pylist([{"hi": node[0], "lo": node[1], "sha": sha.hexdigest()}])

    order = [*NODE, "conv_id"]
    packed = ends.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(blocks, "hi long, lo long, first long, ids string")
    return written(written(packed, "id_blocks").repartition(parts, *NODE).sortWithinPartitions(*NODE, "first").mapInArrow(hashed, "hi long, lo long, sha string"), "ends")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt_paths(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))

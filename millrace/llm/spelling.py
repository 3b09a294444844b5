"""Spelling variants by a dictionary of pairs of trie nodes.

The nodes of a trie of all words, and of one of all words reversed, get numbers.  A word without one position is then a pair of
integers, the node of what stands before it and the node of what stands behind; a whole word cut at a position is such a pair
too.  Two words that share a pair differ by one replaced code point where both skip a position, and by one inserted code point where one
skips and the other is whole, so grouping the pairs gives all neighbours at distance one and nothing else.

A trie is numbered in sorted order: a word's nodes are those of the word before as far as they agree, and new ones from there.  Words
are sorted by range, and a task numbers one range; what neighbouring ranges share at their borders is numbered by the border.
A group of pairs holds at most one whole word and a word for each letter, so groups are small whatever the corpus is, and
counts and best neighbours are taken from it without writing pairs of words out.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words shorter than this, or rarer than that, have no variants here.
LEAST_LENGTH, LEAST_N = 7, 2
#: A frequent neighbour is a word's form if it stands at least so many times as often.
RATIO = 10
#: One run in so many loses a code point.
DROPPED = 31
#: Words that a task numbers, and pairs that it groups.
RANGE, PAIRS = 100_000, 1_500_000
#: Node numbers: the range's number above, then a bit that marks a node of a border, then a number in the range.
SHIFT, BORDER = 40, 1 << 39


def counted(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """word, n: runs of letters with A-Z lower-cased, of which a hash of the document's key and the run picks one in 31 to lose a code point.

    A null key counts as an empty one.  Only words that are long and frequent enough are kept.
    """
    # A run that is too short gives no word, with or without its code point; greedy matches are whole runs.
    runs = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(rf"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.explode(runs).alias("run"))
    each = each.select("k", F.translate("run", UPPER, LOWER).alias("run"))
    each = each.withColumn("h", F.crc32(F.concat("k", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % DROPPED == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return each.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_N))


def shared(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] agrees, a[:high] doesn't
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def _borders(ends: list[tuple[int, str, str]]) -> dict[int, tuple[list[int], str]]:
    """For each range: the numbers of its first word's nodes that it shares with the range before, and the prefix that it shares with the next.

    ``ends``: range, first and last word, in order.  A node on a border belongs to the first range that has it.
    """
    with_next = [shared(a[2], b[1]) for a, b in zip(ends, ends[1:], strict=False)] + [-1] * bool(ends)
    out, held = {}, []
    for (part, first, last), beyond in zip(ends, with_next, strict=True):
        out[part] = (held, last[: max(beyond, 0)])
        through = shared(first, last)
        # What the last word inherits goes on; its other nodes on the border to the next range are numbered by this one.
        kept = held[: min(len(held), through + 1, beyond + 1)]
        held = kept + [(part << SHIFT) | BORDER | i for i in range(len(kept), beyond + 1)]
    return out


def number(words: list[str], part: int, inherited: list[int], border: str, last: bool) -> tuple[array, array]:
    """Nodes of sorted words, from the root to the whole word, one after the other; and where each word's end."""
    nodes, ends = array("q"), array("q", [0])
    base, made, before, now = part << SHIFT, 0, "", list(inherited)
    on_border = -1 if last else len(border)
    for k, w in enumerate(words):
        keep = shared(before, w) + 1 if k else len(inherited)
        del now[keep:]
        same = shared(border, w) if keep <= on_border else -1
        for i in range(keep, len(w) + 1):
            if i <= same and i <= on_border:
                now.append(base | BORDER | i)
            else:
                now.append(base | made)
                made += 1
        nodes.extend(now)
        ends.append(len(nodes))
        before = w
    return nodes, ends


def trie(words: DataFrame, word: Column, name: str) -> DataFrame:
    """``words``, each with the numbers of its nodes in a trie of ``word`` (nodes) and its place in sorted order (place).

    ``word`` must have no equal values.  The driver sees the first and the last word of each range.
    """
    spark = words.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words.count() // RANGE))
    held = words.withColumn("__w", word).repartitionByRange(parts, "__w").sortWithinPartitions("__w").withColumn("place", F.monotonically_increasing_id())
    held = written(held.withColumn("__part", F.shiftright("place", 33)), f"sorted_{name}")
    ends = sorted(tuple(r) for r in held.groupBy("__part").agg(F.min("__w"), F.max("__w")).collect())
    borders, top = _borders(ends), max((e[0] for e in ends), default=0)

    def numbered(key, rows):
        part = key[0].as_py()
        rows = rows.sort_by("place")
        nodes, offsets = number(rows.column("__w").to_pylist(), part, *borders[part], last=part == top)
        lists = pa.LargeListArray.from_arrays(pa.array(np.frombuffer(offsets, np.int64)), pa.array(np.frombuffer(nodes, np.int64)))
        return rows.drop_columns(["__part", "__w"]).append_column("nodes", lists.cast(pa.list_(pa.int64())))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.drop("__part", "__w").schema) + ", nodes array<long>"
    return written(held.groupBy("__part").applyInArrow(numbered, schema), f"trie_{name}")


def _neighbours(batches):
    """From rows p, s, kind, n, place, whole groups of (p, s): place, c, best_n, best, a row where a word has neighbours in a group.

    kind: 0 skips a position, 1 too and it is the first of a run of equal code points, 2 is whole.
    """
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    p, s, kind, n, place = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(5))
    order = np.lexsort((s, p))
    new = np.ones(len(p), bool)
    new[1:] = (p[order][1:] != p[order][:-1]) | (s[order][1:] != s[order][:-1])
    group = np.cumsum(new) - 1
    many = np.bincount(group)[group] > 1
    group, order = group[many], order[many]
    if not len(group):
        return
    kind, n, place = kind[order], n[order], place[order]
    order = np.lexsort((place, -n, group))
    group, kind, n, place = group[order], kind[order], n[order], place[order]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    group = np.cumsum(np.r_[False, group[1:] != group[:-1]])
    rows, none = np.arange(len(group)), len(group)

    def first(mask: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(np.where(mask, rows, none), starts)[group]

    skips = kind < 2
    count = lambda mask: np.add.reduceat(mask.astype(np.int64), starts)[group]
    best = first(skips)
    second = first(skips & (rows != best))
    other = np.where(best == rows, second, best)
    whole, head = first(kind == 2), first(kind == 1)
    found = [
        (skips & (count(skips) > 1), count(skips) - 1, other),
        ((kind == 1) & (whole < none), np.ones(none, np.int64), whole),
        ((kind == 2) & (head < none), count(kind == 1), head),
    ]
    for mask, c, to in found:
        at, to = rows[mask], to[mask]
        yield pa.RecordBatch.from_arrays([pa.array(place[at]), pa.array(c[mask]), pa.array(n[to]), pa.array(place[to])], names=["place", "c", "best_n", "best"])


def near(words: DataFrame) -> DataFrame:
    """words: word (no equal values), n.  Adds place, n_near (words at distance one), best and best_n (the most frequent of them, null if none; ties by code-point order)."""
    spark = words.sparkSession
    forward = trie(words, F.col("word"), "forward")
    backward = trie(forward.select("word", F.col("place").alias("at")), F.reverse("word"), "backward")
    both = forward.select("word", "n", "place", F.col("nodes").alias("p")).join(backward.select(F.col("at").alias("place"), F.col("nodes").alias("s")), "place")
    size = F.size("p") - 1  # code points of the word
    skip = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(
        F.get("p", i).alias("p"), F.get("s", size - 1 - i).alias("s"),
        F.when((i > 0) & (F.get("c", i) == F.get("c", i - 1)), 0).otherwise(1).cast("byte").alias("kind")))
    keep = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(F.get("p", i).alias("p"), F.get("s", size - i).alias("s"), F.lit(2).cast("byte").alias("kind")))
    pairs = both.withColumn("c", F.split("word", "")).select("n", "place", F.explode(F.concat(skip, keep)).alias("x")).select("x.p", "x.s", "x.kind", "n", "place")
    total = words.agg(F.sum(2 * F.length("word") + 1)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PAIRS))
    met = pairs.repartition(parts, "p", "s").mapInArrow(_neighbours, "place long, c long, best_n long, best long")
    met = met.groupBy("place").agg(F.sum("c").alias("n_near"), F.max(F.struct("best_n", (-F.col("best")).alias("b"))).alias("m"))
    met = met.select("place", "n_near", (-F.col("m.b")).alias("best"), F.col("m.best_n").alias("best_n"))
    out = forward.select("word", "n", "place").join(met, "place", "left")
    return written(out.withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long"))), "near")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """words: word, n, no word twice.  Returns word, form, root (string), n, n_near and form_n (long).

    Two words are near if they differ by exactly one inserted, deleted or replaced code point.  A word's form is its most frequent near
    word (ties: the first in code-point order) if that stands at least ``ratio`` times as often, else null; its root is the last word
    that forms lead to, itself if it has none.  Null words are left out; no words give no rows; words of any length are taken whole.
    """
    if ratio < 2:
        raise ValueError("a form is more frequent than its word")
    held = near(words.select("word", F.col("n").cast("long").alias("n")).filter("word IS NOT NULL"))
    formed = F.col("best_n") >= ratio * F.col("n")
    forms = written(held.filter(formed).select("place", F.col("best").alias("root")), "forms")
    # Every form is ratio times as frequent as its word, so chains are short, and each round doubles the steps taken.
    roots, left = forms, forms.count()
    while left:
        ahead = roots.select(F.col("place").alias("root"), F.col("root").alias("next"))
        roots = written(roots.join(ahead, "root", "left").select("place", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        left = roots.filter("moved").count()
        roots = roots.drop("moved")
    names = lambda at, word: held.select(F.col("place").alias(at), F.col("word").alias(word))
    linked = forms.withColumnRenamed("root", "f").join(roots.withColumnRenamed("root", "r"), "place").join(names("f", "form"), "f").join(names("r", "top"), "r")
    out = held.join(linked.select("place", "form", "top"), "place", "left")
    return out.select("word", "form", F.coalesce("top", "word").alias("root"), "n", "n_near", F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(written(counted(table(spark, sf_dir, "documents").select("doc_id", "text")), "words"))

"""Benchmark decontamination by winnowing (DataFrame operations only).

Words hash to numbers, runs of k words to k-gram hashes, and of each w k-grams in a row the smallest is kept: so any k + w - 1 words in
a row that two texts share have a fingerprint in common.  Fingerprints of documents meet those of items in a semi-join; what is left is
extended by the windows around it, which are compared word by word with the items' windows.  Documents are read row by row; only
fingerprints that some item has, and the texts that hold them, are shuffled, equal texts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, table, text_key, with_columns, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
GRAM = 5
#: Distinct fingerprints of items, of eight bytes each, up to which they are sent to all tasks; beyond, both sides are shuffled.
SENT = 1_000_000
KEY = ["__k1", "__k2"]


def words_of(text: Column) -> Column:
    """Words with A-Z lower-cased; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _folded(text: Column) -> Column:
    """Words as ``words_of`` has them, in number, but with all letters lower-cased, which is quicker; equal words stay equal."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _upto(n: Column) -> Column:
    """Numbers from 0 to ``n`` - 1; none if ``n`` isn't positive."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))


def fingerprints(words: Column, length: int) -> Column:
    """What winnowing keeps of windows of ``length`` words: structs of the hash h, the first window that has it as its smallest k-gram (at), the number of windows in a row that do (n), and length."""
    k = min(GRAM, length)
    w = length - k + 1

    def grams(h: Column) -> Column:
        return F.transform(_upto(F.size(h) - k + 1), lambda i: F.xxhash64(F.lit(length), *[F.get(h, i + j) for j in range(k)]))

    def least(g: Column) -> Column:
        return F.transform(_upto(F.size(g) - w + 1), lambda i: F.least(*[F.get(g, i + j) for j in range(w)]) if w > 1 else F.get(g, i))

    def kept(m: Column) -> Column:
        first = F.filter(_upto(F.size(m)), lambda i: ~F.coalesce(F.get(m, i - 1) == F.get(m, i), F.lit(False)))
        return let(first, lambda f: F.transform(f, lambda s, j: F.struct(F.get(m, s).alias("h"), s.alias("at"), (F.coalesce(F.get(f, j + 1), F.size(m)) - s).alias("n"), F.lit(length).alias("length"))))

    return let(let(let(F.transform(words, lambda x: F.xxhash64(x)), grams), least), kept)


def _digest(words: Column, at: Column, length: Column) -> list[Column]:
    """128 bits of hash that stand for the words of a window."""
    joined = F.array_join(F.slice(words, at + 1, length), " ")
    return [F.xxhash64(joined).alias("d1"), F.xxhash64(F.lit(1), joined).alias("d2")]


def _item_windows(items: DataFrame, item: str, text: str) -> DataFrame:
    """item, length, d1, d2: every window of every item once."""
    held = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), words_of(F.col(text)).alias("w"))

    def cut(w: Column) -> Column:
        length = F.least(F.size(w), F.lit(WINDOW))
        return F.when(F.size(w) > 0, F.transform(_upto(F.size(w) - length + 1), lambda i: F.struct(length.alias("length"), *_digest(w, i, length))))

    return held.select("item", F.explode(let(F.col("w"), cut)).alias("x")).select("item", "x.*").distinct()


def _merged(hits: DataFrame) -> DataFrame:
    """Per key: spans, the windows of ``hits`` merged where they overlap or touch, in order, and n_hit, the words in them."""
    order = Window.partitionBy(*KEY).orderBy("at", "length")
    ends = hits.select(*KEY, "at", "length", (F.col("at") + F.col("length")).alias("end")).distinct()
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.coalesce(F.col("at") <= reach, F.lit(False)), 0).otherwise(1)
    runs = ends.withColumn("new", new).withColumn("run", F.sum("new").over(order)).groupBy(*KEY, "run").agg(F.min("at").alias("start"), F.max("end").alias("end"))
    n = F.sum((F.col("end") - F.col("start")).cast("long")).alias("n_hit")
    return runs.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"), n)


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, item_ids, spans and contaminated.

    A window is ten words of an item in a row, or all words of an item that has fewer; items without words have none.  n_hit counts the
    document's words inside any occurrence of a window, spans are the merged runs of them (start and end, end exclusive, words from 0),
    item_ids the items with such windows, distinct, as strings in order, n_items their number.  Words are compared with A-Z lower-cased
    and nothing else.  Null texts have no words; a null item id is written as an empty string, and rows of an equal id are one item.
    Repeated documents come back once each, with the same result; columns of ``docs`` named like a new one are replaced; no documents give
    no rows, and with no items nothing is hit.  Texts of any length are read whole.
    """
    spark = docs.sparkSession
    windows = written(_item_windows(items, item, item_text), "item_windows")
    lengths = sorted(r.length for r in windows.select("length").distinct().collect())  # ten at most
    found = lambda source: F.explode(let(_folded(F.col(source)), lambda ws: F.concat(*[fingerprints(ws, n) for n in lengths])))
    base = docs.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    nothing = "`__k1` long, `__k2` int, n_hit long, n_items long, item_ids array<string>, spans array<struct<start:int,end:int>>"
    result = _hits(base.select("__text", *text_key(F.col("__text"))), items.select(F.col(item_text).alias("__text")), windows, found) if lengths else spark.createDataFrame([], nothing)
    counted = base.withColumns({"__n": F.size(_folded(F.col("__text"))).cast("long"), "__k1": text_key(F.col("__text"))[0], "__k2": text_key(F.col("__text"))[1]}).drop("__text")
    new = {c: F.col(f"__r.{c}") for c in ("n_hit", "n_items", "item_ids", "spans")}
    joined = counted.join(result.select(*KEY, F.struct("n_hit", "n_items", "item_ids", "spans").alias("__r")), KEY, "left")
    out = with_columns(joined, {
        "n_words": F.col("__n"), "n_hit": F.coalesce(new["n_hit"], F.lit(0)), "n_items": F.coalesce(new["n_items"], F.lit(0)),
        "item_ids": F.coalesce(new["item_ids"], F.array().cast("array<string>")), "spans": F.coalesce(new["spans"], F.array().cast("array<struct<start:int,end:int>>")),
        "contaminated": F.col("__r").isNotNull(),
    })
    return out.drop("__n", "__r", *KEY)


def _hits(texts: DataFrame, items: DataFrame, windows: DataFrame, found) -> DataFrame:
    """Per key of a text that holds a window: n_hit, n_items, item_ids, spans."""
    known = written(items.select(found("__text").alias("f")).select("f.h").distinct(), "item_fingerprints")
    few = known.count() <= SENT
    marks = texts.select(*KEY, found("__text").alias("f")).select(*KEY, "f.*")
    marks = marks.join(F.broadcast(known) if few else known, "h", "left_semi").select(*KEY, "at", "n", "length")
    marks = written(marks.distinct(), "marks")
    # Written before texts are made one for each key: the join's sides are plain exchanges, so Spark can split a hot key's rows.
    held = written(texts.join(marks.select(*KEY).distinct(), KEY, "left_semi"), "marked_texts")
    each = held.groupBy(*KEY).agg(F.first("__text").alias("__text"))
    each = each.join(marks.groupBy(*KEY).agg(F.collect_list(F.struct("at", "n", "length")).alias("marks")), KEY)  # no more marks than words
    starts = F.flatten(F.transform("marks", lambda m: F.transform(_upto(m["n"]), lambda i: F.struct((m["at"] + i).alias("at"), m["length"].alias("length")))))
    cut = let(words_of(F.col("__text")), lambda ws: F.transform(starts, lambda s: F.struct(s["at"].alias("at"), s["length"].alias("length"), *_digest(ws, s["at"], s["length"]))))
    around = each.select(*KEY, F.explode(cut).alias("x")).select(*KEY, "x.*")
    numbered = written(windows.groupBy("d1", "d2").agg(F.min("length").alias("length")).withColumn("window", F.monotonically_increasing_id()), "windows")
    hits = written(around.join(numbered, ["d1", "d2", "length"]).select(*KEY, "at", "length", "window"), "hits")
    having = windows.join(numbered, ["d1", "d2", "length"]).select("window", "item")
    met = hits.select(*KEY, "window").distinct().join(having, "window").select(*KEY, "item").distinct()
    met = met.groupBy(*KEY).agg(F.array_sort(F.collect_list("item")).alias("item_ids")).withColumn("n_items", F.size("item_ids").cast("long"))
    return written(_merged(hits).join(met, KEY).select(*KEY, "n_hit", "n_items", "item_ids", "spans"), "contaminated")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = decontaminate(docs, items)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


SQL = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
    i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
    j AS (SELECT item, w, CAST(least(len(w), {WINDOW}) AS BIGINT) AS n FROM i WHERE len(w) > 0),
    iw AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM j)),
    dw AS (SELECT rid, s, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM j))),
    hit AS (SELECT rid, s, n, k FROM dw WHERE k IN (SELECT k FROM iw)),
    cov AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM hit) GROUP BY rid),
    its AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit JOIN iw USING (n, k) GROUP BY rid)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM d LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)"""

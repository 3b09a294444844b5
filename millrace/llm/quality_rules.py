"""Quality rules learned as a decision list (DataFrame operations only).

Text statistics are built-in expressions inside each row, so the scan needs no shuffle.  Sequential covering learns from
the statistics of labelled documents: a rule grows by the threshold with the best information gain, is pruned on
documents held back, and is kept if it rejects almost nothing good; what it covers leaves, and the next rule starts.  A rule that
would reject too much is refined by further thresholds, and skipped if that doesn't help.
The ordered rules become one conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, let, table, with_columns

WINDOW = 5
#: At most so many labelled documents, those with the smallest hash of their id, train the list.
LABELLED = 8192
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_unique_words"]
FEATURES = ["n_words", "word_length", "symbols", "dup_lines", "repeats", "unique_words"]


def _repeat_words(words: Column) -> Column:
    """Words in windows of five that the text has twice or more: sorts hashes of windows, so a text costs n log n."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def covered(h: Column) -> Column:
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda k, d: F.coalesce(F.get(s, k + d)["h"] == F.get(s, k)["h"], F.lit(False))
            ks = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, -1) | same(k, 1))
            return F.sort_array(F.transform(ks, lambda k: F.get(s, k)["i"]))

        def total(p: Column) -> Column:
            steps = F.when(F.size(p) > 1, F.sequence(F.lit(1), F.size(p) - 1)).otherwise(F.array().cast("array<int>"))
            return F.aggregate(steps, F.lit(WINDOW), lambda a, k: a + F.least(F.lit(WINDOW), F.get(p, k) - F.get(p, k - 1)))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(let(ranked, starts), total))

    return F.when(n < WINDOW + 1, 0).otherwise(let(hashes, covered))


def text_stats(text: Column) -> Column:
    """A struct of STATS, each a long; a null text has no words."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(words).cast("long").alias("n_repeat_words"), F.size(lines).cast("long").alias("n_lines"),
            F.size(F.array_distinct(words)).cast("long").alias("n_unique_words"),
        )

    return let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of)


def features(stat) -> dict[str, Column]:
    """FEATURES from the columns that ``stat(name)`` gives; all are defined for empty texts."""
    n = F.greatest(stat("n_words"), F.lit(1))
    return {
        "n_words": stat("n_words").cast("double"), "word_length": stat("word_chars") / n, "symbols": stat("n_symbols") / n,
        "dup_lines": stat("n_dup_lines") / F.greatest(stat("n_lines"), F.lit(1)), "repeats": stat("n_repeat_words") / n, "unique_words": stat("n_unique_words") / n,
    }


@dataclass
class Rule:
    """A conjunction of (feature, ``<=`` or ``>``, threshold)."""

    terms: list[tuple[str, str, float]] = field(default_factory=list)

    def covers(self, row: dict) -> bool:
        return all(row[f] <= t if op == "<=" else row[f] > t for f, op, t in self.terms)

    def column(self, values: dict[str, Column]) -> Column:
        out = F.lit(True)
        for f, op, t in self.terms:
            out = out & (values[f] <= t if op == "<=" else values[f] > t)
        return out


def _grow(bad: list[dict], good: list[dict], cuts: dict[str, list[float]], most: int, first: Rule | None = None) -> Rule:
    rule = Rule(list(first.terms) if first else [])
    p, n = [r for r in bad if rule.covers(r)], [r for r in good if rule.covers(r)]
    while p and n and len(rule.terms) < most:
        best, before = None, math.log2(len(p) / (len(p) + len(n)))
        for f, at in cuts.items():
            for t in at:
                a, b = sum(r[f] <= t for r in p), sum(r[f] <= t for r in n)
                for op, x, y in (("<=", a, b), (">", len(p) - a, len(n) - b)):
                    if x and (gain := x * (math.log2(x / (x + y)) - before)) > (best[0] if best else 1e-9):
                        best = gain, (f, op, t)
        if not best:
            break
        rule.terms.append(best[1])
        p, n = [r for r in p if rule.covers(r)], [r for r in n if rule.covers(r)]
    return rule


def learn(rows: list[dict], precision: float = 0.995, most_rules: int = 12, most_terms: int = 3, cuts: int = 24) -> list[Rule]:
    """An ordered list of rules that reject.

    rows: FEATURES and ``bad``.  Every third row prunes, the others grow.  A rule stays if at least ``precision`` of
    the labelled rows that it still covers, and three of them, are bad.  One that falls short is tried without pruning and then grown on
    all rows by up to ``most_terms`` more; if that falls short too, the bad rows that it covers guide no further rule.  No
    rows of one kind give no rules.
    """
    grow, prune = [r for i, r in enumerate(rows) if i % 3], rows[::3]
    found: list[Rule] = []
    guides = [r for r in grow if r["bad"]]
    while len(found) < most_rules:
        good = [r for r in grow if not r["bad"]]
        if not guides or not good:
            break
        at = {}
        for f in FEATURES:
            # Thresholds lie between values, half of them among those of bad rows.
            values, both = sorted(r[f] for r in guides), sorted(r[f] for r in guides + good)
            at[f] = sorted({v[(len(v) - 1) * k // cuts] for v in (values, both) for k in range(cuts + 1)})

        def worth(rule: Rule) -> float:
            covered = [x["bad"] for x in prune if rule.covers(x)]
            return (2 * sum(covered) - len(covered)) / max(1, len(covered))

        def sure(rule: Rule, rows=rows) -> bool:
            held = [r["bad"] for r in rows if rule.covers(r)]
            return bool(rule.terms) and sum(held) >= max(3, precision * len(held))

        grown = rule = _grow(guides, good, at, most_terms)
        while len(rule.terms) > 1 and worth(shorter := Rule(rule.terms[:-1])) >= worth(rule):
            rule = shorter
        if not sure(rule):
            rule = grown
        if not sure(rule):
            rule = _grow([r for r in rows if r["bad"]], [r for r in rows if not r["bad"]], at, 2 * most_terms, grown)
        if not grown.terms:
            break  # no threshold tells these from the good ones
        if sure(rule):
            found.append(rule)
            rows, grow, prune = ([r for r in x if not rule.covers(r)] for x in (rows, grow, prune))
            guides = [r for r in guides if not rule.covers(r)]
        else:
            guides = [r for r in guides if not grown.covers(r)]
    return found


def decision_list(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", limit: int = LABELLED) -> list[Rule]:
    """Learns from at most ``limit`` labelled documents; label 0 is bad.

    Null keys and labels are ignored, several labels of a document count each, and no labels give no rules.
    """
    chosen = labels.select(key, label).dropna().orderBy(F.xxhash64(F.col(key)), key, label).limit(limit)
    # At most ``limit`` ids: small enough to send to every task.
    stats = docs.select(key, text).join(F.broadcast(chosen), key).select(key, label, text_stats(F.col(text)).alias("s"))
    found = stats.select(key, (F.col(label) == 0).alias("bad"), *[c.alias(n) for n, c in features(lambda x: F.col(f"s.{x}")).items()])
    return learn([r.asDict() for r in found.orderBy(F.xxhash64(F.col(key)), *FEATURES, "bad").limit(2 * limit).collect()])


def quality(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """``docs`` with STATS, base_failed and kept; same-named columns of ``docs`` are replaced, every row comes back once.

    Null and empty texts have no words and fail the base rules; texts of any length are read whole; no documents give no rows.
    """
    held = docs.withColumn("__s", text_stats(F.col(text)))
    stat = lambda x: F.col(f"__s.{x}")
    failed = (stat("n_words") < 10) | (100 * stat("n_repeat_words") > 20 * stat("n_words"))
    values, verdict = features(stat), F.when(failed, False)
    for rule in rules:
        verdict = verdict.when(rule.column(values), False)
    return with_columns(held, {**{x: stat(x) for x in STATS}, "base_failed": failed, "kept": verdict.otherwise(True)}).drop("__s")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs, decision_list(docs, table(spark, sf_dir, "labels"))).drop("text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, repeated rows each; null, empty and short texts fail the base rules and go."""
    # Columns named like a result come back as they were.
    own = {c: f"__own_{c}" for c in docs.columns if c.lower() in {*STATS, "base_failed", "kept"}}
    held = docs.withColumnsRenamed(own) if own else docs.select("*")
    found = quality(held, decision_list(docs, table(spark, sf_dir, "labels"))).filter("kept")
    return found.select(*[F.col(own.get(c, c)).alias(c) if c in own else c for c in docs.columns])

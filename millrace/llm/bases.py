"""What SQL can say of the operators' results, as queries beside theirs: the columns that every method gives alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import audio, license_scan, mixing, quality_rules, suffix_dedup
from .common import table


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.quality(docs, []).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.licenses(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def mixing_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size")


def media_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.store_texts(table(spark, sf_dir, "documents"), keep_media=False).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def repeats_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that several documents share as a whole, and what was removed of them."""
    docs = table(spark, sf_dir, "documents")
    copies = docs.groupBy("text").count().filter("count > 1 AND octet_length(text) >= 400").select("text")
    found = suffix_dedup.repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans")
    return found.join(docs.join(copies, "text", "left_semi").select("doc_id").distinct(), "doc_id", "left_semi")


# Words of the contracts, and documents with a number for each row.
_WORD = r"[^\x20\x09-\x0D]+"
_DOCS = "SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents"
_LICENCE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _starts(phrase: str, label: str) -> str:
    at = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))
    return f"SELECT rid, i - 1 AS i, '{label}' AS label FROM p WHERE {at}"


QUERIES = {f.__name__: f for f in (quality_base, license_base, mixing_base, media_base, repeats_base)}
ORACLE_SQL = {
    "quality_base": rf"""WITH d AS ({_DOCS}), w AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM d),
        win AS (SELECT rid, i, w[i:i + 4] AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
        dup AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, k) > 1), cov AS (SELECT rid, count(DISTINCT i + j) AS n FROM dup, range(0, 5) AS r(j) GROUP BY rid)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
          CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(w) < 10 OR 100 * coalesce(n, 0) > 20 * len(w) AS base_failed FROM w LEFT JOIN cov USING (rid)""",
    "license_base": rf"""WITH d AS (SELECT rid, doc_id, regexp_extract_all(translate(t, '{_UPPER}', '{_LOWER}'), '{_LICENCE}') AS w FROM ({_DOCS})), p AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d),
        b AS ({" UNION ALL ".join(_starts(p, label) for label, p in license_scan.PHRASES)}),
        g AS (SELECT rid, count(*) AS n, min(i) AS a, max(i) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS s FROM b GROUP BY rid)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, z AS last_word, coalesce(s, '') AS base_labels FROM d LEFT JOIN g USING (rid)""",
    "mixing_base": rf"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size FROM documents)
        SELECT doc_id, size, CAST(sum(size) OVER (PARTITION BY source) AS BIGINT) AS source_size FROM d""",
    "media_base": rf"""WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), p AS (SELECT *, octet_length(b) AS n, CASE WHEN octet_length(b) = 0 THEN {audio.PAD} ELSE ({audio.PAD} - octet_length(b) % {audio.PAD}) % {audio.PAD} END AS more FROM d)
        SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(n + more AS BIGINT) AS payload_bytes, sha256(b || unhex(repeat('FF', CAST(more AS INT)))) AS payload_sha256 FROM p""",
    "repeats_base": """SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(strlen(text) AS BIGINT) AS n_removed, CAST(1 AS BIGINT) AS n_spans FROM documents
        WHERE strlen(text) >= 400 AND text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)""",
}

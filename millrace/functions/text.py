"""Column expressions for texts: no Python runs on executors here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def title_case(c: Column) -> Column:
    """Words, runs of letters and digits, with a capital first letter."""
    parts = F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), "")


def fixed_windows(text: Column, size: int, overlap: int = 0) -> Column:
    """Windows of ``size`` characters that start every ``size - overlap`` (one at least), up to the one that reaches the end."""
    step = max(size - overlap, 1)
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.ceil((n - size) / step).cast("int"))
    many = F.transform(starts, lambda k: F.substr(text, k * step + 1, F.lit(size)))
    return F.when(n == 0, F.array().cast("array<string>")).when(n <= size, F.array(text)).otherwise(many)


def sentences(text: Column) -> Column:
    """Trimmed sentences: they end after . ! ? before white space or the end; empty ones are left out."""
    parts = F.transform(F.split(text, r"(?<=[.!?])(?=\s|$)"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda x: x != "")


def tokens(text: Column) -> Column:
    """Distinct lower-cased runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != ""))


def token_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the token sets; two empty ones are the same."""
    x, y = tokens(a), tokens(b)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def judge_score(reply: Column) -> Column:
    """The number that a reply starts with, out of ten, within [0, 1]; null without a number."""
    found = F.regexp_extract(reply, r"^\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(found.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), found / 10)))


def prompt(template: str, columns: list[str]) -> Column:
    """``template`` with {column} replaced, one column after the other; unknown names stay, null is empty."""
    out = F.lit(template)
    for c in columns:
        out = F.replace(out, F.lit("{" + c + "}"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return out


def hmac_token(value: Column, salt: bytes) -> Column:
    """First 16 bytes of HMAC-SHA256 as hex digits; null stays null."""
    import hashlib

    key = (hashlib.sha256(salt).digest() if len(salt) > 64 else salt).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    digest = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(value, "UTF-8")), 256))
    return F.substring(F.sha2(F.concat(F.lit(outer), digest), 256), 1, 32)


def shown(c: Column, kind: str) -> Column:
    """A value as text; doubles without exponent and without a trailing ``.0``."""
    text = c.cast("string")
    if kind not in ("double", "float"):
        return text
    digits = F.regexp_replace(F.regexp_extract(text, r"^-?([0-9.]+)E", 1), r"\.|0+$", "")
    sign = F.when(text.startswith("-"), "-").otherwise("")
    point = F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int") + 1  # digits before the point; a mantissa has one
    spread = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= F.length(digits), F.concat(digits, F.repeat(F.lit("0"), point - F.length(digits))))
        .otherwise(F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1)))
    )
    return F.when(text.contains("E"), F.concat(sign, spread)).otherwise(F.regexp_replace(text, r"\.0$", ""))

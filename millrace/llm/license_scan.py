"""License scans with a positional index of rare licence words (DataFrame operations only).

Templates are notices of a line and the full texts of public licences, with mandatory key phrases.  The index maps a licence word to its
(template, position) postings and travels as a literal: it has the rarest words of each key phrase, so no template takes votes from
another.  Inverse document frequencies come from all documents.  A file looks its words up; postings vote for (template, file
position - template position), and a vote of enough words is verified: all key phrases of the template must stand at their places
there.  All of it is one projection, without a shuffle of texts.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table, with_columns

LICENCE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Labels and phrases of the base scan.
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

# Label, words that public licences and their notices use, mandatory key phrase.
NOTICES = [
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("cc-by", "this work is licensed under a creative commons attribution license", "creative commons attribution"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    ("lgpl", "licensed under the gnu lesser general public license version 2 1", "lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("reserved", "copyright all rights reserved", "all rights reserved"),
]
# Label, file of a full licence text, mandatory key phrases.
FULL = [
    ("apache", "Apache-2.0", ["apache license version 2 0 january 2004", "terms and conditions for use reproduction and distribution"]),
    ("artistic", "Artistic", ["the artistic license preamble", "some semblance of artistic control"]),
    ("bsd", "BSD", ["source and binary forms with or without modification", "redistributions in binary form must reproduce"]),
    ("cc0", "CC0-1.0", ["cc0 1 0 universal", "statement of purpose"]),
    ("gfdl", "GFDL-1.3", ["gnu free documentation license version 1 3", "everyone is permitted to copy and distribute verbatim copies"]),
    ("gpl", "GPL-2", ["gnu general public license version 2 june 1991", "everyone is permitted to copy and distribute verbatim copies"]),
    ("gpl", "GPL-3", ["gnu general public license version 3 29 june 2007", "everyone is permitted to copy and distribute verbatim copies"]),
    ("lgpl", "LGPL-2.1", ["gnu lesser general public license version 2 1 february 1999", "everyone is permitted to copy and distribute verbatim copies"]),
    ("lgpl", "LGPL-3", ["gnu lesser general public license version 3 29 june 2007", "everyone is permitted to copy and distribute verbatim copies"]),
    ("mpl", "MPL-2.0", ["mozilla public license version 2 0", "means each individual or legal entity"]),
]
VOTES = 2  # rarest words of a key phrase that a file looks up, and votes that must agree on a place


@dataclass
class Template:
    """Words of a licence or notice, and the key phrases that must stand at their places."""

    label: str
    words: list[str]
    keys: list[list[str]]

    def places(self) -> list[tuple[int, list[str]]]:
        """Where each key phrase stands first."""
        return [(next(i for i in range(len(self.words)) if self.words[i : i + len(k)] == k), k) for k in self.keys]


def plain_words(text: str) -> list[str]:
    return re.findall(LICENCE_WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def default_templates() -> list[Template]:
    folder = Path(__file__).parent / "licences"
    full = [Template(label, plain_words((folder / f"{file}.txt").read_text(encoding="utf-8")), [k.split() for k in keys]) for label, file, keys in FULL]
    return [Template(label, body.split(), [key.split()]) for label, body, key in NOTICES] + full


def lowered_words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased.

    ``lower`` also changes other capitals; none of them becomes an ASCII letter except the Kelvin sign and the dotted
    capital I, which are replaced first by another character of words.  So ASCII words and all positions are exact.
    """
    text = F.coalesce(text, F.lit(""))
    for odd in ("K", "İ"):
        text = F.replace(text, F.lit(odd), F.lit("é"))
    return F.regexp_extract_all(F.lower(text), F.lit(LICENCE_WORD), F.lit(0))


def rarity(docs: DataFrame, text: str, words: list[str]) -> dict[str, float]:
    """IDF of ``words`` over all documents; the driver gets one row a word of the templates at most."""
    known = F.array(*[F.lit(w) for w in words])
    found = docs.select(F.explode(F.array_append(F.array_intersect(lowered_words(F.col(text)), known), F.lit("")).alias("w")).alias("w"))
    df = {r.w: r.n for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return {w: math.log((1 + df.get("", 0)) / (1 + df.get(w, 0))) for w in words}


def _phrase_at(words: Column, start: Column, phrase: list[str]) -> Column:
    out = start >= 0
    for k, w in enumerate(phrase):
        out = out & F.coalesce(F.get(words, start + k) == w, F.lit(False))
    return out


def licenses(docs: DataFrame, text: str = "text", templates: list[Template] | None = None, phrases=PHRASES) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels and score.

    n_base counts all places of base phrases, which overlapping ones share; first_word and last_word are the smallest
    and largest start, null without any.  labels has the base ones and those of verified templates, distinct, sorted and
    comma-joined; empty if none.  score is the largest share of a verified template's words that stand at their place,
    and at least 0.5 with a base phrase.  Null and empty texts have no words and score 0; rows come back once each,
    repeated ones too; columns named like a new one are replaced; no documents give no rows.  Texts of any
    length are read whole.
    """
    templates = default_templates() if templates is None else templates
    words = sorted({w for t in templates for k in t.keys for w in k})
    idf = rarity(docs, text, words)
    postings: dict[str, set[tuple[int, int]]] = {}
    for t, template in enumerate(templates):
        for at, key in template.places():
            # Different words, rarest first: where the phrase stands, all of them vote.
            for w in sorted(set(key), key=lambda w: (-idf[w], w))[:VOTES]:
                postings.setdefault(w, set()).update((t, at + i) for i, x in enumerate(key) if x == w)
    index = F.array(*[F.struct(F.lit(w).alias("w"), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in sorted(at)]).alias("at")) for w, at in sorted(postings.items())])
    known = F.array(*[F.lit(w) for w in sorted({*postings, *(p.split()[-1] for _, p in phrases)})])
    # Any match holds a key phrase or a base phrase, so the rarest word of each tells which files need a closer look.
    keys = [t.keys[0] for t in templates] + [p.split() for _, p in phrases]
    telling = F.array(*[F.lit(w) for w in sorted({max(k, key=lambda w: (idf.get(w, math.inf), w)) for k in keys})])

    def closer(ws: Column) -> Column:
        hits = F.filter(F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(known, x["w"]))

        def looked_up(hs: Column) -> Column:
            have = F.array_distinct(F.transform(hs, lambda x: x["w"]))
            return let(F.filter(index, lambda e: F.array_contains(have, e["w"])), lambda top: F.array_sort(F.flatten(F.flatten(F.transform(top, lambda e: F.transform(F.filter(hs, lambda x: x["w"] == e["w"]), lambda x: F.transform(e["at"], lambda a: F.struct(a["t"].alias("t"), (x["i"] - a["p"]).alias("o")))))))))

        def agreed(votes: Column) -> Column:
            return F.array_distinct(F.filter(votes, lambda v, k: F.coalesce(F.get(votes, k + VOTES - 1) == v, F.lit(False))))

        def verified(places: Column) -> Column:
            return F.filter(F.array(*[check(places, t, template) for t, template in enumerate(templates)]), lambda x: x["share"].isNotNull())

        def check(places: Column, t: int, template: Template) -> Column:
            body, n = F.split(F.lit(" ".join(template.words)), " "), len(template.words)

            def share(v: Column) -> Column:
                # Words of the file from the template's first on; those before the file's start count as others.
                skip = F.greatest(-v["o"], F.lit(0))
                file = F.slice(ws, v["o"] + skip + 1, F.lit(n) - skip)
                both = F.zip_with(file, F.slice(body, skip + 1, F.size(file)), lambda x, y: x == y)
                return F.size(F.filter(both, lambda x: x)) / n

            def stands(v: Column) -> Column:
                out = v["t"] == t
                for at, key in template.places():
                    out = out & _phrase_at(ws, v["o"] + at, key)
                return out

            return F.struct(F.lit(template.label).alias("label"), F.array_max(F.transform(F.filter(places, stands), share)).alias("share"))

        def places_of(label: str, phrase: list[str]) -> Column:
            last = len(phrase) - 1
            ends = F.filter(hits, lambda x: (x["w"] == phrase[-1]) & _phrase_at(ws, x["i"] - last, phrase))
            return F.transform(ends, lambda x: F.struct((x["i"] - last).cast("long").alias("start"), F.lit(label).alias("label")))

        base = F.flatten(F.array(*[places_of(label, p.split()) for label, p in phrases]))
        return F.struct(F.size(ws).cast("long").alias("n"), base.alias("base"), let(let(let(hits, looked_up), agreed), verified).alias("more"))

    nothing = "struct<n:bigint,base:array<struct<start:bigint,label:string>>,more:array<struct<label:string,share:double>>>"
    scan = let(lowered_words(F.col(text)), lambda ws: F.when(F.arrays_overlap(ws, telling), closer(ws)).otherwise(F.struct(F.size(ws).cast("long").alias("n"), F.array().alias("base"), F.array().alias("more")).cast(nothing)))
    held = docs.withColumn("__l", scan)
    base, more = F.col("__l.base"), F.col("__l.more")
    base_labels = F.transform(base, lambda x: x["label"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return with_columns(held, {
        "n_words": F.col("__l.n"), "n_base": F.size(base).cast("long"),
        "first_word": F.array_min(F.transform(base, lambda x: x["start"])), "last_word": F.array_max(F.transform(base, lambda x: x["start"])),
        "base_labels": joined(base_labels), "labels": joined(F.concat(base_labels, F.transform(more, lambda x: x["label"]))),
        "score": F.greatest(F.when(F.size(base) > 0, 0.5).otherwise(0.0), F.coalesce(F.array_max(F.transform(more, lambda x: x["share"])), F.lit(0.0))),
    }).drop("__l")


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")

"""A training corpus from the documents table: five stages, each over all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import jaccard_join, mixing, packing, quality_rules, suffix_dedup
from millrace.llm.common import forget, mark, table, written

STAGES = [
    ("quality rules", quality_rules.stage),
    ("n-gram Jaccard join", jaccard_join.stage),
    ("suffix-array dedup", suffix_dedup.stage),
    ("mixing sources", mixing.stage),
    ("best-fit packing", packing.stage),
]

#: Learned rules, random rounding and token ids aren't SQL; tests compare a small run with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents table, each result written before the next stage reads it.

    What a stage has written for itself goes when its result is there.  Nulls, repeated rows and empty texts are as each stage says; no
    documents give no rows.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        since = mark(spark)
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
            forget(spark, since, docs)
    return docs

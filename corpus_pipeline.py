"""A corpus pipeline of five stages over ``documents``: rate quality, join near duplicates, decontaminate, mix, shard.

Every stage takes (spark, docs, sf_dir) and works on all rows the stage before
it kept; its result is written as Parquet and read again as the next one's docs.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from furrow.llm.decontaminate import contaminated
from furrow.llm.folder import table, written
from furrow.llm.jaccard import near_duplicates
from furrow.llm.mixing import mix_to_targets
from furrow.llm.quality import score_quality
from furrow.llm.sharding import SHARDS, shard_rows

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates: shingles of so many words, and the Jaccard similarity in percent.
WORDS, PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of quality 1; empty texts stay or go by its intercept."""
    return score_quality(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id; documents without words and null ids stay."""
    found = near_duplicates(docs, WORDS, PERCENT)
    gone = written(found.where("component_id <> doc_id").select("doc_id").distinct(), "copies")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that match no benchmark item."""
    leaks = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(written(leaks, "leaks"), "doc_id", "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says: at most once, as rates stay within 0 and 1."""
    mixed = mix_to_targets(docs, table(spark, sf_dir, "labels"), max_rate=1.0)
    gone = written(mixed.where("copies = 0").select("doc_id").distinct(), "unmixed")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with row, shard and slot."""
    return shard_rows(docs.select(*COLUMNS), ["doc_id", "n_chars"], SHARDS)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

#: The classifier, the mixing fit and the permutation have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{i}")
    return docs

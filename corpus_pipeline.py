"""The corpus pipeline: five stages over ``documents``, each on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import decontamination, mixing, quality_classifier, sharding, simhash
from pageloom.llm.common import table
from pageloom.session import staged


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    NULL and empty texts are scored like any other; repeated rows are all kept or all dropped. Extra columns stay.
    """
    model = quality_classifier.fit_quality(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality_classifier.quality_score(model, docs) >= quality_classifier.THRESHOLD)


def keep_first_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class (four-word shingles, at most 4 differing bits): the one of the smallest id.

    Different texts with equal ids are different documents; rows without an id are documents like any other, and one stays of a class that has no
    id. Of rows equal in id and text one stays. NULL, empty and blank texts are one class.
    """
    return simhash.first_of_classes(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs. NULL and empty texts have none and stay; repeated rows stay; extra columns too."""
    clean = docs
    for matcher in decontamination.matchers(table(spark, sf_dir, "benchmark")):
        shared = spark.sparkContext.broadcast(matcher)
        clean = clean.where(F.size(decontamination.hits(F.col("text"), shared)["spans"]) == 0)
    return clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a document without words is not taken. Rows keep all their columns."""
    return mixing.mixed_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each row; NULL texts have no bytes, rows that repeat get slots of their own."""
    return sharding.assign_shards(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("near-dedup", keep_first_of_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources", mix_sources),
    ("sharding", shard),
]

#: Classifier and mixing have no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; each result is a table in the shared folder that the next stage reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to packed training sequences, in five stages; each is written and read again by its caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeloom.llm.common import scratch, written
from tapeloom.llm.line_dedup import without_boilerplate
from tapeloom.llm.minhash_dedup import without_near_duplicates
from tapeloom.llm.mixing import mixed
from tapeloom.llm.packing import packed
from tapeloom.llm.quality_rules import passing


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return passing(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found on many sources go, but for the first document that has them; so do documents left without a word."""
    return without_boilerplate(docs, keep_empty=False)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return without_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, in training order."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their place in a sequence. A document that the mix takes twice is packed twice."""
    return packed(docs, 1024, keep_ids=False)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Tokens and similarity of shingle sets are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`. What a stage returns is written to the shared folder for the next one; what it needed for that, and the stage's input, is deleted then."""
    docs, previous = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with scratch(spark) as made:
            docs = written(stage(spark, docs, sf_dir))
            own = made.pop()  # the last one
            if previous:
                made.append(previous)
            previous = own
    return STAGES[-1][1](spark, docs, sf_dir)

"""Corpus pipeline: documents that the classifier accepts, one of each near-duplicate class, none
contaminated, mixed to target weights, and written as token records.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last
return the columns of ``documents``; the last returns the index of the records it wrote. A document
that the mix takes twice has two records.

What a stage wrote on its way is deleted once its output is written, and that output once the next
stage's is, so of the corpus at most two copies stand in the shared folder. The records and their
index, in ``<shared folder>/quarry/tokens-...``, are the product and stay.

Defined cases, which are those of the stages in turn: a null or empty text is scored like any other,
is like no other document, is not contaminated, and has no words, so the mix leaves it out; of
repeated rows one stays; rows with a null doc_id are documents without a class; an empty table, or
one of which nothing is kept, gives an empty index; without labels of both classes every document
has the same score; extra columns go along to the mix, whatever their names, and end there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate, mixing, near_duplicates, quality, token_records
from quarry.llm._common import scratch, settled, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.one_of_each(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_records.digest(spark, docs)


STAGES = [
    ("quality classifier", keep_good),
    ("near-duplicate removal", keep_one_of_each),
    ("benchmark decontamination", keep_clean),
    ("source mixing", mix),
    ("token records", write_tokens),
]
#: SQL cannot express the classifier, the signatures or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(spark, table(spark, sf_dir, "documents"), sf_dir)


def apply(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All stages on ``docs``."""
    with scratch():
        for name, stage in STAGES[:-1]:
            before = docs
            docs = settled(lambda stage=stage, before=before: stage(spark, before, sf_dir), "pipeline-" + name.replace(" ", "-"))
        return STAGES[-1][1](spark, docs, sf_dir)

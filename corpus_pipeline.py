"""A training corpus from ``documents``: STAGES in order, each over all that its predecessor kept.

Every stage takes rows with null, empty and very long texts, ties, repeated rows, empty tables and extra columns; what becomes of
them is said at each. Extra columns go with their rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from stackloom.llm import decontaminate, jaccard_join, language_id, mixing, pii
from stackloom.llm.common import delete, shared_dir
from stackloom.runtime import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is decided, learned from the labelled rows of ``docs`` themselves; an unknown ``lang`` is filled.

    Null texts, texts without a letter and those of too little language go; so do all rows where none has a label. Repeated rows
    are decided alike.
    """
    ship(spark)
    return language_id.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal and near-duplicate texts: that of the smallest id, null last, then of the smallest text digest.

    Rows that repeat id and text leave one; null texts are no copies and stay; texts without a word are copies of equal ones only.
    """
    ship(spark)
    return jaccard_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts stay; a row whose id is that of a leaking one goes with it."""
    ship(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked and ``n_chars`` counted anew. Null texts stay null; no row goes."""
    ship(spark)
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, a row each, with the number of copies. Texts without a word have none to take and go; rows that share an id are taken as often."""
    ship(spark)
    return mixing.apply_mix(docs)


STAGES = [
    ("language_id", language),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("source_mix", mixture),
]

#: The language model and the mix's draws are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to ``documents``; each result is written to the shared folder and read again, the last one stays there."""
    root = f"{shared_dir(spark)}/stackloom/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{root}/{i}-{name}"
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if i:
            delete(spark, f"{root}/{i - 1}-{STAGES[i - 1][0]}")
    return docs

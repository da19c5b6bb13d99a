"""A training corpus from raw documents, in stages. Each stage is written as Parquet and read again.

Defined results, for all stages: an empty table stays empty; other columns are carried along, whatever their names; very long
texts are handled whole. Null and empty texts, having no letter, go with the first stage. Of repeated rows (same text and
doc_id) one stays after exact dedup. Rows with a null doc_id stay unless their text is that of a row with one; among equal texts
without any doc_id one stays, and near copies without any all do, as nothing names one of them. A null source is a source of its
own. Reruns keep the same documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dendrolake.llm import exact_dedup, jaccard_join, language_id, mixing, packing
from dendrolake.llm._shared import Scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of an identified language; those without letters or without a clear lead go."""
    return language_id.identified_documents(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal up to white space, the one with the smallest doc_id."""
    return exact_dedup.unique_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked by shingle similarity, the one with the smallest doc_id."""
    return jaccard_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.digests(docs)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: Language identification by compression has no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.cut(stage(spark, docs, sf_dir), str(i))
        if i:
            scratch.drop(str(i - 1))
    return docs

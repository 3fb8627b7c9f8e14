"""From documents to packed sequences: five stages, each by one operator of tributary.llm.

Every stage reads what its predecessor wrote and keeps all of it but what its own decision removes.

Null texts, empty ones and those without letters are in no known language and go in the first stage; so later stages see texts only.
Very long texts are read whole by every stage.  Rows that repeat are one group of equal texts: one stays.  Rows that share a doc_id but no text all stay;
each stage knows a row by its place (file and row), never by doc_id alone.  Other nulls (doc_id, lang, source) decide nothing but ties, where null is the smallest.
An empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import exact_dedup, jaccard_join, language_id, packing, suffix_dedup
from tributary.llm.common import keep, shared_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those that the models reject go."""
    models = language_id.fit(docs, drop_odd=True)
    names = [c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]  # none that a prediction has
    return language_id.predict(docs.toDF(*names), models).filter("not rejected").select(names).toDF(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates."""
    return jaccard_join.survivors(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one has."""
    return suffix_dedup.strip(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_duplicates", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack_sequences),
]

#: SQL cannot express language models, shingle similarity or packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            keep(docs, folder, name)
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs

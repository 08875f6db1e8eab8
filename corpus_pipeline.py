"""From raw documents to packed training sequences, stage by stage.

Each stage takes the documents its predecessor kept and returns their columns; the
last returns one row for each packed piece. A stage's result is written as Parquet
and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import langid, line_dedup, mixing, near_copies, packing
from graphloom.llm.common import materialise
from graphloom.llm.queries import table, vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay."""
    return langid.keep_known(docs)


def remove_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that spread over many sites go, but for their first document."""
    return line_dedup.dedup_lines(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: by SimHash as in op3 and, beyond
    its reach, by five-word shingles of similarity 0.8 or more."""
    return near_copies.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as the mix of sources asks for."""
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in a training sequence."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("language", identify_language),
    ("lines", remove_boilerplate),
    ("near_copies", remove_near_copies),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: SQL can't express the language model, the fingerprints, the mix or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

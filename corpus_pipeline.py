"""The corpus pipeline: language ID, line dedup, near-dedup, mixing and packing of `documents`.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; all but the
last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language, line_dedup, mixing, near_dedup, packing
from tessera.llm.common import documents, written
from tessera.llm.queries import WORD_BPE


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a learned language: no letter, or like none of them."""
    return language.keep_known(docs, language.train(docs))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that three documents or more share, but in the last of them; every document stays."""
    out = line_dedup.line_dedup(docs).withColumn("text", F.when(F.col("text").isNotNull(), F.col("text_kept")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles stays."""
    return near_dedup.drop_near_duplicates(docs, words=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it: no time, once or twice."""
    return mixing.mix_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 4096 tokens."""
    return packing.pack_documents(docs, WORD_BPE, release=True)


STAGES = [
    ("language ID", known_language),
    ("line dedup", without_repeated_lines),
    ("near-dedup", without_near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
]

#: Models and random rounding aren't SQL; tests/llm checks each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs

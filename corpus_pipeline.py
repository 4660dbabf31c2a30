"""The corpus pipeline: from documents to packed training sequences, each stage over all that the one
before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import exact_dedup, language, mixing, near_dedup, packing
from weftline.llm.common import documents, store
from weftline.llm.queries import vocabulary


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those with less than half of their words in one language."""
    return language.drop_unknown(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space the longest stays, then the smallest doc_id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return near_dedup.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the shares of the curriculum, a row for each copy, in ranges of training position. Texts
    stay whole, so a source may exceed its share by less than one document."""
    return mixing.mixed_documents(docs, whole_texts=True)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 4,096 ids."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), end=1)


STAGES = [("language", keep_known_languages), ("exact dedup", drop_exact_copies), ("near dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack_sequences)]
ORACLE_SQL = None  # language scores, signatures and packing aren't SQL; tests hold the rows against plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

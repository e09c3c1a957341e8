"""A corpus pipeline of five stages over ``documents``; each calls one operator of the ``llm`` subpackage.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, language, mixing, packing, simhash
from tessera.llm.common import discard, materialise
from tessera.llm.queries import table, tokenizer


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go."""
    return language.identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (five-word shingles, similarity 0.8) one document stays."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.sample_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, in sequences of 2048 ids."""
    return packing.pieces(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("language ID", language_id), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing to target weights", mix), ("packing", pack)]

#: No SQL has the language model, the tokenizer or the hash; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)  # what a stage has written goes when the next one has written its own
    return STAGES[-1][1](spark, docs, sf_dir)

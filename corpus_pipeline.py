"""A corpus from documents to packed sequences: stages, each on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from dueline.llm.exact_dedup import drop_duplicates
from dueline.llm.mixing import mix
from dueline.llm.packing import pack
from dueline.llm.quality import keep_good
from dueline.llm.queries import RECIPE, REST, SEED
from dueline.llm.shared import read, written
from dueline.llm.similar import drop_similar


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return keep_good(docs, read(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts."""
    return drop_duplicates(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash fingerprints within 3 bits, or five-word shingles
    with a Jaccard similarity of 0.8 or more."""
    return drop_similar(docs, simhash=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources have their target shares, in random order."""
    return mix(docs, RECIPE, REST, seed=SEED)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens, with their token ids."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mix_sources", mix_sources),
    ("packing", packing),
]

#: Nearest neighbours, XXH64 fingerprints and the tokenizer have no SQL; tests check stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs

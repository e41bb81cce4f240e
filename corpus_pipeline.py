"""The corpus pipeline: five stages over ``documents``, each written and read again before the next one.

Edge cases, as the operators define them: null texts count as empty; null ids, repeated rows and very long texts pass through; empty tables give empty tables; other columns
stay as they are, and ones named like an operator's own columns keep their input values.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import exact_dedup, ordinal_toxicity, packing, poisson_mix, simhash_trie
from foliospark.llm.common import stored, table
from foliospark.ship import ship


CORE = ("doc_id", "text", "lang", "source", "n_chars")


def _filtered(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that a stage returns, with docs' columns: those besides documents' own travel in one struct, so none clashes with an operator's."""
    extra = [c for c in docs.columns if c not in CORE]
    core = [F.col(c) for c in docs.columns if c in CORE]
    out = stage(docs.select(*core, F.struct(*[F.col(f"`{c}`") for c in extra]).alias("_extra")) if extra else docs)
    return out.select(*[F.col(f"_extra.`{c}`").alias(c) if c in extra else F.col(c) for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labelled ones among them, doesn't reject. An empty text has no evidence and stays; without labels of both kinds nothing is rejected."""
    model = ordinal_toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _filtered(docs, lambda d: ordinal_toxicity.grade(d, model).filter("NOT toxic"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, that of the smallest id; null ids after all others, one row of those alike in every column. Null and empty texts are equal."""
    return _filtered(docs, exact_dedup.drop)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, likeness 0.8 or more), that of the smallest id; a null id only where there is no other. Texts without words are copies of each other."""
    return _filtered(docs, simhash_trie.drop)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources have equal shares, in global random order. A null source is one of its own; a document may be drawn zero times; repeated rows draw alike."""
    return _filtered(docs, poisson_mix.mix)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 4096 tokens; a null or empty text is its end token alone."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("near-dedup", near), ("mixing", mixing), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's pieces, from the documents that all stages before kept."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned weights, fingerprints and token ids have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None

"""Corpus preparation: quality rules, toxicity, near-duplicates, packing.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and
returns a DataFrame: the documents it keeps, with the columns of its input, or
for the last stage the packed pieces.  Each stage learns from and works on all
that its predecessor kept.  ``run`` writes every stage's result as Parquet to
the shared checkpoint folder and rereads it for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm import near_dup, packing, quality, toxicity
from lexiflow.llm.common import table
from lexiflow.session import Scratch


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the n-gram likelihood ratio."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def toxicity_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class models don't call toxic."""
    return toxicity.keep_ordinary(docs, table(spark, sf_dir, "labels"))


def near_dup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group (five-word
    shingles, similarity 0.8 or more)."""
    return near_dup.keep_one(docs)


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents, packed into sequences of 1024."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("minhash_near_dedup", near_dup_stage),
    ("packing", packing_stage),
]

# Trained class models, MinHash and byte-pair ids have no SQL form; the tests
# compare every stage with a brute-force version instead.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = scratch.cut(stage(spark, docs, sf_dir), name)
        scratch.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)

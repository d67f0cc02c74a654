"""Documents to packed training sequences: stages over the whole table, each written before the next."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from changelens.llm import jaccard_join, line_dedup, mixing, packing, quality_rules
from changelens.llm.base import read, written
from changelens.session import clear_scratch, scratch_mark

#: Marks of the scratch folders that the last stage took.
_last: list[tuple[int, int]] = []


def stage(fn):
    """A stage starts when the one before is written, so the folders that one worked in can go."""
    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _last:
            clear_scratch(spark, *_last.pop())
        start = scratch_mark()
        out = fn(spark, docs, sf_dir)
        _last.append((start, scratch_mark()))
        return out

    return run_stage


@stage
def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: documents that the base rules and the learned decision list keep."""
    return quality_rules.keep_good(docs, read(spark, sf_dir, "labels"))


@stage
def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: texts without later copies of line runs of 50 words or more."""
    return line_dedup.drop_repeated_lines(docs)


@stage
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: one document of each class at five words and a similarity of 0.8."""
    return jaccard_join.keep_one(docs)


@stage
def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: the mix; a document comes once for every repetition."""
    return mixing.mixed_documents(docs)


@stage
def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5: pieces of token sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", good_documents), ("line_dedup", fresh_lines), ("jaccard_join", one_of_each),
          ("mixing", mixed_sources), ("packing", packed_sequences)]
#: Learned rules and token ids have no SQL; tests/llm/test_brute_force.py holds every stage to SQL or plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to the documents table; every stage is written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

"""The corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes all rows that the one before kept, as read back from Parquet in the shared folder; all but the last
return the columns of `documents`, whatever these are, names that operators use among them.

Null and empty texts, and those of under 50 words, fail the base rule of the first stage and go. Rows without an id are
documents of their own; repeated rows are copies, of which near-dedup keeps one; of equal ids any one may stand for a group.
Labels and benchmark items that are null or of unknown documents count for nothing. Empty tables give an empty result. Very
long texts are taken whole by each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from blockscope.llm.common import load, materialize
from blockscope.llm.decontaminate import decontaminate
from blockscope.llm.line_dedup import drop_repeated_lines
from blockscope.llm.near_dedup import drop_near_duplicates
from blockscope.llm.packing import pack
from blockscope.llm.quality_rules import filter_quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the rules learned from `labels` keep."""
    return filter_quality(docs, load(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of runs of lines of 50 words and more; documents that lose all lines go."""
    return drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked at a similarity of 0.8 over five-word shingles."""
    return drop_near_duplicates(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans that occur in `benchmark` items."""
    return decontaminate(docs, load(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, packed into sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: SQL expresses neither the sketches nor the tokenizer; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Registered queries of the text operators: each applies its operator to a whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockscope.llm import bpe_index, merkle, oracle
from blockscope.llm.common import load, materialize, new_path
from blockscope.llm.decontaminate import contamination
from blockscope.llm.html_extract import extract_main_text
from blockscope.llm.line_dedup import line_report
from blockscope.llm.near_dedup import near_duplicates
from blockscope.llm.ngram import held_out_scores
from blockscope.llm.packing import pack
from blockscope.llm.prefix_trie import prefix_trie
from blockscope.llm.quality_rules import quality_verdicts
from blockscope.llm.sharding import shard_by_bytes
from blockscope.llm.token_counts import token_counts
from blockscope.llm.warc import read_warc, write_warc


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"), width=3, percent=85)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(load(spark, sf_dir, "documents"))


def op3_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_scores(load(spark, sf_dir, "documents"), order=3)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(load(spark, sf_dir, "documents"), shards=8)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(load(spark, sf_dir, "pages"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_warc(load(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return read_warc(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("longest_run")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def packed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts and the replies that follow them, packed under limits of tokens, segments and loss-bearing (reply) tokens at once."""
    path, turns = public_tokenizers.path("word_bpe_49k.json"), load(spark, sf_dir, "conversations")
    example = F.concat_ws(":", "conv_id", "turn").alias("example")
    prompts = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.coalesce("text", F.lit("")).alias("prompt"))
    replies = turns.where("role = 'assistant'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("reply"))
    pairs = materialize(prompts.join(replies, ["conv_id", "turn"]).select(example, "prompt", "reply"), "examples")
    sizes = token_counts(pairs, path, "example", "prompt").select("example", F.col("n_tokens").alias("prompt_tokens"))
    whole = pairs.select("example", F.concat_ws("\n", "prompt", "reply").alias("text")).join(sizes, "example")
    return pack(whole, path, "example", "text", "prompt_tokens", capacity=2048, max_segments=12, max_loss=1024)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe_index.encode(load(spark, sf_dir, "documents"), path, decoded=True).select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = merkle.build_manifest(load(spark, sf_dir, "documents"), claimed=merkle.without_newlines)
    return merkle.verify(manifest).withColumnRenamed("id", "doc_id")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(load(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_ngram_scores": op3_ngram_scores,
    "op4_quality_rules": op4_quality_rules,
    "op5_sharding": op5_sharding,
    "op6_html_extraction": op6_html_extraction,
    "op7_warc": op7_warc,
    "op8_decontamination": op8_decontamination,
    "op9_packing": op9_packing,
    "op10_token_counts": op10_token_counts,
    "packed_conversations": packed_conversations,
    "op11_bpe": op11_bpe,
    "op12_merkle": op12_merkle,
    "op13_prefix_trie": op13_prefix_trie,
}
#: The others need a tokenizer, a parser, a learned model or sums of logarithms, which SQL does not give to the last bit; tests/llm checks them.
ORACLE: dict[str, str] = {
    "op1_near_dedup": oracle.NEAR_DEDUP,
    "op2_line_dedup": oracle.LINE_DEDUP,
    "op7_warc": oracle.WARC,
    "op8_decontamination": oracle.DECONTAMINATION,
    "op12_merkle": oracle.MERKLE,
    "op13_prefix_trie": oracle.PREFIX_TRIE,
}

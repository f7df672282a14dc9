"""The queries opN_<name>: each operator over its whole table, with the columns that can be checked."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.decontaminate import leaks
from tallyforge.llm.html_text import html_text
from tallyforge.llm.langid import language_id
from tallyforge.llm.minhash import document_fingerprints
from tallyforge.llm.packing import pack
from tallyforge.llm.shared import table
from tallyforge.llm.sharding import shard
from tallyforge.llm.simhash import simhash_components
from tallyforge.llm.suffix_dedup import suffix_dedup
from tallyforge.llm.token_counts import token_counts
from tallyforge.llm.toxicity import toxicity

ORACLES: dict[str, str] = {}


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op2_differencing_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 16 shards of near equal bytes, equal texts together."""
    return shard(table(spark, sf_dir, "documents"), shards=16)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; a third of them, by crc32 of doc_id, is held out from learning."""
    return language_id(table(spark, sf_dir, "documents"), mod=3, held=1)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other numbers, names and units."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document; a fifth of them, by crc32 of doc_id, is held out from learning."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), mod=5, held=0)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes in strings of 200 bytes that start more than once are removed from every document."""
    return suffix_dedup(table(spark, sf_dir, "documents"), width=200, digest=True).withColumnRenamed("kept", "kept_sha256")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose fingerprints differ in at most 3 bits."""
    out = simhash_components(table(spark, sf_dir, "documents"), distance=3, width=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a token counts where its first character is."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "first")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All visible text of every page."""
    return html_text(table(spark, sf_dir, "pages"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its text with an edited end."""
    return document_fingerprints(table(spark, sf_dir, "documents"))


_ALL = (
    op1_best_fit_packing, op2_differencing_shards, op3_language_id, op4_benchmark_decontamination, op5_toxicity, op6_suffix_dedup,
    op7_simhash_near_dedup, op8_token_counts, op9_html_text, op10_document_fingerprints,
)
QUERIES = {f.__name__: f for f in _ALL}

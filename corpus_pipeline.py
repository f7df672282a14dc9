"""The corpus pipeline: toxic documents go, then near duplicates, repeated passages and benchmark leaks; the rest is packed.

Each stage works on all rows that its predecessor kept and returns the columns of ``documents``; the last returns the
packed pieces. In every stage null ids and texts, empty and very long texts, repeated rows, empty tables and further columns
of any name are as its operator's docstring says: only near copies, toxic documents and leaks go, whole rows at a time, and
only repeated passages are cut. Without labels of both kinds no document is toxic; without items none leaks.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm.decontaminate import without_leaks
from tallyforge.llm.jaccard import without_similar
from tallyforge.llm.packing import pack
from tallyforge.llm.shared import discard, scratch, table, written
from tallyforge.llm.simhash import without_near_duplicates
from tallyforge.llm.suffix_dedup import without_repeats
from tallyforge.llm.toxicity import fit, without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go; the classifier learns from all labels of documents that came in."""
    return without_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the least doc_id stays: first by fingerprints of five words, then by exact similarity.

    Fingerprints at 3 or fewer differing bits find the close copies, whole groups at a time; of 64 bits some ten differ at a
    similarity of 0.8, so the documents left are compared by the Jaccard similarity of their runs of five words, 0.8 or more.
    """
    return without_similar(written(without_near_duplicates(docs, width=5), "distinct"))


def cut_repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 200 bytes that start more than once go from every document; the document stays with the rest."""
    return without_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, in sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeated_text),
    ("benchmark_decontamination", drop_leaks),
    ("best_fit_packing", pack_sequences),
]

#: A trained classifier, similarity by hashes and a tokenizer have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch():
            docs = written(stage(spark, before, sf_dir), name, keep=True)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)

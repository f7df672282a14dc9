"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit storage.

Each run of five words is hashed once; the leading bits name one of ``BINS`` bins and a bin keeps its least remaining
value. An empty bin takes the value of the bin that a sequence of hashes, the same for every document, names first
among the filled ones. Stored are the low 8 bits of each value; the share of equal bins is corrected for the 1/256
chance of equal bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm import bytewise as B
from tallyforge.llm.shared import NO_ID, batches, text_or_empty, written

BINS = 256
WORDS = 5
_EMPTY = np.uint64(2**64 - 1)


def _densified(least: np.ndarray) -> np.ndarray:
    filled = least != _EMPTY
    row, bin_ = np.nonzero(~filled & filled.any(axis=1)[:, None])
    bins, t = np.uint64(least.shape[1]), 0
    while len(row):
        t += 1
        at = (B.mix(bin_.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(t)) % bins).astype(np.int64)
        hit = filled[row, at]
        least[row[hit], bin_[hit]] = least[row[hit], at[hit]]
        row, bin_ = row[~hit], bin_[~hit]
    return least


def fingerprint_batch(texts: list[bytes], bins: int = BINS, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(documents x bins) bytes, and whether the document has any word. Upper-case A-Z count as lower case."""
    out, some = np.zeros((len(texts), bins), np.uint8), np.zeros(len(texts), bool)
    if not texts:
        return out, some
    data, ends = B.joined(texts)
    data = B.lowered(data)
    starts, stops = B.words(data)
    h, doc = B.shingles(B.spans(data, starts, stops), np.searchsorted(ends, starts), width)
    if not len(h):
        return out, some
    shift = np.uint64(64 - (bins.bit_length() - 1))
    cell = doc * bins + (h >> shift).astype(np.int64)
    least = np.full(len(texts) * bins, _EMPTY)
    np.minimum.at(least, cell, B.mix(h & ((np.uint64(1) << shift) - np.uint64(1))) >> np.uint64(1))
    least = least.reshape(len(texts), bins)
    some = (least != _EMPTY).any(axis=1)
    out[some] = (_densified(least[some]) & np.uint64(255)).astype(np.uint8)
    return out, some


def likeness(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of rows; two documents without words are alike, one without is unlike."""
    chance = 1 / 256
    raw = ((a == b).mean(axis=-1) - chance) / (1 - chance)
    return np.where(some_a & some_b, np.clip(raw, 0, 1), (some_a == some_b).astype(float))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_FIELDS = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _compared(texts: list[str], following: list[str], of: np.ndarray, some: np.ndarray, of_next: np.ndarray, some_next: np.ndarray) -> dict:
    changed = [edited(a, b).encode() for a, b in zip(texts, following, strict=True)]
    e, some_e = fingerprint_batch(changed)
    raw = lambda x, ok: [r.tobytes() if k else b"" for r, k in zip(x, ok, strict=True)]
    return {
        "n_chars": [len(t) for t in texts], "edited_sha256": [hashlib.sha256(c).digest() for c in changed], "fingerprint": raw(of, some), "edited_fingerprint": raw(e, some_e),
        "near_edited": likeness(of, e, some, some_e), "near_next": likeness(of, of_next, some, some_next),
    }


def _neighbours(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For a sorted partition: results of all rows but the last; the texts of the first and the last."""
    part = TaskContext.get().partitionId()
    held, first = None, True
    for frame in batches(frames, most=1 << 19):
        ids, texts = frame.id.tolist(), frame.text.tolist()
        of, some = fingerprint_batch([t.encode() for t in texts])
        if first:
            yield pd.DataFrame({"id": [ids[0]], "part": [part], "kind": [1], "text": [texts[0]]}).reindex(columns=["id", "part", "kind", "text", *_FIELDS])
            first = False
        if held is not None:
            ids, texts = [held[0], *ids], [held[1], *texts]
            of, some = np.vstack((held[2][None], of)), np.concatenate(([held[3]], some))
        if len(ids) > 1:
            got = _compared(texts[:-1], texts[1:], of[:-1], some[:-1], of[1:], some[1:])
            yield pd.DataFrame({"id": ids[:-1], "part": part, "kind": 0, "text": None} | got)
        held = (ids[-1], texts[-1], of[-1], some[-1])
    if held is not None:
        yield pd.DataFrame({"id": [held[0]], "part": [part], "kind": [2], "text": [held[1]]}).reindex(columns=["id", "part", "kind", "text", *_FIELDS])


def _ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches(frames):
        texts, following = frame.text.tolist(), frame.following.tolist()
        of, some = fingerprint_batch([t.encode() for t in texts])
        of_next, some_next = fingerprint_batch([t.encode() for t in following])
        yield pd.DataFrame({"id": frame.id.tolist()} | _compared(texts, following, of, some, of_next, some_next))


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and how alike they and the next document's are.

    The next document is the next lower doc_id (null ids last, equal ids by a hash of the text; after the last comes
    the first; equal rows are dealt over partitions in any order). A null text counts as empty; a text without words has the fingerprint ''; a single document is its own
    next; an empty table gives no rows; other columns do not matter. Texts are dealt once, by ranges of doc_id; a
    partition writes the texts of its first and last row, and those few meet in a second step.
    """
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("id"), text_or_empty().alias("text"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("id").desc(), F.xxhash64("text").desc(), F.col("row")]  # the row number lets a row that comes very often be cut by ranges too
    kinds = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    done = written(dealt.mapInPandas(_neighbours, f"id long, part int, kind int, text string, {kinds}"), "minhash")
    firsts = done.where("kind = 1").select("part", F.col("text").alias("following"))
    # as many rows as partitions
    ring = firsts.select("part").withColumn("after", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())))
    lasts = done.where("kind = 2").select("id", "part", "text").join(ring, "part")
    pairs = lasts.join(firsts.withColumnRenamed("part", "after"), "after").select("id", "text", "following")
    more = pairs.mapInPandas(_ends, f"id long, {kinds}")
    out = done.where("kind = 0").select("id", *_FIELDS).unionByName(more)
    text: dict[str, Column] = {c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")}
    return out.withColumns(text).withColumn("doc_id", F.when(F.col("id") != NO_ID, F.col("id"))).select("doc_id", *_FIELDS)

"""Best-fit packing planned on a histogram of lengths.

Documents become pieces of at most ``capacity`` tokens. Only the number of pieces of each length goes to the planner,
which runs best-fit decreasing over counts: all sequences with the same room left are one class, and a step moves as
many pieces of one length as the class with the tightest room takes. A plan line says that pieces of one length,
ranks [first, first + n), go to consecutive sequences at one offset. Pieces then take their places by joining on their
rank within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import batches, ranked, text_or_empty, through_pandas, written
from tallyforge.llm.tokens import word_encoder

CAPACITY = 2048


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Lines (length, first rank, n, first sequence, offset) that place every piece once.

    Classes of sequences are runs of consecutive numbers with equal room. Lengths go from long to short, each into the
    class of least sufficient room; new sequences open only when no open one has room. Each step uses up a length or a
    run, and makes at most one run more, so lines are bounded by lengths and not by pieces.
    """
    lines: list[tuple[int, int, int, int, int]] = []
    rooms: dict[int, list[list[int]]] = {}  # room left -> runs [first sequence, n]
    sequences = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        if length > capacity or length < 1:
            raise ValueError(f"no piece of {length} tokens fits a sequence of {capacity}")
        while left:
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:
                each = capacity // length
                room, n = capacity, -(-left // each)
                rooms[room] = [[sequences, n]]
                sequences += n
            first, n = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
            each, offset = room // length, capacity - room
            # as many full runs of ``each`` pieces as there are, then one sequence with the rest
            if left >= each:
                take = min(n, left // each)
                per = each
            else:
                take, per = 1, left
            for k in range(per):
                lines.append((length, rank, take, first, offset + k * length))
                rank += take
            left -= per * take
            rooms.setdefault(room - per * length, []).append([first, take]) if room > per * length else None
            if take < n:
                rooms.setdefault(room, []).append([first + take, n - take])
    return lines


def _pieces(path: str, capacity: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = word_encoder(path)
        for frame in batches(frames):
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for i, ids in zip(frame.doc_id, encode(frame.text.tolist()), strict=True):
                ids += b"\0\0\0\0"  # 4 bytes an id; id 0 ends the document
                for piece, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    for k, v in zip(out, (i, piece, a // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        out[k].append(v)
            yield pd.DataFrame(out)
        encode.forget()  # the worker serves other stages next

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and a closing 0, cut into pieces."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return through_pandas(rows, ("doc_id",), _pieces(tokenizer, capacity), "piece int, start long, length long, ids_crc32 long", text=text_or_empty())


def placed(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces; any column order and further columns may come along."""
    counts = {r.length: r.n for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    lines = plan(counts, capacity)
    spark = made.sparkSession
    frame = pd.DataFrame(lines, columns=["length", "first", "n", "sequence", "offset"]).astype("int64")
    tables = {int(x): t[["first", "n", "sequence", "offset"]].to_numpy() for x, t in frame.groupby("length")}
    order = [c for c in ("doc_id", "piece", "ids_crc32") if c in made.columns] or made.columns
    rows = ranked(made, ["length"], order, "pack")
    known = spark.sparkContext.broadcast(tables)  # plan lines: bounded by lengths squared, see plan()

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in frames:
            sequence, offset = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
            length, rank = part["_length"].to_numpy(), part["_rank"].to_numpy()
            for x in np.unique(length):
                i = np.flatnonzero(length == x)
                t = known.value[int(x)]
                k = np.searchsorted(t[:, 0], rank[i], side="right") - 1
                sequence[i], offset[i] = t[k, 2] + rank[i] - t[k, 0], t[k, 3]
            yield part.drop(columns=["_length", "_rank"]).assign(sequence_id=sequence, offset=offset)

    return through_pandas(rows, tuple(made.columns), place, "sequence_id long, offset long", _length=F.col("length"), _rank=F.col("rank"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Packs every document into sequences of at most ``capacity`` tokens; one row per piece.

    A null text counts as empty: its only token is the closing 0. Null and repeated ids stay, each row a document of
    its own; an empty table gives no rows; other columns do not matter.
    """
    return placed(written(pieces(docs, tokenizer, capacity), "pieces"), capacity)

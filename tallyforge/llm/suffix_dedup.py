"""Suffix-array deduplication: remove every byte covered by a ``width``-byte string that starts more than once.

A suffix array over all positions does not fit a budget of a few times the input, so the array is sparse. Every
``width``-byte string names one anchor inside itself: the place of its smallest hashed ``lead``-byte string. Equal
strings name equal anchors at equal places, so two equal strings always meet among the suffixes that begin at anchors.

1. ``anchors``: each anchor with the range of string starts that name it (about one anchor in 85 bytes).
2. Anchors whose leading bytes occur once in the corpus are done; the rest fetch their surrounding bytes.
3. Sampled splitters (Spark's range partitioner) deal the suffixes by their leading bytes. A bucket sorts its suffixes
   by multikey quicksort over 8-byte symbols, and what stands before them, read backwards, likewise. Neighbours' common
   prefixes cut both orders into intervals for every length; a string that begins o bytes before its anchor occurs
   again if another suffix shares its interval of width - o bytes onwards and its interval of o bytes backwards.
4. Suffixes with the same leading bytes in more than one bucket compare across boundaries: each bucket sends a 128-bit
   hash of the strings it saw once, and one hash for each that it saw more often.
5. Starts of repeated strings become byte ranges, merged for each document.

Within a bucket strings are compared byte for byte. Rows are found again by (doc_id, xxhash64 of the text), so null or
repeated ids do no harm; repeated rows are repeated text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import bytewise as B
from tallyforge.llm.shared import NO_ID, batches, beside_row, discard, spread_join, text_or_empty, written

WIDTH = 200
LEAD = 32
#: Anchors with the same leading bytes beyond which they are dealt over more than one bucket.
SPLIT = 4096
#: Bytes looked at together.
CHUNK = 1 << 18
#: Low bits of an anchor's rank that hold its place; the same number for every chunk, so that equal strings name equal anchors.
PLACE_BITS = 24


def anchors(data: np.ndarray, width: int, lead: int) -> tuple[np.ndarray, ...]:
    """Places of anchors, the first and last string start that name each, and the hash of their leading bytes."""
    h = B.strings(data, lead)
    n = len(data) - width + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, B.U),)
    if len(h) >> PLACE_BITS:
        raise ValueError(f"{len(h)} strings at once; {1 << PLACE_BITS} at most")
    bits = B.U(PLACE_BITS)
    least = ((h >> bits) << bits) | np.arange(len(h), dtype=B.U)  # the leftmost wins a tie
    window, w, full = width - lead + 1, 1, least
    while 2 * w <= window:
        full = np.minimum(full[:-w], full[w:])
        w *= 2
    full = np.minimum(full[:n], full[window - w : window - w + n])
    at = (full & ((B.U(1) << bits) - B.U(1))).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
    last = np.concatenate((first[1:] - 1, [n - 1]))
    return at[first], first, last, h[at[first]]


def _find_anchors(width: int, lead: int):
    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, most=CHUNK):
            texts = [t.encode() for t in frame.text]
            rows = [i for i, t in enumerate(texts) if len(t) >= width]
            if not rows:
                continue
            ends = np.cumsum([len(texts[i]) for i in rows])
            data = np.frombuffer(b"".join(texts[i] for i in rows), np.uint8)
            out = []
            for a in range(0, len(data) - width + 1, CHUNK):
                at, first, last, h = anchors(data[a : a + CHUNK + width - 1], width, lead)
                at, first, last = at + a, first + a, last + a
                doc = np.searchsorted(ends, first, side="right")
                # a range of starts may run on into the next documents; each keeps the part whose strings end in it
                more = np.searchsorted(ends, last, side="right")
                spread = np.repeat(np.arange(len(at)), more - doc + 1)
                step = np.arange(len(spread)) - np.repeat(np.cumsum(more - doc + 1) - (more - doc + 1), more - doc + 1)
                doc = doc[spread] + step
                begin = np.where(doc > 0, ends[doc - 1], 0)
                lo, hi = np.maximum(first[spread], begin), np.minimum(last[spread], ends[doc] - width)
                ok = lo <= hi
                out.append((doc[ok], (at[spread] - begin)[ok], (lo - begin)[ok], (hi - begin)[ok], h[spread][ok]))
            doc, at, lo, hi, h = (np.concatenate(x) for x in zip(*out, strict=True))
            rows = np.array(rows)[doc]
            yield pd.DataFrame({"lead": h.view(np.int64), "id": frame.id.to_numpy()[rows], "th": frame.th.to_numpy()[rows], "at": at.astype(np.int32), "lo": lo.astype(np.int32), "hi": hi.astype(np.int32)})

    return find


def _fetch(width: int, lead: int, most: int = 4096):
    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ("first", "salt", "id", "th", "lo", "back", "context")
        out: list[tuple] = []
        for frame in batches(frames, most=CHUNK):
            for text, i, th, found in zip(frame.text, frame.id, frame.th, frame.found, strict=True):
                data = text.encode()
                for x in found:
                    at, lo, hi = x["at"], x["lo"], x["hi"]
                    out.append((data[at : at + lead], x["salt"], i, th, lo, at - lo, data[lo : hi + width]))
                    if len(out) == most:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
        yield pd.DataFrame(out, columns=columns)

    return fetch


def multikey_order(keys: np.ndarray) -> np.ndarray:
    """The order of byte strings of one length (rows of bytes) by multikey quicksort: by one 8-byte symbol, then on within each tie."""
    n, wide = len(keys), -(-keys.shape[1] // 8) * 8
    padded = np.zeros((n, wide), np.uint8)
    padded[:, : keys.shape[1]] = keys
    symbols = padded.view(">u8").astype(np.uint64)
    order = np.argsort(symbols[:, 0], kind="stable") if wide else np.arange(n)
    group = np.concatenate(([0], np.cumsum(np.diff(symbols[order, 0]) != 0))) if wide and n else np.zeros(n, np.int64)
    for depth in range(1, symbols.shape[1]):
        tied = np.zeros(n, bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)  # ties stay together, each in its own stretch
        if not len(at):
            break
        symbol = symbols[order[at], depth]
        by = np.lexsort((symbol, group[at]))
        order[at], symbol = order[at][by], symbol[by]
        new = np.ones(n, bool)
        new[1:] = ~same
        split = np.flatnonzero(symbol[1:] != symbol[:-1]) + 1
        new[at[split]] = True
        group = np.cumsum(new)
    return order


def common_prefixes(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of each row in order, how many leading bytes it shares with the row before; the first shares none."""
    out = np.zeros(len(order), np.int64)
    for a in range(1, len(order), 1 << 12):
        x = keys[order[a - 1 : a + (1 << 12)]]
        differ = x[1:] != x[:-1]
        out[a : a + len(differ)] = np.where(differ.any(axis=1), differ.argmax(axis=1), keys.shape[1])
    return out


def _gathered(data: np.ndarray, start: np.ndarray, step: int, size: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``width`` bytes, the first ``size`` of them from ``start`` in steps of 1 or -1, then zeros."""
    place = np.arange(width)
    inside = place < size[:, None]
    at = np.where(inside, start[:, None] + step * place, 0)
    return np.where(inside, data[at], 0) if len(data) else np.zeros((len(size), width), np.uint8)


def repeats(context: list[bytes], back: np.ndarray, width: int, reach: int) -> tuple[np.ndarray, ...]:
    """Of the strings of the contexts that may occur again: the context, its place there, whether it does occur again among them, and whether it is the first of its kind.

    ``back`` is how far into a context its anchor stands, ``reach`` the most that it can be. Strings are compared only with those as far from
    their anchor; those whose neighbours have too little in common are left out. The places of a context come in order and without a gap.
    """
    data = np.frombuffer(b"".join(context), np.uint8)
    sizes = np.fromiter(map(len, context), np.int64, len(context))
    begin = np.cumsum(sizes) - sizes
    count = sizes - width + 1
    n, lengths = len(context), np.arange(reach + 1)
    onward = _gathered(data, begin + back, 1, sizes - back, width)
    backward = _gathered(data, begin + back - 1, -1, back, max(1, reach))
    interval, most = [], []
    for keys, needed in ((onward, width - lengths), (backward, lengths)):
        order = multikey_order(keys)
        shared = common_prefixes(keys, order)
        number = np.zeros((n, reach + 1), np.int32)
        number[order] = np.cumsum(shared[:, None] < needed, axis=0, dtype=np.int32)
        interval.append(number)
        near = np.zeros(n, np.int64)
        near[order] = np.maximum(shared, np.append(shared[1:], 0))
        most.append(near)
    # a string begins ``off`` bytes before its anchor
    low, high = np.maximum(back - count + 1, width - most[0]), np.minimum(back, most[1])
    some = np.maximum(0, high - low + 1)
    row = np.repeat(np.arange(n), some)
    off = high[row] - (np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some))
    key = (off * (n + 1) + interval[0][row, off]) * (n + 1) + interval[1][row, off]
    twice, first = np.zeros(len(row), bool), np.ones(len(row), bool)
    by = np.argsort(key, kind="stable")
    same = key[by[1:]] == key[by[:-1]]
    twice[by[1:][same]] = True
    twice[by[:-1][same]] = True
    first[by[1:][same]] = False
    return row, back[row] - off, twice, first


def _bucket(width: int, lead: int, rows_at_once: int = 1024, strings_at_once: int = 1 << 15):
    """For a partition sorted by leading bytes: ranges of repeated starts, and hashes for other buckets where needed.

    Suffixes of other leading bytes share no interval, so several groups are compared at once.
    """

    def compare(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        context, lo, ids, th = rows.context.tolist(), rows.lo.to_numpy(np.int64), rows.id.to_numpy(), rows.th.to_numpy()
        row, place, twice, first = repeats(context, rows.back.to_numpy(np.int64), width, width - lead)
        a, b = _starts(twice, row, place)
        yield pd.DataFrame({"id": ids[row[a]], "th": th[row[a]], "a": lo[row[a]] + place[a], "b": lo[row[a]] + place[b - 1], "h": 0, "g": 0, "open": 0})
        split = np.flatnonzero(rows.salt.to_numpy() >= 0)
        if not len(split):
            return
        count = np.fromiter((len(c) - width + 1 for c in context), np.int64, len(context))
        begin = np.cumsum(count) - count
        open_ = np.ones(count.sum(), np.int8)  # 0: another of its kind stands for it
        open_[begin[row] + place] = np.where(first, 1 + twice, 0)
        each = max(1, strings_at_once // (width - lead + 1))
        for k in range(0, len(split), each):
            some = split[k : k + each]
            r = np.repeat(some, count[some])
            p = np.arange(len(r)) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
            kept = open_[begin[r] + p]
            r, p, kept = r[kept > 0], p[kept > 0], kept[kept > 0]
            h = np.frombuffer(b"".join([xxhash.xxh3_128_digest(context[x][y : y + width]) for x, y in zip(r.tolist(), p.tolist(), strict=True)]), np.int64).reshape(-1, 2)
            yield pd.DataFrame({"id": ids[r], "th": th[r], "a": lo[r] + p, "b": lo[r] + p, "h": h[:, 0], "g": h[:, 1], "open": kept})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for frame in frames:
            for a in range(0, len(frame), rows_at_once):
                part = frame.iloc[a : a + rows_at_once]
                held.append(part)
                size += len(part)
                if size < rows_at_once:
                    continue
                rows = pd.concat(held, ignore_index=True)
                tail = rows["first"].iloc[-1]
                salt = rows["salt"].iloc[-1]
                done = ((rows["first"] != tail) | (rows["salt"] != salt)).to_numpy()
                if done.any():
                    yield from compare(rows[done])
                held, size = [rows[~done]], int((~done).sum())
        if size:
            yield from compare(pd.concat(held, ignore_index=True))

    return run


def _starts(twice: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of repeated starts; a run ends with its row."""
    edge = np.concatenate(([True], row[1:] != row[:-1]))
    begin = twice & (edge | np.concatenate(([True], ~twice[:-1])))
    end = twice & np.concatenate((edge[1:] | ~twice[1:], [True]))
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def repeated_ranges(docs: DataFrame, width: int = WIDTH, lead: int = LEAD, split: int = SPLIT) -> DataFrame:
    """(id, th, ranges): for each document with repeated strings, [first, last] starts of them (bytes)."""
    lead = min(lead, width)
    ids = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("id"), text_or_empty().alias("text"))
    ids = ids.withColumn("th", F.xxhash64("text"))
    long_enough = ids.where(F.octet_length("text") >= width)
    schema = "lead long, id long, th long, at int, lo int, hi int"
    found = written(long_enough.mapInPandas(_find_anchors(width, lead), schema), "anchors")
    often = written(found.groupBy("lead").agg(F.count("*").alias("n")).where("n > 1"), "leads")
    salt = F.when(F.col("n") > split, F.pmod(F.xxhash64("id", "th", "at"), F.ceil(F.col("n") / split)).cast("int")).otherwise(-1)
    again = spread_join(found, often, ["lead"], "n", found.count()).select("id", "th", F.struct("at", "lo", "hi", salt.alias("salt")).alias("x"))
    lists = written(again.groupBy("id", "th").agg(F.collect_set("x").alias("found")), "candidates")
    # repeated rows stay repeated here, as they should: each is a place where the string starts
    rows = long_enough.join(lists, ["id", "th"])
    contexts = written(rows.mapInPandas(_fetch(width, lead), "first binary, salt int, id long, th long, lo int, back int, context binary"), "contexts")
    discard(found, often, lists)
    dealt = contexts.repartitionByRange("first", "salt").sortWithinPartitions("first", "salt")
    seen = written(dealt.mapInPandas(_bucket(width, lead), "id long, th long, a int, b int, h long, g long, open byte"), "compared")
    discard(contexts)
    across = seen.where("open > 0")
    more = across.groupBy("h", "g").agg(F.sum("open").alias("n")).where("n > 1")
    late = across.where("open = 1").join(more, ["h", "g"]).select("id", "th", "a", "b")
    ranges = seen.where("open = 0").select("id", "th", "a", "b").unionByName(late)
    return ranges.groupBy("id", "th").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))


def _covered(ranges, width: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((x["a"], x["b"] + width) for x in ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(width: int, digest: bool):
    def cut(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for text, ranges in zip(frame.text, frame.ranges, strict=True):
            data, at, kept, spans = text.encode(), 0, [], []
            for a, b in _covered(ranges, width) if ranges is not None else []:
                kept.append(data[at:a])
                spans.append((a, b))
                at = b
            left = b"".join([*kept, data[at:]])
            removed = len(data) - len(left)
            rows.append((len(data), removed, len(spans), hashlib.sha256(left).hexdigest() if digest else left.decode(errors="ignore")))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    return cut


def _cut_rows(docs: DataFrame, row: Column, width: int, digest: bool) -> DataFrame:
    """(_row, n_bytes, n_removed, n_spans, kept) for every row of ``docs``."""
    found = written(repeated_ranges(docs, width).withColumn("part", F.lit(-1)), "ranges")
    keyed = docs.select(row.alias("_row"), F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("id"), text_or_empty().alias("text"))
    # texts that are too short have no ranges; they join under keys that do not meet, or those without an id would gather
    # (the other side's is written: a literal would be folded into the condition and leave the key)
    short = F.octet_length("text") < width
    keyed = keyed.withColumns({"th": F.xxhash64("text"), "part": F.when(short, F.spark_partition_id()).otherwise(-1)})
    rows = keyed.join(found, ["id", "th", "part"], "left")
    return beside_row(rows, F.col("_row"), _cut(width, digest), "n_bytes long, n_removed long, n_spans long, kept string", text=F.col("text"), ranges=F.col("ranges"))


def suffix_dedup(docs: DataFrame, width: int = WIDTH, digest: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Removes repeated strings of ``width`` bytes from ``docs`` (doc_id, text).

    Returns doc_id, the columns in ``keep``, n_bytes, n_removed, n_spans and ``kept``: the remaining text, or with
    ``digest`` the SHA-256 of the remaining bytes. A null text counts as empty; texts shorter than ``width`` lose
    nothing; null and repeated ids and repeated rows stay, and a repeated row is repeated text; an empty table gives an
    empty result; other columns of ``docs`` do not matter, whatever they are called. Where a range begins or ends
    within a character, the remaining text goes without that character's loose bytes.
    """
    row = F.struct("doc_id", *[F.col(f"`{c}`") for c in keep if c != "doc_id"])
    return _cut_rows(docs, row, width, digest).select("_row.*", "n_bytes", "n_removed", "n_spans", "kept")


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """All rows and columns of ``docs``, with the remaining text as ``text`` and its length as ``n_chars``, if there is such a column.

    Every document stays, be it with an empty text; a null text stays null. Otherwise as ``suffix_dedup``.
    """
    kept = [c for c in docs.columns if c not in ("text", "n_chars")]
    row = F.struct(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("kept"), F.col("text").isNull().alias("gone"))
    out = _cut_rows(docs, row, width, False)
    text = F.when(~F.col("_row.gone"), F.col("kept"))
    made = {"text": text, "n_chars": F.length(text)} | {c: F.col("_row.kept").getField(c) for c in kept}
    return out.select(*[made[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns])

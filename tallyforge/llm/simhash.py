"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link at ``distance`` or fewer differing bits. The bits are dealt into partitions, correlated
bits together; partition i gets a threshold t_i with sum(t_i + 1) = distance + 1 (t_i = -1: not probed), so of two
linked fingerprints some partition differs in at most t_i bits. Thresholds come from dynamic programming over the
estimated number of keys and candidate pairs. A fingerprint's keys in a partition are its bits with up to t_i zeros set
to one: two values that differ in at most t_i bits meet at the union of their ones. All fingerprints of a key are
verified against each other, by a search that takes linked ones out of the rest, so a group of near copies gives a
star of edges and not its pairs. A key that many fingerprints share is cut into blocks, and each pair of blocks is
verified in a task of its own. Components follow by contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import bytewise as B
from tallyforge.llm.components import components
from tallyforge.llm.shared import batches, discard, scratch, spread_join, text_or_empty, through_pandas, written

DISTANCE = 3
WORDS = 3
SEED = 42
BITS = 64
#: Fingerprints of a key that one task compares, and those that tell, by a sample, which keys have more.
BLOCK = 1 << 15
SAMPLE = 1 << 17
#: Rows whose doc_id is null come after all others.
LAST_ID = 2**63 - 1


def fingerprint(text: str, width: int = WORDS) -> int:
    """Bit j is one if it is one in over half the XXH64 of the text's word runs; no word: zero."""
    words = text.encode().lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    if len(words) < width:
        h = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    else:
        digest = xxhash.xxh64_intdigest
        runs = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
        h = np.fromiter((digest(x, SEED) for x in runs), np.uint64, len(words) - width + 1)
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(h), 1 << 16):
        part = h[a : a + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames):
            values = np.array([fingerprint(t, width) for t in frame.text], np.uint64).view(np.int64)
            yield frame.drop(columns="text").assign(fp=values)

    return run


def fingerprints(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """(doc_id, fp long) for every row of ``docs``."""
    return through_pandas(docs, ("doc_id",), _fingerprints(width), "fp long", text=text_or_empty())


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total, n = np.zeros((BITS, BITS)), 0
    for frame in frames:
        for a in range(0, len(frame), 1 << 16):
            x = _bits(frame.fp.to_numpy()[a : a + (1 << 16)]).astype(np.float32)
            total += x.T @ x
            n += len(x)
    if n:
        yield pd.DataFrame({"i": np.repeat(np.arange(BITS), BITS), "j": np.tile(np.arange(BITS), BITS), "ones": total.ravel().astype(np.int64), "n": n})


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of fingerprints, each bit's share of ones and the correlation of bits, over all of them.

    What comes to the driver is one 64 x 64 table, whatever the input.
    """
    rows = distinct.mapInPandas(_moments, "i int, j int, ones long, n long").groupBy("i", "j").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n")).collect()
    both, n = np.zeros((BITS, BITS)), 0
    for r in rows:
        both[r.i, r.j], n = r.ones, r.n
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return n, p, np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))


def grouped_bits(related: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of near equal width; each takes next the bit most correlated with those it has."""
    left, out = set(range(len(related))), []
    for k in range(parts):
        size = len(left) // (parts - k)
        group: list[int] = []
        while len(group) < size:
            best = max(sorted(left), key=lambda b: related[b, group].sum() if group else related[b, sorted(left)].sum())
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def plan(n: int, p: np.ndarray, related: np.ndarray, distance: int, key_cost: float = 8.0) -> tuple[list[list[int]], list[int], float]:
    """Partitions, their thresholds and the estimated cost: keys (``key_cost`` each) and candidate pairs.

    The candidates of a partition at threshold t are the pairs expected to differ in at most t of its bits, bits
    taken as independent with the measured shares.
    """
    best: tuple[list[list[int]], list[int], float] | None = None
    for parts in range(1, distance + 2):
        groups = grouped_bits(related, parts)
        costs = []
        for group in groups:
            differ = 2 * p[group] * (1 - p[group])
            chance = np.zeros(distance + 2)
            chance[0] = 1
            for d in differ:
                chance[1:] = chance[1:] * (1 - d) + chance[:-1] * d
                chance[0] *= 1 - d
            zeros = max(1.0, float((1 - p[group]).sum()))
            row = [0.0]
            for t in range(distance + 1):
                keys = sum(comb(round(zeros), i) for i in range(t + 1))
                row.append(key_cost * n * keys + n * (n - 1) / 2 * chance[: t + 1].sum())
            costs.append(row)  # at t + 1
        table = {0: (0.0, [])}
        for row in costs:
            new: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, chosen) in table.items():
                for extra, more in enumerate(row):
                    if used + extra <= distance + 1 and (used + extra not in new or cost + more < new[used + extra][0]):
                        new[used + extra] = (cost + more, [*chosen, extra - 1])
            table = new
        cost, chosen = table[distance + 1]
        if best is None or cost < best[2]:
            best = (groups, chosen, cost)
    return best


def _keys(groups: list[list[int]], thresholds: list[int], heavy: dict[tuple[int, int], int] | None = None):
    """(part, key, block, fp) of every key of every fingerprint; of a heavy key (and its number of blocks) once for each pair of blocks that it is in."""
    crowded = {k: np.array(sorted(key for part, key in heavy or {} if part == k), np.int64) for k in range(len(groups))}

    def dealt(k: int, key: np.ndarray, fp: np.ndarray) -> Iterator[pd.DataFrame]:
        known, block = crowded[k], np.zeros(len(key), np.int32)
        many = np.isin(key, known) if len(known) else None
        if many is not None and many.any():
            for x in np.unique(key[many]):
                n, own = heavy[k, int(x)], fp[key == x]
                mine = (B.mix(own.view(np.uint64)) % np.uint64(n)).astype(np.int64)
                for other in range(n):
                    some = mine != other  # within a block they meet in any of its pairs
                    pair = np.minimum(mine[some], other) * n + np.maximum(mine[some], other) + 1
                    yield pd.DataFrame({"part": np.int8(k), "key": x, "block": pair.astype(np.int32), "fp": own[some]})
            key, fp, block = key[~many], fp[~many], block[~many]
        yield pd.DataFrame({"part": np.int8(k), "key": key, "block": block, "fp": fp})

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), 1 << 14):
                fp = frame.fp.to_numpy()[a : a + (1 << 14)].view(np.uint64)
                for k, (group, t) in enumerate(zip(groups, thresholds, strict=True)):
                    mask = np.uint64(sum(1 << b for b in group))
                    for size in range(t + 1):
                        for chosen in combinations(group, size):
                            up = np.uint64(sum(1 << b for b in chosen))
                            some = fp[(fp & up) == 0] if size else fp
                            yield from dealt(k, ((some & mask) | up).view(np.int64), some.view(np.int64))

    return emit


def bucket_edges(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints: (node, centre) pairs.

    Whatever a visited fingerprint links to leaves the rest at once, so dense groups cost few passes.
    """
    a, b = [], []
    rest = fp
    while len(rest) > 1:
        centre, rest = rest[0], rest[1:]
        front = [centre]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= distance
            if near.any():
                hit = rest[near]
                a.append(hit)
                b.append(np.full(len(hit), centre))
                rest = rest[~near]
                front.extend(hit)
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def _verify(distance: int, small: int = 12):
    def one(rows: pd.DataFrame) -> pd.DataFrame | None:
        part, key, block, fp = (rows[c].to_numpy() for c in ("part", "key", "block", "fp"))
        fp = fp.view(np.uint64)
        edge = np.flatnonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
        begin, end = np.concatenate(([0], edge)), np.concatenate((edge, [len(fp)]))
        size = end - begin
        a, b = [], []
        group = np.repeat(np.arange(len(size)), size)
        few = (size <= small)[group]
        for d in range(1, small):  # neighbours d apart, in all small groups at once
            ok = few[d:] & (group[d:] == group[:-d])
            if not ok.any():
                break
            i = np.flatnonzero(ok)
            near = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= distance]
            a.append(fp[near])
            b.append(fp[near + d])
        for k in np.flatnonzero(size > small):
            x, y = bucket_edges(fp[begin[k] : end[k]], distance)
            a.append(x)
            b.append(y)
        if not a or not sum(map(len, a)):
            return None
        return pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)}).drop_duplicates()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for frame in frames:
            rows = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if not len(rows):
                continue
            last = (rows.part == rows.part.iloc[-1]) & (rows.key == rows.key.iloc[-1]) & (rows.block == rows.block.iloc[-1])
            done, held = rows[~last], rows[last]
            if len(done) and (out := one(done)) is not None:
                yield out
        if held is not None and len(held) and (out := one(held)) is not None:
            yield out

    return run


def heavy_keys(distinct: DataFrame, n: int, groups: list[list[int]], thresholds: list[int], block: int, sample: int) -> dict[tuple[int, int], int]:
    """(part, key) of keys that likely have more than ``block`` of the ``n`` fingerprints, and into how many blocks they go.

    At most ``sample`` fingerprints or so are looked at. A key that they miss costs time and loses nothing.
    """
    if n <= block:
        return {}
    share = min(1.0, sample / n)
    some = distinct.where(F.pmod(F.xxhash64("fp", F.lit(3)), F.lit(1 << 30)) < share * (1 << 30))
    seen = some.select("fp").mapInPandas(_keys(groups, thresholds), "part byte, key long, block int, fp long").groupBy("part", "key").agg(F.count("*").alias("n"))
    rows = seen.where(F.col("n") > max(8, block * share)).orderBy(F.desc("n")).limit(1 << 14).collect()
    return {(r.part, r.key): max(2, -(-int(r.n / share) // block)) for r in rows}


def links(distinct: DataFrame, distance: int = DISTANCE, block: int | None = None, sample: int | None = None) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints ``fp`` that join exactly those that links join."""
    n, p, related = bit_statistics(distinct)
    groups, thresholds, _ = plan(n, p, related, distance)
    heavy = heavy_keys(distinct, n, groups, thresholds, block or BLOCK, sample or SAMPLE)
    keyed = distinct.select("fp").mapInPandas(_keys(groups, thresholds, heavy), "part byte, key long, block int, fp long")
    dealt = keyed.repartition("part", "key", "block").sortWithinPartitions("part", "key", "block")
    return dealt.mapInPandas(_verify(distance), "a long, b long")


def _rooted(marked: DataFrame, distance: int) -> DataFrame:
    """A written table (fp, root, least, n) of all distinct fingerprints of a written table (doc_id, fp)."""
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    with scratch():
        root = components(links(distinct, distance))
        out = written(distinct.join(root, distinct.fp == root.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least", "n"), "roots", keep=True)
    discard(distinct)
    return out


def simhash_components(docs: DataFrame, distance: int = DISTANCE, width: int = WORDS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``; component_id is the least doc_id of its component.

    A null text counts as empty: fingerprint zero, linked like any other. Null ids stay; component_id is null only
    where a component has no other. Repeated rows stay; an empty table gives no rows; other columns do not matter.
    """
    marked = written(fingerprints(docs, width), "fingerprints")
    rooted = _rooted(marked, distance)
    least = written(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("fps")), "least")
    named = spread_join(rooted, least, ["root"], "fps", rooted.count()).select("fp", "component_id", "n")
    named = written(named, "named")
    discard(rooted, least)
    return spread_join(marked, named, ["fp"], "n", marked.count()).select("doc_id", "fp", "component_id")


def keyed_rows(docs: DataFrame) -> DataFrame:
    """(_id, _th, _row) once for each doc_id and text: of rows that differ in other columns alone, the one whose hash is least.

    ``_id`` is the doc_id, a null one last; ``_th`` a hash of the text; ``_row`` all columns. Equal rows meet where they are read already.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rest = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")], F.lit(0))))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("_id"), F.xxhash64(text_or_empty()).alias("_th"), rest.alias("_rest"), row.alias("_row"))
    return keyed.groupBy("_id", "_th").agg(F.min_by("_row", "_rest").alias("_row"))


def without_near_duplicates(docs: DataFrame, distance: int = DISTANCE, width: int = WORDS) -> DataFrame:
    """One row of ``docs`` for each component: the least doc_id (a null one last, then the least text hash), all columns.

    A null text counts as empty and stays null where it stays; texts without words are one group. Repeated rows count as
    copies, and of rows that differ in other columns alone one fixed by their hash stays; an empty table gives no rows;
    columns may have any names.
    """
    keys = (F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("_id"), F.xxhash64(text_or_empty()).alias("_th"), text_or_empty().alias("text"))
    marks = docs.select(*keys).mapInPandas(_fingerprints(width), "_id long, _th long, fp long")
    marked = written(marks.withColumn("doc_id", F.col("_id")), "fingerprints")
    rooted = _rooted(marked, distance)
    first = marked.groupBy("fp").agg(F.min(F.struct("_id", "_th")).alias("first"))
    best = written(first.join(rooted, "fp").groupBy("root").agg(F.min("first").alias("first")).select("first._id", "first._th"), "kept")
    discard(marked, rooted)
    return keyed_rows(docs).join(best, ["_id", "_th"]).select("_row.*")

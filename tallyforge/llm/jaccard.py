"""Near duplicates by exact Jaccard similarity of word runs: a prefix-filter join, then a check of whole sets.

A text is its set of runs of five words (upper-case A-Z count as lower case), each by a 64-bit hash. All sets are put
in one order of hashes, rare ones first. Two sets of similarity 0.8 or more share one of the first n // 5 + 1 hashes of
each, n being its size, so no such pair is missed; the places of the first shared hash bound what two sets can share,
and so do counts of hashes in 512 cells; the pairs left are checked on all their hashes. The order comes from a sample and decides the cost alone.
The smaller of two such sets, m of its hashes, has the first shared one among its first m // 9 + 1, so rows of a hash without a set of such
a place and a fitting size go before anything is paired.

What is wanted is which sets are joined by links, so not all pairs of a group are made. A first round pairs every set with
the next ``NEAR`` of each hash alone, in the order of sizes, which covers hashes of few sets and joins up groups of near
copies; later ones pair the sets of one hash that those before left in different components, and only where their cells allow
it. Copies of one text that differ in places of their own are mostly not alike, so cells are compared where the sets of a hash
are and rows are made only of what passes: first the nearest ``NEAR`` of each set, then, of what is still apart, every pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm import bytewise as B
from tallyforge.llm.components import components
from tallyforge.llm.shared import batches, discard, scratch, text_or_empty, written
from tallyforge.llm.simhash import LAST_ID, keyed_rows

WORDS = 5
#: The least similarity, as a fraction.
SHARE = (4, 5)
#: Documents from which the order of hashes is taken, and how often a hash has to be among them to count as frequent.
SAMPLE = 1 << 14
FREQUENT = 4
#: Sets of one hash that a set is paired with in the first two rounds, and of how many sets a hash is split among tasks later.
NEAR = 2
BLOCK = 1 << 15
#: Cells of a set's hashes are told by so many bits.
CELL_BITS = 9
#: Slots of the table that tells which sets the pairs may name.
SLOTS = 1 << 22


def sets(texts: list[bytes], width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text's word runs, ascending, and the text each belongs to."""
    data, ends = B.joined(texts)
    data = B.lowered(data)
    starts, stops = B.words(data)
    h, doc = B.shingles(B.spans(data, starts, stops), np.searchsorted(ends, starts), width)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[first], doc[first]


def _named(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``sets``, the size of each set and its name: equal sets have equal names, a text without words has zero."""
    h, doc = sets([t.encode() for t in texts])
    n = np.bincount(doc, minlength=len(texts))
    total = np.concatenate(([np.uint64(0)], np.cumsum(B.mix(h ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
    ends = np.cumsum(n)
    name = B.mix((total[ends] - total[ends - n]) + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return h, doc, n, np.where(n > 0, name, np.uint64(0))


def _names(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches(frames):
        yield frame.drop(columns="text").assign(name=_named(frame.text.tolist())[3].view(np.int64))


def _all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches(frames):
        yield pd.DataFrame({"h": sets([t.encode() for t in frame.text])[0].view(np.int64)})


def _values(value, wanted):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames):
            h, _, n, name = _named(frame.text.tolist())
            ends, name = np.cumsum(n), name.view(np.int64)
            some = np.flatnonzero(wanted.value[name % SLOTS])
            if len(some):
                yield pd.DataFrame({"name": name[some], "value": [value(h[ends[i] - n[i] : ends[i]]) for i in some]})

    return run


def _cells(h: np.ndarray) -> bytes:
    """How many of a set's hashes fall into each cell, and no less where that is over 8 bits; then how many there are."""
    return np.minimum(np.bincount((h >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=1 << CELL_BITS), 255).astype(np.uint8).tobytes() + len(h).to_bytes(8, "little")


def shared_at_most(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many hashes the set of cells x and each set of rows of cells y can share; where a cell is full, any number."""
    least = np.minimum(x, y)
    return np.where((least == 255).any(axis=1), np.iinfo(np.int32).max, least.sum(axis=1, dtype=np.int32)).astype(np.int64)


def _may_be_alike(x: bytes, y: bytes) -> bool:
    p, q = np.frombuffer(x[:-8], np.uint8), np.frombuffer(y[:-8], np.uint8)
    m, n = int.from_bytes(x[-8:], "little"), int.from_bytes(y[-8:], "little")
    return sum(SHARE) * int(shared_at_most(p, q[None])[0]) >= SHARE[0] * (m + n)


def _is_alike(x: bytes, y: bytes) -> bool:
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    return sum(SHARE) * len(np.intersect1d(p, q, assume_unique=True)) >= SHARE[0] * (len(p) + len(q))


def _prefixes(frequent):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, rank = frequent.value
        for frame in batches(frames):
            h, doc, n, name = _named(frame.text.tolist())
            late = np.zeros(len(h), np.int64)
            if len(known) and len(h):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                late = np.where(known[at] == h, rank[at], 0)
            order = np.lexsort((h, late, doc))
            h, doc = h[order], doc[order]
            place = np.arange(len(h)) - (np.cumsum(n) - n)[doc]
            kept = place < n[doc] - -(-SHARE[0] * n[doc] // SHARE[1]) + 1
            of = doc[kept]
            yield pd.DataFrame({"h": h[kept].view(np.int64), "name": name[of].view(np.int64), "n": n[of].astype(np.int32), "place": place[kept].astype(np.int32)})

    return run


def may_be_alike(n: np.ndarray, place: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets i and j can be alike, by their sizes and the places of the hash that they share."""
    up, down = SHARE
    m, k = n[i].astype(np.int64), n[j].astype(np.int64)
    shared = np.minimum(m - place[i], k - place[j])
    return (down * np.minimum(m, k) >= up * np.maximum(m, k)) & ((up + down) * shared >= up * (m + k))


def fitting(prefixes: DataFrame) -> DataFrame:
    """The rows of a hash that can be of a pair whose first shared hash it is.

    Of two alike sets, the smaller one's place is at most a ninth of its size and its size at least ``SHARE`` of the larger one's.
    So by size the larger one's row comes after such a row, the last of which is no smaller, and the smaller one's before a row that fits.
    """
    up, down = SHARE
    order = Window.partitionBy("h").orderBy("n", "name")
    early = (up + down) * (F.col("n") - F.col("place")).cast("long") >= 2 * up * F.col("n").cast("long")
    before = F.last(F.when(early, F.col("n")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = prefixes.select("h", "name", "n", "place", before.alias("before"), F.lead("n").over(order).alias("after"))
    larger, smaller = down * F.col("before").cast("long") >= up * F.col("n").cast("long"), early & (down * F.col("n").cast("long") >= up * F.col("after").cast("long"))
    return marked.where(F.coalesce(larger, F.lit(False)) | F.coalesce(smaller, F.lit(False))).select("h", "name", "n", "place")


def _named_pairs(x: np.ndarray, y: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)}).drop_duplicates()


def _near(near: int, at_once: int = 1 << 16):
    """Pairs of sets at most ``near`` places apart among those of a hash, and all rows of hashes of more sets; rows come by hash, size and name.

    Of the rows before only the last ``near`` are held, so a hash may have any number of them.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for frame in frames:
            for a in range(0, len(frame), at_once):
                part = frame.iloc[a : a + at_once]
                old = 0 if held is None else len(held)
                rows = part if held is None else pd.concat([held, part], ignore_index=True)
                h, name, n, place = (rows[c].to_numpy() for c in ("h", "name", "n", "place"))
                found = []
                for d in range(1, near + 1):
                    j = np.arange(max(old, d), len(rows))
                    j = j[h[j] == h[j - d]]
                    j = j[(name[j] != name[j - d]) & may_be_alike(n, place, j - d, j)]
                    found.append((name[j - d], name[j]))
                pairs = _named_pairs(*(np.concatenate(x) for x in zip(*found, strict=True)))
                yield pairs.assign(h=0, n=0, place=-1)
                # a row more than ``near`` places after another of its hash; the first such brings those before it along
                far, begin = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
                j = np.arange(max(old, near + 1), len(rows))
                far[j] = h[j] == h[j - near - 1]
                begin[j] = far[j] & ((j < near + 2) | (h[j - near - 2] != h[j]))
                for d in range(1, near + 2):
                    far[:-d] |= begin[d:]
                if far.any():
                    yield pd.DataFrame({"a": name[far], "b": name[far], "h": h[far], "n": n[far], "place": place[far]})
                held = rows.iloc[-near - 2 :]

    return run


def _apart(near: int | None, most: int = 1 << 20):
    """Pairs of sets of one hash and block that are in different components and may be alike by places, sizes and cells.

    With ``near``, of each set outside a block's largest component only those with so many others that can share the most.
    """

    def out(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        key = rows[["h", "block"]].to_numpy()
        edge = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        name, n, place, root = (rows[c].to_numpy() for c in ("name", "n", "place", "root"))
        found, size = [], 0
        for begin, end in zip(np.concatenate(([0], edge)), np.concatenate((edge, [len(rows)])), strict=True):
            kinds, of, count = np.unique(root[begin:end], return_inverse=True, return_counts=True)
            if len(kinds) == 1:
                continue
            cells = np.frombuffer(b"".join(x[:-8] for x in rows["value"].iloc[begin:end]), np.uint8).reshape(end - begin, -1)
            few = begin + np.flatnonzero(of != count.argmax())  # every pair wanted has one outside the largest component
            for i in few:
                j = np.arange(begin, end)
                j = j[(root[j] != root[i]) & (near is not None or (j > i) | (of[j - begin] == count.argmax()))]
                j = j[may_be_alike(n, place, np.full(len(j), i), j)]
                shared = shared_at_most(cells[i - begin], cells[j - begin])
                can = sum(SHARE) * shared >= SHARE[0] * (n[i].astype(np.int64) + n[j])
                j = j[can] if near is None else j[can][np.argsort(-shared[can], kind="stable")[:near]]
                found.append((np.full(len(j), name[i]), name[j]))
                size += len(j)
                if size > most:
                    yield _named_pairs(*(np.concatenate(x) for x in zip(*found, strict=True)))
                    found, size = [], 0
        if size:
            yield _named_pairs(*(np.concatenate(x) for x in zip(*found, strict=True)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for frame in frames:
            rows = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if len(rows):
                last = (rows.h == rows.h.iloc[-1]) & (rows.block == rows.block.iloc[-1])
                held = rows[last]
                yield from out(rows[~last]) if not last.all() else ()
        if held is not None and len(held):
            yield from out(held)

    return run


def _known(texts: DataFrame, names: DataFrame, value) -> DataFrame:
    """A written table (name, value) of the sets with a name among ``names``, and few others."""
    slots = names.select(F.pmod("name", F.lit(SLOTS)).cast("int").alias("slot")).distinct().toPandas()
    bits = np.zeros(SLOTS, bool)
    bits[slots.slot.to_numpy(np.int64)] = True
    wanted = texts.sparkSession.sparkContext.broadcast(bits)
    return written(texts.mapInPandas(_values(value, wanted), "name long, value binary").dropDuplicates(["name"]), "values")


def _checked(texts: DataFrame, pairs: DataFrame, value, test) -> DataFrame:
    """A written table of the pairs whose sets' values pass the test; only sets of pairs, and few others, are dealt."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.loc[[test(x, y) for x, y in zip(frame.x, frame.y, strict=True)], ["a", "b"]]

    known = _known(texts, pairs.select(F.explode(F.array("a", "b")).alias("name")), value)
    x = known.select(F.col("name").alias("a"), F.col("value").alias("x"))
    y = known.select(F.col("name").alias("b"), F.col("value").alias("y"))
    out = written(pairs.join(x, "a").join(y, "b").mapInPandas(run, "a long, b long"), "alike")
    discard(known)
    return out


def _verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """A written table of the pairs whose sets are alike."""
    possible = _checked(texts, pairs, _cells, _may_be_alike)
    out = _checked(texts, possible, np.ndarray.tobytes, _is_alike)
    discard(possible)
    return out


def links(texts: DataFrame, near: int | None = None, block: int | None = None) -> DataFrame:
    """(node, root) for all names of sets of ``text`` that a similarity of 0.8 or more to an unlike set joins, directly or by others."""
    spark, near, block = texts.sparkSession, near or NEAR, block or BLOCK
    every = max(1, texts.count() // SAMPLE)
    some = texts.where(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(every)) == 0).mapInPandas(_all, "h long")
    rows = some.groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") >= FREQUENT).orderBy(F.desc("k"), "h").limit(1 << 18).toPandas()
    known = rows.h.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(known)
    frequent = spark.sparkContext.broadcast((known[order], rows.k.to_numpy(np.int64)[order]))
    dealt = fitting(texts.mapInPandas(_prefixes(frequent), "h long, name long, n int, place int").repartition("h")).sortWithinPartitions("h", "n", "name")
    first = written(dealt.mapInPandas(_near(near), "a long, b long, h long, n int, place int"), "near")
    alike = _verified(texts, first.where("place < 0").select("a", "b").distinct())
    rows = first.where("place >= 0").select("h", F.col("a").alias("name"), "n", "place").dropDuplicates(["h", "name"])
    own, other, cells, old = F.pmod(F.xxhash64("name"), F.col("parts")).cast("int"), F.col("other"), None, first
    for most in (near, None):
        root = components(alike)
        rooted = written(rows.join(root, rows.name == root.node, "left").select("h", "name", "n", "place", F.coalesce("root", "name").alias("root")), "rooted")
        discard(old)
        mixed = rooted.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("m")).where("x <> y").select("h", "m")
        old = written(rooted.join(mixed, "h"), "mixed")
        discard(rooted)
        rows = old.select("h", "name", "n", "place")
        cells = _known(texts, rows.select("name"), _cells) if cells is None else cells
        spread = old.withColumn("parts", F.ceil(F.col("m") / block).cast("int")).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        spread = spread.select("h", "name", "n", "place", "root", (F.least("own", other) * F.col("parts") + F.greatest("own", other)).alias("block")).join(cells, "name")
        pairs = written(spread.repartition("h", "block").sortWithinPartitions("h", "block").mapInPandas(_apart(most), "a long, b long").distinct(), "apart")
        if pairs.isEmpty():  # what the first of these rounds finds none of, the second does not either
            break
        alike = alike.unionByName(_checked(texts, pairs, np.ndarray.tobytes, _is_alike))
        discard(pairs)
    else:
        root = components(alike)
    discard(old, cells)
    return root


def without_similar(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component of texts of similarity 0.8 or more: the least doc_id, all columns.

    A null doc_id comes last, then the least text hash. Texts without words, null ones too, are one set. Repeated rows
    count as copies, and of rows that differ in other columns alone one fixed by their hash stays; an empty table gives
    no rows; columns may have any names.
    """
    keys = (F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("_id"), F.xxhash64(text_or_empty()).alias("_th"), text_or_empty().alias("text"))
    marked = written(docs.select(*keys).mapInPandas(_names, "_id long, _th long, name long"), "names")
    first = marked.groupBy("name").agg(F.min(F.struct("_id", "_th")).alias("first"))
    with scratch():
        root = links(docs.select(text_or_empty().alias("text")))
        rooted = first.join(root, first.name == root.node, "left").select(F.coalesce("root", "name").alias("root"), "first")
        best = written(rooted.groupBy("root").agg(F.min("first").alias("first")).select("first._id", "first._th"), "kept", keep=True)
    discard(marked)
    return keyed_rows(docs).join(best, ["_id", "_th"]).select("_row.*")

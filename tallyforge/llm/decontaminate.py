"""Benchmark decontamination by template canonicalisation.

Words are runs of letters and digits, with the points and commas between digits. Numbers (in figures, or a spelled word of
one), units after a number, and names (capitalised words) become typed placeholders; what remains is lower-cased. A capitalised word at the start of a sentence or line may be a name or not,
so texts are read in four ways. An item's template windows are its runs of five canonical words; windows with fewer
than three literal words name nothing and do not count. A document's windows meet the items' in a hash join; an item
whose windows, in one reading, a document holds to 0.8 or more is a candidate, and its slots must then be filled
consistently: one value of the item's always stands for one value of the document's. Every alignment on which 0.8 of the
windows meet, shifted words allowed for, is tried until one is consistent; if no alignment has so many, that on which most
windows meet is. Equal fillings are copies, other consistent ones re-parameterised questions.

A document also holds an item if it holds 0.8 of the item's runs of five plain words, whatever their case, line breaks
and kinds; an item of fewer words is one run of all its words.

The items are a query set: the build side of the hash join is a block of them of bounded size, broadcast with a directory
of hash buckets; the documents' windows, five to a word, probe it where they are made and are never written or dealt.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import bytewise as B
from tallyforge.llm.shared import batches, text_or_empty, through_pandas

WORDS = 5
LITERALS = 3
SIMILARITY = 0.8
#: Item words that one scan of the documents carries; each begins a window in up to five readings.
BLOCK = 1 << 20
#: Words that are units where they follow a number.
UNITS = """
m cm mm km mi ft inch inches feet mile miles meter meters metre metres yard yards kg g mg lb lbs pound pounds ounce ounces oz ton tons
gram grams kilogram kilograms l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week
weeks month months year years percent degree degrees dollar dollars euro euros cent cents usd eur mph kmh hz khz mhz ghz kb mb gb tb
""".split()

#: Words that are numbers.
NUMBERS = """
zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty
thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half
""".split()
#: How far, in words, an alignment may shift within one occurrence of an item: so much, or this share of the item's words.
SHIFT = (5, 0.2)

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LITERAL, NUMBER, UNIT, NAME = range(4)
_PLACEHOLDER = B.mix(np.array([0, 0x1111, 0x2222, 0x3333], np.uint64))


def _among(h: np.ndarray, listed: list[str]) -> np.ndarray:
    data, _ = B.joined([u.encode() for u in listed])
    known = np.sort(B.spans(data, *B.words(data)))
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def canonical(texts: list[bytes]):
    """Of all words in turn: start, end, document, hash and kind in each of the readings; and the bytes they are places in.

    The readings differ in what a capitalised word may be where a sentence or line starts: none a name; those at a
    line's start inside a sentence; also those that stand capitalised inside a sentence of the text elsewhere; all.
    """
    raw, ends = B.joined(texts)
    data = B.lowered(raw)
    digits = (data >= 48) & (data <= 57)
    inner = np.zeros(len(data), bool)
    inner[1:-1] = ((data[1:-1] == ord(".")) | (data[1:-1] == ord(","))) & digits[:-2] & digits[2:]
    a, b = B.runs(_WORD[data] | inner)
    doc = np.searchsorted(ends, a)
    h = B.spans(data, a, b)
    kind = np.zeros(len(a), np.int8)
    if not len(a):
        return raw, a, b, doc, h, [kind]
    number = (digits[a] & digits[b - 1]) | _among(h, NUMBERS)
    kind[number] = NUMBER
    after = np.concatenate(([False], number[:-1] & (doc[1:] == doc[:-1])))
    kind[after & ~number & _among(h, UNITS)] = UNIT
    # a capital followed by a small letter; inside a sentence if before it stand only blanks, and then a word's end or a comma
    solid = np.where(_SPACE[data], 0, np.arange(len(data)))
    np.maximum.accumulate(solid, out=solid)
    before = np.where(a > 0, solid[np.maximum(a - 1, 0)], 0)
    inside = np.concatenate(([False], doc[1:] == doc[:-1])) & (_WORD[data[before]] | (data[before] == ord(",")) | (data[before] == ord(";")))
    line = np.zeros(len(data) + 1, np.int64)
    np.cumsum(raw == 10, out=line[1:])
    upper = (raw[a] >= 65) & (raw[a] <= 90) & (b - a > 1)
    small = raw[np.minimum(a + 1, len(raw) - 1)]
    capital = upper & (((small >= 97) & (small <= 122)) | (small >= 128)) & (kind == LITERAL)
    inside &= capital
    own = B.mix(h ^ doc.astype(np.uint64))
    elsewhere = capital & np.isin(own, own[inside])
    return raw, a, b, doc, h, [np.where(names, np.int8(NAME), kind) for names in (inside & (line[a] == line[before]), inside, elsewhere, capital)]


def windows(h: np.ndarray, doc: np.ndarray, kind: np.ndarray | None, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the template windows that count, and the word each begins with; without kinds, all literal windows."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = h if kind is None else np.where(kind == LITERAL, h, _PLACEHOLDER[kind])
    run = out[:n].copy()
    for i in range(1, width):
        run = run * np.uint64(0x9E3779B97F4A7C15) + out[i : i + n]
    ok = doc[:n] == doc[width - 1 :]
    if kind is not None:
        literal = np.concatenate(([0], np.cumsum(kind == LITERAL)))
        ok &= literal[width:] - literal[:-width] >= min(LITERALS, width)
    at = np.flatnonzero(ok)
    return B.mix(run[at]), at


class Items:
    """A block of benchmark items, each in its readings and as plain words, ready for lookups."""

    def __init__(self, ids: list[int], texts: list[bytes], width: int) -> None:
        raw, a, b, doc, h, kinds = canonical(texts)
        self.ids, self.kinds = ids, kinds
        self.first, self.count = np.searchsorted(doc, np.arange(len(ids))), np.bincount(doc, minlength=len(ids))
        self.values = [raw[x:y].tobytes().lower() if k else b"" for x, y, k in zip(a, b, kinds[-1], strict=True)]
        #: Lengths below ``width`` of whole items; documents are asked for literal windows of these too.
        self.short = sorted({int(c) for c in self.count if 0 < c < width})
        found = [(r, *windows(h, doc, kind, width)) for r, kind in enumerate(kinds)] + [(len(kinds), *windows(h, doc, None, width))]
        for c in self.short:
            w, at = windows(h, doc, None, c)
            whole = self.count[doc[at]] == c
            found.append((len(kinds), B.mix(w[whole] ^ np.uint64(c)), at[whole]))
        w, at = np.concatenate([x for _, x, _ in found]), np.concatenate([x for _, _, x in found])
        reading = np.concatenate([np.full(len(x), r) for r, x, _ in found])
        order = np.argsort(w, kind="stable")
        self.hashes, self.reading, self.item = w[order], reading[order], doc[at][order]
        self.place = (at - self.first[doc[at]])[order]
        distinct = np.unique(np.rec.fromarrays([self.item, self.reading, self.hashes]))
        self.total = np.zeros((len(ids), len(kinds) + 1), np.int64)
        np.add.at(self.total, (distinct.f0, distinct.f1), 1)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.hashes >> np.uint64(44)] = True


def consistent(pairs: list[tuple[int, bytes, bytes]]) -> bool:
    """Whether each (kind, value of the item) has one value of the document."""
    seen: dict[tuple[int, bytes], bytes] = {}
    return all(seen.setdefault((k, x), y) == y for k, x, y in pairs)


def alignments(hits: set[tuple[int, int, int]], length: int, enough: float) -> Iterator[dict[int, int]]:
    """For each alignment on which at least ``enough`` distinct windows meet: the word at which each place's window begins.

    An alignment is a shift (word - place) with hits, those on which most windows meet first; hits of nearly the same shift
    belong to it too, for words put in or left out, and each place takes its hit of the nearest shift.
    """
    by_shift = defaultdict(list)
    for w, word, place in hits:
        by_shift[word - place].append((w, word, place))
    room = max(SHIFT[0], int(SHIFT[1] * length))
    shifts = np.array(sorted(by_shift))
    for shift in sorted(by_shift, key=lambda x: (-len(by_shift[x]), x)):
        near = shifts[np.searchsorted(shifts, shift - room) : np.searchsorted(shifts, shift + room, "right")]
        if sum(len(by_shift[int(x)]) for x in near) < enough:
            continue
        found: dict[int, int] = {}
        windows_met = set()
        for x in sorted(near.tolist(), key=lambda x: (abs(x - shift), x)):
            for w, word, place in by_shift[x]:
                windows_met.add(w)
                found.setdefault(place, word)
        if len(windows_met) >= enough:
            yield found


def matches(known: Items, texts: list[bytes], width: int, similarity: float) -> Iterator[tuple[int, int, float, int, bool]]:
    """(text, item, similarity, slots, whether a slot differs) for each text that holds an item, by the first reading that does."""
    raw, a, b, doc, h, kinds = canonical(texts)
    met: dict[tuple[int, int, int], set[tuple[int, int, int]]] = defaultdict(set)
    asked = [windows(h, doc, kind, width) for kind in [*kinds, None]]
    for c in known.short:
        w, at = windows(h, doc, None, c)
        asked.append((B.mix(w ^ np.uint64(c)), at))
    for w, at in asked:
        maybe = np.flatnonzero(known.filter[w >> np.uint64(44)])
        lo, hi = np.searchsorted(known.hashes, w[maybe], "left"), np.searchsorted(known.hashes, w[maybe], "right")
        maybe, lo, hi = maybe[hi > lo], lo[hi > lo], hi[hi > lo]
        for i, x, y in zip(maybe, lo, hi, strict=True):
            word = int(at[i])
            for k in range(x, y):
                met[int(doc[word]), int(known.item[k]), int(known.reading[k])].add((int(w[i]), word, int(known.place[k])))
    plain, done = len(known.kinds), set()
    for (d, item, reading), hits in sorted(met.items(), key=lambda x: x[0]):
        share = len({x for x, _, _ in hits}) / known.total[item, reading]
        if share < similarity or (d, item) in done:
            continue
        kind = known.kinds[reading if reading < plain else 0]
        first, length = int(known.first[item]), int(known.count[item])

        def filled(words: dict[int, int]) -> list[tuple[int, bytes, bytes]]:
            """Slots by place in the item, with the item's and the document's values."""
            out = []
            for p, at_word in sorted(words.items()):
                k = kind[first + p]
                if k and 0 <= at_word < len(doc) and doc[at_word] == d and kinds[-1][at_word] == k:
                    out.append((int(k), known.values[first + p], raw[a[at_word] : b[at_word]].tobytes().lower()))
            return out

        def whole(starts: dict[int, int]) -> dict[int, int]:
            """The word at each place of the item that a window covers; a place takes the window that begins nearest before it."""
            words: dict[int, int] = {}
            for p in sorted(starts, reverse=True):
                for i in range(width):
                    if p + i < length:
                        words.setdefault(p + i, starts[p] + i)
            return words

        shift = min(Counter(word - place for _, word, place in hits).items(), key=lambda x: (-x[1], x[0]))[0]
        straight = filled({p: shift + p for p in range(length)})
        if reading == plain or consistent(straight):
            chosen = straight
        else:
            chosen = next((x for x in (filled(whole(s)) for s in alignments(hits, length, similarity * known.total[item, reading])) if consistent(x)), None)
        if chosen is not None:
            done.add((d, item))
            yield d, item, share, len(chosen), any(x != y for _, x, y in chosen)


def _blocks(benchmark: DataFrame, width: int, block: int) -> Iterator[Items]:
    """The items, a block of bounded size at a time."""
    asked = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (2 * block)))  # a word takes two characters of text at least
    for k in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        yield Items([r.item_id for r in part], [r.text.encode() for r in part], width)


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = WORDS, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, similarity, slots, reparameterised) for each document that holds an item.

    ``similarity`` is the share of the item's windows in the document; ``slots`` counts aligned placeholders. Items
    without words, and null ones, name nothing. Null texts hold nothing; rows with null ids are found too,
    under a null id; repeated rows give repeated results; empty tables give no rows; other columns do not matter.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for block_items in _blocks(benchmark, width, block):
        items = docs.sparkSession.sparkContext.broadcast(block_items)

        def find(frames: Iterator[pd.DataFrame], items=items) -> Iterator[pd.DataFrame]:
            for frame in batches(frames, most=1 << 19):
                found = [(frame.doc_id.iloc[d], items.value.ids[i], *x) for d, i, *x in matches(items.value, [t.encode() for t in frame.text], width, similarity)]
                if found:
                    yield pd.DataFrame(found, columns=["doc_id", "item_id", "similarity", "slots", "reparameterised"])

        found = through_pandas(rows, ("doc_id",), find, "item_id long, similarity double, slots int, reparameterised boolean", text=text_or_empty())
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WORDS, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns as they were. No row moves: each block of items is one filter.

    Null and empty texts hold nothing and stay; null and repeated ids do not matter; of repeated rows all stay or all go;
    without items all rows stay; an empty table gives no rows.
    """
    for block_items in _blocks(benchmark, width, block):
        items = docs.sparkSession.sparkContext.broadcast(block_items)

        def keep(parts: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for a in range(0, part.num_rows, 256):
                    texts = [(t or "").encode() for t in part.column("text")[a : a + 256].to_pylist()]
                    held = np.zeros(len(texts), bool)
                    held[[d for d, *_ in matches(items.value, texts, width, similarity)]] = True
                    yield part.slice(a, 256).filter(pa.array(~held))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs

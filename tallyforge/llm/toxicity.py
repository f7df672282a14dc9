"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of the rows that its hashed features name: the word, its first 3 to 6 bytes and its last
4. Filters over one, two and three words slide over the document, each keeps its largest response, and a linear layer
gives the logit. Word counts by language give a detector of the text's own language; the logit has the threshold of the
detected language taken off, so that 0.5 is the threshold of every language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm import bytewise as B
from tallyforge.llm.langid import fold, least_hashed
from tallyforge.llm.shared import batches, text_or_empty, through_pandas

BUCKETS = 1 << 16
EMBED = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Learned from are at most so many labelled rows of each class, and of these whole texts of so many bytes together.
ROWS_PER_CLASS = 2500
BYTES_PER_CLASS = 1 << 25
PREFIXES = (3, 4, 5, 6)
SUFFIX = 4

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True  # letters, digits and bytes of longer characters


def featurised(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features (buckets) of each distinct word, and the distinct word and document of each word in turn."""
    width = len(PREFIXES) + 2
    data, ends = B.joined(texts)
    data = B.lowered(data)
    a, b = B.runs(_WORD[data])
    if not len(a):
        return np.zeros((0, width), np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    of = B.Spans(data)
    whole = of(a, b)
    _, first, word = np.unique(whole, return_index=True, return_inverse=True)
    parts = [whole[first]]
    begin, end = a[first], b[first]
    for p in PREFIXES:
        parts.append(of(begin, np.minimum(begin + p, end)) + np.uint64(p))
    parts.append(of(np.maximum(end - SUFFIX, begin), end) + np.uint64(99))
    feature = (B.mix(np.stack(parts, 1)) % np.uint64(BUCKETS)).astype(np.int32)
    return feature, word.reshape(-1), np.searchsorted(ends, a)


def featurised_in_parts(texts: list[bytes], most: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``featurised``, with the memory of about ``most`` bytes at a time; a word may be listed once for each part."""
    out, a, known = [], 0, 0
    while a < len(texts):
        b, size = a + 1, len(texts[a])
        while b < len(texts) and size + len(texts[b]) <= most:
            size += len(texts[b])
            b += 1
        feature, word, doc = featurised(texts[a:b])
        out.append((feature, (word + known).astype(np.int32), (doc + a).astype(np.int32)))
        known += len(feature)
        a = b
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else featurised([])


@dataclass
class TextNet:
    embed: np.ndarray  # BUCKETS x EMBED
    filters: list[list[np.ndarray]]  # by width and place: EMBED x FILTERS
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    tongue: np.ndarray  # BUCKETS x languages: log chances of words
    threshold: np.ndarray  # by detected language
    scale: float

    def responses(self, vectors: np.ndarray, word: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        """(documents x filters): the largest response, zero at least."""
        got = []
        for w, (parts, bias) in enumerate(zip(self.filters, self.bias, strict=True), 1):
            y = (vectors @ parts[0])[word]
            for k in range(1, w):
                more = (vectors @ parts[k])[word[k:]]
                more[doc[k:] != doc[:-k]] = 0  # beyond the document's end
                y[: len(more)] += more
            got.append(y + bias)
        y = np.maximum(np.concatenate(got, axis=1), 0)
        out = np.zeros((docs, y.shape[1]), y.dtype)
        if len(doc):
            first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            out[doc[first]] = np.maximum.reduceat(y, first, axis=0)
        return out

    def logits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The logit of each text and its detected language."""
        feature, word, doc = featurised(texts)
        z = self.responses(self.embed[feature].sum(axis=1), word, doc, len(texts)) @ self.out + self.out_bias
        lang = np.zeros((len(texts), self.tongue.shape[1]))
        if len(doc):
            first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            lang[doc[first]] = np.add.reduceat(self.tongue[feature[:, 0]][word], first, axis=0)
        return z, lang.argmax(axis=1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        z, lang = self.logits(texts)
        return 1 / (1 + np.exp(-np.clip((z - self.threshold[lang]) * self.scale, -30, 30)))


def train(texts: list[bytes], label: np.ndarray, lang: list[str], visits: int = 12_000, rate: float = 0.01, seed: int = 5) -> TextNet:
    """Adam on the class-balanced log loss of three quarters of the rows; the rest sets the thresholds by language."""
    rng = np.random.default_rng(seed)
    feature, word, doc = featurised_in_parts(texts)
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    order = rng.permutation(len(texts))
    fitted, spare = np.sort(order[len(order) // 4 :]), np.sort(order[: len(order) // 4])
    if len(np.unique(label[fitted])) < 2:
        fitted = np.arange(len(texts))
    # the first coordinate starts at how much more often documents of label 1 have the feature
    have = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
    number = [1e-9, 1e-9]
    for i in fitted:
        f = np.unique(feature[word[bounds[i] : bounds[i + 1]]])
        have[label[i]][f] += 1
        number[label[i]] += 1
    share = [(have[k] + 0.5) / (number[k] + 1) for k in (0, 1)]
    surprise = np.log(share[1] / share[0]) * np.minimum(1, have[1] / 3)
    embed = rng.normal(0, 0.02, (BUCKETS, EMBED))
    embed[:, 0] = np.clip(surprise, -1, 6) / len(PREFIXES)
    filters = [[rng.normal(0, 0.2, (EMBED, FILTERS)) for _ in range(w)] for w in WIDTHS]
    for parts in filters:
        parts[0][0, : FILTERS // 2] = np.abs(parts[0][0, : FILTERS // 2]) + 0.5
    bias = [np.full(FILTERS, -0.5) for _ in WIDTHS]
    tongues = sorted(set(lang)) or [""]
    counts = np.zeros((BUCKETS, len(tongues)))
    for i in range(len(texts)):
        np.add.at(counts[:, tongues.index(lang[i])], feature[word[bounds[i] : bounds[i + 1]], 0], 1)
    tongue = np.log((counts + 0.1) / (counts.sum(axis=0) + 0.1 * BUCKETS))
    net = TextNet(embed, filters, bias, np.abs(rng.normal(0, 0.3, FILTERS * len(WIDTHS))), -1.0, tongue, np.zeros(len(tongues)), 1.0)
    weights = [net.embed, *[p for parts in net.filters for p in parts], *net.bias, net.out]
    m, v = [np.zeros_like(x) for x in weights], [np.zeros_like(x) for x in weights]
    mb = vb = 0.0
    balance = [len(fitted) / (2 * max(1, (label[fitted] == k).sum())) for k in (0, 1)]
    step = 0
    for _ in range(min(8, max(2, visits // max(1, len(fitted))))):
        shuffled = rng.permutation(fitted)
        for a in range(0, len(shuffled), 16):
            grads = [np.zeros_like(x) for x in weights[1:]]
            touched: list[tuple[np.ndarray, np.ndarray]] = []
            gb = 0.0
            rows = shuffled[a : a + 16]
            for i in rows:
                w_ = word[bounds[i] : bounds[i + 1]]
                if not len(w_):
                    continue
                keep, inv = np.unique(w_, return_inverse=True)
                vec = net.embed[feature[keep]].sum(axis=1)
                x = vec[inv]
                raw, at = [], []
                for w, (parts, b) in enumerate(zip(net.filters, net.bias, strict=True), 1):
                    y = x @ parts[0]
                    for k in range(1, w):
                        y[: len(x) - k] += x[k:] @ parts[k]
                    best = y.argmax(axis=0)
                    at.append(best)
                    raw.append(y[best, np.arange(FILTERS)] + b)
                raw_ = np.concatenate(raw)
                hidden = np.maximum(raw_, 0)
                p = 1 / (1 + np.exp(-np.clip(hidden @ net.out + net.out_bias, -30, 30)))
                g = (p - label[i]) * balance[label[i]] / len(rows)
                gb += g
                grads[-1] += g * hidden
                back = g * net.out * (raw_ > 0)
                place = 0
                for w, parts in enumerate(net.filters, 1):
                    part = back[(w - 1) * FILTERS : w * FILTERS]
                    grads[sum(WIDTHS) + w - 1] += part
                    for k in range(w):
                        where = at[w - 1] + k
                        ok = where < len(x)
                        grads[place] += np.where(ok, x[np.minimum(where, len(x) - 1)].T * part, 0)
                        if ok.any():
                            into = (parts[k] * part)[:, ok].T  # filters x EMBED
                            f = feature[w_[where[ok]]]
                            touched.append((f.reshape(-1), np.repeat(into, f.shape[1], axis=0)))
                        place += 1
            step += 1
            fix, fix2 = 1 - 0.9**step, 1 - 0.999**step
            for t, g in enumerate(grads, 1):
                m[t] = 0.9 * m[t] + 0.1 * g
                v[t] = 0.999 * v[t] + 0.001 * g * g
                weights[t] -= rate * (m[t] / fix) / (np.sqrt(v[t] / fix2) + 1e-8)
            if touched:  # rows of the embedding that had no gradient stay as they are
                f, g = np.concatenate([x for x, _ in touched]), np.concatenate([x for _, x in touched])
                u, inv = np.unique(f, return_inverse=True)
                total = np.zeros((len(u), EMBED))
                np.add.at(total, inv, g)
                m[0][u] = 0.9 * m[0][u] + 0.1 * total
                v[0][u] = 0.999 * v[0][u] + 0.001 * total * total
                net.embed[u] -= rate * (m[0][u] / fix) / (np.sqrt(v[0][u] / fix2) + 1e-8)
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            net.out_bias -= rate * (mb / fix) / (vb / fix2 + 1e-16) ** 0.5
    return calibrated(net, [texts[i] for i in spare], label[spare])


def calibrated(net: TextNet, texts: list[bytes], label: np.ndarray) -> TextNet:
    """Sets each language's threshold to the middle of the best cut of the spare rows, held near 0 where they are few."""
    net.embed, net.tongue = net.embed.astype(np.float32), net.tongue.astype(np.float32)
    net.filters = [[p.astype(np.float32) for p in parts] for parts in net.filters]
    if not len(texts):
        return net
    found = [net.logits(texts[a : a + 64]) for a in range(0, len(texts), 64)]
    z, lang = (np.concatenate(x) for x in zip(*found, strict=True))
    for k in range(len(net.threshold)):
        own, is_one = z[lang == k], label[lang == k]
        if len(own) < 5 or is_one.min() == is_one.max():
            continue
        cuts = np.unique(own)
        cuts = np.concatenate(([cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1]))
        wrong = np.array([((own >= c) != is_one).sum() for c in cuts])
        best = cuts[wrong == wrong.min()]
        net.threshold[k] = best[np.abs(best).argmin()] * min(1, is_one.sum() / 20)
    return net


def fit(docs: DataFrame, labels: DataFrame, per_class: int = ROWS_PER_CLASS, bytes_per_class: int = BYTES_PER_CLASS) -> TextNet | None:
    """Learns from labelled documents: of each class the labelled ids of least hash, ``per_class`` at most, and their distinct texts.

    The sample is bounded: in the order of hashes of id and text, ``per_class`` texts that have ``bytes_per_class`` bytes together
    at most (a single text longer than that is not learned from). Repeated ids with many texts count as so many rows; an id
    labelled twice counts as toxic if one label says so. None without labelled texts of both classes.
    """
    marks = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = least_hashed(marks.select("toxic", F.xxhash64("doc_id", F.lit(13)).alias("h"), "doc_id"), "toxic", per_class, 2).select("doc_id", "toxic")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    text = text_or_empty()
    there = docs.where(F.octet_length(text) <= bytes_per_class).select("doc_id", text.alias("text"), lang.alias("lang"))
    rows = there.join(F.broadcast(chosen), "doc_id")  # at most per_class ids a class
    rows = least_hashed(rows.select("toxic", F.xxhash64("doc_id", "text", F.lit(17)).alias("h"), "doc_id", "text", "lang"), "toxic", per_class, 2)
    size = F.sum(F.octet_length("text")).over(Window.partitionBy("toxic").orderBy("h"))
    got = rows.withColumn("_size", size).where(F.col("_size") <= bytes_per_class).select("doc_id", "text", "lang", "toxic").toPandas()
    got = got.sort_values(["doc_id", "text"], ignore_index=True)
    if got.toxic.nunique() < 2:
        return None
    return train([t.encode() for t in got.text], got.toxic.to_numpy(), got.lang.tolist())


def _score(net: TextNet | None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, most=1 << 19):
            s = net.scores([t.encode() for t in frame.text]) if net else np.zeros(len(frame))
            yield frame.drop(columns="text").assign(score=s.astype(float), predicted=(s >= 0.5).astype(np.int32))

    return run


def score(docs: DataFrame, net: TextNet | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, score and predicted (score >= 0.5) of every row, from the whole text alone."""
    return through_pandas(docs, keep, _score(net), "score double, predicted int", text=text_or_empty())


def without_toxic(docs: DataFrame, net: TextNet | None) -> DataFrame:
    """The rows of ``docs`` whose text scores below 0.5, all columns as they were; all rows if there is no net.

    A null text is scored as an empty one and stays null; ids do not matter; repeated rows all stay or all go.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column("text")
            for a in range(0, part.num_rows, 256):
                some = [(t or "").encode() for t in texts[a : a + 256].to_pylist()]
                yield part.slice(a, 256).filter(pa.array(net.scores(some) < 0.5))

    return docs.mapInArrow(run, docs.schema) if net else docs


def toxicity(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; learns from labelled rows that are not held out.

    A null text counts as empty and has a score like any text without words; without labels of both kinds every score
    is 0. A doc_id labelled twice counts as toxic if one label says so. An empty table gives no rows.
    """
    net = fit(docs.where(fold(mod) != held), labels.where(fold(mod) != held))
    return score(docs.withColumn("held_out", fold(mod) == held), net, ("doc_id", "held_out"))

"""Language identification by a byte convolutional network, trained in numpy.

A window of ``WINDOW`` bytes is embedded byte by byte; filters of several widths slide over it, each keeps its largest
response, and a softmax over these gives the language. A document is cut into consecutive windows, all of it; its
probabilities are the mean over windows, weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.shared import batches, text_or_empty, through_pandas

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
#: At most so many documents of each language are learned from, so many windows of each, and so many languages, the most frequent.
DOCS_PER_LANGUAGE = 600
WINDOWS_PER_DOC = 4
LANGUAGES = 256
_LETTER = regex.compile(r"\p{L}")


@dataclass
class ByteNet:
    classes: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: list[np.ndarray]  # (width * EMBED) x FILTERS
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> list[tuple[np.ndarray, ...]]:
        """The responses to byte pairs, so that a filter of width w is a sum of table rows."""
        found = []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            single = [self.embed @ f[k * EMBED : (k + 1) * EMBED] for k in range(w)]
            parts = [(single[k][:, None, :] + single[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, w - 1, 2)]
            if w % 2:
                parts.append(single[-1])
            found.append(tuple(p.astype(np.float32) for p in parts))
        return found

    def pooled(self, windows: np.ndarray, tables: list[tuple[np.ndarray, ...]]) -> np.ndarray:
        """(windows x filters) largest responses; windows: n x WINDOW bytes."""
        pairs = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
        got = []
        for w, parts, bias in zip(WIDTHS, tables, self.bias, strict=True):
            n = windows.shape[1] - w + 1
            y = None
            for k, part in enumerate(parts):
                x = part[(pairs if len(part) > 256 else windows)[:, 2 * k : 2 * k + n]]
                y = x if y is None else np.add(y, x, out=y)
            got.append(y.max(axis=1) + bias)
        return np.maximum(np.concatenate(got, axis=1), 0)

    def probabilities(self, windows: np.ndarray, tables) -> np.ndarray:
        z = self.pooled(windows, tables) @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def cut(data: bytes, window: int = WINDOW) -> np.ndarray:
    """All consecutive windows of a text; the last is filled up with zeros."""
    n = -(-len(data) // window)
    return np.frombuffer(data.ljust(n * window, b"\0"), np.uint8).reshape(n, window)


def train(windows: np.ndarray, label: np.ndarray, classes: list[str], epochs: int = 6, rate: float = 0.01, batch: int = 64, seed: int = 7) -> ByteNet:
    """Adam on the cross-entropy; each epoch draws as many windows of every class. Only the largest responses carry gradients."""
    rng = np.random.default_rng(seed)
    k = len(classes)
    net = ByteNet(
        classes, rng.normal(0, 0.5, (256, EMBED)), [rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)) for w in WIDTHS],
        [np.zeros(FILTERS) for _ in WIDTHS], rng.normal(0, 0.1, (FILTERS * len(WIDTHS), k)), np.zeros(k),
    )
    weights = [net.embed, *net.filters, *net.bias, net.out, net.out_bias]
    m, v = [np.zeros_like(x) for x in weights], [np.zeros_like(x) for x in weights]
    members = [np.flatnonzero(label == c) for c in range(k)]
    step, each = 0, max(400, min(1500, int(np.median([len(x) for x in members]))))
    for _ in range(epochs):
        drawn = rng.permutation(np.concatenate([rng.choice(x, each) for x in members]))
        for a in range(0, len(drawn), batch):
            rows = drawn[a : a + batch]
            x, y, n = windows[rows], label[rows], len(rows)
            e = net.embed[x]
            got, at = [], []
            for w, f, b in zip(WIDTHS, net.filters, net.bias, strict=True):
                cols = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(n, -1, w * EMBED)
                r = cols @ f
                best = r.argmax(axis=1)
                at.append(best)
                got.append(np.take_along_axis(r, best[:, None, :], 1)[:, 0] + b)
            raw = np.concatenate(got, axis=1)
            hidden = np.maximum(raw, 0)
            z = hidden @ net.out + net.out_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            p = z / z.sum(axis=1, keepdims=True)
            p[np.arange(n), y] -= 1
            p /= n
            grads = [np.zeros_like(x) for x in weights]
            grads[-2], grads[-1] = hidden.T @ p, p.sum(axis=0)
            back = (p @ net.out.T) * (raw > 0)
            for i, w in enumerate(WIDTHS):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                grads[1 + len(WIDTHS) + i] = g.sum(axis=0)
                rows_at = np.arange(n)[:, None]
                for j in range(w):
                    byte = x[rows_at, at[i] + j]  # n x FILTERS
                    part = slice(j * EMBED, (j + 1) * EMBED)
                    grads[1 + i][part] += np.einsum("nfe,nf->ef", net.embed[byte], g)
                    np.add.at(grads[0], byte, g[:, :, None] * net.filters[i][part].T[None])
            step += 1
            for t, (x_, g) in enumerate(zip(weights, grads, strict=True)):
                m[t] = 0.9 * m[t] + 0.1 * g
                v[t] = 0.999 * v[t] + 0.001 * g * g
                x_ -= rate * (m[t] / (1 - 0.9**step)) / (np.sqrt(v[t] / (1 - 0.999**step)) + 1e-8)
    return net


def fold(mod: int) -> Column:
    """crc32 of doc_id as text, modulo ``mod``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod


def _learning_windows(classes: list[str], most: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames):
            out = []
            for text, lang in zip(frame.text, frame.lang, strict=True):
                w = cut(text.encode())
                for i in sorted({int(x) for x in np.linspace(0, len(w) - 1, most)}) if len(w) else ():
                    out.append((classes.index(lang), w[i].tobytes()))
            yield pd.DataFrame(out, columns=["label", "window"])

    return run


def least_hashed(rows: DataFrame, group: str, per_group: int, groups: int) -> DataFrame:
    """Of the rows (``group``, h, further columns), the ``per_group`` distinct h that are least in each of the most frequent ``groups``.

    An approximate count of distinct hashes gives the share of hashes that is looked at, twice what is needed, so repeated
    rows count once and few rows move.
    """
    seen = rows.groupBy(group).agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), group).limit(groups)
    share = {r[0]: min(1.0, 2 * (per_group + 50) / max(1, r.n)) for r in seen.collect()}
    if not share:
        return rows.where("false")
    asked = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(v))])[F.col(group)]
    some = rows.where(F.pmod("h", F.lit(1 << 30)) < asked * (1 << 30)).dropDuplicates([group, "h"])
    return some.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy("h"))).where(F.col("_r") <= per_group).drop("_r")


def fit(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE, windows_per_doc: int = WINDOWS_PER_DOC, languages: int = LANGUAGES) -> ByteNet | None:
    """Learns from (doc_id, text, lang): of each language the ``per_language`` distinct documents (id and text) of least hash.

    The sample is bounded by ``languages`` x ``per_language`` documents of ``windows_per_doc`` windows, evenly spread over
    the whole text; ids may be null or repeated. None if no row has a language.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    chosen = least_hashed(usable.select("lang", F.xxhash64("doc_id", "text", F.lit(11)).alias("h"), "text"), "lang", per_language, languages)
    classes = sorted(r.lang for r in chosen.select("lang").distinct().collect())
    rows = chosen.select("text", "lang").mapInPandas(_learning_windows(classes, windows_per_doc), "label int, window binary").toPandas()
    if not len(rows):
        return None
    rows = rows.sort_values(["label", "window"], ignore_index=True)  # the same sample in the same order, whatever the partitions
    windows = np.frombuffer(b"".join(rows.window), np.uint8).reshape(-1, WINDOW)
    return train(windows, rows.label.to_numpy(), classes)


def _predict(net: ByteNet | None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = net.tables() if net else None
        for frame in batches(frames, most=1 << 17):
            texts = frame.text.tolist()
            known = [i for i, t in enumerate(texts) if net and _LETTER.search(t)]
            lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            if known:
                cuts = [texts[i].encode() for i in known]
                sizes = np.fromiter(map(len, cuts), np.int64, len(cuts))
                count = -(-sizes // WINDOW)
                total = np.zeros((len(known), len(net.classes)))
                owner = np.repeat(np.arange(len(known)), count)
                weight = np.full(len(owner), float(WINDOW))
                weight[np.cumsum(count) - 1] = sizes - (count - 1) * WINDOW
                windows = np.concatenate([cut(c) for c in cuts])
                for a in range(0, len(windows), 128):
                    p = net.probabilities(windows[a : a + 128], tables) * weight[a : a + 128, None]
                    np.add.at(total, owner[a : a + 128], p)
                total /= sizes[:, None]
                best = total.argmax(axis=1)
                lang[known] = [net.classes[b] for b in best]
                score[known] = np.clip(total[np.arange(len(known)), best], 0, 1)
            yield frame.drop(columns="text").assign(lang_pred=lang, score=score)

    return run


def predict(docs: DataFrame, net: ByteNet | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds lang_pred (``und`` for a null text or one without letters) and score to the kept columns."""
    return through_pandas(docs, keep, _predict(net), "lang_pred string, score double", text=text_or_empty())


def language_id(docs: DataFrame, mod: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row; learns from rows that are not held out and have a language.

    Null or letterless texts give ``und`` with score 0; without any learned language all do. Null ids count as the
    text '' in the fold; repeated rows get equal results; an empty table gives no rows; other columns do not matter.
    """
    net = fit(docs.where(fold(mod) != held))
    out = docs.withColumn("held_out", fold(mod) == held)
    return predict(out, net, ("doc_id", "held_out"))

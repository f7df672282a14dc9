"""Token counts of fields and sections by offset-mapped attribution.

A document is encoded once, as a whole. Its tokens' spans follow from their byte lengths, and an interval join by binary
search gives each token to the section that its rule names:

- ``first``: the section of the token's first character;
- ``last``: that of its last character;
- ``most``: that with most of its bytes, the earlier one on a tie.

Every token counts once, so a document's counts add up to its tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import batches, through_pandas

RULES = ("first", "last", "most")


@cache
def _encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        size[i] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, size


def attributed(sizes: np.ndarray, starts: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token, from token lengths and section starts, both in bytes and gapless from 0."""
    end = np.cumsum(sizes)
    begin = end - sizes
    first = np.searchsorted(starts, begin, side="right") - 1
    if rule == "first":
        return first
    last = np.searchsorted(starts, end - 1, side="right") - 1
    if rule == "last":
        return last
    out = first.copy()
    bounds = np.append(starts, end[-1] if len(end) else 0)
    for i in np.flatnonzero(first != last):
        own = [min(end[i], bounds[s + 1]) - max(begin[i], bounds[s]) for s in range(first[i], last[i] + 1)]
        out[i] = first[i] + int(np.argmax(own))
    return out


def _places(data: bytes, chars: list[int]) -> np.ndarray:
    """Byte places of character places."""
    lead = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return np.append(lead, len(data))[chars]


def _count(path: str, pattern: str, rule: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, size = _encoder(path, pattern)
        for frame in batches(frames, most=1 << 19):
            out: dict[str, list] = {k: [] for k in ("row", "section", "n_chars", "n_tokens")}
            for row, (text, begins) in enumerate(zip(frame.text, frame.begins, strict=True)):
                data = text.encode()
                if begins is None:  # lines; a line keeps its end
                    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
                    starts = np.concatenate(([0], breaks[breaks < len(data)]))
                else:
                    starts = _places(data, [int(x) for x in begins])
                chars = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
                ids = np.array(encode(text), np.int64)
                n = np.bincount(attributed(size[ids], starts, rule), minlength=len(starts)) if len(ids) else np.zeros(len(starts), int)
                out["row"].append(np.full(len(starts), row))
                out["section"].append(np.arange(len(starts)))
                out["n_chars"].append(np.diff(chars[np.append(starts, len(data))]))
                out["n_tokens"].append(n)
            made = {k: np.concatenate(v) for k, v in out.items()}
            rows = frame.drop(columns=["text", "begins"]).iloc[made.pop("row")].reset_index(drop=True)
            yield rows.assign(**made)

    return run


def token_counts(docs: DataFrame, tokenizer: str, pattern: str, rule: str = "first", fields: list[str] | None = None, key: str = "doc_id") -> DataFrame:
    """(key, section, n_chars, n_tokens): one row for each section of each row of ``docs``.

    Without ``fields`` the sections are the lines of ``text``, each with its line end. With them, the document is the
    fields in turn, each but the last followed by a line end that belongs to it, and section k is the k-th field.
    Null texts and fields count as empty; an empty document has one section without tokens (or all its fields); null
    and repeated keys stay as they are; an empty table gives no rows; other columns do not matter.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    if fields is None:
        text: Column = F.coalesce(F.col("text"), F.lit(""))
        begins: Column = F.lit(None).cast("array<int>")
    else:
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]
        text = F.concat_ws("\n", *parts)
        begins, at = [F.lit(0)], F.lit(0)
        for p in parts[:-1]:
            at = at + F.length(p) + 1
            begins.append(at)
        begins = F.array(*begins).cast("array<int>")
    return through_pandas(docs, (key,), _count(tokenizer, pattern, rule), "section int, n_chars long, n_tokens long", text=text, begins=begins)

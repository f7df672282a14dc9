"""Encoders over public vocabulary files, each made once in a Python worker."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import cache

import numpy as np

#: Words whose ids are remembered, about; as many from before, in case they come again.
REMEMBERED = 300_000
#: The vocabulary's own split, for text of the Basic Latin and Latin-1 letters in lower case.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\sa-z0-9\xaa\xb5\xba\xdf-\xf6\xf8-\xff\xb2\xb3\xb9\xbc-\xbe]+")
#: Text outside of this takes the general way.
_OTHER = re.compile(r"[^\t\n\x0b\x0c\r -~\xa1-\xff]|<\|")


@cache
def word_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """texts -> the ids of each as little-endian unsigned 32-bit numbers, exactly as the tokenizer gives them.

    The vocabulary splits a text into words before it merges, and each word's last token is marked as an end, so a
    word's ids do not depend on its neighbours and are remembered (until ``forget()``); new words of a batch are encoded together. Text
    with other characters, which normalisation might join, is encoded as a whole.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    ending = np.zeros(tokenizer.get_vocab_size() + 1, bool)
    ending[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
    known: dict[str, bytes] = {}
    before: dict[str, bytes] = {}  # words seen longer ago; those that come again are known again

    def ids_of(text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def learn(words: list[str]) -> None:
        for a in range(0, len(words), 4096):
            part = words[a : a + 4096]
            ids = ids_of(" ".join(part))
            ends = np.flatnonzero(ending[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("the vocabulary does not mark the end of each word")
            raw, at = ids.tobytes(), [0, *(4 * ends).tolist()]
            known.update(zip(part, (raw[x:y] for x, y in zip(at, at[1:], strict=False)), strict=True))

    def encode(texts: list[str]) -> list[bytes]:
        split = [None if _OTHER.search(t) else _SPLIT.findall(t.lower()) for t in texts]
        nonlocal known, before
        if len(known) > REMEMBERED:
            known, before = {}, known
        new = set().union(*filter(None, split)) - known.keys()
        again = new & before.keys()
        known.update((w, before[w]) for w in again)
        learn(sorted(new - again))
        get = known.__getitem__
        return [ids_of(t).tobytes() if own is None else b"".join(map(get, own)) for t, own in zip(texts, split, strict=True)]

    def forget() -> None:
        nonlocal known, before
        known, before = {}, {}

    encode.forget = forget
    return encode

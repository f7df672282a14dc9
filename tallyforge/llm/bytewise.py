"""Vectorised hashing of words and byte strings: numpy over the concatenated UTF-8 bytes of a batch."""

from __future__ import annotations

import numpy as np

U = np.uint64
_MUL = U(0x9E3779B97F4A7C15)
_MIX = U(0xD6E8FEB86659FD93)
#: One random odd word for each byte value.
BYTE = (np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) << U(1)) | U(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = h ^ (h >> U(32))
    h = h * _MIX
    h ^= h >> U(29)
    h *= _MUL
    h ^= h >> U(32)
    return h


def _power(m: np.uint64, n: int) -> np.uint64:
    return U(pow(int(m), n, 1 << 64))


def doubled(data: np.ndarray, widths: int) -> dict[int, np.ndarray]:
    """Polynomial hashes of all strings of the powers of two in ``widths``; entry w has len - w + 1 values."""
    out, w, now = {}, 1, BYTE[data]
    while w <= widths:
        if widths & w:
            out[w] = now
        if 2 * w <= widths and len(now) > w:
            now = now[:-w] * _power(_MUL, w) + now[w:]
        w *= 2
    return out


def strings(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of every string of ``width`` bytes, from its binary parts."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    parts = doubled(data, width)
    out, at = None, 0
    for bit in reversed(range(width.bit_length())):
        w = 1 << bit
        if width & w:
            piece = parts[w][at : at + n]
            out = piece.copy() if out is None else out * _power(_MUL, w) + piece
            at += w
    return mix(out)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts with one space after each, and the place where each ends (its space)."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    return data, ends


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return edges[::2], edges[1::2]


def words(data: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: runs of bytes other than 0x20 and 0x09-0x0D."""
    return runs(~_SPACE[data])


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        up = np.full(size, _MUL)
        up[0] = 1
        down = np.full(size, U(pow(int(_MUL), -1, 1 << 64)))
        down[0] = 1
        _POWERS.update(up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Spans:
    """Hashes of any pieces of one array, from a running sum and the multiplier's inverse powers."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = _powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, U)
        np.cumsum(BYTE[data] * up[: len(data)], out=self.total[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * self.down[starts] + (ends - starts).astype(U))


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each data[start:end]."""
    return Spans(data)(starts, ends) if len(starts) else np.zeros(0, U)


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def shingles(hashes: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words in one document; a document of fewer words gives one run of them all.

    ``doc`` is ascending. Returns the hashes and their documents, in document order.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    count = np.bincount(doc, minlength=int(doc[-1]) + 1)
    out, of = np.zeros(0, U), np.zeros(0, np.int64)
    if n >= width:
        run = hashes[: n - width + 1].copy()
        for i in range(1, width):
            run = run * _MUL + hashes[i : n - width + 1 + i]
        whole = doc[: n - width + 1] == doc[width - 1 :]
        out, of = mix(run[whole]), doc[: n - width + 1][whole]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        first = np.searchsorted(doc, short)
        extra = []
        for a, c in zip(first, count[short]):
            h = 0
            for x in hashes[a : a + c]:
                h = (h * int(_MUL) + int(x)) & (2**64 - 1)
            extra.append(h ^ int(c))
        out, of = np.concatenate((out, mix(np.array(extra, U)))), np.concatenate((of, short))
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of

"""Vectorised word and shingle hashes over Arrow string batches.

Words are maximal runs of bytes other than ``\\x20`` and ``\\x09-\\x0D``; A-Z may count as a-z.  A whole
slice of texts is hashed at once in numpy: a polynomial hash per word from one running sum over
the bytes (the multiplier is odd, so positions can be divided out modulo 2**64), then a mixed
sum over ``width`` neighbouring words per shingle.  Slices hold about ``SLICE_BYTES`` bytes, and a
longer text is hashed piece by piece, so memory is bounded by the longest word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15          # odd multiplier of the byte polynomial
_INVERSE = pow(_BASE, -1, 1 << 64)
_RNG = np.random.RandomState(20240229)
_BYTE = _RNG.randint(0, 1 << 62, size=256, dtype=np.int64).astype(_U) * _U(4) + _U(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]      # A-Z hash as a-z
_MULT = _RNG.randint(0, 1 << 62, size=64, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of MurmurHash3 (public domain): a bijection on 64 bits."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class _Powers:
    """Powers of the multiplier and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, _U), np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * SLICE_BYTES)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, _U(base))
                steps[0] = _U(1)
                setattr(self, name, np.cumprod(steps, dtype=_U))
        return self.up, self.down


_POWERS = _Powers()
powers = _POWERS.upto


def _words(raw: np.ndarray, breaks: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word in ``raw``; ``breaks`` are offsets at which a word always ends."""
    n = len(raw)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, _U)
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = breaks[(breaks > 0) & (breaks < n)]
    first[cut] |= inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut - 1] |= inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    up, down = _POWERS.upto(n + 1)
    terms = table[raw]
    terms *= up[:n]
    run = np.cumsum(terms, dtype=_U)
    total = run[end]
    total[start > 0] -= run[start[start > 0] - 1]
    return start, mix(total * down[start] + (end - start).astype(_U))


def _long_words(raw: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Word hashes of one long text, hashed in pieces that end at white space."""
    out, at = [], 0
    while at < len(raw):
        to = min(len(raw), at + SLICE_BYTES)
        while to < len(raw):
            gap = np.flatnonzero(_SPACE[raw[to:to + SLICE_BYTES]])
            if len(gap):
                to += int(gap[0])
                break
            to = min(len(raw), to + SLICE_BYTES)
        out.append(_words(raw[at:to], np.empty(0, np.int64), table)[1])
        at = to
    return np.concatenate(out)


def word_hashes(texts: pa.Array, fold: bool = True) -> Iterator[np.ndarray]:
    """The hashes of the words of each text in order, none for null or empty texts; ``fold``: A-Z as a-z."""
    table = _FOLDED if fold else _BYTE
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    texts = texts.fill_null(b"")
    if len(texts) == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        base = offsets[at]
        to = max(at + 1, int(np.searchsorted(offsets, base + SLICE_BYTES, side="right")) - 1)
        raw = data[base:offsets[to]]
        if to == at + 1 and len(raw) > SLICE_BYTES:
            yield _long_words(raw, table)
        else:
            breaks = offsets[at:to + 1] - base
            start, hashes = _words(raw, breaks, table)
            cuts = np.searchsorted(start, breaks)
            for k in range(to - at):
                yield hashes[cuts[k]:cuts[k + 1]]
        at = to


def grams(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the ``width``-word windows, in order; empty if there are fewer words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, _U)
    total = words[:n] * _MULT[0]
    for k in range(1, width):
        total += words[k:k + n] * _MULT[k]
    return mix(total)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingles; a text of fewer words than ``width`` is one shingle, of none has none."""
    n = len(words)
    if n == 0:
        return words
    if n < width:
        return mix((words * _MULT[:n]).sum(dtype=_U, keepdims=True) + _MULT[-n:-n + 1 or None])
    found = np.sort(grams(words, width))
    if n == width:
        return found
    keep = np.ones(len(found), bool)
    np.not_equal(found[1:], found[:-1], out=keep[1:])
    return found[keep]

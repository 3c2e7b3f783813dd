"""Multiset intersections of many pairs of texts at once.

The texts of a slice lie one after the other in one array of code points, and so do the grams that start at
every place.  A place's longest gram and the row it is in are one number, and one sort of the slice's numbers serves
all orders: equal grams of fewer code points are runs with an equal head.  The intersection of two bags is the
sum, over a row's runs, of the smaller count of either side, and the different grams of a side are the runs it is in.
There is no loop over rows.  Code points are numbered densely within a slice, so six of them and a row fit
63 bits in most alphabets; where they do not, grams are numbered order by order from those one shorter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 16         # code points of a slice, both sides, which caches hold; a longer pair is a slice by itself


def _runs(key: np.ndarray, row_shift: int, rows: int, tails: list[int], mask: int = 0, kinds: bool = False) -> list[np.ndarray]:
    """For each of ``tails``, ascending, by row: the size of the intersection of two bags; with ``kinds`` either side's different items too.

    A key is the row, the item and, in the last bit, the side; an item is the key without so many last bits.  With a
    ``mask`` items whose last bits are all zero are none.
    """
    key.sort()
    n = len(key)
    seconds = np.zeros(n + 1, np.int32)     # keys of the second side before each place
    np.cumsum(key & 1, out=seconds[1:])
    change = np.empty(n, np.int64)
    change[:1] = -1
    np.bitwise_xor(key[1:], key[:-1], out=change[1:])
    bounds = np.append(np.searchsorted(key, np.arange(rows) << row_shift), n)
    starts, out = np.arange(n, dtype=np.int32), []

    def by_row(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=sums[1:])
        return np.diff(sums[edges])
    for tail in tails:
        heads = np.flatnonzero(change >> tail)
        starts, change = starts[heads], change[heads]
        at = np.append(starts, np.int32(n))
        count, second = at[1:] - at[:-1], seconds[at]
        second = second[1:] - second[:-1]
        first = count - second
        if mask:
            real = (key[starts] >> tail) & mask != 0
            first *= real
            second *= real
        edges = np.searchsorted(starts, bounds)
        found = [by_row(np.minimum(first, second), edges)]
        if kinds:
            found += [by_row(first > 0, edges), by_row(second > 0, edges)]
        out.append(np.stack(found))
    return out


def _bits(values: int) -> int:
    return max(1, int(values - 1).bit_length()) if values > 1 else 1


def _code_points(texts: pa.Array) -> np.ndarray:
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = b"" if data is None else data[int(offsets[0]):int(offsets[-1])].to_pybytes() if len(offsets) else b""
    return np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32).astype(np.int64)


class _Slice:
    """Pairs of normalised texts as dense code points, all first texts and then all second ones."""

    def __init__(self, pred: pa.Array, ref: pa.Array) -> None:
        self.rows = len(pred)
        self.texts = pa.concat_arrays([pred, ref])
        self.lengths = pc.utf8_length(self.texts).to_numpy().astype(np.int64)
        points = _code_points(self.texts)
        seen = np.zeros(int(points.max(initial=0)) + 1, bool)
        seen[points] = True
        known = np.flatnonzero(seen)
        dense = np.zeros(len(seen), np.int64)
        dense[known] = np.arange(1, len(known) + 1)     # 0 stands for no code point
        self.points, self.alphabet = dense[points], len(known) + 1
        # the row in the highest bits and the side in the lowest; a gram goes between
        self.row_shift = 63 - _bits(self.rows)
        self.place = (np.arange(2 * self.rows) % self.rows << self.row_shift) | (np.arange(2 * self.rows) >= self.rows)

    def tokens(self, kinds: bool) -> tuple[np.ndarray, np.ndarray]:
        """(what ``_runs`` tells, numbers of tokens of either side) of the bags of tokens between single spaces."""
        split = pc.split_pattern(self.texts, " ")
        n = pc.list_value_length(split).to_numpy().astype(np.int64)
        words = split.flatten().dictionary_encode()
        ids = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        key = (ids << 1) | np.repeat(self.place, n)
        n = np.where(self.lengths > 0, n, 0)
        if not n.all():     # an empty text splits into an empty token
            key = key[np.repeat(self.lengths > 0, pc.list_value_length(split).to_numpy())]
        return _runs(key, self.row_shift, self.rows, [1], 0, kinds)[0], n.reshape(2, -1)

    def grams(self, most: int, kinds: bool) -> list[np.ndarray]:
        """What ``_runs`` tells of the bags of 1 to ``most`` code points; texts with fewer have none here."""
        each, ends, place = _bits(self.alphabet), np.cumsum(self.lengths), np.repeat(self.place, self.lengths)
        if most * each + 1 > self.row_shift:
            return self._order_by_order(most, kinds, each, ends, place)
        gram = self.points << each * (most - 1) + 1
        for k in range(1, min(most, len(gram))):
            gram[:-k] |= self.points[k:] << each * (most - 1 - k) + 1
        for k in range(1, most):    # what follows a text's last places is of no gram
            gram[ends[self.lengths >= k] - k] &= -1 << each * (most - k) + 1
        gram |= place
        found = _runs(gram, self.row_shift, self.rows, [1 + each * k for k in range(most)], (1 << each) - 1, kinds)
        return found[::-1]

    def _order_by_order(self, most: int, kinds: bool, each: int, ends: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
        gram, out = self.points, []
        bits, inside = each, np.ones(len(gram), bool)
        for n in range(1, most + 1):
            if n > 1:
                if bits + each + 1 > self.row_shift:    # number the grams so far; a slice has few of them, or is one row
                    known, gram = np.unique(gram, return_inverse=True)
                    bits = _bits(len(known))
                size = max(len(self.points) - n + 1, 0)
                gram = (gram[:size] << each) | self.points[len(self.points) - size:]
                bits += each
                # no gram starts at the last n - 1 places of a text
                inside[ends[self.lengths >= n - 1] - (n - 1)] = False
            size = len(gram)
            out += _runs(((gram << 1) | place[:size])[inside[:size]], self.row_shift, self.rows, [1], 0, kinds)
        return out


def counted(pred: pa.Array, ref: pa.Array, most: int, kinds: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(intersections, sizes, different items) of shapes (1 + most, rows) and twice (1 + most, 2, rows): tokens, then
    grams of 1 to ``most``.  Without ``kinds`` different items are not counted.

    ``pred`` and ``ref`` are normalised texts without nulls.  An empty text has empty bags; a text shorter than an order
    is that order's one gram, equal only to itself.
    """
    pred, ref = pred.cast(pa.large_string()), ref.cast(pa.large_string())
    rows = len(pred)
    size = pc.add(pc.utf8_length(pred), pc.utf8_length(ref)).to_numpy().astype(np.int64)
    shared, sizes = np.zeros((1 + most, rows), np.int64), np.zeros((1 + most, 2, rows), np.int64)
    different = np.zeros((1 + most, 2, rows), np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + SLICE, side="right")))
        part = _Slice(pred.slice(at, to - at), ref.slice(at, to - at))
        found, sizes[0, :, at:to] = part.tokens(kinds)
        shared[0, at:to] = found[0]
        if kinds:
            different[0, :, at:to] = found[1:]
        lengths = part.lengths.reshape(2, -1)
        short, long = lengths.min(axis=0), lengths.max(axis=0)
        same = pc.equal(pred.slice(at, to - at), ref.slice(at, to - at)).to_numpy(zero_copy_only=False)
        for n, found in enumerate(part.grams(most, kinds), 1):
            whole = (short > 0) & (short < n)
            shared[n, at:to] = np.where(whole, (same & (long < n)).astype(np.int64), found[0])
            sizes[n, :, at:to] = np.where(lengths < n, np.minimum(lengths, 1), lengths - n + 1)
            if kinds:
                different[n, :, at:to] = np.where(lengths < n, np.minimum(lengths, 1), found[1:])
        at = to
    return shared, sizes, different


def overlaps(pred: pa.Array, ref: pa.Array, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(intersections, sizes) of shapes (1 + most, rows) and (1 + most, 2, rows), as ``counted`` tells them."""
    return counted(pred, ref, most, False)[:2]


def f_scores(shared: np.ndarray, sizes: np.ndarray, beta: float) -> np.ndarray:
    """F-beta by row: 1 for two empty bags, 0 for one, 0 without a shared item."""
    pred, ref = sizes[0], sizes[1]
    beta2 = beta * beta
    with np.errstate(divide="ignore", invalid="ignore"):
        precision, recall = shared / pred, shared / ref
        score = ((1.0 + beta2) * precision * recall) / (beta2 * precision + recall)
    empty = (pred == 0) | (ref == 0)
    return np.where(empty, (pred == ref).astype(np.float64), np.where(shared == 0, 0.0, score))

"""Substring dedup: MinHash banding of paragraphs, verified and clustered by components.

Paragraphs are all runs of ``WINDOW`` words of a text, so a passage is found wherever it stands in
a line.  A key is the run of ``RUN`` words (its 13 neighbouring five-word shingles) at the shingle that
a permutation puts first.  With one band, among those where the run ends inside the paragraph; overlapping
paragraphs mostly share it.  ``bands_for`` tells how many such bands ones with a changed word need, by
``key_share``, and from two on the minima of every nine neighbouring runs are taken instead, under one permutation:
near paragraphs share half a paragraph of equal words, which holds nine runs, so they share a key for certain.
A text has about one key per five words.

Texts are first grouped by equality: of copies all but the first by id are repeats as a whole, and
that one alone takes part in what follows.  In every
bucket of a key one pivot text is paired with the others.  A pair's matches are verified on the
words themselves: maximal equal runs of at least ``WINDOW`` words, or aligned paragraphs whose exact
Jaccard of five-word shingles reaches ``PERCENT``.  A place of a key is settled if all paragraphs
around it lie in one equal run with the pivot, which has the key once.  Unsettled places and the pivots'
places in their buckets give the hashes of the whole paragraphs around them: places that share one are
linked to the first of them, so no equal paragraph is lost and no bucket becomes all its pairs.
Places that still lie in no match meet the other unsettled places of their bucket by keys, never pair by
pair.  With 46 different shingles a Jaccard of 0.8 leaves two paragraphs one changed, missing or added word, or
``NEARLY`` equal words in a row.  So a place first gives six keys of its run and 11 more words, of which near
paragraphs share one; places whose keys meet give keys of the words before and after each edit beside the run, as
far off as the words next to an edit may have their place; edits that meet, with different words passed over, give the key of every paragraph around them without the
word.  All paragraphs of such a key are one edit apart, so a link of each with the first loses none.
Overlapping matches of a text join into spans; matches connect spans, and each component keeps its
first span, by id and place, and gives the others up for removal.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paraspark.llm.common import dropped, sized_broadcast, stored, table, text_or_empty, trimmed
from paraspark.llm.components import components
from paraspark.llm.ngram_join import (
    BITMAP_BITS,
    BROADCAST_ROWS,
    RARE_LEVEL,
    _add_chunks,
    _bitmap,
    _CHUNK,
    common,
    ranks,
    sketch_bits,
    sliced,
)
from paraspark.llm.shingles import grams, mix, powers, word_hashes

WINDOW = 50
RUN = 17
WIDTH = 5
PERCENT = 80
RECALL = 0.95
HALF = 25           # equal words side by side that near paragraphs share; they hold nine runs
PARTNERS = 512      # pairs of a pivot in one task
NEARLY = 45         # equal words that leave the paragraph around them a Jaccard of PERCENT, if their shingles differ
PLACES = 4096       # of a text whose keys are made at once
POSITIONS = 1 << 14
KEY_ROWS = 1 << 17  # keys held before they go on
_PART = 11          # of three parts of 32 words one has as many
_MIDDLE = 35        # equal words on the longer side of an edit: so many or more, or at most one less
BROADCAST_PAIRS = 200_000   # with their places
BROADCAST_PLACES = 6_000_000    # of eight bytes each
BROADCAST_KEYS = 2_000_000      # of eight bytes, about 130 MB as a hash table

Batches = Iterator[pa.RecordBatch]


def bands_for(similarity: float, recall: float = RECALL) -> int:
    """Bands of one row that let paragraphs of this Jaccard share a minimum with this probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity)))


def key_share(window: int = WINDOW, run: int = RUN, width: int = WIDTH) -> float:
    """Least probability, over its places, that paragraphs with one changed word share their key of a band.

    The minimum over the places of both must be at one whose whole run is without the word.
    """
    places, shares = range(window - run + 1), []
    for word in range(window):
        kept = sum(not p <= word < p + run for p in places)
        shares.append(kept / (len(places) + sum(p <= word < p + width for p in places)))
    return min(shares)


def anchors(words: np.ndarray, bands: int, window: int = WINDOW, run: int = RUN, width: int = WIDTH) -> np.ndarray:
    """Places of the minima, ascending: of all paragraphs for one band, of the runs in all half paragraphs for more."""
    span = (window if bands == 1 else HALF) - run + 1
    if len(words) < window:
        return np.empty(0, np.int64)
    shingles = grams(words, width)[:len(words) - run + 1]
    found, step = [], 1 << 16
    low = np.uint64((1 << 20) - 1)
    places = np.arange(min(len(shingles), step + span), dtype=np.uint64)
    order = mix(shingles ^ np.uint64(0x9E3779B97F4A7C15)) & ~low
    for at in range(0, len(order) - span + 1, step):
        least = order[at:at + step + span - 1] | places[:len(order[at:at + step + span - 1])]
        done = 1        # each entry is the minimum, with its place, of this many from it on
        while done < span:
            shift = min(done, span - done)
            least = np.minimum(least[:-shift], least[shift:])
            done += shift
        found.append(np.unique(least & low).astype(np.int64) + at)
    return np.unique(np.concatenate(found))


def _keys(bands: int) -> Callable[[Batches], Batches]:
    def make(batches: Batches) -> Batches:
        done: set[int] = set()      # a task gives the keys of equal texts once
        for batch in sliced(batches):
            size, keys, places, offsets = [], [], [], [0]
            for text, words in zip(batch.column("node").to_pylist(), word_hashes(batch.column("text")), strict=True):
                size.append(len(words))
                at = np.empty(0, np.int64)
                if len(words) >= WINDOW and text not in done:
                    done.add(text)
                    at = anchors(words, bands)
                keys.append(grams(words, RUN)[at] if len(at) else np.empty(0, np.uint64))
                places.append(at)
                offsets.append(offsets[-1] + len(at))
            flat, at = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, places))
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x)) for x in (flat.view(np.int64), at.astype(np.int32))]
            yield pa.record_batch([batch.column("id"), batch.column("row_key"), batch.column("node"), pa.array(size, pa.int64()), *lists],
                                  names=["id", "row_key", "node", "n", "keys", "places"])
    return make


def _count_keys(bits: int) -> Callable[[Batches], Batches]:
    import zlib

    def count(batches: Batches) -> Batches:
        cells = np.zeros(1 << bits, np.int64)
        for batch in batches:
            flat = batch.column("keys").flatten().to_numpy().view(np.uint64)
            cells += np.bincount((flat >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        chunks = [(k, cells[at:at + _CHUNK]) for k, at in enumerate(range(0, 1 << bits, _CHUNK))]
        chunks = [(k, zlib.compress(c.tobytes(), 1)) for k, c in chunks if c.any()]
        yield pa.record_batch([pa.array([k for k, _ in chunks], pa.int32()), pa.array([c for _, c in chunks], pa.binary())],
                              names=["chunk", "cells"])
    return count


def _key_rows(levels) -> Callable[[Batches], Batches]:
    def rows(batches: Batches) -> Batches:
        for batch in batches:
            lists = batch.column("keys")
            flat = lists.flatten().to_numpy()
            node = np.repeat(batch.column("node").to_numpy(), pa.compute.list_value_length(lists).to_numpy())
            rare = ranks(flat.view(np.uint64), levels.value) <= RARE_LEVEL
            yield pa.record_batch([pa.array(flat), pa.array(node, pa.int64()), batch.column("places").flatten(), pa.array(rare)],
                                  names=["key", "node", "place", "rare"])
    return rows


def _words(bits) -> Callable[[Batches], Batches]:
    def make(batches: Batches) -> Batches:
        for batch in sliced(batches):
            place = batch.column("row_key").to_numpy() & ((1 << BITMAP_BITS) - 1)
            hit = pa.array(((bits.value[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)).astype(bool))
            raw = [(w >> np.uint64(32)).astype(np.uint32).tobytes() for w in word_hashes(batch.column("text").filter(hit))]
            yield pa.record_batch([batch.column("node").filter(hit), pa.array(raw, pa.binary())], names=["node", "words"])
    return make


def matches(a: np.ndarray, b: np.ndarray, seeds: list[tuple[int, int]], grams_a: np.ndarray | None = None) -> list[tuple[int, int, int, int]]:
    """(start and end in a, start and end in b) of verified repeats around places with equal keys.

    A key lies in a maximal run of equal words.  A run of ``WINDOW`` words is a repeat; around a shorter
    one the two paragraphs that start and that end with it are compared, so one changed, missing or
    added word beside it is found.
    """
    found: list[tuple[int, int, int, int]] = []
    breaks: dict[int, np.ndarray] = {}      # per diagonal the places of a where the texts differ
    done: set[tuple[int, int]] = set()
    grams_b = None
    for i, j in sorted(seeds):
        d = i - j
        if d not in breaks:
            lo, hi = max(0, d), min(len(a), len(b) + d)
            breaks[d] = np.concatenate(([lo - 1], np.flatnonzero(a[lo:hi] != b[lo - d:hi - d]) + lo, [hi]))
        k = int(np.searchsorted(breaks[d], i))
        start, end = int(breaks[d][k - 1]) + 1, int(breaks[d][k])
        if (d, start) in done:
            continue
        done.add((d, start))
        if end - start >= WINDOW:
            found.append((start, end, start - d, end - d))
            continue
        if grams_b is None:
            grams_a = grams(a.astype(np.uint64), WIDTH) if grams_a is None else grams_a
            grams_b = grams(b.astype(np.uint64), WIDTH)
        for x in (start, end - WINDOW):
            y = x - d
            if x < 0 or y < 0 or x + WINDOW > len(a) or y + WINDOW > len(b):
                continue
            p, q = (np.unique(g[at:at + WINDOW - WIDTH + 1]) for g, at in ((grams_a, x), (grams_b, y)))
            shared = common(p, q)
            if 100 * shared >= PERCENT * (len(p) + len(q) - shared):
                found.append((x, x + WINDOW, y, y + WINDOW))
    return found


def _verify(batches: Batches) -> Batches:
    """Rows arrive by (pivot, part), the pivot's own words first; ``n`` is the length of b if the match is exact.

    A seed holds its place in a above the 32 bits of that in b.
    """
    at, pivot, pivot_grams = None, None, None
    names = ["a", "b", "a0", "a1", "b0", "b1", "n"]
    for batch in batches:
        out = []
        for a, b, seeds, raw in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "seeds", "words")), strict=True):
            words = np.frombuffer(raw, np.uint32)
            if b is None:
                at, pivot, pivot_grams = a, words, grams(words.astype(np.uint64), WIDTH)
            elif at == a:
                found = set(matches(pivot, words, [(s >> 32, s & 0xFFFFFFFF) for s in seeds], pivot_grams))
                out += [(a, b, *m, len(words) if np.array_equal(pivot[m[0]:m[1]], words[m[2]:m[3]]) else None) for m in found]
        columns = list(zip(*out, strict=True)) if out else [[]] * 7
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 2 + [pa.int32()] * 5, strict=True)], names=names)


def _whole(batches: Batches) -> Batches:
    """The hashes of all paragraphs that hold one of the places: ``(key, node, place)``."""
    for batch in batches:
        keys, nodes, starts = [], [], []
        for node, raw, places in zip(*(batch.column(c).to_pylist() for c in ("node", "words", "places")), strict=True):
            whole = grams(np.frombuffer(raw, np.uint32).astype(np.uint64), WINDOW)
            p = np.array(places, np.int64)
            at = np.flatnonzero(_marked(len(whole), p + RUN - WINDOW, p + 1))
            keys.append(whole[at])
            starts.append(at)
            nodes.append(np.full(len(at), node, np.int64))
        flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, nodes, starts)]
        yield pa.record_batch([pa.array(flat[0].view(np.int64)), pa.array(flat[1], pa.int64()), pa.array(flat[2].astype(np.int32))],
                              names=["key", "node", "place"])


class _Runs:
    """Hashes of any runs of one text's words, from running sums of a polynomial."""

    def __init__(self, words: np.ndarray) -> None:
        self.n = len(words)
        self.up, self.down = powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(mix(words.astype(np.uint64) + np.uint64(1)) * self.up[:self.n], out=self.sums[1:])
        self.words = words

    def inside(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (start >= 0) & (end <= self.n)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        start, end = np.clip(start, 0, self.n), np.clip(end, 0, self.n)
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def pair(self, tag: int, left: tuple, right: tuple) -> np.ndarray:
        """The key of two runs, of which the tag tells the kind."""
        return mix(self.of(*left) * np.uint64(0xD6E8FEB86659FD93) + mix(self.of(*right) + np.uint64(tag)))

    def word(self, at: np.ndarray) -> np.ndarray:
        return self.words[np.clip(at, 0, self.n - 1)].astype(np.int64)


def _loose(runs: _Runs, places: np.ndarray, opened: np.ndarray) -> Iterator[tuple]:
    """Six keys a place, of which near paragraphs that hold it share one: ``(keys, opened, place, around)``.

    With ``l`` and ``r`` equal words beside the run, an edit there and ``q`` equal words beyond it,
    l + r + q >= 32, so one of the three is at least 11; where it is ``q``, the words 11 beyond the run are
    equal, shifted by a word if one is missing.  ``around`` tells all words that such paragraphs can hold.
    """
    p, e, part = places, places + RUN, _PART
    first, last = np.maximum(0, e - WINDOW), np.minimum(runs.n, p + WINDOW)
    around = mix(runs.of(first, last) + (p - first).astype(np.uint64)).view(np.int64)
    for tag, left, right, ok in (
            (1, (p - part, p), (p, e), p >= part), (2, (p, e), (e, e + part), e + part <= runs.n),
            *((3, (p, e), (e + x, e + x + part), e + x + part <= runs.n) for x in (part, part - 1)),
            *((4, (p - x - part, p - x), (p, e), p - x - part >= 0) for x in (part, part - 1))):
        yield runs.pair(tag, left, right)[ok], opened[ok], p[ok], around[ok]


def _marked(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each number below ``n`` lies in one of the ranges, whose ends are exclusive."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, np.clip(starts, 0, n), 1)
    np.add.at(steps, np.clip(ends, 0, n), -1)
    return np.cumsum(steps)[:n] > 0


def _edits(runs: _Runs, places: np.ndarray, opened: np.ndarray, reach: int = HALF - RUN) -> Iterator[tuple]:
    """Keys of the words before and after every edit at most ``reach`` words beside a place's run: ``(keys, opened, at, kind, gap, word)``.

    Each edit of a text gives its keys once, however many places it is beside.  Of the 49 equal words, kind 0 has
    ``HALF`` or more before the edit, kind 1 as many after it; those next to it hold a place.  ``word`` is the word passed
    over, -1 if none is (``gap`` 0); ``at`` is where the words before it end or, for kind 1, those after it start.  Kinds 2 and
    3: equal runs of ``NEARLY`` words, of which the first hold a place, in the last or the first paragraph that holds them.
    """
    for kind, first, last in ((0, RUN, RUN + reach), (1, -reach, 0), (2, -reach, 0)):
        marked, free = (_marked(runs.n + 1, p + first, p + last + 1) for p in (places, places[opened]))
        whole = np.flatnonzero(marked)
        for k in range(0, len(whole), POSITIONS):
            at = whole[k:k + POSITIONS]
            if kind == 2:
                x = at[runs.inside(at, at + NEARLY) & _varied(runs, at)]
                for side, start in ((2, np.minimum(x, runs.n - WINDOW)), (3, np.maximum(x + NEARLY - WINDOW, 0))):
                    yield runs.pair(side, (x, x), (x, x + NEARLY)), free[x], start, side, 0, 0
                continue
            held, beyond = (HALF, WIDTH) if kind == 0 else (WIDTH, HALF)
            for gap in (0, 1):
                end, start = (at - gap, at) if kind == 1 else (at, at + gap)
                ok = runs.inside(end - held, start + beyond)
                end, start, x = end[ok], start[ok], at[ok]
                yield (runs.pair(16 + kind, (end - held, end), (start, start + beyond)), free[x], x, kind, gap,
                       runs.word(end) if gap else -1)


def _varied(runs: _Runs, at: np.ndarray) -> np.ndarray:
    """Whether the ``NEARLY`` words have so many different shingles that five others leave the Jaccard at ``PERCENT``."""
    found = grams(runs.words.astype(np.uint64), WIDTH)
    span = NEARLY - WIDTH + 1
    if len(found) < span:
        return np.zeros(at.shape, bool)
    order = np.argsort(found, kind="stable")
    before = np.full(len(found), -1, np.int64)
    same = found[order][1:] == found[order][:-1]
    before[order[1:][same]] = order[:-1][same]
    starts, back = np.unique(np.clip(at, 0, len(found) - span), return_inverse=True)
    kinds = (np.lib.stride_tricks.sliding_window_view(before, span)[starts] < starts[:, None]).sum(axis=1)
    least = -(-PERCENT * 2 * (WINDOW - NEARLY) // (100 - PERCENT))
    return (kinds >= least)[back].reshape(at.shape)


def _narrow(runs: _Runs, at: np.ndarray, opened: np.ndarray, kinds: np.ndarray, gaps: np.ndarray) -> Iterator[tuple]:
    """Two keys an edit, of which those that share a key of ``_exact`` share one: ``(keys, opened, at, kind, gap, word)``.

    Of the words on both sides, that are 49, the longer side has ``HALF`` and the other 15, or ``_MIDDLE`` and ``WIDTH``.
    """
    for gap in (0, 1):
        for side in (0, 1):
            own = np.flatnonzero((kinds == side) & (gaps == gap))
            m = at[own]
            for part, held in enumerate((HALF, _MIDDLE)):
                beyond = (WINDOW - _MIDDLE, WIDTH)[part]
                left, right = ((m - held, m), (m + gap, m + gap + beyond)) if side == 0 else ((m - gap - beyond, m - gap), (m, m + held))
                ok = runs.inside(left[0], right[1])
                word = runs.word(m if side == 0 else m - 1)[ok] if gap else -1
                yield runs.pair(32 + 2 * side + part, left, right)[ok], opened[own][ok], m[ok], side, gap, word


def _exact(runs: _Runs, at: np.ndarray, opened: np.ndarray, kinds: np.ndarray, gaps: np.ndarray) -> Iterator[tuple]:
    """Keys of all paragraphs with their edit there: ``(keys, opened, start of the paragraph, word)``.

    ``WINDOW`` - 1 words are equal, and the paragraph starts or ends with those before or after the edit.
    """
    for gap in (0, 1):
        for side in (0, 1):
            own = np.flatnonzero((kinds == side) & (gaps == gap))
            k = np.arange(HALF, NEARLY)[None, :]
            m, rest = at[own][:, None] + 0 * k, WINDOW - 1 - k
            if side == 0:
                start, left, right, word = m - k, (m - k, m), (m + gap, m + gap + rest), runs.word(m)
            else:
                start, left, right, word = m + k - WINDOW, (m - gap - rest, m - gap), (m, m + k), runs.word(m - 1)
            ok = runs.inside(start, start + WINDOW) & runs.inside(left[0], right[1])
            key = mix(runs.pair(64 + side, left, right) + k.astype(np.uint64))
            yield key[ok], np.broadcast_to(opened[own][:, None], ok.shape)[ok], start[ok], word[ok] if gap else -1


def _packed(columns: list[str]) -> Column:
    """A place, the columns of 0 or 1 that follow it, and ``opened`` in one number; a struct takes eight bytes for each and more."""
    packed = F.col(columns[0]).cast("long")
    for c in (*columns[1:], "opened"):
        packed = 2 * packed + F.col(c).cast("long")
    return packed


def _unpacked(packed: np.ndarray, columns: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """``opened`` and the columns that ``_packed`` put together."""
    return (packed & 1).astype(bool), [packed >> columns, *((packed >> (columns - k)) & 1 for k in range(1, columns))]


def _near_keys(make, asked: list[str], fields: list[str], types: list) -> Callable[[Batches], Batches]:
    """Rows ``key, node`` and what ``make`` tells of each key, with ``opened`` of its place."""
    def run(batches: Batches) -> Batches:
        names, kinds = ["key", "node", *fields, "opened"], [pa.int64(), pa.int64(), *types, pa.bool_()]
        parts: list[list[np.ndarray]] = [[] for _ in names]

        def give() -> pa.RecordBatch:
            flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in parts]
            for part in parts:
                part.clear()
            return pa.record_batch([pa.array(x).cast(t) for x, t in zip(flat, kinds, strict=True)], names=names)

        held = 0
        for batch in batches:
            for node, raw, found in zip(*(batch.column(c) for c in ("node", "words", "places")), strict=True):
                runs = _Runs(np.frombuffer(raw.as_py(), np.uint32))
                opened, given = _unpacked(found.values.to_numpy(), len(asked))
                for first in range(0, len(opened), PLACES):
                    part_of = slice(first, first + PLACES)
                    for keys, free, *more in make(runs, given[0][part_of].astype(np.int64), opened[part_of], *(x[part_of] for x in given[1:])):
                        columns = [keys.view(np.int64), np.full(len(keys), node.as_py(), np.int64),
                                   *(np.broadcast_to(x, len(keys)) for x in more), free]
                        for part, column in zip(parts, columns, strict=True):
                            part.append(column)
                        held += len(keys)
                        if held > KEY_ROWS:
                            yield give()
                            held = 0
        yield give()
    return run


def _sized(asked: DataFrame, places: str) -> DataFrame:
    """Hint a broadcast only if both the rows and all their places are few enough."""
    rows, held = asked.agg(F.count("*"), F.coalesce(F.sum(F.size(places)), F.lit(0))).first()
    return sized_broadcast(asked, rows if held <= BROADCAST_PLACES else BROADCAST_PAIRS + 1, BROADCAST_PAIRS)


class _Passages:
    """The steps of one search; holds what they share."""

    def __init__(self, texts: DataFrame, bands: int) -> None:
        self.texts, spark = texts, texts.sparkSession
        self.reach = (NEARLY if bands == 1 else HALF) - RUN
        self.members = stored(texts.mapInArrow(trimmed(_keys(bands)), "id long, row_key long, node long, n long, keys array<long>, "
                                               "places array<int>"), "passage-keys")
        long = self.members.where(F.col("n") >= WINDOW)
        # equal texts: how many, and the row that stands for them
        again = stored(long.groupBy("node").agg(F.count("*").alias("times"), F.min(F.when(F.size("keys") > 0, F.col("row_key")))
                       .alias("chosen"), F.max("n").alias("n"), F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first"))
                       .where("times > 1"), "passage-copies")
        self.copies = again
        self.classes = (long.where(F.size("keys") > 0)
                        .join(sized_broadcast(again.select("node", "chosen"), again.count(), BROADCAST_ROWS), "node", "left")
                        .where("chosen IS NULL OR chosen = row_key"))
        bits = sketch_bits(self.members.count())
        added = (self.classes.select("keys").mapInArrow(_count_keys(bits), "chunk int, cells binary")
                 .repartition("chunk").mapInArrow(_add_chunks, "chunk int, cells binary"))
        levels = np.zeros(1 << bits, np.uint8)
        for k, c in added.collect():
            levels[k * _CHUNK:k * _CHUNK + len(c)] = np.frombuffer(c, np.uint8)
        self.levels = spark.sparkContext.broadcast(levels)

    def hits(self) -> DataFrame:
        """``key, node, place, lo`` of the keys that several texts have; ``lo`` is the pivot text."""
        rows = self.classes.select("node", "keys", "places").mapInArrow(
            _key_rows(self.levels), "key long, node long, place int, rare boolean")
        by_key = W.partitionBy("key")
        few = (rows.where("rare").select("key", "node", "place").withColumn("lo", F.min("node").over(by_key))
               .withColumn("hi", F.max("node").over(by_key)).where("lo <> hi").drop("hi"))
        many = rows.where("NOT rare").select("key", "node", "place")
        met = many.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").drop("hi")
        return stored(few.unionByName(many.join(met, "key")), "passage-hits")

    def words_of(self, nodes: DataFrame) -> DataFrame:
        """``(node, words)`` of at least the given texts, from one row each; read once, for all rounds."""
        keys = self.classes.select("node", "row_key").join(nodes.distinct(), "node")
        bits = self.texts.sparkSession.sparkContext.broadcast(_bitmap(keys, "row_key"))
        words = self.texts.select("row_key", "node", "text").mapInArrow(trimmed(_words(bits)), "node long, words binary")
        return stored(words, "passage-words")

    def links(self, hits: DataFrame) -> DataFrame:
        """Verified matches of the pivots with the other texts of their buckets."""
        own = hits.where("node = lo").groupBy("key").agg(F.min("place").alias("i"))
        pairs = (hits.where("node <> lo").join(own, "key").groupBy(F.col("lo").alias("a"), F.col("node").alias("b"))
                 .agg(F.collect_set(F.shiftleft(F.col("i").cast("long"), 32).bitwiseOR(F.col("place").cast("long"))).alias("seeds")))
        pairs = stored(pairs, "passage-pairs")
        self.words = words = self.words_of(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))))
        # the keys of all texts are not read from here on
        with_keys, self.members = self.members, stored(self.members.select("id", "node", "n"), "passage-members")
        dropped(with_keys)
        parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"))
        # small tables of places go to all tasks, so that words are shuffled once, to their pivot
        asked = stored(pairs.join(parts, "a").select("a", F.pmod(F.hash("b"), "parts").alias("part"), "b", "seeds"), "passage-asked")
        few = asked.count()
        partner = (words.withColumnRenamed("node", "b").join(_sized(asked, "seeds"), "b")
                   .select("a", "part", "b", "seeds", "words"))
        pivots = (words.withColumnRenamed("node", "a").join(sized_broadcast(parts, few, BROADCAST_ROWS), "a")
                  .select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"),
                          F.lit(None).cast("array<long>").alias("seeds"), "words"))
        met = (partner.unionByName(pivots).repartition("a", "part")
               .sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()))
        return stored(met.mapInArrow(trimmed(_verify), "a long, b long, a0 int, a1 int, b0 int, b1 int, n int"), "passage-links")

    def unsettled(self, hits: DataFrame, links: DataFrame) -> DataFrame:
        """``key, node, place`` of the places that the pivot's matches do not settle, and of the pivots there.

        A near match settles nothing here: its text may share an equal paragraph with a third one.
        """
        runs = (links.where("n IS NOT NULL").groupBy(F.col("a").alias("lo"), F.col("b").alias("node"))
                .agg(F.collect_set(F.struct("b0", "b1")).alias("runs"), F.first("n").alias("n")))
        settled = F.exists("runs", lambda r: (r["b0"] <= F.greatest(F.lit(0), F.col("place") + (RUN - WINDOW)))
                           & (r["b1"] >= F.least("n", F.col("place") + WINDOW)))
        pivots = hits.where("node = lo").select("key", "node", "place")
        again = pivots.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key", F.lit(True).alias("again"))
        again = stored(again, "passage-again")
        left = (hits.where("node <> lo").join(runs, ["lo", "node"], "left")
                .join(sized_broadcast(again, again.count(), BROADCAST_ROWS), "key", "left")
                .where(F.col("again").isNotNull() | ~F.coalesce(settled, F.lit(False))))
        left = stored(left.select("key", "node", "place"), "passage-unsettled")
        return stored(left.union(pivots.join(left.select("key").distinct(), "key")), "passage-rest")

    def run(self) -> DataFrame:
        """All matches: with the pivots, then of whole paragraphs at the places that those do not settle."""
        hits = self.hits()
        links = self.links(hits)
        rest = self.unsettled(hits, links)
        links = stored(links.drop("n").unionByName(self.equal(rest)), "passage-links")
        return stored(links.unionByName(self.near(rest, links)), "passage-links")

    def near(self, rest: DataFrame, links: DataFrame) -> DataFrame:
        """Links of near paragraphs at the places that no match with the pivot holds, with any place of their buckets."""
        # a match elsewhere links a place with others than its bucket's, so only one with the pivot's first place holds it
        found = (links.groupBy(F.col("a").alias("lo"), F.col("b").alias("node"))
                 .agg(F.collect_set(F.struct("a0", "a1", "b0", "b1")).alias("found")))
        first = rest.groupBy("key").agg(F.min("node").alias("lo"), F.min(F.struct("node", "place"))["place"].alias("i"))
        held = F.exists("found", lambda r: (r["a0"] <= F.col("i")) & (r["a1"] >= F.col("i") + RUN)
                        & (r["b0"] <= F.col("place")) & (r["b1"] >= F.col("place") + RUN))
        held = F.coalesce(held, F.lit(False)) | ((F.col("node") == F.col("lo")) & (F.col("place") == F.col("i")))
        marked = stored(rest.join(first, "key").join(found, ["lo", "node"], "left").select("key", "node", "place", (~held).alias("opened")),
                        "passage-marked")
        places = self.meeting(marked).select("node", "place", "opened").distinct()
        loose = stored(self.keyed(places, ["place"], _loose, ["place", "around"], "place int, around long"), "passage-loose")
        # places with equal words all around are linked already, so one of them stands for the others
        dropped(marked)
        places = self.meeting(loose).groupBy("around").agg(F.min(F.struct("node", "place")).alias("one"), F.max("opened").alias("opened"))
        places = places.select("one.*", "opened")
        edits = stored(self.keyed(places, ["place"], partial(_edits, reach=self.reach), ["at", "kind", "gap", "word"], "at int, kind int, gap int, word long"),
                       "passage-edits")
        dropped(loose)
        nearly = edits.where("kind IN (2, 3)")
        starts = self.starred(nearly.select("key", "node", F.col("at").alias("start"), "opened"))
        met = self.meeting(edits.where("kind NOT IN (2, 3)"), F.min("word") < F.max("word"))
        # most edits that meet have no 49 equal words around them: two keys tell, before each gives those of 20 paragraphs
        columns = ["place", "kind", "gap"]
        places = met.select("node", F.col("at").alias("place"), "kind", "gap", "opened")
        narrow = stored(self.keyed(places, columns, _narrow, ["place", "kind", "gap", "word"], "place int, kind int, gap int, word long"),
                        "passage-narrow")
        dropped(edits)
        places = self.meeting(narrow, F.min("word") < F.max("word")).select("node", *columns, "opened")
        exact = stored(self.keyed(places, columns, _exact, ["start", "word"], "start int, word long"), "passage-exact")
        dropped(narrow)
        more = self.starred(exact, F.min("word") < F.max("word"))
        dropped(exact)
        return starts.unionByName(more).distinct()

    def meeting(self, rows: DataFrame, also=None) -> DataFrame:
        """The rows whose key several texts have, one of them at an open place; if few keys are left, rows are not shuffled."""
        several = (F.min("node") < F.max("node")) & (F.max("opened") if "opened" in rows.columns else F.lit(True))
        keys = rows.groupBy("key").agg((several if also is None else several & also).alias("several")).where("several").select("key")
        keys = stored(keys, "passage-met")
        return rows.join(sized_broadcast(keys, keys.count(), BROADCAST_KEYS), "key", "left_semi")

    def keyed(self, places: DataFrame, columns: list[str], make, fields: list[str], schema: str) -> DataFrame:
        """The keys that ``make`` gives to the places of each text."""
        asked = places.groupBy("node", *columns).agg(F.max("opened").alias("opened"))
        asked = stored(asked.groupBy("node").agg(F.collect_list(_packed(columns)).alias("places")), "passage-places")
        types = [pa.int64() if c.split()[1] == "long" else pa.int32() for c in schema.split(", ")]
        return (self.words.join(_sized(asked, "places"), "node")
                .mapInArrow(trimmed(_near_keys(make, columns, fields, types)), f"key long, node long, {schema}, opened boolean"))

    def starred(self, rows: DataFrame, also=None) -> DataFrame:
        """Links of all paragraphs of a key, equal but for one edit, with the first of them."""
        rows = stored(self.meeting(rows, also).select("key", "node", "start"), "passage-starred")
        first = rows.groupBy("key").agg(F.min(F.struct("node", "start")).alias("first"))
        first = first.select("key", F.col("first.node").alias("a"), F.col("first.start").alias("a0"))
        return rows.join(first, "key").where("node <> a").select(
            "a", F.col("node").alias("b"), "a0", (F.col("a0") + WINDOW).alias("a1"), F.col("start").alias("b0"),
            (F.col("start") + WINDOW).alias("b1")).distinct()

    def equal(self, rest: DataFrame) -> DataFrame:
        """Links of the places that share a whole paragraph, with the first place of the smallest text."""
        asked = stored(rest.groupBy("node").agg(F.collect_set("place").alias("places")), "passage-places")
        rows = stored(self.words.join(_sized(asked, "places"), "node")
                      .mapInArrow(trimmed(_whole), "key long, node long, place int"), "passage-whole")
        whole, rows = rows, stored(self.meeting(rows), "passage-whole")
        dropped(whole)
        first = rows.groupBy("key").agg(F.min(F.struct("node", "place")).alias("first")).select(
            "key", F.col("first.node").alias("a"), F.col("first.place").alias("i"))
        same = rows.join(first, "key").where("node <> a OR place <> i")
        return same.select("a", F.col("node").alias("b"), F.col("i").alias("a0"), (F.col("i") + WINDOW).alias("a1"),
                           F.col("place").alias("b0"), (F.col("place") + WINDOW).alias("b1")).distinct()


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """One row per repeated span: ``id, start_word, end_word, n_words, cluster_id, keep_id, removed``.

    Spans are in words (A-Z as a-z) of the whole text, end exclusive; texts without a repeat of
    at least ``WINDOW`` words have no row, nor have null, empty and shorter texts.  Equal texts are one
    span each, the whole text, in a cluster of their own; passages are clustered over the row of them that
    stays.  A component's first span by id and place stays (``removed`` false), null
    ids last; rows repeated with the same id and text all stay.  An empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    texts = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    texts = texts.select("id", F.xxhash64("id", "text").alias("row_key"), F.xxhash64("text").alias("node"), "text")
    search = _Passages(texts, bands_for(key_share(), recall))
    links = search.run()

    ends = (links.select(F.col("a").alias("node"), F.col("a0").alias("s"), F.col("a1").alias("e"))
            .union(links.select("b", "b0", "b1")).distinct())
    by_start = W.partitionBy("node").orderBy("s", "e")
    before = F.max("e").over(by_start.rowsBetween(W.unboundedPreceding, -1))
    opened = ends.withColumn("opens", F.when(before.isNull() | (F.col("s") >= before), F.col("s")))
    placed = stored(opened.withColumn("span", F.max("opens").over(by_start.rowsBetween(W.unboundedPreceding, W.currentRow)))
                    .select("node", "s", "e", "span"), "passage-ends")
    span = F.xxhash64("node", "span")
    names = placed.select("node", "s", "e", span.alias("span_id"))
    edges = (links.join(names.toDF("a", "a0", "a1", "x"), ["a", "a0", "a1"])
             .join(names.toDF("b", "b0", "b1", "y"), ["b", "b0", "b1"]).select(F.col("x").alias("a"), F.col("y").alias("b")))
    spans = placed.groupBy("node", "span").agg(F.max("e").alias("end")).withColumn("span_id", span)
    spans = spans.join(components(edges).withColumnRenamed("node", "span_id"), "span_id", "left").select(
        "node", "span", "end", F.coalesce("component", "span_id").alias("cluster_id"))
    copies = search.copies.select("node", F.col("n").cast("int").alias("whole"), "first")
    members = search.members.where(F.col("n") >= WINDOW).select("id", "node").join(
        sized_broadcast(copies, copies.count(), BROADCAST_ROWS), "node", "left")
    again = members.where("first IS NOT NULL").select(
        "id", F.lit(0).alias("span"), F.col("whole").alias("end"), F.xxhash64("node", F.lit("copies")).alias("cluster_id"),
        F.col("first.id").alias("keep_id"), F.col("id").eqNullSafe(F.col("first.id")).alias("stays"))
    alone = members.where(F.col("first").isNull() | F.col("id").eqNullSafe(F.col("first.id"))).select("id", "node")
    rows = stored(alone.join(stored(spans, "passage-spans"), "node").select("id", "span", "end", "cluster_id"), "passage-rows")
    first = rows.groupBy("cluster_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "span")).alias("first"))
    first = stored(first.select("cluster_id", F.col("first.id").alias("keep_id"), F.col("first.span").alias("keep_span")), "passage-first")
    stays = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("span") == F.col("keep_span"))
    found = rows.join(first, "cluster_id").select("id", "span", "end", "cluster_id", "keep_id", stays.alias("stays"))
    return found.unionByName(again).select(
        F.col("id").alias(id_col), F.col("span").alias("start_word"), F.col("end").alias("end_word"),
        (F.col("end") - F.col("span")).alias("n_words"), "cluster_id", "keep_id", (~F.col("stays")).alias("removed"))


def op9_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))

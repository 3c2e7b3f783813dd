"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Compiled once on the driver from the model's bytes and broadcast (its size is the vocabulary's):

* normaliser: optional dummy prefix and white-space folding, every space read as U+2581;
* pieces: an arc from i to j for each piece that spells characters i..j; its weight is minus the
  piece's score (unigram models) or zero (BPE models);
* byte fallback: an arc over a character that no piece spells, writing its UTF-8 byte pieces.

The input, a chain of characters, is composed with these and the cheapest path in the tropical
semiring (min, +) is the encoding.  A BPE model is a sequence of merges, not a sum of scores; its
encodings are exactly the paths whose neighbouring pieces are *compatible*: the merges applied to
the two pieces' characters give the two pieces back.  So the BPE transducer is also composed with
an acceptor that reads pairs of pieces, weight zero if compatible, infinite if not.  Each prefix of
a text then has one finite path, and states need only the position and the last piece.  Where
pieces of equal score compete (runs of spaces) the merges are ordered by place, which no weight
of a pair can say: such segments are merged in order.

Segments that no piece can span (before each space, at characters in no piece) are independent,
so their paths are found once and kept in a bounded cache per task process.  The segments of many texts
that are not there are searched side by side: one numpy step takes the next arc of each of them.
"""

from __future__ import annotations

import heapq
import math
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paraspark.llm.common import table, text_or_empty, trimmed

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
CACHE_SEGMENTS = 100_000     # kept in a task process, about 200 bytes each, besides those of the texts at hand
CACHE_PAIRS = 400_000        # pairs of pieces, about 100 bytes each
CACHE_CHARS = 64             # longer segments are not kept
SEARCHED = 1 << 17           # characters searched side by side
SPACE = "▁"
UNIGRAM, BPE = 1, 2
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol-buffer message."""
    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if raw[at - 1] < 128:
                return value, at

    at = 0
    while at < len(raw):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = raw[at:at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = struct.unpack("<f" if size == 4 else "<d", raw[at:at + size])[0], at + size
        yield key >> 3, value


class _Hashed:
    """Numbers looked up by whole arrays of keys of at least zero: open addressing, a quarter full at most."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int) -> None:
        bits = max(4, int(len(keys)).bit_length() + 2)
        self.shift, self.low, self.missing = np.uint64(64 - bits), (1 << bits) - 1, missing
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, missing, np.int32)
        rest, slots = np.arange(len(keys)), self._slots(keys)
        while len(rest):
            free = self.keys[slots[rest]] < 0
            self.keys[slots[rest[free]]] = keys[rest[free]]      # one of several that meet stays
            placed = self.keys[slots[rest]] == keys[rest]
            self.values[slots[rest[placed]]] = values[rest[placed]]
            rest = rest[~placed]
            slots[rest] = (slots[rest] + 1) & self.low

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slots(keys)
        there = self.keys[slots]
        out = np.where(there == keys, self.values[slots], self.missing)
        rest = np.flatnonzero((there != keys) & (there >= 0))
        while len(rest):
            slots[rest] = (slots[rest] + 1) & self.low
            there = self.keys[slots[rest]]
            same = there == keys[rest]
            out[rest[same]] = self.values[slots[rest[same]]]
            rest = rest[~same & (there >= 0)]
        return out


class _SideBySide:
    """``Transducer._finite`` for many segments at once: the same depth-first search, an arc of each a step."""

    def __init__(self, model: Transducer) -> None:
        spell, arcs, rank, ids = model.spell, model.arcs, model.rank, model.vocabulary
        self.char = np.zeros(0x110000, np.int32)        # 0: in no piece, and the end of a segment
        inner = sorted({c for p in arcs for c in p if c in arcs})
        self.char[[ord(c) for c in inner]] = np.arange(1, len(inner) + 1)
        self.width = len(inner) + 1
        # the tree of the pieces' heads; node 0 is the empty one
        nodes, keys, pieces = {"": 0}, [], [-1]
        for piece in (p for p in arcs if all(c in arcs for c in p)):
            for size in range(1, len(piece) + 1):
                if piece[:size] not in nodes:
                    nodes[piece[:size]] = len(nodes)
                    keys.append(nodes[piece[:size - 1]] * self.width + int(self.char[ord(piece[size - 1])]))
                    pieces.append(arcs.get(piece[:size], -1))
        self.children = _Hashed(np.array(keys, np.int64), np.arange(1, len(nodes), dtype=np.int32), -1)
        self.piece = np.array(pieces, np.int32)
        self.size = np.array([len(p) for p in spell], np.int32)
        # ranks, the parts that pieces are merged from, and the ranks of all pairs that may merge
        self.rank, self.left, self.right = (np.full(len(spell), x, np.int64) for x in (-1, -1, -1))
        self.whole = np.ones(len(spell), bool)          # without parts
        keys, values = [], []
        for piece, i in ids.items():
            self.rank[i] = rank[piece]
            if model.parts[piece]:
                self.whole[i] = False
                self.left[i], self.right[i] = (ids.get(x, -1) for x in model.parts[piece])
            for at in range(1, len(piece)):
                a, b = ids.get(piece[:at]), ids.get(piece[at:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    values.append(2 * rank[piece])
        self.merges = _Hashed(np.array(keys, np.int64), np.array(values, np.int32), 1 << 30)

    def compatible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """``Transducer.compatible`` of pairs of ids."""
        ok = np.ones(len(x), bool)
        at, limit = np.arange(len(x)), np.full(len(x), 1 << 29, np.int64)    # twice a rank, plus one for the right side
        while len(at):
            fine = self.merges.of(x << 20 | y) >= limit
            ok[at[~fine]] = False
            one, two = self.rank[x], self.rank[y]
            left = ~self.whole[x] & (self.whole[y] | (one > two))
            fine &= left | ~self.whole[y]
            limit = np.where(left, 2 * one, 2 * two + 1)
            x, y = np.where(left, self.right[x], x), np.where(left, y, self.left[y])
            fine &= (x >= 0) & (y >= 0)
            at, x, y, limit = at[fine], x[fine], y[fine], limit[fine]
        return ok

    def paths(self, segments: list[str]) -> Iterator[bytes]:
        """The paths as int32 bytes, in order; all characters of the segments have to be pieces."""
        sizes = np.array([len(x) + 1 for x in segments])
        ends = np.cumsum(sizes) - 1
        chars = self.char[np.frombuffer("\0".join([*segments, ""]).encode("utf-32-le"), np.uint32)]
        chars[ends] = 0
        arcs, left = [], np.zeros(len(chars), np.int64)      # by length the pieces from each place on, and which are untried
        at = np.arange(len(chars))
        node = np.zeros(len(chars), np.int64)
        while len(at):
            there = chars[np.minimum(at + len(arcs), len(chars) - 1)]
            node = self.children.of(node * self.width + there)
            some = (node >= 0) & (there > 0)
            at, node = at[some], node[some].astype(np.int64)
            if len(at):
                piece = np.full(len(chars), -1, np.int32)
                piece[at] = self.piece[node]
                left[at[piece[at] >= 0]] |= 1 << len(arcs)
                arcs.append(piece)
        arcs = np.stack(arcs)
        via = np.full(len(chars), -1, np.int64)     # the piece that a place is reached by
        place, goal = ends - sizes + 1, ends
        while len(place):
            untried = left[place]
            go = untried > 0
            back = place[~go]
            place[~go] = back - self.size[via[back]]        # leads nowhere
            start, untried = place[go], untried[go]
            size = np.frexp(untried.astype(np.float64))[1].astype(np.int64)      # the longest one
            left[start] = untried ^ (np.int64(1) << (size - 1))
            piece, before = arcs[size - 1, start].astype(np.int64), via[start]
            fine = before < 0
            asked = np.flatnonzero(~fine)
            fine[asked] = self.compatible(before[asked], piece[asked])
            via[start[fine] + size[fine]] = piece[fine]
            place[go] = start + np.where(fine, size, 0)
            open_ = place < goal
            place, goal = place[open_], goal[open_]
        used = np.zeros(len(chars), bool)
        place, goal = ends, ends - sizes + 1
        while len(place):
            used[place] = True
            place = place - self.size[via[place]]
            open_ = place > goal
            place, goal = place[open_], goal[open_]
        raw = via[used].astype(np.int32).tobytes()
        to = (4 * np.cumsum(used)[ends]).tolist()
        return (raw[a:b] for a, b in zip([0, *to], to))


class Transducer:
    """A compiled model; ``encode`` and ``decode`` work on whole texts."""

    def __init__(self, raw: bytes) -> None:
        self.kind, self.prefix, self.fold, self.byte_fallback = UNIGRAM, True, True, False
        self.spell: list[str] = []
        self.known: dict[int, bool] = {}        # whether pairs of ids are compatible
        scores, kinds = [], []
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                self.spell.append(piece.get(1, b"").decode())
                scores.append(piece.get(2, 0.0))
                kinds.append(piece.get(3, _NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
                self.kind, self.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
            elif number == 3:
                rules = dict(_fields(value))
                if rules.get(2):
                    raise ValueError("models with a compiled character map are not supported")
                self.prefix, self.fold = bool(rules.get(3, 1)), bool(rules.get(4, 1))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.unknown = kinds.index(_UNKNOWN)
        self.byte = {int(self.spell[i][3:5], 16): i for i, k in enumerate(kinds) if k == _BYTE}
        self.score = scores
        usable = {i for i, k in enumerate(kinds) if k in (_NORMAL, _USER)}
        self.vocabulary = {self.spell[i]: i for i in sorted(usable, reverse=True)}
        self.longest = max(map(len, self.vocabulary), default=1)
        inner = {c for p in self.vocabulary if len(p) > 1 for c in p}
        # a segment may start before a space unless some piece has one after another character
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.vocabulary)
        self.alone = "\n" not in inner and self.splits
        self.written = [p.replace(SPACE, " ").encode() for p in self.spell]
        for value, i in self.byte.items():
            self.written[i] = bytes([value])
        for i, k in enumerate(kinds):
            if k not in (_NORMAL, _USER, _BYTE):
                self.written[i] = " ⁇ ".encode() if k == _UNKNOWN else b""
        if self.kind == BPE:
            self._compile_merges()

    # ---- the acceptor of compatible pairs

    def _compile_merges(self) -> None:
        """Order of merges, and the two parts each reachable piece is merged from."""
        order = sorted(self.vocabulary, key=lambda p: (len(p) > 1, -self.score[self.vocabulary[p]], self.vocabulary[p]))
        self.rank = {p: k for k, p in enumerate(order)}
        self.parts = {p: None if len(p) == 1 else self._last_merge(p) for p in order}
        self.arcs = {p: self.vocabulary[p] for p in order if len(p) == 1 or self.parts[p]}
        tied = [s for s in map(self.score.__getitem__, self.vocabulary.values())]
        seen = set()
        self.ties = {s for s in tied if s in seen or seen.add(s)}
        self.tied = [p for p in self.vocabulary if len(p) > 1 and self.score[self.vocabulary[p]] in self.ties]
        starts: dict[str, set[int]] = {}
        for p in self.arcs:
            starts.setdefault(p[:2], {1}).add(len(p))
            if len(p) > 2:
                starts.setdefault(p[:3], {1}).add(len(p))
        for head, found in starts.items():
            if len(head) == 3 and head[:2] in self.arcs:
                found.add(2)
        ordered = {head: tuple(sorted(found, reverse=True)) for head, found in starts.items()}
        self.lengths = {head: found for head, found in ordered.items() if len(head) < 3}
        self.lengths3 = {head: found for head, found in ordered.items() if len(head) == 3}

    def merged(self, text: str) -> list[str]:
        """The merges in order: best score first, then leftmost."""
        symbols, score, vocabulary, n = list(text), self.score, self.vocabulary, len(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str]] = []     # entries whose symbols have changed are passed over

        def offer(k: int) -> None:
            if k >= 0 and after[k] < n:
                piece = symbols[k] + symbols[after[k]]
                i = vocabulary.get(piece)
                if i is not None:
                    heapq.heappush(heap, (-score[i], k, piece))

        for k in range(n - 1):
            offer(k)
        while heap:
            _, k, piece = heapq.heappop(heap)
            j = after[k]
            if not symbols[k] or j >= n or symbols[k] + symbols[j] != piece:
                continue
            symbols[k], symbols[j], after[k] = piece, "", after[j]
            if after[j] < n:
                before[after[j]] = k
            offer(before[k])
            offer(k)
        return [x for x in symbols if x]

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        symbols, rank = list(piece), self.rank
        while len(symbols) > 2:
            found = [(rank[m], k) for k in range(len(symbols) - 1) if (m := symbols[k] + symbols[k + 1]) in rank]
            if not found:
                return None
            at = min(found)[1]
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
        return tuple(symbols) if symbols[0] + symbols[1] == piece else None

    def compatible(self, a: str, b: str) -> bool:
        """Whether the merges of a + b stop at a, b: undo them, latest first, on both sides of the
        seam; wherever the parts that touch could merge before the undone merge, they would have."""
        rank, parts, x, y, limit, ok = self.rank, self.parts, a, b, (math.inf, 0), True
        while x in rank and y in rank:      # characters outside the vocabulary never merge
            joined = rank.get(x + y)
            if joined is not None and (joined, 0) < limit:
                ok = False
                break
            left, right = parts[x], parts[y]
            # the later of the two last merges is undone first; of equal ones the right one
            if left and (not right or rank[x] > rank[y]):
                limit, x = (rank[x], 0), left[1]
            elif right:
                limit, y = (rank[y], 1), right[0]
            else:
                break
        return ok

    # ---- composition and shortest path

    def path(self, text: str) -> list[int]:
        """Piece ids on the cheapest path over one segment."""
        if self.kind == UNIGRAM:
            return self._cheapest(text)
        if SPACE + SPACE in text and any(p in text for p in self.tied):
            return [i for s in self.merged(text) for i in self._ids(s)]
        return self._finite(text)

    def _finite(self, text: str) -> list[int]:
        """The one path of finite weight (zero) of a BPE model, depth first, long arcs first.

        A place is reached by the encoding of what precedes it or not at all, so none is tried twice.
        """
        arcs, three, two, pairs, one = self.arcs, self.lengths3, self.lengths, self.known, (1,)
        i, n, before, ids, frames = 0, len(text), -1, [], []
        sizes = iter(three.get(text[:3]) or two.get(text[:2]) or one)
        while i < n:
            for size in sizes:
                piece = text[i:i + size]
                k = arcs.get(piece)
                if k is None or len(piece) < size:
                    continue
                if before >= 0:
                    known = pairs.get(before << 20 | k)
                    if known is None:
                        known = pairs[before << 20 | k] = self.compatible(self.spell[before], piece)
                    if not known:
                        continue
                frames.append((i, before, sizes))
                ids.append(k)
                i, before = i + size, k
                break
            else:
                if text[i] in arcs:             # leads nowhere
                    i, before, sizes = frames.pop()
                    ids.pop()
                    continue
                frames.append((i, before, iter(())))
                ids.append(-1 - ord(text[i]))   # a character outside the vocabulary: bytes, or unknown
                i, before = i + 1, -1
            sizes = iter(three.get(text[i:i + 3]) or two.get(text[i:i + 2]) or one)
        if min(ids, default=0) >= 0:
            return ids
        return [x for k in ids for x in ((k,) if k >= 0 else self._ids(chr(-1 - k)))]

    def _cheapest(self, text: str) -> list[int]:
        """Shortest path of a unigram model, position by position."""
        n, score, arcs = len(text), self.score, self.vocabulary
        cost, last = [0.0] + [math.inf] * n, [0] * (n + 1)
        fallback = 10.0 - min(score)
        for i in range(n):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                k = arcs.get(text[i:j])
                weight = -score[k] if k is not None else fallback if j == i + 1 else math.inf
                if cost[i] + weight < cost[j]:
                    cost[j], last[j] = cost[i] + weight, i
        ids, j = [], n
        while j:
            ids.append(self._ids(text[last[j]:j]))
            j = last[j]
        return [k for step in reversed(ids) for k in step]

    def _ids(self, symbol: str) -> list[int]:
        if symbol in self.vocabulary:
            return [self.vocabulary[symbol]]
        if self.byte_fallback:
            return [self.byte[b] for b in symbol.encode()]
        return [self.unknown]

    # ---- whole texts

    def normalise(self, text: str) -> str:
        if self.fold:
            text = re.sub(" +", " ", text.replace(SPACE, " ")).strip(" ")
        text = text.replace(" ", SPACE)
        return SPACE + text if self.prefix and text else text

    def segments(self, text: str) -> list[str]:
        """The normalised text, cut where no piece can reach across."""
        text = self.normalise(text)
        if not self.splits:
            return [text] if text else []
        if not self.alone:
            return re.findall(f"{SPACE}+[^{SPACE}]*|^[^{SPACE}]+", text)
        return re.findall(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n", text)

    def encode_all(self, texts: list[str], cache: _Cache) -> list[np.ndarray]:
        """``encode`` of every text; segments that are not in the cache are searched side by side."""
        segments = [self.segments(text) for text in texts]
        cache.fill({x for found in segments for x in found})
        return [np.frombuffer(b"".join(map(cache.__getitem__, found)), np.int32) for found in segments]

    def encode(self, text: str, cache: dict | None = None) -> np.ndarray:
        cache = _Cache(self) if cache is None else cache
        return np.frombuffer(b"".join(map(cache.__getitem__, self.segments(text))), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of the pieces; bytes that are no UTF-8 become U+FFFD, the dummy prefix goes."""
        raw = b"".join(map(self.written.__getitem__, ids.tolist()))
        if self.prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode(errors="replace")


class _Cache(dict):
    """Segment -> its path as int32 bytes; the older half goes when the cache is full."""

    def __init__(self, model: Transducer) -> None:
        super().__init__()
        self.model, self.older = model, {}
        # lengths are bits of a number, and ids take 20 bits of a pair's key
        many = model.kind == BPE and model.longest <= 48 and len(model.spell) < 1 << 20
        self.searched = _SideBySide(model) if many else None

    def fill(self, segments: set[str]) -> None:
        """Keep the paths of all the given segments but the longest ones and those with ties or odd characters."""
        if self.searched is None:
            return
        if len(self) >= CACHE_SEGMENTS // 2:
            self.older = dict(self)
            self.clear()
        asked, held, two, tied, char = [], 0, SPACE + SPACE, self.model.tied, self.searched.char
        for x in segments:
            if x in self or len(x) > CACHE_CHARS or two in x and any(p in x for p in tied):
                continue
            path = self.older.get(x)
            if path is not None:
                self[x] = path
                continue
            asked.append(x)
            held += len(x) + 1
            if held > SEARCHED:
                self._search(asked)
                asked, held = [], 0
        if asked:
            self._search(asked)

    def _search(self, asked: list[str]) -> None:
        flat = np.frombuffer("".join(asked).encode("utf-32-le"), np.uint32)
        odd = self.searched.char[flat] == 0
        if odd.any():
            ends = np.cumsum([len(x) for x in asked])
            several = set(np.searchsorted(ends, np.flatnonzero(odd), side="right").tolist())
            asked = [x for k, x in enumerate(asked) if k not in several]
        if asked:
            self.update(zip(asked, self.searched.paths(asked), strict=True))

    def __missing__(self, segment: str) -> bytes:
        path = self.older.get(segment)
        if path is None:
            path = array('i', self.model.path(segment)).tobytes()
        if len(segment) <= CACHE_CHARS:
            if len(self.model.known) > CACHE_PAIRS:
                self.model.known.clear()
            if len(self) >= CACHE_SEGMENTS // 2:
                self.older = dict(self)
                self.clear()
            self[segment] = path
        return path


_HELD: dict[int, _Cache] = {}


def cache_of(shared) -> _Cache:
    """The cache of a broadcast model in this task process."""
    key = shared.value[0]
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = _Cache(Transducer(shared.value[1]))
    return _HELD[key]


def share_model(spark: SparkSession, model_path: str = MODEL_PATH):
    """Broadcast the model file's bytes (fixed size, read on the driver only)."""
    with open(model_path, "rb") as f:
        raw = f.read()
    Transducer(raw)
    return spark.sparkContext.broadcast((hash(raw), raw))


def _arrow_ids(paths: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(paths) + 1, np.int32)
    np.cumsum([len(p) for p in paths], out=offsets[1:])
    flat = np.concatenate(paths) if paths else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))


SLICE = 512     # texts encoded before a batch goes on


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 model_path: str = MODEL_PATH) -> DataFrame:
    """One row per input row: ``id, ids, n_tokens, n_byte_tokens, round_trip``.

    ``ids`` encodes the whole text, null as empty (no ids).  ``round_trip`` tells whether decoding
    gives the text back; it does unless the text has a literal U+2581, read as a space, or the
    model folds white space or lacks byte fallback.  Texts of any length are encoded segment by
    segment.  Repeated rows give repeated results; an empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    shared = share_model(df.sparkSession, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = cache_of(shared)
        model = cache.model
        lo, hi = (min(model.byte.values()), max(model.byte.values())) if model.byte else (0, -1)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                texts = batch.column("text").to_pylist()
                paths = model.encode_all(texts, cache)
                yield pa.record_batch(
                    [batch.column("id"), _arrow_ids(paths), pa.array([len(p) for p in paths], pa.int64()),
                     pa.array([int(np.count_nonzero((p >= lo) & (p <= hi))) for p in paths], pa.int64()),
                     pa.array([model.decode(p) == t for p, t in zip(paths, texts, strict=True)], pa.bool_())],
                    names=["id", "ids", "n_tokens", "n_byte_tokens", "round_trip"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    out = rows.mapInArrow(trimmed(run), "id long, ids array<int>, n_tokens long, n_byte_tokens long, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


def decode_ids(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_path: str = MODEL_PATH) -> DataFrame:
    """``id, text`` from arrays of piece ids; a null array gives a null text, an id out of range an error."""
    shared = share_model(df.sparkSession, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = cache_of(shared).model
        for batch in batches:
            texts = [None if x is None else model.decode(np.array(x, np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))

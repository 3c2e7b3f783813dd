"""N-gram Jaccard self-join by prefix filters under several global token orders.

Order 1 is rare-first: a fixed-size count sketch over all shingles ranks them, ties by hash.  Any
global order gives exact prefix filters; the sketch only keeps common shingles out of prefixes.
Orders 2 and 3 permute the hash under the same ranks.  Two sets with Jaccard of at least
``percent`` share a token in their prefixes of every order.

1. Texts with equal sets are one class; from here on one row stands for all copies.
2. Prefix tokens under order 1 meet.  The sketch bounds how many rows share a token: rare tokens
   are grouped by one shuffle, for the others counts are aggregated map-side before they meet.
   Rows without a partner of fitting length, and pairs that fail the position filter, go.
3. Every bucket is labelled with its smallest class, and buckets of one label are one group, so two
   classes meet in a group if they share a prefix token, however many they share.  Groups are
   verified in blocks of bounded size: pairs that also share prefix tokens under orders 2 and 3
   are counted exactly on their whole sets.  A block gives a spanning forest of its links, so
   a large group of near copies never becomes all its pairs, and no link between components is lost.

Texts are read again for the sets of classes in some pair; a fixed-size bit map picks them out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paraspark.llm.common import sized_broadcast, stored, table, text_or_empty, trimmed
from paraspark.llm.components import components
from paraspark.llm.shingles import mix, shingle_set, word_hashes

WIDTH = 5
PERCENT = 80
BLOCK = 256         # rows of a block of a large group; two blocks meet in a task
SLICE = 1000        # texts hashed before a batch goes on
TOKEN_BYTES = 5     # of a shingle's hash that are compared within a block
BITMAP_BITS = 23
BROADCAST_ROWS = 1_000_000
RARE_LEVEL = 39     # sketch cells of at most 1,022 shingles: so many rows share such a token at most
_CHUNK = 4096       # sketch cells in a row
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)   # orders 2 and 3

Batches = Iterator[pa.RecordBatch]


# ---- order 1: a sketch of how common each shingle is -------------------------------------------

def sketch_bits(rows: int) -> int:
    """A cell for every quarter of a document, between 2**12 and 2**24 cells."""
    return min(24, max(12, math.ceil(math.log2(max(1, rows))) + 2))


def _count_cells(bits: int, width: int) -> Callable[[Batches], Batches]:
    def count(batches: Batches) -> Batches:
        cells, shift = np.zeros(1 << bits, np.int64), np.uint64(64 - bits)
        pending, held = [], 0
        for batch in batches:
            for words in word_hashes(batch.column("text")):
                pending.append(shingle_set(words, width))
                held += len(pending[-1])
                if held > 1 << 20:
                    cells += np.bincount((np.concatenate(pending) >> shift).astype(np.int64), minlength=1 << bits)
                    pending, held = [], 0
        if pending:
            cells += np.bincount((np.concatenate(pending) >> shift).astype(np.int64), minlength=1 << bits)
        chunks = [(k, cells[at:at + _CHUNK]) for k, at in enumerate(range(0, 1 << bits, _CHUNK))]
        chunks = [(k, zlib.compress(c.tobytes(), 1)) for k, c in chunks if c.any()]
        yield pa.record_batch([pa.array([k for k, _ in chunks], pa.int32()),
                               pa.array([c for _, c in chunks], pa.binary())], names=["chunk", "cells"])
    return count


def _add_chunks(batches: Batches) -> Batches:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, c in zip(batch.column("chunk").to_pylist(), batch.column("cells").to_pylist(), strict=True):
            cells = np.frombuffer(zlib.decompress(c), np.int64)
            total[k] = total[k] + cells if k in total else cells
    levels = {k: np.floor(4 * np.log2(1 + c)).astype(np.uint8).tobytes() for k, c in total.items()}
    yield pa.record_batch([pa.array(list(levels), pa.int32()), pa.array(list(levels.values()), pa.binary())],
                          names=["chunk", "cells"])


def commonness(texts: DataFrame, rows: int, width: int = WIDTH) -> np.ndarray:
    """Per sketch cell the logarithmic count of shingles, one byte each: 16 MB at most."""
    bits, schema = sketch_bits(rows), "chunk int, cells binary"
    added = (texts.select("text").mapInArrow(trimmed(_count_cells(bits, width)), schema)
             .repartition("chunk").mapInArrow(_add_chunks, schema))
    levels = np.zeros(1 << bits, np.uint8)
    for k, c in added.collect():
        levels[k * _CHUNK:k * _CHUNK + len(c)] = np.frombuffer(c, np.uint8)
    return levels


# ---- sets, prefixes, filters -------------------------------------------------------------------

def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def node_of(found: np.ndarray) -> int:
    """The class id of a set: 64 bits of a hash of all its shingles."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes()))))


def ranks(found: np.ndarray, levels: np.ndarray) -> np.ndarray:
    return levels[(found >> np.uint64(64 - int(len(levels)).bit_length() + 1)).astype(np.int64)]


def sliced(batches: Batches) -> Batches:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _classes(levels, width: int, percent: int) -> Callable[[Batches], Batches]:
    def make(batches: Batches) -> Batches:
        done: set[int] = set()          # a task gives the prefix of a class once
        for batch in sliced(batches):
            size, node, rare, tokens, offsets = [], [], [], [], [0]
            for words in word_hashes(batch.column("text")):
                found = shingle_set(words, width)
                size.append(len(found))
                node.append(node_of(found) if len(found) else None)
                first = found[:0]
                if node[-1] is not None and node[-1] not in done:
                    done.add(node[-1])
                    level = ranks(found, levels.value)
                    order = np.argsort(level, kind="stable")[:prefix_length(len(found), percent)]
                    first = found[order]
                    rare.append(int(np.count_nonzero(level[order] <= RARE_LEVEL)))
                else:
                    rare.append(0)
                tokens.append(first)
                offsets.append(offsets[-1] + len(first))
            flat = np.concatenate(tokens).view(np.int64) if tokens else np.empty(0, np.int64)
            yield pa.record_batch(
                [batch.column("id"), batch.column("row_key"), pa.array(size, pa.int64()), pa.array(node, pa.int64()),
                 pa.array(rare, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))],
                names=["id", "row_key", "n", "node", "rare", "tokens"])
    return make


def _may_link(n: Column, pos: Column, m: Column, at: Column, percent: int) -> Column:
    """Length and position filter for sets of sizes n and m that share a token at these places."""
    need = F.ceil(percent * (n + m) / F.lit(100 + percent))
    most = F.least(pos, at) + 1 + F.least(n - pos, m - at) - 1
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (most >= need)


def other_prefix(found: np.ndarray, level: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The prefix of a set under order 2 or 3 (``order`` 0 or 1)."""
    size = prefix_length(len(found), percent)
    again = mix(found ^ _SALTS[order])
    return np.sort(found[np.lexsort((again, level))[:size]])


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def _bitmap(nodes: DataFrame, key: str) -> np.ndarray:
    """A bit for the low bits of every key: one megabyte, whatever the number of keys."""
    place = F.col(key).bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    words = (nodes.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 AS int)))").alias("bits")))
    bits = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    found = words.toArrow()     # a row each would take the driver a hundred times as much
    bits[found.column("w").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bits


def _sets(bits, width: int) -> Callable[[Batches], Batches]:
    def make(batches: Batches) -> Batches:
        for batch in sliced(batches):
            place = batch.column("row_key").to_numpy() & ((1 << BITMAP_BITS) - 1)
            hit = (bits.value[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)
            node, raw = [], []
            for words in word_hashes(batch.column("text").filter(pa.array(hit.astype(bool)))):
                found = shingle_set(words, width)
                if len(found):
                    node.append(node_of(found))
                    raw.append(found.view(np.uint8).reshape(-1, 8)[:, 8 - TOKEN_BYTES:].tobytes())
            yield pa.record_batch([pa.array(node, pa.int64()), pa.array(raw, pa.binary())], names=["node", "tokens"])
    return make


def _unpacked(raw: bytes) -> np.ndarray:
    """The leading bytes of a set's hashes, still in order."""
    out = np.zeros((len(raw) // TOKEN_BYTES, 8), np.uint8)
    out[:, 8 - TOKEN_BYTES:] = np.frombuffer(raw, np.uint8).reshape(-1, TOKEN_BYTES)
    return out.reshape(-1).view(np.uint64)


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections, by products of the rows' incidence with shared tokens."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    times = np.diff(np.concatenate((starts, [len(flat)])))
    column = np.repeat(np.cumsum(times > 1) - 1, times)     # numbers of the tokens that several rows have
    several = np.repeat(times > 1, times)
    owner, column = owner[several], column[several]
    counts = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, (at, at + 4096))
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        counts += part @ part.T
    return counts.astype(np.int64)


def block_links(nodes: list[int], sets: list[np.ndarray], levels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within a block."""
    size = np.array([len(x) for x in sets])
    fit = 100 * np.minimum(size, size[:, None]) >= percent * np.maximum(size, size[:, None])
    for order in range(len(_SALTS)):
        prefixes = [other_prefix(x, ranks(x, levels), order, percent) for x in sets]
        fit &= shared_counts(prefixes) > 0
    fit = np.triu(fit, 1)
    if not fit.any():
        return []
    some = np.flatnonzero(fit.any(axis=0) | fit.any(axis=1))
    shared = shared_counts([sets[k] for k in some])
    fit, size = fit[np.ix_(some, some)], size[some]
    linked = fit & (100 * shared >= percent * (size + size[:, None] - shared))
    return _forest([(nodes[some[x]], nodes[some[y]]) for x, y in zip(*np.nonzero(linked), strict=True)])


def _verify(levels, percent: int) -> Callable[[Batches], Batches]:
    """Rows arrive by block; yields each block's links."""
    def verify(batches: Batches) -> Batches:
        at, nodes, sets = None, [], []

        def close() -> list[tuple[int, int]]:
            found = block_links(nodes, sets, levels.value, percent) if len(nodes) > 1 else []
            nodes.clear()
            sets.clear()
            return found

        def linked(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            out = []
            keys = zip(*(batch.column(c).to_pylist() for c in ("pivot", "cls", "one", "two")), strict=True)
            for k, key in enumerate(keys):
                if key != at:
                    out += close()
                    at = key
                nodes.append(batch.column("node")[k].as_py())
                sets.append(_unpacked(batch.column("tokens")[k].as_py()))
            yield linked(out)
        yield linked(close())
    return verify


def _forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A spanning forest: at most one pair less than there are nodes, with the same components."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in pairs:
        if (x := find(a)) != (y := find(b)):
            parent[x] = y
            kept.append((a, b))
    return kept


# ---- the join ----------------------------------------------------------------------------------

class _Join:
    """The steps of one join; holds what they share."""

    def __init__(self, texts: DataFrame, width: int, percent: int) -> None:
        self.texts, self.width, self.percent = texts, width, percent
        spark = texts.sparkSession
        self.levels = spark.sparkContext.broadcast(commonness(texts, texts.count(), width))
        self.members = stored(texts.mapInArrow(trimmed(_classes(self.levels, width, percent)), "id long, row_key long, n long, "
                                               "node long, rare int, tokens array<long>"), "ngram-classes")
        # of the prefixes that several tasks gave for one class, the smallest row's stays
        given = self.members.where(F.size("tokens") > 0)
        again = stored(given.groupBy("node").agg(F.count("*").alias("times"), F.min("row_key").alias("chosen"))
                       .where("times > 1").select("node", "chosen"), "ngram-again")
        self.classes = (given.join(sized_broadcast(again, again.count(), BROADCAST_ROWS), "node", "left")
                        .where("chosen IS NULL OR chosen = row_key"))

    def sets_of(self, nodes: DataFrame) -> DataFrame:
        """``(node, tokens)`` of at least the given nodes, from one row each."""
        keys = self.classes.select("node", "row_key").join(nodes.select("node").distinct(), "node")
        bits = self.texts.sparkSession.sparkContext.broadcast(_bitmap(keys, "row_key"))
        return self.texts.select("row_key", "text").mapInArrow(trimmed(_sets(bits, self.width)), "node long, tokens binary")

    def groups(self) -> DataFrame:
        """``(pivot, node, n)``: classes that share a prefix token with one that may link are in one group."""
        rows = self.classes.select("node", "n", "rare", F.posexplode("tokens").alias("pos", "token"))
        by_size = W.partitionBy("token").orderBy("n", "node")
        whole = by_size.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        few = (rows.where("pos < rare").select("token", "node", "n", "pos")
               .withColumn("rows", F.count("*").over(whole)).withColumn("pivot", F.min("node").over(whole)))
        for name, shift in (("m", "n"), ("at", "pos")):
            few = few.withColumn(name, F.lag(shift).over(by_size)).withColumn(f"{name}2", F.lead(shift).over(by_size))
        n, pos = F.col("n"), F.col("pos")
        pair = _may_link(n, pos, F.coalesce("m", "m2"), F.coalesce("at", "at2"), self.percent)
        near = (F.coalesce(100 * F.col("m") >= self.percent * n, F.lit(False))
                | F.coalesce(100 * n >= self.percent * F.col("m2"), F.lit(False)))
        few = few.where("rows > 1").where(F.when(F.col("rows") == 2, pair).otherwise(near)).select("pivot", "node", "n")
        common = rows.where("pos >= rare").select("token", "node", "n")
        met = common.groupBy("token").agg(F.count("*").alias("rows"), F.min("node").alias("pivot")).where("rows > 1")
        many = common.join(met.select("token", "pivot"), "token").select("pivot", "node", "n")
        return stored(few.unionByName(many).distinct(), "ngram-groups")

    def run(self) -> DataFrame:
        groups = self.groups()
        sizes = groups.groupBy("pivot").agg(F.count("*").alias("size")).where("size > 1")
        sized = groups.join(sizes, "pivot")
        small = sized.where(F.col("size") <= 2 * BLOCK).select("pivot", F.lit(-1).alias("cls"), "node", F.lit(1).alias("blocks"))
        # rows of large groups meet those of the same and the neighbouring class of lengths
        cls = F.floor(F.log("n") / math.log(100 / self.percent)).cast("int")
        large = sized.where(F.col("size") > 2 * BLOCK).select("pivot", "node", F.explode(F.array(cls, cls + 1)).alias("cls"))
        blocks = large.groupBy("pivot", "cls").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        placed = small.unionByName(large.join(blocks, ["pivot", "cls"]).select("pivot", "cls", "node", "blocks"))
        block = F.pmod(F.hash("node"), "blocks")
        placed = stored(placed.select("pivot", "cls", "node", block.alias("block"),
                                      F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
                        .select("pivot", "cls", "node", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two")),
                        "ngram-blocks")
        # with the places at hand in every task the sets are shuffled once, to their blocks
        places = sized_broadcast(placed, placed.count(), BROADCAST_ROWS)
        met = self.sets_of(placed).join(places, "node").select("pivot", "cls", "one", "two", "node", "tokens")
        met = met.repartition("pivot", "cls", "one", "two").sortWithinPartitions("pivot", "cls", "one", "two")
        return components(stored(met.mapInArrow(trimmed(_verify(self.levels, self.percent)), "a long, b long"), "ngram-links"))


def ngram_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
               percent: int = PERCENT) -> DataFrame:
    """One row per input row: ``id, n_shingles, component_id, class_id``.

    ``component_id`` is the smallest id reachable over links, the row's own included; ``class_id``
    is equal for rows with equal sets.  Texts with fewer words than ``width`` are one shingle; null texts and
    texts without words have none, link with nothing and have a null class.  Null ids take part and
    never are the smallest, so a component of null ids only has a null id.  Rows may repeat: copies
    are one class.  An empty table gives no rows; other columns are ignored, whatever their names.
    """
    texts = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    texts = texts.select("id", F.xxhash64("id", "text").alias("row_key"), "text")
    join = _Join(texts, width, percent)
    comps = join.run()
    members = join.members.select("id", "n", "node")
    names = members.where("n > 0").groupBy("node").agg(F.min("id").alias("id"))
    names = names.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = names.groupBy("component").agg(F.min("id").alias("component_id"))
    labels = names.join(least, "component").select("node", "component_id")
    out = members.join(labels, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
                      F.col("node").alias("class_id"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).drop("class_id")


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w),
 c AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM s) GROUP BY s),
 t AS (SELECT rep, n, md5_number_lower(unnest(s)) AS g FROM c),
 p AS (
  SELECT a.rep AS a, b.rep AS b FROM t a JOIN t b ON a.g = b.g AND a.rep < b.rep AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
 e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
 r(node, comp) AS (
  SELECT rep, rep FROM c UNION SELECT e.b, r.comp FROM r JOIN e ON r.node = e.a AND r.comp < e.b),
 m AS (SELECT node, min(comp) AS comp FROM r GROUP BY node)
SELECT x.doc_id, len(x.s)::BIGINT AS n_shingles, CASE WHEN len(x.s) = 0 THEN x.doc_id ELSE m.comp END AS component_id
FROM (SELECT doc_id, s, list_sort(s) AS k FROM s) x JOIN c ON x.k = c.s JOIN m ON m.node = c.rep
"""

"""Exact dedup with an extendible-hash index kept on shared files.

1. Every row becomes an index entry ``(key, id, sha)``; the key is a 64-bit hash of the whole text.
   The entries are written to the shared folder, texts are not.
2. The directory starts with one slot per ``capacity`` rows.  While a bucket holds more than
   ``capacity`` distinct keys the directory doubles and that bucket splits on its next hash bit.
   A key with many rows never forces a split: its rows are one chain.
3. The entries are rewritten as bucket pages, one folder per bucket, each owning a key range.
4. Chains of more than one row fetch their texts.  Copies collapse batch by batch before they are
   shuffled, then each owner task walks its key ranges in key order and compares bytes, so texts
   that merely share a key stay apart, and a group of any size costs one row per batch.

The driver holds the directory only: two entries per bucket, ``2 * rows / capacity``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paraspark.llm.common import sized_broadcast, stored, table, text_or_empty
from paraspark.session import scratch_dir

CAPACITY = 65_536           # distinct keys of a bucket
BROADCAST_ROWS = 1_000_000  # of 8 to 64 bytes; beyond that the join is shuffled


def slot(key, depth: int):
    """The leading ``depth`` bits of a key."""
    return F.lit(0).cast("long") if depth == 0 else F.shiftrightunsigned(key, 64 - depth)


def build_directory(entries: DataFrame, capacity: int = CAPACITY) -> tuple[int, dict[int, tuple[int, int]]]:
    """(global depth, slot -> (bucket's first slot, local depth)) after splitting all overfull buckets."""
    keys = entries.select("key").groupBy("key").count().select("key")
    depth = max(0, math.ceil(math.log2(max(1, entries.count()) / capacity)))
    full = {r[0]: r[1] for r in keys.groupBy(slot(F.col("key"), depth)).count().collect()}
    buckets = {s: depth for s in range(1 << depth)}
    over = {s for s, n in full.items() if n > capacity}
    while over and depth < 63:
        buckets = {2 * s: d for s, d in buckets.items() if s not in over} | {
            c: depth + 1 for s in over for c in (2 * s, 2 * s + 1)}
        parents, depth = over, depth + 1
        split = keys.where(slot(F.col("key"), depth - 1).isin(sorted(parents)))
        full = {r[0]: r[1] for r in split.groupBy(slot(F.col("key"), depth)).count().collect()}
        over = {s for s, n in full.items() if n > capacity}
    return depth, {s: (first, d) for first, d in buckets.items()
                   for s in range(first, first + (1 << (depth - d)))}


def write_pages(entries: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rewrite the entries as pages ``bucket=N`` sorted by key; returns the pages."""
    spark = entries.sparkSession
    depth, directory = build_directory(entries, capacity)
    slots = spark.createDataFrame([(s, b) for s, (b, _) in directory.items()], "slot long, bucket long")
    path = scratch_dir(spark, "exact-index")
    placed = (entries.withColumn("slot", slot(F.col("key"), depth))
              .join(sized_broadcast(slots, len(directory), BROADCAST_ROWS), "slot").drop("slot"))
    (placed.repartition("bucket", F.shiftright("key", 8) % 16)   # a bucket may be written by several tasks
     .sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(path))
    return spark.read.schema(placed.schema).parquet(path)


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for equal texts of a batch: the largest id and the number of rows."""
    for batch in batches:
        rows = pa.Table.from_batches([batch]).group_by(["bucket", "key", "text"]).aggregate(
            [("id", "max"), ([], "count_all")])
        yield from rows.rename_columns(["bucket", "key", "text", "id", "n"]).to_batches()


def _compare_chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owner task: rows arrive in key order; a chain keeps one entry per distinct text."""
    chain: dict[bytes, list] = {}
    at, out = None, []

    def close() -> None:
        out.extend((at, *x) for x in chain.values())
        chain.clear()

    for batch in batches:
        key, text, sha, top, n = (batch.column(c).to_pylist() for c in ("key", "text", "sha", "id", "n"))
        for i, k in enumerate(key):
            if k != at:
                close()
                at = k
            seen = chain.get(text[i])          # equal only if all bytes are
            if seen is None:
                chain[text[i]] = [sha[i], top[i], n[i]]
            else:
                seen[2] += n[i]
                if top[i] is not None and (seen[1] is None or top[i] > seen[1]):
                    seen[1] = top[i]
        if len(out) >= 10_000:
            yield _groups(out)
            out.clear()
    close()
    if out:
        yield _groups(out)


def _groups(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()),
                            pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())],
                           names=["key", "sha", "keep_id", "group_size"])


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                capacity: int = CAPACITY) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when all bytes are; null counts as empty.  Of equal texts the largest id stays.
    Rows repeated with the same id and text all count in ``group_size`` and all carry ``kept``;
    null ids stay only if the whole group has none.  An empty table gives no rows.  Other columns of
    the input are ignored, whatever their names.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    entries = stored(rows.select("id", F.xxhash64("text").alias("key"), F.sha2("text", 256).alias("sha")),
                     "exact-entries")
    pages = write_pages(entries, capacity)
    chained = stored(pages.groupBy("bucket", "key").count().where("count > 1").select("bucket", "key"),
                     "exact-chains")
    n_chained = chained.count()
    copies = (rows.withColumn("key", F.xxhash64("text"))
              .join(sized_broadcast(chained, n_chained, BROADCAST_ROWS), "key")
              .select("bucket", "key", "text", "id")
              .mapInArrow(_collapse, "bucket long, key long, text string, id long, n long"))
    groups = stored(copies.withColumn("sha", F.sha2("text", 256))
                    .withColumn("text", F.col("text").cast("binary"))
                    .repartition("bucket", "key").sortWithinPartitions("bucket", "key")
                    .mapInArrow(_compare_chains, "key long, sha string, keep_id long, group_size long"),
                    "exact-groups")
    found = pages.select("id", "key", "sha").join(
        sized_broadcast(groups, n_chained, BROADCAST_ROWS // 4), ["key", "sha"], "left")
    size = F.coalesce("group_size", F.lit(1).cast("long"))
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return found.select(F.col("id").alias(id_col), keep.alias("keep_id"), size.alias("group_size"),
                        F.col("id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
     g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.text) AS text_sha256
FROM t JOIN g ON t.text = g.text
"""

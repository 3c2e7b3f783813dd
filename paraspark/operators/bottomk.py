"""Bounded, mergeable summaries of the rows with the smallest draws of every group.

A task keeps at most ``2 n`` rows of a group at a time and hands on its ``n`` smallest, with the number of rows it saw;
merging two summaries is keeping the ``n`` smallest again.  Rows stay Arrow batches: Python sees only the
draws, keys and groups.  One scan of the input; with many tasks the summaries are merged in a tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 64        # summaries merged by one task, about
DRAW, SEEN = "__draw", "__seen"


def _order(t: pa.Table, keys: list[str]) -> pa.Array:
    return pc.sort_indices(t, sort_keys=[(c, "ascending") for c in (DRAW, *keys)], null_placement="at_start")


class _Summary:
    """The ``n`` smallest rows of one group."""

    def __init__(self, n: int, keys: list[str]) -> None:
        self.n, self.keys, self.held, self.rows, self.seen = n, keys, [], 0, 0

    def add(self, t: pa.Table, seen: int) -> None:
        self.seen += seen
        self.held.append(t if t.num_rows <= self.n else t.take(_order(t, self.keys)[:self.n]))
        self.rows += self.held[-1].num_rows
        if self.rows > 2 * self.n:
            self.shrink()

    def shrink(self) -> pa.Table:
        whole = pa.concat_tables(self.held)
        whole = whole.take(_order(whole, self.keys)[:self.n]).combine_chunks()
        self.held, self.rows = [whole], whole.num_rows
        return whole


def _groups(batches: Iterator[pa.RecordBatch], by: str, keys: list[str], n: int) -> dict:
    found: dict = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        group, seen = t.column(by).combine_chunks().dictionary_encode(null_encoding="encode"), t.column(SEEN).to_numpy()
        codes = group.indices.to_numpy(zero_copy_only=False)
        for code, name in enumerate(group.dictionary.to_pylist()):
            mine = np.flatnonzero(codes == code)
            found.setdefault(name, _Summary(n, keys)).add(t.take(pa.array(mine)), int(seen[mine].sum()))
    return found


def _put(t: pa.Table, **columns) -> pa.Table:
    for name, values in columns.items():
        k = t.schema.get_field_index(name)
        t = t.set_column(k, t.schema.field(k), pa.array(values, t.schema.field(k).type))
    return t


def _summarise(by: str, keys: list[str], n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for summary in _groups(batches, by, keys, n).values():
            t = summary.shrink()
            # a group's number of rows rides on its first one
            yield from _put(t, **{SEEN: [summary.seen] + [0] * (t.num_rows - 1)}).to_batches()
    return run


def quotas(sizes: list[int], n: int) -> list[int]:
    """Equal shares of ``n``, the first groups one more while there is a remainder, none beyond its group's size."""
    return [min(size, n // len(sizes) + (k < n % len(sizes))) for k, size in enumerate(sizes)]


def _choose(by: str, keys: list[str], n: int, top_up: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _groups(batches, by, keys, n)
        names = sorted(found, key=lambda g: (g is not None, g))
        shares = quotas([found[g].seen for g in names], n) if names else []
        rest = []
        for name, share in zip(names, shares):
            t = found[name].shrink()
            yield from t.slice(0, share).to_batches()
            rest.append(t.slice(share))
        needed = min(n, sum(found[g].seen for g in names)) - sum(shares)
        if top_up and needed:
            whole = pa.concat_tables(rest)
            yield from whole.take(_order(whole, keys)[:needed]).to_batches()
    return run


def balanced_bottom(df: DataFrame, draw, keys: list[str], by: str, n: int, top_up: bool = True) -> DataFrame:
    """``n`` rows of ``df``, each group's share those with its smallest draws; short groups are made up for by the
    smallest draws of all rows that are left.

    A null group is a group, the first one.  ``draw`` is a Column, ties go by the keys.  No more than ``n`` rows
    of a group leave a task, and the merging task holds ``2 n`` a group.
    """
    drawn = df.withColumn(DRAW, draw).withColumn(SEEN, F.lit(1).cast("bigint"))
    summaries = drawn.mapInArrow(_summarise(by, keys, n), drawn.schema)
    tasks = df.sparkSession.sparkContext.defaultParallelism
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        summaries = summaries.repartition(tasks).mapInArrow(_summarise(by, keys, n), drawn.schema)
    return summaries.repartition(1).mapInArrow(_choose(by, keys, n, top_up), drawn.schema).drop(DRAW, SEEN)

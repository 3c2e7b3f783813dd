"""CSV files read by several tasks, quoted line ends included.

A line of a CSV file starts a record or goes on inside a quoted field, which only the lines before it tell.
But what a line does to that state is a function of two states, and such functions compose in any grouping.
One pass sums every file block up: the state after it, the records that end in it and the pieces of
records that cross its edges, for either state before it.  A scan over the blocks (a row each, running sums)
gives every block its true state and its records' numbers.  The second pass joins the lines of a
block to records; pieces of records that cross blocks, at most two a block, meet by their number.
Records are then read by Spark's own CSV expression.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paraspark.session import scratch_dir

_BLOCKS = ("path string, start long, out0 int, out1 int, n0 long, n1 long, "
           "head string, tail0 string, tail1 string, whole boolean")
_OPTIONS = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}


def open_after(line: str, opened: bool, first: bool = False) -> bool:
    """Whether a quoted field is open at the end of ``line``, if it was (not) at its start.

    A quote opens a field only where the field starts, two quotes inside a quoted field are a character, and
    after the closing quote the rest of the field is plain.  ``first``: a byte-order mark may come before.
    """
    if '"' not in line:
        return opened
    if first:
        line = line.removeprefix("﻿")
    parts = line.split('"')
    # where the text before a quote leaves off: s(tart of a field), t(ext), q(uoted), c(losed just now)
    state = "q" if opened else "s" if parts[0] == "" or parts[0][-1] == "," else "t"
    for part in parts[1:]:
        if state in "sc":
            state = "q"
            continue
        if state == "q" and part == "":
            state = "c"
            continue
        state = "s" if part[-1:] == "," else "t"
    return state == "q"


class _Block:
    """One file block, entered in one of the two states: records that end in it and the pieces at its edges."""

    def __init__(self, path: str, start: int, opened: bool) -> None:
        self.path, self.start, self.opened, self.inside = path, start, opened, opened
        self.ended, self.head, self.held, self.lines = 0, None, [], 0

    def add(self, line: str) -> str | None:
        """The record that ends with this line and began in this block, blank ones aside."""
        self.opened = open_after(line, self.opened, self.start == 0 and self.lines == 0)
        self.lines += 1
        self.held.append(line)
        if self.opened:
            return None
        whole, self.held = "\n".join(self.held), []
        if self.inside:
            self.inside, self.head = False, whole
            self.ended += 1
            return None
        if whole in ("", "\r"):
            return None
        self.ended += 1
        return whole


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(first line of a block?, line, path, start, further columns) of a scan, in order."""
    last = None
    for batch in batches:
        for value, path, start, *more in zip(*[c.to_pylist() for c in batch.columns]):
            yield (path, start) != last, value, path, start, *more
            last = (path, start)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("lineSep", "\n").text(path)
            .select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    either: tuple[_Block, _Block] | None = None

    def summed() -> pa.RecordBatch:
        out, on = either
        return pa.RecordBatch.from_pylist([{
            "path": out.path, "start": out.start, "out0": int(out.opened), "out1": int(on.opened), "n0": out.ended, "n1": on.ended,
            "head": "\n".join(on.held) if on.inside else on.head, "tail0": "\n".join(out.held) if out.held else None,
            "tail1": "\n".join(on.held) if on.held and not on.inside else None, "whole": on.inside}],
            schema=pa.schema([("path", pa.string()), ("start", pa.int64()), ("out0", pa.int32()), ("out1", pa.int32()), ("n0", pa.int64()),
                              ("n1", pa.int64()), ("head", pa.string()), ("tail0", pa.string()), ("tail1", pa.string()), ("whole", pa.bool_())]))

    for new, line, path, start in _by_block(batches):
        if new:
            if either:
                yield summed()
            either = _Block(path, start, False), _Block(path, start, True)
        for block in either:
            block.add(line)
    if either:
        yield summed()


def _joiner(size: int = 4096) -> Callable:
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("n", pa.int64()), ("record", pa.string())])
        block, out = None, []
        for new, line, path, start, opened, before in _by_block(batches):
            if new:
                block = _Block(path, start, bool(opened))
            record = block.add(line)
            if record is not None:
                out.append({"path": path, "n": before + block.ended - 1, "record": record})
            if len(out) == size:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    return records


def _entered(blocks: DataFrame) -> DataFrame:
    """Blocks with the state before them (``opened``) and the number of their file's records before them (``before``)."""
    in_file = Window.partitionBy("path").orderBy("start")
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    # a block keeps the state, turns it round, or sets it whatever it was
    sets, turns = F.col("out0") == F.col("out1"), (F.col("out0") == 1) & (F.col("out1") == 0)
    turned = blocks.withColumn("turned", F.coalesce(F.sum(F.when(turns, 1).otherwise(0)).over(
        in_file.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    known = F.last(F.when(sets, F.struct("out0", "turned")), ignorenulls=True).over(earlier)
    since = F.coalesce(F.last("turned").over(earlier), F.lit(0)) - F.coalesce(known["turned"], F.lit(0))
    opened = (F.coalesce(known["out0"], F.lit(0)) + since) % 2
    entered = turned.withColumn("opened", opened.cast("int"))
    ended = F.when(F.col("opened") == 0, F.col("n0")).otherwise(F.col("n1"))
    return (entered.withColumn("ended", ended)
            .withColumn("before", F.coalesce(F.sum("ended").over(earlier), F.lit(0))))


def read_csv_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(``path, n, record``, ``path, rows``): the records of all files as text, and each file's number of rows.

    ``n`` counts a file's records from 0, the header, blank lines aside.  The first pass runs at once and leaves a row per
    file block in the shared folder; a few numbers of each are what is broadcast.
    """
    lines = _lines(spark, path)
    place = scratch_dir(spark, "csv-blocks")
    lines.mapInArrow(_summaries, _BLOCKS).write.parquet(place)
    blocks = _entered(spark.read.schema(_BLOCKS).parquet(place))
    tagged = lines.join(F.broadcast(blocks.select("path", "start", "opened", "before")), ["path", "start"])
    inside = tagged.select("value", "path", "start", "opened", "before").mapInArrow(_joiner(), "path string, n long, record string")
    # all pieces of a record have its number: as many records of the file ended before them
    pieces = blocks.select("path", F.explode(F.array(
        F.when(F.col("opened") == 1, F.struct(F.col("before").alias("n"), "start", F.lit(0).alias("part"), F.col("head").alias("text"))),
        F.when((F.col("opened") == 0) & F.col("tail0").isNotNull(),
               F.struct((F.col("before") + F.col("n0")).alias("n"), "start", F.lit(1).alias("part"), F.col("tail0").alias("text"))),
        F.when((F.col("opened") == 1) & F.col("tail1").isNotNull(),
               F.struct((F.col("before") + F.col("n1")).alias("n"), "start", F.lit(1).alias("part"), F.col("tail1").alias("text"))),
    )).alias("piece")).where("piece IS NOT NULL").select("path", "piece.*")
    across = pieces.groupBy("path", "n").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("start", "part", "text"))), lambda p: p["text"]), "\n").alias("record"))
    last_open = F.when(F.col("opened") == 0, F.col("out0")).otherwise(F.col("out1"))
    files = blocks.groupBy("path").agg((F.sum("ended") + F.max_by(last_open, "start") - 1).alias("rows"))
    return inside.unionByName(across), files


def read_csv_split(spark: SparkSession, path: str, index: str | None = None, start: int = 0) -> DataFrame:
    """Header CSV in the dialect Python's csv module writes, as strings; every file is read by as many tasks as it has blocks.

    Doubled quotes, quoted line ends and a byte-order mark are understood; the first file's header names the columns,
    short rows end in nulls, further fields are dropped, blank lines are no rows.  ``index`` adds the rows' dense
    number in order of file path and place.  Records end at line feeds, with or without a carriage return.
    """
    header = spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("encoding", "UTF-8").csv(path)
    names = [c.lstrip("﻿") for c in header.columns]
    schema = ", ".join(f"`c{k}` string" for k in range(len(names)))
    if not names:
        return header
    records, files = read_csv_records(spark, path)
    if index:
        earlier = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
        bases = files.select("path", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("base"))      # one row a file
        records = records.join(F.broadcast(bases), "path")
    text = F.regexp_replace("record", r"\r\z", "")
    rows = records.where("n > 0").select(F.from_csv(text, schema, _OPTIONS).alias("row"),
                                         *([(F.col("base") + F.col("n") - 1 + start).alias("at")] if index else []))
    return rows.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(names)], *([F.col("at").alias(index)] if index else []))

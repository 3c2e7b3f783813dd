"""Row identity: dense numbering without a single-task window.

``row_number() OVER (ORDER BY ..)`` with no partition puts every row into one task.  Rows of files
need no sort: a scan's rows are numbered by their place in a file block plus the rows of the blocks
before it.  Rows of tables are dealt to cells by cuts of their keys, counted by cell and numbered within;
the cuts are literals of the plan, so both passes deal alike.  Offsets have one row per block or cell.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paraspark.session import scratch_dir

_MID = "__mid"
SKETCH_PER_CELL = 64    # keys drawn for each cut


def _order_cols(order_cols):
    if isinstance(order_cols, (str,)) or hasattr(order_cols, "_jc"):
        order_cols = [order_cols]
    return [F.col(c) if isinstance(c, str) else c for c in order_cols]


def stored_keys(df: DataFrame, name: str) -> DataFrame:
    """A narrow frame written under the shared folder and read back, as numbering reads its rows several times."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def key_cuts(df: DataFrame, names: list[str], cells: int) -> str:
    """Up to ``cells - 1`` keys that cut the rows into parts of about one size.

    The sketch is the rows whose keys have the smallest hashes: a uniform draw of keys whose parts
    merge by keeping the smallest again, so a task sends ``cells * SKETCH_PER_CELL`` keys at most.
    Only the cuts come to the driver, as JSON; any cuts give the right numbers, even ones give even tasks.
    """
    size = cells * SKETCH_PER_CELL
    drawn = df.select(*names, F.xxhash64(*names).alias("__h")).orderBy("__h").limit(size)
    # the bounded draw is one array; its elements at every cells-th part are the cuts
    sorted_ = F.array_sort(F.collect_set(F.struct(*names)))
    cuts = drawn.agg(sorted_.alias("s")).select(F.filter("s", lambda _, i: (i > 0) & (
        F.floor(i * cells / F.size("s")) > F.floor((i - 1) * cells / F.size("s")))).alias("cuts"))
    return cuts.select(F.to_json("cuts")).first()[0]


def _cell(df: DataFrame, names: list[str], cuts: str) -> Column:
    """How many cuts are at or below the row's key: a binary search in an array that is a literal of the plan."""
    n = len(json.loads(cuts))
    if not n:
        return F.lit(0)
    kind = T.ArrayType(df.select(*names).schema)
    literal = F.array_sort(F.from_json(F.lit(cuts), kind))
    key = F.struct(*names)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])

    def step(at: Column, by: Column) -> Column:
        return F.when((at + by <= n) & (F.get(literal, at + by - 1) <= key), at + by).otherwise(at)
    return F.aggregate(steps, F.lit(0), step)


def with_row_index(df: DataFrame, order_cols, start: int = 0, name: str = "row_index", num_partitions: int | None = None,
                   total: str | None = None) -> DataFrame:
    """Dense index ``start, start+1, ..`` following ``order_cols`` (B1), column names; nulls come first.

    Every row keeps its place in the result: rows of one key are numbered one after the other, in no defined
    order among themselves.  Building the plan runs one job, which finds the cuts; nothing is written or
    checkpointed, and rows are shuffled once, to their cells.  A rerun, or a lost executor, numbers rows alike
    (but for rows of one key).  ``total`` adds the number of rows under that name.
    """
    names = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    cells = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell = _cell(df, names, key_cuts(df, names, cells))
    counts = df.select(*names).groupBy(cell.alias("__cell")).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(F.col("__cell"), _offset(Window.orderBy("__cell")),
                            F.sum("__n").over(Window.partitionBy(F.lit(0))).alias("__total"))
    dealt = df.withColumn("__cell", cell)
    within = F.row_number().over(Window.partitionBy("__cell").orderBy(*names)) - 1
    # one row per cell
    out = dealt.withColumn("__within", within).join(F.broadcast(offsets), "__cell")
    return out.select(*df.columns, (F.col("__off") + F.col("__within") + F.lit(start)).cast("bigint").alias(name),
                      *([F.col("__total").alias(total)] if total else []))


def _offset(order) -> Column:
    return F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off")


def with_scan_index(scan: DataFrame, start: int = 0, name: str = "row_index", keep: Column | None = None) -> DataFrame:
    """Dense index of the rows of a file scan, in order of file path and place in the file.

    Lazy, without shuffle or checkpoint of rows: one pass counts rows per file block, the other adds the
    counts of the blocks before.  A scan cuts its files alike in both passes.  ``keep`` selects the rows
    that are numbered and returned.
    """
    block = [F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__start")]
    tagged = scan.select("*", *block).withColumn(_MID, F.monotonically_increasing_id())
    if keep is not None:
        # numbered after the filter: ids inside a block then rise without gaps
        tagged = scan.select("*", *block).where(keep).withColumn(_MID, F.monotonically_increasing_id())
    counts = tagged.groupBy("__path", "__start").agg(F.count(F.lit(1)).alias("__n"), F.min(_MID).alias("__first"))
    offsets = counts.select("__path", "__start", "__first", _offset(Window.orderBy("__path", "__start")))
    # one row per file block
    return (tagged.join(F.broadcast(offsets), ["__path", "__start"])
            .withColumn(name, (F.col("__off") + F.col(_MID) - F.col("__first") + F.lit(start)).cast("bigint"))
            .drop("__path", "__start", "__first", "__off", _MID))


def number_bounded(df: DataFrame, order_cols, name: str, start: int = 0) -> DataFrame:
    """Dense numbering of a frame whose size is bounded by a parameter (a drawn sample).

    A global window is fine here: the frame has at most ``n`` rows by construction.
    """
    cols = _order_cols(order_cols)
    return df.withColumn(name, (F.row_number().over(Window.orderBy(*cols)) - 1 + start).cast("bigint"))

"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paraspark.session import scratch_dir

WORD = r"[^\x20\x09-\x0D]+"
ARROW_ROWS = 1000       # whole texts that both Spark and Python hold at once
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Let at most ``ARROW_ROWS`` rows go to Python at once in this session."""
    if not 0 < int(spark.conf.get(_ROWS_SETTING)) <= ARROW_ROWS:
        spark.conf.set(_ROWS_SETTING, str(ARROW_ROWS))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared folder and read it back: cuts lineage and survives executors.

    The shuffle files of the write go when it ends, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    before = spark.conf.get(_CLEANUP_SETTING, "false")
    spark.conf.set(_CLEANUP_SETTING, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP_SETTING, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table from ``stored`` that nothing reads any more, lazy frames included."""
    context = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(folder))
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` over a task's batches; then what Arrow and malloc keep goes back, as idle workers stay for a minute."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc's
        if trim:
            trim(0)
    return whole


def sized_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Hint a broadcast only if the counted rows stay under ``limit``; else Spark shuffles the join."""
    return F.broadcast(df) if rows <= limit else df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))

"""A sink that deals lines to several folders in one job and commits them together.

Rows are ``route, line``.  Every task writes its lines of a route to a file of its own under a staging folder and
reports it; only when all tasks are done does the driver move the reported files to ``<path>/<route>``.  Files of
failed, repeated or speculative tasks are never reported, and a job that fails leaves nothing.  A route without lines
still gets its folder with an empty file.  Paths are opened by ``pyarrow.fs`` (local, HDFS, S3, GCS, Azure).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "routed_lines"
_END = pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())     # nothing after the line's end


@dataclass
class Written(WriterCommitMessage):
    """The files of one task by route, with their numbers of lines."""

    files: list[tuple[str, str, int]] = field(default_factory=list)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class RoutedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.routes = options["path"].rstrip("/"), json.loads(options["routes"])
        self.job, self.overwrite = uuid.uuid4().hex, overwrite
        store, root = _open(self.path)
        taken = [r for r in self.routes if store.get_file_info(f"{root}/{r}").type != fs.FileType.NotFound]
        if taken and not overwrite:
            raise ValueError(f"{self.path} has {', '.join(taken)} already")

    def _staging(self, root: str) -> str:
        return f"{root}/_staging-{self.job}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = _open(self.path)
        task, out, counts = uuid.uuid4().hex, {}, {}
        try:
            for batch in batches:
                coded = batch.column("route").dictionary_encode()
                codes = coded.indices.to_numpy(zero_copy_only=False)
                for code, route in enumerate(coded.dictionary.to_pylist()):
                    if route not in self.routes:
                        raise ValueError(f"no folder for the route {route!r}")
                    lines = batch.column("line").take(pa.array(np.flatnonzero(codes == code)))
                    if route not in out:
                        place = f"{self._staging(root)}/{route}"
                        store.create_dir(place, recursive=True)
                        out[route], counts[route] = store.open_output_stream(f"{place}/part-{task}.jsonl"), 0
                    text = pc.binary_join_element_wise(lines.cast(pa.large_string()), *_END).cast(pa.large_binary())
                    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
                    out[route].write(text.buffers()[2][int(offsets[0]):int(offsets[-1])])
                    counts[route] += len(lines)
        finally:
            for stream in out.values():
                stream.close()
        return Written([(route, f"part-{task}.jsonl", n) for route, n in counts.items()])

    def commit(self, messages: list) -> None:
        store, root = _open(self.path)
        for route in self.routes:
            place = f"{root}/{route}"
            if self.overwrite and store.get_file_info(place).type != fs.FileType.NotFound:
                store.delete_dir(place)
            store.create_dir(place, recursive=True)
            names = [f[1] for m in messages if m for f in m.files if f[0] == route]
            for name in names:
                store.move(f"{self._staging(root)}/{route}/{name}", f"{place}/{name}")
            if not names:
                store.open_output_stream(f"{place}/part-empty.jsonl").close()
        self._clear(store, root)

    def abort(self, messages: list) -> None:
        self._clear(*_open(self.path))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(self._staging(root)).type != fs.FileType.NotFound:
            store.delete_dir(self._staging(root))


class RoutedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "route string, line string"

    def writer(self, schema: StructType, overwrite: bool) -> RoutedWriter:
        return RoutedWriter(self.options, overwrite)


def write_routed(df: DataFrame, path: str, routes: list[str], mode: str = "append") -> None:
    """Write ``route, line`` rows as text files under ``path``, one folder per route, all of them or none.

    ``append`` refuses folders that are there already; ``overwrite`` replaces them when the job has succeeded.
    A route that is not listed, a null one too, fails the job.  Null lines are empty lines.
    """
    spark: SparkSession = df.sparkSession
    spark.dataSource.register(RoutedLines)
    (df.select("route", F.coalesce("line", F.lit("")).alias("line")).write.format(FORMAT).mode(mode)
     .option("routes", json.dumps(routes)).save(path))

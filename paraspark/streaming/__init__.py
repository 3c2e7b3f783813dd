"""Incremental ingest: the stateless prepare stage on a growing folder of pair files.

The source scripts read finite files and keep no state, so nothing here is stateful.  Validation,
the keyed split draw and direction expansion are pure per-row functions, so the very same Column
expressions run on a streaming DataFrame: each new JSONL file in ``input_dir`` becomes directed
chat examples (valid rows) and quarantine records (invalid rows) in one micro-batch.  Row
identity in a stream is the file and a hash of the line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paraspark.constants import DEFAULT_SEED, DEFAULT_VALIDATION_RATIO, REQUIRED_PAIR_FIELDS
from paraspark.operators import cases as X
from paraspark.operators import sampling as E
from paraspark.operators import validate as V


def stream_pairs(spark: SparkSession, input_dir: str) -> DataFrame:
    """JSONL pair lines from a folder as a streaming frame keyed by ``(source, line_key)``."""
    lines = (spark.readStream.format("text").option("maxFilesPerTrigger", 1000).load(input_dir)
             .where(F.trim("value") != "")
             .withColumn("source", F.input_file_name())
             .withColumn("line_key", F.xxhash64("value")))
    v = F.try_parse_json("value")
    return lines.select("source", "line_key",
                        *[F.try_variant_get(v, f"$.{f}", "string").alias(f) for f in REQUIRED_PAIR_FIELDS])


def prepare_stream(spark: SparkSession, input_dir: str, output_dir: str, checkpoint_dir: str, bidirectional: bool = True,
                   ratio: float = DEFAULT_VALIDATION_RATIO, seed: int = DEFAULT_SEED, available_now: bool = True):
    """Start the incremental prepare; returns the StreamingQuery.

    ``checkpoint_dir`` is this stream's own: a restart with the same folder goes on where it stopped.
    Each micro-batch owns the folders of its number and overwrites them, so a retried batch leaves no
    duplicates.  A line that is no JSON has no fields, so it goes to the skipped rows.
    """
    pairs = stream_pairs(spark, input_dir)
    checked = V.with_missing(pairs).withColumn("valid", F.size("missing") == 0)
    split = E.split_bernoulli(checked, ["source", "line_key"], ratio=ratio, seed=seed)

    def write_batch(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        examples = X.chat_examples(batch.where("valid"), bidirectional).select("messages", "metadata", "split")
        examples.write.mode("overwrite").partitionBy("split").json(f"{output_dir}/examples/batch={epoch}")
        (batch.where(~F.col("valid")).select("source", "line_key", "missing").write.mode("overwrite")
         .json(f"{output_dir}/skipped_rows/batch={epoch}"))
        batch.unpersist()

    writer = split.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()

"""End-to-end flows: the prepare, re-weight, calibrate and evaluate runs as Spark jobs.

Each flow reads, transforms and writes with the operators of this package; command-line options
become keyword arguments.  Frames that feed several outputs are persisted (memory and disk; a
lost executor's blocks are recomputed from lineage).  Reports are one-row DataFrames written as
JSON.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from paraspark.constants import (
    DEFAULT_CALIBRATION_SIZE, DEFAULT_SEED, DEFAULT_TASK_PREFIX, DEFAULT_VALIDATION_RATIO, PROMPT_ONLY_MODE,
)
from paraspark.functions import chat as C
from paraspark.functions.hashing import seeded_hash
from paraspark.functions.text import token_count
from paraspark.operators import cases as X
from paraspark.operators import reports as R
from paraspark.operators import sampling as E
from paraspark.operators import validate as V
from paraspark.operators.identity import number_bounded
from paraspark.operators.inference import predict_batches
from paraspark.operators.metrics import score_predictions
from paraspark.operators.tokens import encode, supervised_only
from paraspark.sources import readers as IO
from paraspark.sources import writers as W
from paraspark.sources.routed import write_routed


PREDICTION_COLUMNS = ("direction", "row_index", "term", "target_length", "style", "source_text", "reference_text",
                      "baseline_prediction", "baseline_gpt_score", "baseline_chrf_like", "prompt_template",
                      "prediction", "exact_match", "token_f1", "chrf_like")
SEGMENT_COLUMNS = ("segment_id", "accent", "youtube_id", "start_time", "duration", "source_text")


def run_prepare(spark: SparkSession, output_dir: str, input: str | None = None, train_input: str | None = None,
                validation_input: str | None = None, validation_ratio: float = DEFAULT_VALIDATION_RATIO,
                train_all: bool = False, seed: int = DEFAULT_SEED, limit: int | None = None,
                skip_invalid: bool = False, bidirectional: bool = False) -> DataFrame:
    """Pairs -> validated, split, directed chat examples, quarantine and stats."""
    if train_all and (train_input or validation_input):
        raise ValueError("with train_all there is one input, and it is not split")
    explicit = bool(train_input or validation_input)
    if explicit and not (train_input and validation_input):
        raise ValueError("of train_input and validation_input, one is missing")

    def load(path, split=None):
        df = V.limit_source(IO.read_pairs(spark, path), limit)
        df = df.withColumn("__source", F.lit(path))
        return df.withColumn("split", F.lit(split)) if split else df

    if explicit:
        frame = load(train_input, "train").unionByName(load(validation_input, "validation"), allowMissingColumns=True)
    elif train_all:
        frame = E.split_train_all(load(input))
    else:
        # the draw is keyed on the source row number: both directions of a row share a split
        frame = E.split_bernoulli(load(input), "row_number", ratio=validation_ratio, seed=seed)
    sources = [train_input, validation_input] if explicit else [input]
    checked = V.with_missing(frame).withColumn("valid", F.size("missing") == 0)
    if not skip_invalid:
        checked = V.failing_on_invalid(checked, "__source")
    # counts are taken while the rows pass to the sink: one scan of the input in all
    seen = Observation(f"prepare-{uuid.uuid4().hex}")
    checked = checked.observe(seen, *R.prepare_metrics(bidirectional))
    examples = X.chat_examples(checked, bidirectional)
    valid, routes = F.col("valid"), ["examples/split=train", "examples/split=validation"] + (["skipped_rows"] if skip_invalid else [])
    # a rejected row is one line, whatever the number of directions
    lines = examples.where(valid | (F.col("direction") == X.directions_for(bidirectional)[0])).select(
        F.when(valid, F.concat(F.lit("examples/split="), F.col("split"))).otherwise("skipped_rows").alias("route"),
        F.when(valid, F.to_json(F.struct("messages", "metadata"))).otherwise(W.quarantine_line(
            [F.col("__source").alias("source"), F.col("row_number"),
             V.error_message(F.col("__source"), F.col("row_number"), F.col("missing")).alias("error")], "__row")).alias("line"))
    try:
        write_routed(lines, output_dir, routes)
    except Exception as e:
        # the first bad row in file order, as a reader of the message would look for it
        if not skip_invalid and V.INVALID in str(e):
            V.require_valid(V.with_missing(frame).drop("missing"), source=sources, source_col="__source")
        raise
    stats = R.prepare_document(seen.get, sources, output_dir, validation_ratio=validation_ratio, seed=seed,
                               bidirectional=bidirectional, train_all=train_all, skip_invalid=skip_invalid)
    return W.write_document(spark, stats, f"{output_dir}/stats")


def run_reweight(spark: SparkSession, train_file: str, validation_file: str, output_dir: str,
                 en_es_repeat: int = 2, es_en_repeat: int = 1, seed: int = DEFAULT_SEED, shuffle: bool = True,
                 weight_validation: bool = False) -> DataFrame:
    """Direction re-weighting of a chat split set, with the before/after report."""
    factors = {"en-es": en_es_repeat, "es-en": es_en_repeat}

    def load(path, split):
        chat = IO.read_chat(spark, path)
        return chat.withColumn("direction", C.infer_direction("messages", F.col("metadata.direction"))) \
                   .withColumn("split", F.lit(split))

    train, val = load(train_file, "train"), load(validation_file, "validation")
    weighted = E.reweight(train, val, "line_no", factors, seed, do_shuffle=shuffle, weight_validation=weight_validation)
    for split in ("train", "validation"):
        part = weighted.where(F.col("split") == split)
        weighted_split = split == "train" or weight_validation
        order_cols = (["position"] if shuffle else ["line_no", "copy"]) if weighted_split else ["line_no"]
        W.write_chat_jsonl(part.orderBy(*order_cols), f"{output_dir}/{split}")
    weighted_splits = ("train", "validation") if weight_validation else ("train",)
    report = R.reweight_report(train.unionByName(val), factors, weighted_splits=weighted_splits)
    rows = [r.asDict() for r in report.collect()]       # a row per split and direction
    W.write_document(spark, R.reweight_document(
        rows, {"train": train_file, "validation": validation_file}, output_dir, seed, shuffle, factors, weight_validation),
        f"{output_dir}/stats")
    return spark.createDataFrame(rows, report.schema)


def calibration_frame(spark: SparkSession, chat: DataFrame, sample_size: int = DEFAULT_CALIBRATION_SIZE,
                      seed: int = DEFAULT_SEED, balance: bool = True, task_prefix: str = DEFAULT_TASK_PREFIX,
                      dataset_version: str | None = None, key: str = "source_index") -> DataFrame:
    """Sampled chat rows rendered as calibration prompts and records."""
    chat = chat.withColumn("direction", C.infer_direction("messages", F.col("metadata.direction")))
    sample = (E.sample_balanced(chat, key, sample_size, "direction", seed) if balance
              else E.sample_uniform(chat, key, sample_size, seed))
    sample = number_bounded(sample, key, "sample_id")
    pm = C.prompt_messages("messages")
    text = C.render_prompt_only(pm)
    n = token_count(text)
    return sample.select(
        "sample_id", F.col(key).alias("source_index"), "direction", C.format_texts("messages").alias("f"), "metadata",
        F.concat((F.col("sample_id") + 1).cast("string"), F.lit("_prompt_only")).alias("id"), text.alias("text"),
        F.concat(F.lit(task_prefix + "_"), F.replace(F.col("direction"), F.lit("-"), F.lit("_"))).alias("task"),
        F.lit(dataset_version).cast("string").alias("dataset_version"), F.lit(PROMPT_ONLY_MODE).alias("mode"),
        C.length_bucket(n).alias("bucket"), n.alias("token_length"),
        (F.col(key) + 1).cast("bigint").alias("source_line_no"),
        F.lit(None).cast("string").alias("meeting_id"), F.lit(None).cast("string").alias("segment_id"))


def calibration_report(frame: DataFrame) -> DataFrame:
    """Rows written, direction counts and bucket counts as one row (I1, I3) in one pass: grouping
    sets over the sample, then a global fold of the few grouped rows into sorted maps."""
    g = frame.groupingSets([["direction"], ["bucket"]], "direction", "bucket").agg(
        F.grouping("bucket").alias("__by_direction"), F.count(F.lit(1)).alias("n"))
    by_dir = F.col("__by_direction") == 1
    return g.agg(
        F.sum(F.when(by_dir, F.col("n"))).alias("sample_size_written"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(by_dir, F.struct("direction", "n"))))).alias("direction_counts"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(~by_dir, F.struct("bucket", "n"))))).alias("bucket_counts"),
    )


def run_calibrate(spark: SparkSession, input: str, output_dir: str, **kw) -> DataFrame:
    """Calibration sample: prompts JSONL, prompt-only records, two text files and stats."""
    chat = IO.read_chat(spark, input).withColumn("source_index", F.col("line_no") - 1)
    frame = calibration_frame(spark, chat, **kw).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        ordered = frame.orderBy("sample_id")
        W.write_jsonl(ordered.select("sample_id", "source_index", "direction", "f.prompt", "f.full_text",
                                     "f.reference", "metadata"), f"{output_dir}/calibration_prompts")
        W.write_jsonl(ordered.select("id", "text", "task", "dataset_version", "mode", "bucket", "token_length",
                                     "source_line_no", "meeting_id", "segment_id"),
                      f"{output_dir}/calibration_prompt_only", keep_nulls=True)
        W.write_text_lines(ordered, "f.prompt", f"{output_dir}/calibration_prompts_txt")
        W.write_text_lines(ordered, "f.full_text", f"{output_dir}/calibration_full_texts_txt")
        W.write_stats(calibration_report(frame), f"{output_dir}/stats")
        return frame
    finally:
        frame.unpersist()


def prediction_table(scored: DataFrame) -> DataFrame:
    """The 15 columns of the predictions file, in order; cases from a test file have no baseline."""
    absent = [c for c in PREDICTION_COLUMNS if c.startswith("baseline_") and c not in scored.columns]
    return scored.withColumns({c: F.lit("") for c in absent}).select(*PREDICTION_COLUMNS)


def run_evaluate(spark: SparkSession, output_dir: str, predictor_factory, cases_file: str | None = None,
                 test_file: str | None = None, sample_size: int = 500, seed: int = DEFAULT_SEED,
                 direction: str = "both", prompt_template: str = "structured", batch_size: int = 8) -> DataFrame:
    """Cases -> batched predictions -> scores -> predictions CSV and summary JSON."""
    if cases_file:
        cases = IO.read_cases(spark, cases_file, direction, prompt_template)
        order = [F.col("case_index")]
    else:
        rows = IO.read_pairs_csv(spark, test_file).withColumn("row_index", F.col("row_number") - 1)
        V.require_sample_size(rows, sample_size, test_file)
        sampled = E.sample_uniform(rows, "row_index", sample_size, seed)
        cases = X.evaluation_cases(sampled, direction, prompt_template)
        order = [seeded_hash(seed, "row_index"), F.col("row_index"), F.col("direction")]     # as drawn
    V.require_rows(cases, "evaluation examples")
    prompts = cases.withColumn("__prompt", C.render_plain("messages", generation_cue=True))
    predicted = predict_batches(prompts, predictor_factory, text_col="__prompt", batch_size=batch_size).drop("__prompt")
    scored = score_predictions(predicted.withColumn("prompt_template", F.lit(prompt_template)),
                               ["row_index", "direction"]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        W.write_table_csv(prediction_table(scored.orderBy(*order)), f"{output_dir}/predictions")
        summary = R.eval_summary(scored, digits=None)
        rows = [r.asDict() for r in summary.collect()]      # one row, and one per direction
        W.write_document(spark, R.eval_document(rows), f"{output_dir}/summary")
        return spark.createDataFrame(rows, summary.schema)
    finally:
        scored.unpersist()


def run_translate(spark: SparkSession, input: str, output_dir: str, predictor_factory, batch_size: int = 8,
                  result_key: str = "translation") -> DataFrame:
    """Chat prompts -> the same lines with the translation as a key, and a segment table as CSV with a byte-order mark.

    All messages of a row are the prompt.  A ``segment_id`` that is there stays, a null one too.
    """
    chat = IO.read_chat(spark, input, require_messages=True)
    V.require_rows(chat, input)
    prompts = C.render_plain("messages", generation_cue=True)
    predicted = predict_batches(chat.withColumn("__prompt", prompts), predictor_factory, text_col="__prompt",
                                batch_size=batch_size).drop("__prompt").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        ordered = predicted.orderBy("line_no")
        W.write_chat_jsonl(ordered, f"{output_dir}/translations", added={result_key: F.col("prediction")})
        segments = X.segment_columns(predicted)
        table = segments.select("line_no", *SEGMENT_COLUMNS, F.col("prediction").alias(result_key))
        W.write_table_csv(table.orderBy("line_no").drop("line_no"), f"{output_dir}/segments", bom=True)
        return table
    finally:
        predicted.unpersist()


def training_frame(splits: DataFrame, max_train: int | None = None, max_validation: int | None = 512, max_len: int = 512,
                   tokenizer=None, evaluate: bool = True) -> DataFrame:
    """Split rows -> capped, encoded, rows without supervised labels dropped; an empty split is an error.

    ``evaluate=False``: there is no validation split, and none is asked for.
    """
    caps = {"train": max_train} | ({"validation": max_validation} if evaluate else {})
    parts = [V.take_first(splits.where(F.col("split") == name), cap, "line_no", by=None) for name, cap in caps.items()]
    encoded = encode(parts[0].unionByName(parts[1]) if evaluate else parts[0], tokenizer, max_len)
    flagged = encoded.withColumn("supervised", F.col("prompt_len") < F.size("labels"))
    R.truncation_report(flagged.select("split", "supervised"), fail_on_empty=True, splits=tuple(caps))
    return supervised_only(encoded)


def run_training_data(spark: SparkSession, train_file: str, validation_file: str | None, output_dir: str, **kw) -> DataFrame:
    """Training features of a chat split set as Parquet, by split; without a validation file evaluation is off."""
    files = {"train": train_file} | ({"validation": validation_file} if validation_file else {})
    splits = IO.read_splits(spark, files)
    frame = training_frame(splits, evaluate=bool(validation_file), **kw).select("split", "line_no", "input_ids", "attention_mask", "labels")
    frame.write.partitionBy("split").parquet(f"{output_dir}/features")
    return spark.read.schema(frame.schema).parquet(f"{output_dir}/features")


__all__ = ["run_prepare", "run_reweight", "run_calibrate", "calibration_frame", "run_evaluate", "run_translate",
           "training_frame", "run_training_data"]

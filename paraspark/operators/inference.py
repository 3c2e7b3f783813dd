"""Batch inference surface.

Model loading and generation are the user's: a *predictor factory* is called once per task and
returns ``predict(list[str]) -> list[str]``.  Texts reach it through a pandas UDF in batches of
``batch_size``; ``spark.sql.execution.arrow.maxRecordsPerBatch`` bounds what one Arrow batch
holds.  Outputs pass through the stop-marker cleaning.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from paraspark.constants import DEFAULT_BATCH_SIZE, ERROR_VALUE
from paraspark.functions.chat import result_column
from paraspark.functions.text import clean_prediction
from paraspark.session import scratch_dir

Predictor = Callable[[list], list]
PredictorFactory = Callable[[], Predictor]


BUFFER = 64     # batches whose texts are sorted by length together


def _windows(lengths: list[int], batch_size: int, buffer: int) -> Iterator[list[int]]:
    """Places of the texts, batch by batch: sorted by length within every ``buffer`` batches."""
    size = batch_size * max(buffer, 1)
    for lo in range(0, len(lengths), size):
        places = range(lo, min(lo + size, len(lengths)))
        order = sorted(places, key=lengths.__getitem__) if buffer else list(places)
        for start in range(0, len(order), batch_size):
            yield order[start:start + batch_size]


def _predicted(predict: Predictor, texts: list[str], batch_size: int, buffer: int) -> list[str]:
    """The predictions in the order of the texts; the predictor sees texts of like length together."""
    out: list = [None] * len(texts)
    for places in _windows([len(t) for t in texts], batch_size, buffer):
        said = predict([texts[k] for k in places])
        if len(said) != len(places):
            raise ValueError(f"{len(said)} predictions for {len(places)} texts")
        for k, x in zip(places, said):
            out[k] = x
    return out


def predict_batches(df: DataFrame, factory: PredictorFactory, text_col: str = "source_text",
                    batch_size: int = DEFAULT_BATCH_SIZE, out_col: str = "prediction", buffer: int = BUFFER,
                    profile: ResourceProfile | None = None) -> DataFrame:
    """Append ``out_col`` with the cleaned prediction for every row; input columns are kept (G1).

    A model pads a batch to its longest text, so texts are sorted by length within ``buffer`` batches of an Arrow batch
    and the predictions put back in place; ``buffer=0`` keeps the order as read.  Only the text column goes through
    Python, unless a ``profile`` asks for executors of its own (GPUs, memory): that is a property of a whole
    stage, which then carries all columns.
    """
    if profile is not None:
        schema = df.withColumn("__raw_prediction", F.lit("")).schema

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            predict = factory()
            for batch in batches:
                texts = [t or "" for t in batch.column(text_col).to_pylist()]
                yield batch.append_column("__raw_prediction", pa.array(_predicted(predict, texts, batch_size, buffer), pa.string()))
        said = df.mapInArrow(rows, schema, profile=profile)
        return said.withColumn(out_col, clean_prediction(F.col("__raw_prediction"))).drop("__raw_prediction")

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = factory()
        for texts in batches:
            yield pd.Series(_predicted(predict, texts.fillna("").tolist(), batch_size, buffer), dtype="object")

    return df.withColumn(out_col, clean_prediction(run(F.col(text_col))))


def padding_report(df: DataFrame, text_col: str = "source_text", batch_size: int = DEFAULT_BATCH_SIZE, buffer: int = BUFFER) -> DataFrame:
    """One row ``texts, chars, padding_as_read, padding_by_length``: code points that batches padded to their longest text
    add, in the order of the rows and as ``predict_batches`` deals them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()
            added = [sum(len(w) * max(lengths[k] for k in w) for w in _windows(lengths, batch_size, b)) - sum(lengths) for b in (0, buffer)]
            yield pa.RecordBatch.from_pylist([{"texts": len(lengths), "chars": sum(lengths), "padding_as_read": added[0],
                                               "padding_by_length": added[1]}])
    found = df.select(F.col(text_col).alias("text")).mapInArrow(
        run, "texts long, chars long, padding_as_read long, padding_by_length long")
    return found.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in found.columns])


def predict_models(spark: SparkSession, df: DataFrame, factories: dict, key=None, text_col: str = "source_text",
                   batch_size: int = DEFAULT_BATCH_SIZE) -> DataFrame:
    """One ``<label>_translation`` column per model (G2), all models in one pass over the texts.

    A task holds all predictors and hands every batch to each.  One that fails, when it is made or when it predicts, is
    left out from there on and named in the row; a metric of the write brings the names to the driver, and such a
    model's column is the constant ``ERROR`` in every row, with a warning that names the cause.  Any other failure ends the run.
    The rows are written once under the shared folder, input columns kept, and nothing is joined.  ``key`` is not needed.
    """
    columns = {label: result_column(label) for label in factories}
    if len(set(columns.values())) < len(columns):
        raise ValueError(f"two models share a result column: {sorted(columns.values())}")
    failed = {label: f"__failed_{k}" for k, label in enumerate(factories)}
    fields = ", ".join(f"`{columns[x]}` string, `{failed[x]}` string" for x in factories)

    @F.pandas_udf(fields)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predictors, errors = {}, {}

        def attempt(label, work):
            try:
                return work()
            except Exception as e:  # noqa: BLE001 - whatever a user's model raises
                errors[label] = f"{type(e).__name__}: {e}"
                return None

        for label, factory in factories.items():
            predictors[label] = attempt(label, factory)
        for texts in batches:
            given, out = texts.fillna("").tolist(), {}
            for label, predict in predictors.items():
                said = None if label in errors else attempt(label, lambda p=predict: _predicted(p, given, batch_size, BUFFER))
                out[columns[label]] = pd.Series(said or [None] * len(given), dtype="object")
                out[failed[label]] = pd.Series([errors.get(label)] * len(given), dtype="object")
            yield pd.DataFrame(out)

    seen = Observation(f"models-{uuid.uuid4().hex}")
    said = df.withColumn("__said", run(F.col(text_col)))
    rows = said.select(*df.columns, *[clean_prediction(F.col("__said")[c]).alias(c) for c in columns.values()],
                       *[F.col("__said")[c].alias(c) for c in failed.values()])
    path = scratch_dir(spark, "models")
    rows.observe(seen, *[F.max(c).alias(c) for c in failed.values()]).drop(*failed.values()).write.parquet(path)
    out = spark.read.schema(rows.drop(*failed.values()).schema).parquet(path)
    for label, column in columns.items():
        if cause := seen.get[failed[label]]:
            warnings.warn(f"model {label} failed: {cause}", stacklevel=2)
            out = out.withColumn(column, F.lit(ERROR_VALUE))
    return out


# ---- deterministic stand-in predictors (no model runtime here) ----

_ASCII_UPPER = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def upper_ascii_factory() -> Predictor:
    """Stand-in model: ASCII upper-case plus a stop marker and junk the cleaning must cut."""
    def predict(texts):
        return [t.translate(_ASCII_UPPER) + "<|im_end|>junk" for t in texts]
    return predict


def failing_factory() -> Predictor:
    """Stand-in model that cannot load."""
    raise RuntimeError("model failed to load")

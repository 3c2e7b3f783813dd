"""Readers: Parquet test tables, pair files (CSV / JSONL), chat JSONL, case files, split sets.

Line identity is derived once, at ingest, with :func:`with_scan_index`: file order, then position
inside the file, without a sort or a copy of the lines.
"""

from __future__ import annotations

from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paraspark.constants import REQUIRED_PAIR_FIELDS
from paraspark.operators.identity import with_scan_index
from paraspark.sources.csv_split import read_csv_split

PAIR_SCHEMA = T.StructType([T.StructField(f, T.StringType(), True) for f in REQUIRED_PAIR_FIELDS])
MESSAGES_TYPE = T.ArrayType(T.StructType([
    T.StructField("role", T.StringType(), True),
    T.StructField("content", T.StringType(), True),
]))
METADATA_TYPE = T.StructType([
    T.StructField("term", T.StringType(), True),
    T.StructField("target_length", T.StringType(), True),
    T.StructField("style", T.StringType(), True),
    T.StructField("direction", T.StringType(), True),
])
CHAT_SCHEMA = T.StructType([
    T.StructField("messages", MESSAGES_TYPE, True),
    T.StructField("metadata", METADATA_TYPE, True),
    T.StructField("segment_id", T.StringType(), True),
    T.StructField("accent", T.StringType(), True),
    T.StructField("youtube_id", T.StringType(), True),
    T.StructField("start_time", T.StringType(), True),
    T.StructField("duration", T.StringType(), True),
])
CASE_COLUMNS = ("direction", "row_index", "term", "target_length", "style", "source_text",
                "reference_text", "prediction", "baseline_gpt_score", "chrf_like")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver test table (Parquet): pushdown and pruning apply."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread_small(df: DataFrame, *keys: str) -> DataFrame:
    """A scanned table dealt to all cores by ``keys``, if it is too small for its splits to fill them.

    A file with one row group is one task, however many cores there are.  From a split for every core on
    (``spark.sql.files.maxPartitionBytes`` each) the table is left as it is read: nothing large is shuffled.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, *keys) if size < cores * split else df


def read_pairs_csv(spark: SparkSession, path: str, with_row_number: bool = True) -> DataFrame:
    """Pairs from CSV (A1) with a 1-based ``row_number`` in file order; ``__row`` holds the whole row as
    JSON, columns that are no required field included."""
    df = read_csv_split(spark, path, index="__number" if with_row_number else None, start=1)
    columns = [c for c in df.columns if c != "__number"]
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})
    fields = [F.col(f).cast("string") if f in columns else F.lit(None).cast("string").alias(f) for f in REQUIRED_PAIR_FIELDS]
    return df.select(*fields, whole.alias("__row"), *([F.col("__number").alias("row_number")] if with_row_number else []))


def _blank() -> F.Column:
    return F.regexp_replace("value", r"[\s\x1c-\x1f\x85\p{Z}]", "") == ""


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with ``line_no`` (1-based, blank lines counted) and a ``blank`` flag."""
    return with_scan_index(spark.read.text(path), 1, "line_no").withColumn("blank", _blank())


def _falsy(variant, field: str) -> F.Column:
    """Python truthiness of a JSON field: absent, null, '', 0, false, [] and {} are missing."""
    path = f"$.{field}"
    as_text = F.try_variant_get(variant, path, "string")
    kind = F.schema_of_variant(F.try_variant_get(variant, path, "variant"))
    as_num = F.try_variant_get(variant, path, "double")
    is_str = kind == "STRING"
    return (as_text.isNull()
            | (is_str & (as_text == ""))
            | (~is_str & (F.coalesce(as_num == 0, F.lit(False)) | as_text.isin("false", "[]", "{}"))))


def read_pairs_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Pairs from JSONL (A2): blank lines skipped, a malformed line fails the job.

    ``row_number`` counts non-blank lines (1-based).  Each required field is kept as text, numbers as
    written, plus a ``__falsy_<field>`` flag carrying JSON truthiness (0, false, [] count as missing);
    ``__row`` is the line itself.
    """
    lines = with_scan_index(spark.read.text(path), 1, "row_number", keep=~_blank())
    v = F.parse_json(F.col("value"))  # raises on malformed JSON: fail fast
    parsed = lines.select("row_number", F.col("value").alias("__row"), v.alias("__v"))
    cols = [F.when(F.try_variant_get("__v", f"$.{f}", "string").isNotNull(), F.get_json_object("__row", f"$.{f}")).alias(f)
            for f in REQUIRED_PAIR_FIELDS]
    flags = [_falsy(F.col("__v"), f).alias(f"__falsy_{f}") for f in REQUIRED_PAIR_FIELDS]
    return parsed.select(*cols, *flags, "__row", "row_number")


def detect_format(path: str) -> str:
    suffix = PurePath(path.rstrip("/")).suffix.lower()
    if suffix == ".csv":
        return "csv"
    if suffix in {".jsonl", ".json"}:
        return "jsonl"
    raise ValueError(f"neither CSV nor JSON lines by its suffix: {path}")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pick the CSV or JSONL reader by suffix (A3)."""
    return read_pairs_csv(spark, path) if detect_format(path) == "csv" else read_pairs_jsonl(spark, path)


def read_chat(spark: SparkSession, path: str, require_messages: bool = False) -> DataFrame:
    """Chat JSONL (A4): ``line_no`` (1-based, blanks counted), the raw line (unknown keys kept
    for a lossless rewrite) and typed columns."""
    lines = read_lines(spark, path).where(~F.col("blank"))
    parsed = lines.select(
        "line_no", F.col("value").alias("raw"),
        F.from_json("value", CHAT_SCHEMA, {"mode": "FAILFAST"}).alias("__j"),
        F.get_json_object("value", "$.messages").isNotNull().alias("__has_messages"),
    ).select("line_no", "raw", "__j.*", "__has_messages")
    if require_messages:
        from paraspark.operators.validate import require_rows_where
        require_rows_where(parsed, ~F.col("__has_messages"), "line_no", "is missing 'messages'")
    return parsed.drop("__has_messages")


def read_cases(spark: SparkSession, path: str, direction: str = "both", prompt_template: str = "structured") -> DataFrame:
    """Earlier predictions reused as evaluation cases (A5, with C6 and C7).

    ``source_text`` is required; other columns default to ''.  ``prediction`` and ``chrf_like``
    become ``baseline_prediction`` and ``baseline_chrf_like``.  ``row_index`` defaults to the
    0-based record position, counted before the direction filter; ``case_index`` is that position always.
    """
    from paraspark.operators.validate import filter_direction, require_columns
    df = read_csv_split(spark, path, index="__case_index")
    require_columns(df, ["source_text"], what=path)
    has_row_index = "row_index" in df.columns
    for c in CASE_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    # a present column wins even when the cell is empty; only an absent column falls back
    row_index = (F.coalesce(F.col("row_index").cast("string"), F.lit("")) if has_row_index
                 else F.col("__case_index").cast("string"))
    cases = df.select(
        F.col("direction").alias("__raw_direction"),
        F.col("__case_index").alias("case_index"),
        row_index.alias("row_index"),
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("term", "target_length", "style", "source_text", "reference_text")],
        F.coalesce(F.col("prediction"), F.lit("")).alias("baseline_prediction"),
        F.coalesce(F.col("baseline_gpt_score"), F.lit("")).alias("baseline_gpt_score"),
        F.coalesce(F.col("chrf_like"), F.lit("")).alias("baseline_chrf_like"),
    )
    from paraspark.operators.cases import with_case_messages
    return with_case_messages(filter_direction(cases, direction, "__raw_direction"), prompt_template)


def read_splits(spark: SparkSession, paths: dict) -> DataFrame:
    """Several named chat JSONL files as one frame with a ``split`` column."""
    frames = [read_chat(spark, p).withColumn("split", F.lit(name)) for name, p in paths.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out

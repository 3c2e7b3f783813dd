"""Writers (A7-A12).  Output folders hold Spark part files; one folder per logical file."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from paraspark.functions.text import flatten_text


def write_jsonl(df: DataFrame, path: str, keep_nulls: bool = False, mode: str = "errorifexists") -> None:
    """JSON lines; ``keep_nulls`` writes null fields instead of dropping them."""
    (df.write.mode(mode).option("ignoreNullFields", str(not keep_nulls).lower()).json(path))


def write_splits(df: DataFrame, path: str, splits=("train", "validation"), split_col: str = "split",
                 mode: str = "errorifexists") -> None:
    """One JSONL folder per split (A7); a split with no rows still gets a folder (train-all mode writes
    an empty validation set)."""
    for name in splits:
        rows = df.where(F.col(split_col) == name).drop(split_col)
        rows.write.mode(mode).json(f"{path.rstrip('/')}/{split_col}={name}")


def write_quarantine(rejected: DataFrame, path: str, mode: str = "errorifexists", raw_row: str | None = None) -> None:
    """Rejected rows as T3 JSON lines; null fields are written, not dropped.

    ``raw_row`` names a column with the source row as JSON: it becomes ``row`` as it stands, unknown
    keys and JSON types included.
    """
    if raw_row is None:
        return write_jsonl(rejected, path, keep_nulls=True, mode=mode)
    line = quarantine_line([F.col(c) for c in rejected.columns if c != raw_row], raw_row)
    rejected.select(line.alias("value")).write.mode(mode).text(path)


def quarantine_line(columns: list[F.Column], raw_row: str) -> F.Column:
    """A T3 record as JSON, its ``row`` the source row as it stands."""
    record = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return F.concat(F.regexp_replace(record, r"\}$", ""), F.lit(',"row":'), F.col(raw_row), F.lit("}"))


def write_text_lines(df: DataFrame, col: str, path: str, mode: str = "errorifexists") -> None:
    """One whitespace-flattened text per line."""
    df.select(flatten_text(col).alias("value")).write.mode(mode).text(path)


def write_table_csv(df: DataFrame, path: str, mode: str = "errorifexists", bom: bool = False) -> None:
    """Header CSV that Python's csv module and :func:`read_csv_split` read back (A10); ``bom`` starts
    every file with a byte-order mark."""
    if bom and df.columns:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    (df.write.mode(mode).option("header", True).option("escape", '"').option("encoding", "UTF-8")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def with_added_keys(raw: str, **added) -> F.Column:
    """The raw JSON line with extra keys, nulls written; other keys and their order untouched.

    A key that the line has already is set where it stands; such lines are rewritten in Python.
    """
    line = F.col(raw)
    members = F.to_json(F.struct(*[c.alias(k) for k, c in added.items()]), {"ignoreNullFields": "false"})
    inside = F.regexp_replace(members, r"^\{|\}$", "")
    sep = F.when(line.rlike(r"^\s*\{\s*\}\s*$"), F.lit("")).otherwise(F.lit(","))
    appended = F.concat(F.regexp_replace(line, r"\}\s*$", ""), sep, inside, F.lit("}"))
    clash = F.arrays_overlap(F.json_object_keys(line), F.array(*map(F.lit, added)))
    return F.when(clash, _merged(F.when(clash, line), members)).otherwise(appended)


@F.pandas_udf(StringType())
def _merged(lines: pd.Series, members: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else json.dumps(json.loads(x) | json.loads(m), ensure_ascii=False)
                      for x, m in zip(lines, members, strict=True)], dtype="object")


def write_chat_jsonl(df: DataFrame, path: str, raw: str = "raw", added: dict | None = None,
                     mode: str = "errorifexists") -> None:
    """Rewrite chat rows from their raw lines, unknown keys kept, internal numbering gone."""
    line = with_added_keys(raw, **added) if added else F.col(raw)
    df.select(line.alias("value")).write.mode(mode).text(path)


def write_stats(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A one-row report as JSON with nulls kept."""
    write_jsonl(df.coalesce(1), path, keep_nulls=True, mode=mode)


def write_document(spark: SparkSession, document: dict, path: str, mode: str = "errorifexists") -> DataFrame:
    """A report document as one line of JSON (A12), and the frame that reads it back."""
    line = spark.createDataFrame([(json.dumps(document, ensure_ascii=False),)], "value string")
    line.coalesce(1).write.mode(mode).text(path)
    return spark.read.json(path)

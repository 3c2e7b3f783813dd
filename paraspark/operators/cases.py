"""Directed examples: one pair row becomes one or two directed rows (D1, D2, evaluation cases).

Expansion is a ``Generate`` over a two-element literal array: no shuffle, one scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraspark.constants import DIRECTIONS
from paraspark.functions.chat import (
    chat_example, prompt_simple, prompt_structured_messages, source_text, source_text_for, target_text_for,
)


def directions_for(bidirectional_or_direction) -> list:
    if bidirectional_or_direction is True or bidirectional_or_direction == "both":
        return list(DIRECTIONS)
    if bidirectional_or_direction is False or bidirectional_or_direction is None:
        return ["en-es"]
    if bidirectional_or_direction not in DIRECTIONS:
        raise ValueError(f"no such direction: {bidirectional_or_direction!r}")
    return [bidirectional_or_direction]


def expand_directions(df: DataFrame, directions="both", name: str = "direction") -> DataFrame:
    """One row per requested direction, ``en-es`` first."""
    dirs = directions_for(directions)
    if len(dirs) == 1:
        return df.withColumn(name, F.lit(dirs[0]))
    return df.withColumn(name, F.explode(F.array(*[F.lit(d) for d in dirs])))


def chat_examples(df: DataFrame, bidirectional: bool = False) -> DataFrame:
    """Pairs to directed chat examples ``messages, metadata`` (D1 after D2)."""
    return (expand_directions(df, bidirectional)
            .withColumn("__ex", chat_example("direction"))
            .withColumn("messages", F.col("__ex.messages"))
            .withColumn("metadata", F.col("__ex.metadata"))
            .drop("__ex"))


def flatten_chat(df: DataFrame) -> DataFrame:
    """Chat example columns as flat strings (for comparison and CSV output)."""
    return (df.withColumn("system_content", F.col("messages")[0]["content"])
              .withColumn("user_content", F.col("messages")[1]["content"])
              .withColumn("assistant_content", F.col("messages")[2]["content"]))


def evaluation_cases(df: DataFrame, direction: str = "both", prompt_template: str = "structured") -> DataFrame:
    """Sampled test rows to directed evaluation cases."""
    expanded = expand_directions(df, direction)
    return with_case_messages(expanded.select(
        "direction", F.col("row_index"), "term", "target_length", "style",
        source_text_for("direction", "english_scenario", "spanish_translation").alias("source_text"),
        target_text_for("direction", "english_scenario", "spanish_translation").alias("reference_text"),
    ), prompt_template)


def with_case_messages(df: DataFrame, prompt_template: str = "structured") -> DataFrame:
    """Attach the prompt messages of the chosen template."""
    if prompt_template == "simple":
        msgs = prompt_simple("direction", "source_text")
    elif prompt_template == "structured":
        msgs = prompt_structured_messages("direction", "style", "target_length", "source_text")
    else:
        raise ValueError(f"Unknown prompt template: {prompt_template}")
    return df.withColumn("messages", msgs)


def segment_columns(chat: DataFrame) -> DataFrame:
    """Segment table of chat rows (D16): the optional columns or '', ``segment_id`` falling back to the
    line number, the source text, and whatever else ``chat`` holds but its messages and raw line.

    With the raw line at hand, a ``segment_id`` that is there but null stays null.
    """
    names = ("segment_id", "accent", "youtube_id", "start_time", "duration")
    there = {c: F.col(c) if c in chat.columns else F.lit(None).cast("string") for c in names}
    other = [c for c in chat.columns if c not in (*names, "messages", "metadata", "raw")]
    segment = F.coalesce(there["segment_id"], F.col("line_no").cast("string"))
    if "raw" in chat.columns:
        segment = F.when(F.array_contains(F.json_object_keys("raw"), "segment_id"), there["segment_id"]).otherwise(segment)
    return chat.select(
        segment.alias("segment_id"),
        *[F.coalesce(there[c], F.lit("")).alias(c) for c in names[1:]], source_text("messages").alias("source_text"), *other)

"""Fixture views built from the driver's test tables.

The test tables hold no translation pairs, so every query starts from one of these views.  They
read whole tables and whole texts; variants (missing fields, prediction kinds, run gaps) come
from the data itself (labels, roles, neighbouring rows) or from a per-row case assignment, never
from a filter that shrinks the input.  Each view has a DuckDB twin in
:mod:`paraspark.plans.oracle` so both engines start from identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paraspark.sources.readers import read_table, spread_small


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def _next_text(docs: DataFrame) -> DataFrame:
    """The following document's text keyed by this document's id (neighbour pairing)."""
    return docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next_text"))


def fx_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One translation pair per document: the document and its successor as the two sides.

    ``style`` comes from the quality label ('' when unlabeled -> invalid), the Spanish side is
    missing for documents labelled toxic and for the last document.
    """
    docs = _docs(spark, sf_dir).select("doc_id", "source", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    joined = spread_small(docs, "doc_id").join(_next_text(docs), "doc_id", "left").join(labels, "doc_id", "left")
    n_words = F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit(""))) + 1
    return joined.select(
        F.col("doc_id").alias("pair_id"),
        F.col("source").alias("term"),
        n_words.cast("string").alias("target_length"),
        F.when(F.col("quality") == 1, "formal").when(F.col("quality") == 0, "brief").otherwise("").alias("style"),
        F.col("text").alias("english_scenario"),
        F.when(F.col("toxic") == 1, F.lit(None).cast("string")).otherwise(F.col("next_text")).alias("spanish_translation"),
    )


def fx_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns with direction metadata on two thirds of the conversations and
    direction markers in the user turns of the rest."""
    conv = read_table(spark, sf_dir, "conversations")
    is_user = F.col("role") == "user"
    variant9 = F.col("conv_id") % 9
    variant3 = F.col("conv_id") % 3
    content = (F.when(is_user & (variant9 == 2), F.concat(F.lit("Spanish: "), F.col("text")))
                .when(is_user & (variant9 == 5), F.concat(F.lit("Direction: x\nEnglish: "), F.col("text")))
                .otherwise(F.col("text")))
    direction = F.when(variant3 == 0, "en-es").when(variant3 == 1, "es-en")
    return conv.select("conv_id", "turn", "role", content.alias("content"), direction.alias("direction"))


def fx_chat(spark: SparkSession, sf_dir: str, segments: bool = False) -> DataFrame:
    """One chat record per conversation: ordered messages plus metadata; ``segments`` adds segment
    columns, present in some rows only."""
    turns = fx_turns(spark, sf_dir)
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "content")))
    return turns.groupBy("conv_id").agg(
        F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"),
        F.struct(F.max("direction").alias("direction")).alias("metadata"),
        *([F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("seg-"), F.col("conv_id"))).alias("segment_id"),
           F.when(F.col("conv_id") % 3 == 0, F.lit("north")).alias("accent")] if segments else []),
    )


def fx_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation cases over whole documents: normalisation-equal, words changed to one outside the
    basic plane, the next text with a stop marker and tail, and vowels changed with edge spaces;
    every fortieth prediction is empty, every tenth case has no reference."""
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    joined = spread_small(docs, "doc_id").join(_next_text(docs), "doc_id", "left")
    v4 = F.col("doc_id") % 4
    raw = (F.when(v4 == 0, F.concat(F.lit("  "), F.lower("text"), F.lit(" ")))
            .when(v4 == 1, F.replace("text", F.lit(" the "), F.lit(" \U0001F600 ")))
            .when(v4 == 2, F.concat(F.coalesce("next_text", F.lit("")), F.lit("<|im_end|>tail")))
            .when(F.col("doc_id") % 40 == 3, F.lit(""))
            .otherwise(F.concat(F.lit(" "), F.replace("text", F.lit("e"), F.lit("a")), F.lit("\t "))))
    return joined.select(
        F.col("doc_id").alias("row_index"),
        F.when(F.col("doc_id") % 2 == 0, "en-es").otherwise("es-en").alias("direction"),
        F.when(F.col("doc_id") % 10 == 9, F.lit("")).otherwise(F.col("text")).alias("reference_text"),
        raw.alias("raw_prediction"),
    )


def fx_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two evaluation runs over every conversation turn in both directions."""
    conv = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    nxt = conv.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    base = spread_small(conv, "conv_id", "turn").join(nxt, ["conv_id", "turn"], "left")
    fan = (base
           .withColumn("run", F.explode(F.array(F.lit(0), F.lit(1))))
           .withColumn("dk", F.explode(F.array(
               F.struct(F.lit("en-es").alias("direction"), F.lit(0).alias("k")),
               F.struct(F.lit("es-en").alias("direction"), F.lit(1).alias("k"))))))
    v = (F.col("conv_id") + F.col("turn") + F.col("run") + F.col("dk.k")) % 3
    raw = (F.when(v == 0, F.col("text"))
            .when(v == 1, F.replace("text", F.lit("o"), F.lit("u")))
            .otherwise(F.coalesce("next_text", F.lit(""))))
    return fan.select(
        "run", "conv_id", "turn", F.col("dk.direction").alias("direction"),
        F.col("text").alias("reference_text"), raw.alias("raw_prediction"),
    )


FIXTURES = {
    "fx_pairs": fx_pairs,
    "fx_turns": fx_turns,
    "fx_chat": fx_chat,
    "fx_cases": fx_cases,
    "fx_runs": fx_runs,
}

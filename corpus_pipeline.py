"""Corpus pipeline: documents -> quality rules -> exact dedup -> near dedup -> mix -> token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; ``run`` writes
every stage's result as Parquet under the shared folder and reads it back as the next one's docs.
Rows are told apart by a hash of all their columns, so ids may repeat or be null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paraspark.llm.common import sized_broadcast, small_batches, stored, table
from paraspark.llm.exact_dedup import exact_dedup
from paraspark.llm.mixing import mix_sources
from paraspark.llm.ngram_join import ngram_join
from paraspark.llm.quality import quality_rules
from paraspark.llm.sentencepiece_fst import encode_texts

BROADCAST_ROWS = 1_000_000      # of a few numbers each; beyond that the join is shuffled
ORACLE_SQL = None               # the tokeniser is not SQL; tests/llm holds a brute-force version


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a hash of their columns and of which are null, under a name that no column has."""
    name = "row_hash"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, F.xxhash64(*docs.columns, *(F.col(c).isNull() for c in docs.columns))), name


def _without(docs: DataFrame, dropped: DataFrame, keys: list[str]) -> DataFrame:
    dropped = stored(dropped.select(*keys).distinct(), "dropped")
    return docs.join(sized_broadcast(dropped, dropped.count(), BROADCAST_ROWS), keys, "left_anti")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; equal rows share their verdict."""
    rows, row = _numbered(docs)
    verdicts = quality_rules(rows, id_col=row)
    return _without(rows, verdicts.where(~F.col("kept")), [row]).select(*docs.columns)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id; of rows equal in id and text, one."""
    # a row is known by its id and text; null ids are told apart by the flag
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").isNull().alias("none"),
                       F.coalesce("doc_id", F.lit(0)).alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    keys = ["none", "id", "sha"]
    found = stored(exact_dedup(docs).select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"),
                                            F.col("text_sha256").alias("sha"), "kept"), "copies")
    kept = _without(rows, found.where(~F.col("kept")), keys)
    again = stored(found.where("kept").groupBy(*keys).count().where("count > 1").select(*keys), "again")
    if not again.isEmpty():
        repeated = kept.join(again, keys, "left_semi").dropDuplicates(keys)
        kept = kept.join(again, keys, "left_anti").unionByName(repeated)
    return kept.select("row.*")


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that are linked, directly or over others, the one with the smallest id; null ids last."""
    rows, row = _numbered(docs)
    groups = ngram_join(rows, id_col=row).select(F.col(row), F.col("component_id").alias("group"))
    groups = stored(groups.join(rows.select(row, "doc_id").distinct(), row), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("first"))
    first = stored(groups.groupBy("group").agg(F.min(order).alias("m")).select("group", "m.first"), "first")
    return _without(rows, groups.join(first, "group").where(F.col(row) != F.col("first")), [row]).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; documents it does not take go."""
    rows, row = _numbered(docs)
    # rows are told apart by nulls as well, but the draws are of the columns' hash alone
    drawn = f"draw_{row}"
    while drawn in docs.columns:
        drawn += "_"
    taken = mix_sources(rows.withColumn(drawn, F.xxhash64(*docs.columns)), id_col=row, draw_col=drawn).where("taken > 0")
    times = stored(taken.select(F.col(row), (F.col("taken") / F.col("size")).cast("int").alias("times")).distinct(), "times")
    name = "times"
    while name in docs.columns:
        name += "_"
    mixed = rows.join(sized_broadcast(times.withColumnRenamed("times", name), times.count(), BROADCAST_ROWS), row)
    return mixed.withColumn(name, F.explode(F.sequence(F.lit(1), F.col(name)))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mix; the texts go to Python in small batches, as the caller writes them."""
    small_batches(spark)
    return encode_texts(docs)


STAGES = [("quality_rules", keep_quality), ("exact_dedup", keep_one_copy), ("ngram_join", keep_one_near_copy),
          ("mixing", mix), ("sentencepiece", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

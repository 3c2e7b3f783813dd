"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key ``-ln(u) / quality``; ``u`` is a hash of its id, so reruns
agree.  A source first takes its complete epochs, then documents in key order until a prefix sum of
their sizes meets what is left of the source's target.  The prefix sums run over (source, key
range) cells: a cell's own rows are summed by a window, and the cells' totals by a second one, so
a source with a third of all rows is spread over ``CELLS`` tasks and no group meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paraspark.llm.common import WORD, stored, table, text_or_empty

WEIGHTS = (5, 2, 1)     # of the sources in code-point order, repeating
SHARE = 1.5             # of all words that the mix takes
MOST = 2                # times its words that a source gives at most
CELLS = 1024            # key ranges of a source
SEED = "mix-1"
NOISE = "0123456789#*$%&|<>{}[]!?=_~^@"   # characters that lower a document's quality weight


def quality(text: Column) -> Column:
    """Quality weight in [0.1, 1]: one tenth plus nine tenths of the share of characters that are no noise."""
    clean = F.length(F.translate(text, NOISE, ""))
    return F.when(F.length(text) == 0, F.lit(1.0)).otherwise((1 + 9 * clean / F.length(text)) / 10)


def draw(key: Column, seed: str = SEED) -> Column:
    """Uniform in (0, 1]: 52 bits of md5 of ``seed:key``."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10)
    return (bits.cast("long") + 1) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from per-source sizes.

    Weights follow the sources in code-point order, null last.  A target above ``most`` times its
    source stops there and the excess is shared out anew by weight: ordered by capacity per weight,
    the water level is the largest of the levels that the remaining sources would reach.
    One row per source goes through these windows.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("most", most * F.col("source_size"))
    by_room = W.orderBy(F.col("most") / F.col("w"), F.col("source").isNull(), "source")
    before = by_room.rowsBetween(W.unboundedPreceding, -1)
    after = by_room.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = ((F.sum("source_size").over(everything) * F.lit(share)
              - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("w").over(after))
    rows = rows.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return rows.select("source", "source_size",
                       F.least(F.col("most").cast("double"), F.col("level") * F.col("w")).alias("target"))


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED,
                cells: int = CELLS, draw_col: str | None = None) -> DataFrame:
    """One row per input row: ``id, source, size, source_size, target, taken``.

    ``size`` counts the words of the whole text, null counting none.  ``taken`` is ``size`` times the
    source's complete epochs, once more for documents whose middle lies before the end of what
    remains of the target, so a source misses its target by half a document at most.  Null sources
    are one source, the last.  Equal keys (repeated rows) are ordered by id and size.  Documents
    without words take nothing; an empty table gives no rows; other input columns are ignored.
    ``draw_col`` names what the draws are of, if that is not the id.
    """
    text = text_or_empty(text_col)
    drawn = df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                      F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
                      (-F.log(draw(F.col(draw_col or id_col), seed)) / quality(text)).alias("key"))
    cell = F.floor(cells * (1 - F.exp(-F.col("key")))).cast("int")
    drawn = stored(drawn.withColumn("cell", cell), "mix")
    budgets = targets(drawn.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    in_cells = drawn.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    ahead = F.sum("cell_size").over(W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, -1))
    # the join is on columns that are never null, so that the one null source joins as well
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    cells_ahead = in_cells.select(name.alias("name"), "cell", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    cells_ahead = cells_ahead.join(budgets.select(name.alias("name"), "source_size", "target",
                                                  epochs.cast("long").alias("epochs")), "name")
    own = F.sum("size").over(W.partitionBy("name", "cell").orderBy("key", "id", "size")
                             .rowsBetween(W.unboundedPreceding, -1))
    placed = (drawn.withColumn("name", name).join(cells_ahead, ["name", "cell"])
              .withColumn("start", F.col("ahead") + F.coalesce(own, F.lit(0))))
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    once_more = (F.col("start") + F.col("size") / 2 <= rest).cast("long")
    return placed.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
                         (F.col("size") * (F.col("epochs") + once_more)).alias("taken"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("source")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
 s AS (
  SELECT doc_id, source, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         -ln((('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 1) / 4503599627370496.0::DOUBLE)
         / CASE WHEN t = '' THEN 1.0::DOUBLE
                ELSE (1 + 9 * length(translate(t, '0123456789#*$%&|<>{}[]!?=_~^@', ''))::DOUBLE / length(t)) / 10 END AS key
  FROM d),
 g AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
  FROM s GROUP BY source),
 l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM g),
 b AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, (max(level) OVER ()) * w) AS target FROM l),
 p AS (
  SELECT s.*, source_size, target,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM s JOIN b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN start + size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""

"""Aggregate reports.

Each report is one aggregation pass; grouped counts are tiny (one row per direction, bucket or
split) so the ratio windows run over a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paraspark.constants import NO_METRICS_NOTE


def direction_counts(df: DataFrame, by: str = "direction") -> DataFrame:
    """Rows per direction, sorted by name."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(by)


def direction_ratio(counts: DataFrame, by: str = "direction", count_col: str = "n",
                    partition: list | None = None) -> DataFrame:
    """Share of each direction, 4 decimals; an empty input gives no rows."""
    w = Window.partitionBy(*(partition or [F.lit(0)]))
    return counts.withColumn("ratio", F.round(F.col(count_col) / F.sum(count_col).over(w), 4))


def bucket_counts(df: DataFrame, by: str = "bucket") -> DataFrame:
    """Rows per length bucket."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(by)


def eval_summary(scored: DataFrame, ref: str = "reference_text", digits: int | None = 6) -> DataFrame:
    """Evaluation summary overall and per direction in one pass (I4).

    ``GROUPING SETS ((), (direction))``: the overall row has ``level = 'overall'`` and a null
    direction.  Means cover scored rows only (avg skips nulls); with nothing scored they are null
    and the overall row carries the note instead.
    """
    is_scored = F.col(ref).isNotNull() & (F.col(ref) != "")

    def mean(c):
        m = F.avg(c)
        return F.round(m, digits) if digits is not None else m

    agg = scored.groupingSets([[], ["direction"]], "direction").agg(
        F.grouping("direction").alias("__g"),
        F.count(F.lit(1)).alias("num_examples"),
        F.count_if(is_scored).alias("num_scored_examples"),
        mean("exact_match").alias("exact_match"),
        mean("token_f1").alias("token_f1"),
        mean("chrf_like").alias("chrf_like"),
    )
    return agg.select(
        F.when(F.col("__g") == 1, F.lit("overall")).otherwise(F.lit("direction")).alias("level"),
        "direction", "num_examples", "num_scored_examples", "exact_match", "token_f1", "chrf_like",
        F.when((F.col("__g") == 1) & (F.col("num_scored_examples") == 0), F.lit(NO_METRICS_NOTE)).alias("metrics_note"),
    )


def prepare_metrics(bidirectional: bool = False, valid_col: str = "valid", split_col: str = "split") -> list[Column]:
    """Row accounting of a prepare run as aggregates: of a frame, or observed while its rows pass to a sink."""
    per_row = 2 if bidirectional else 1
    valid = F.col(valid_col)
    return [F.count(F.lit(1)).alias("source_rows"), F.count_if(~valid).alias("skipped"),
            (F.count_if(valid & (F.col(split_col) == "train")) * per_row).alias("train"),
            (F.count_if(valid & (F.col(split_col) == "validation")) * per_row).alias("validation")]


def prepare_stats(df: DataFrame, bidirectional: bool = False, valid_col: str = "valid",
                  split_col: str = "split") -> DataFrame:
    """Row accounting of a prepare run in one conditional aggregate."""
    counts = df.agg(*prepare_metrics(bidirectional, valid_col, split_col))
    return counts.withColumn("total", F.col("train") + F.col("validation"))


def prepare_document(counts: dict, sources: list[str], output_dir: str, **options) -> dict:
    """The report of a prepare run (A12): sources, outputs, counts and options."""
    skipped = f"{output_dir}/skipped_rows" if options["skip_invalid"] else None
    return {"sources": sources, "train_path": f"{output_dir}/examples/split=train",
            "validation_path": f"{output_dir}/examples/split=validation", "total": counts["train"] + counts["validation"],
            **{k: counts[k] for k in ("source_rows", "train", "validation", "skipped")}, **options, "skipped_rows_path": skipped}


def reweight_document(rows: list[dict], sources: dict, output_dir: str, seed: int, shuffled: bool, factors: dict,
                      weight_validation: bool) -> dict:
    """The report of a re-weighting run (A12): options, and for each split totals, counts and shares by direction."""
    def split(name: str) -> dict:
        mine = sorted((r for r in rows if r["split"] == name), key=lambda r: r["direction"])
        out: dict = {}
        for side in ("input", "output"):
            kept = [r for r in mine if r[f"{side}_count"]]
            out[f"{side}_total"] = sum(r[f"{side}_count"] for r in kept)
            out[f"{side}_direction_counts"] = {r["direction"]: r[f"{side}_count"] for r in kept}
            out[f"{side}_direction_ratio"] = {r["direction"]: r[f"{side}_ratio"] for r in kept}
        return out

    return {"sources": sources, "outputs": {s: f"{output_dir}/{s}" for s in ("train", "validation")}, "seed": seed,
            "shuffled": shuffled, "repeats": factors, "weight_validation": weight_validation,
            "train": split("train"), "validation": split("validation")}


def eval_document(rows: list[dict]) -> dict:
    """The summary of an evaluation run (A12): counts and means over all rows, then for each direction."""
    def part(row: dict) -> dict:
        counts = {k: row[k] for k in ("num_examples", "num_scored_examples")}
        return counts | ({k: row[k] for k in ("exact_match", "token_f1", "chrf_like")} if row["num_scored_examples"] else {})

    (whole,) = [r for r in rows if r["level"] == "overall"]
    note = {"metrics_note": whole["metrics_note"]} if whole["metrics_note"] else {}
    return part(whole) | note | {r["direction"]: part(r) for r in sorted(
        (r for r in rows if r["level"] == "direction"), key=lambda r: r["direction"])}


def reweight_report(df: DataFrame, factors: dict, by: str = "direction", split_col: str = "split",
                    weighted_splits=("train",)) -> DataFrame:
    """Before/after counts and ratios per split and direction without expanding rows.

    The output count of a group is ``count x factor`` for weighted splits, ``count`` otherwise.
    """
    factor = F.lit(1)
    expr = None
    for d, f in factors.items():
        expr = F.when(F.col(by) == d, F.lit(int(f))) if expr is None else expr.when(F.col(by) == d, F.lit(int(f)))
    if expr is not None:
        factor = expr.otherwise(F.lit(1))
    weighted = F.col(split_col).isin(list(weighted_splits))
    grouped = df.groupBy(split_col, by).agg(
        F.count(F.lit(1)).alias("input_count"),
        F.sum(F.when(weighted, factor).otherwise(F.lit(1))).alias("output_count"),
    )
    w = Window.partitionBy(split_col)
    return (grouped
            .withColumn("input_total", F.sum("input_count").over(w))
            .withColumn("output_total", F.sum("output_count").over(w))
            .withColumn("input_ratio", F.round(F.col("input_count") / F.col("input_total"), 4))
            .withColumn("output_ratio", F.when(F.col("output_total") > 0,
                                               F.round(F.col("output_count") / F.col("output_total"), 4))))


def truncation_report(df: DataFrame, split_col: str = "split", supervised_col: str = "supervised",
                      fail_on_empty: bool = False, splits=("train", "validation")) -> DataFrame:
    """Rows per split before and after dropping rows without supervised labels.

    ``fail_on_empty`` raises for every split of ``splits`` that keeps no row, also one without any.
    """
    rep = df.groupBy(split_col).agg(
        F.count(F.lit(1)).alias("before"),
        F.count_if(F.col(supervised_col)).alias("after"),
    ).withColumn("removed", F.col("before") - F.col("after"))
    if fail_on_empty:
        kept = {r[0] for r in rep.where(F.col("after") > 0).select(split_col).collect()}
        if empty := [s for s in splits if s not in kept]:
            raise ValueError(f"no supervised labels left in: {', '.join(empty)}")
    return rep

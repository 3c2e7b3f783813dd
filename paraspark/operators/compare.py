"""Comparing evaluation runs.

Equi-joins on the case key ``(row_index, direction)`` - ``row_index`` alone repeats when both
directions are evaluated.  No broadcast hint: AQE converts a join to a broadcast only after it
has measured the smaller side at runtime, and keeps the sort-merge join otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ("exact_match", "token_f1", "chrf_like")


def _keys(key):
    return [key] if isinstance(key, str) else list(key)


def compare_runs(a: DataFrame, b: DataFrame, key, metrics=METRICS) -> DataFrame:
    """Cases present in both runs with each metric side by side and its delta."""
    keys = _keys(key)
    left = a.select(*keys, *[F.col(m).alias(f"{m}_a") for m in metrics])
    right = b.select(*keys, *[F.col(m).alias(f"{m}_b") for m in metrics])
    out = left.join(right, keys, "inner")
    for m in metrics:
        out = out.withColumn(f"{m}_delta", F.col(f"{m}_b") - F.col(f"{m}_a"))
    return out


def regression_gate(a: DataFrame, b: DataFrame, key, metric: str = "chrf_like", tol: float = 0.01,
                    improve: str = "en-es", guard: str = "es-en", digits: int = 6) -> DataFrame:
    """Accept run ``b`` only if ``improve`` gains and ``guard`` falls by at most ``tol``.

    Means and ``n_cases`` are over the cases scored in both runs; the verdict, one row, is decided on
    unrounded means, only the shown deltas are rounded.
    """
    joined = compare_runs(a, b, key, metrics=(metric,)).where(
        F.col(f"{metric}_a").isNotNull() & F.col(f"{metric}_b").isNotNull())
    per_dir = joined.groupBy("direction").agg(
        F.avg(f"{metric}_a").alias("mean_a"), F.avg(f"{metric}_b").alias("mean_b"), F.count(F.lit(1)).alias("n_cases"))
    delta = F.col("mean_b") - F.col("mean_a")
    return per_dir.agg(
        F.max(F.when(F.col("direction") == improve, delta)).alias("up"),
        F.max(F.when(F.col("direction") == guard, delta)).alias("down"),
        F.coalesce(F.sum("n_cases"), F.lit(0)).alias("n_cases"),
    ).select(
        F.round("up", digits).alias("improve_delta"), F.round("down", digits).alias("guard_delta"), "n_cases",
        F.coalesce((F.col("up") > 0) & (F.col("down") >= -F.lit(tol)), F.lit(False)).alias("accepted"))


def same_cases(df: DataFrame, cases: DataFrame, key, index: str | None = None) -> DataFrame:
    """Restrict a run to the cases of an earlier run (J3): left semi join.

    ``index`` names the cases' position (``case_index`` of ``read_cases``): the rows then carry it and come in its
    order, a key that the cases repeat at its first place.  Rows of ``df`` keep their number either way.
    """
    keys = _keys(key)
    if index is None:
        return df.join(cases.select(*keys), keys, "left_semi")
    places = cases.groupBy(*keys).agg(F.min(index).alias(index))
    return df.drop(index).join(places, keys).orderBy(index, *keys)


def carry_baseline(df: DataFrame, baseline: DataFrame, key,
                   columns=(("prediction", "baseline_prediction"), ("chrf_like", "baseline_chrf_like"))) -> DataFrame:
    """Earlier prediction and score next to the new ones, '' when absent (J4): left join."""
    keys = _keys(key)
    right = baseline.select(*keys, *[F.col(src).cast("string").alias(dst) for src, dst in columns])
    out = df.join(right, keys, "left")
    for _, dst in columns:
        out = out.withColumn(dst, F.coalesce(F.col(dst), F.lit("")))
    return out


def remaining(df: DataFrame, chosen: DataFrame, key) -> DataFrame:
    """Rows not chosen yet (J5): left anti join."""
    keys = _keys(key)
    return df.join(chosen.select(*keys), keys, "left_anti")

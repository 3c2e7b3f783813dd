"""Text metrics (H1-H6).

Exact match is a projection.  Token F1 and the character n-gram F-score need multiset
intersections of one case's two texts, which sit in the same row: an Arrow function counts those of a whole
batch by sorting its grams once an order (:mod:`paraspark.functions.bags`), so scoring is a projection too, without a
shuffle or a join back.  Characters are code points throughout.  Per-order F-scores are averaged with the same
operation order as the definition; queries round to 6 decimals.

``bag_items`` gives the bags themselves, a row per occurrence; ``bag_counts`` their sizes without these rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paraspark.constants import CHRF_BETA, CHRF_MAX_ORDER
from paraspark.functions import bags
from paraspark.functions.text import normalize_text

BROADCAST_KEYS = 100_000      # keys of several rows
_NP, _NR, _SCORES = "__np", "__nr", "__scores"


def exact_match(pred, ref) -> Column:
    """1/0 equality of the normalised texts; null when the reference is empty (H1)."""
    p = F.col(pred) if isinstance(pred, str) else pred
    r = F.col(ref) if isinstance(ref, str) else ref
    return F.when(r != "", (normalize_text(p) == normalize_text(r)).cast("int"))


def bag_items(cases: DataFrame, key_cols: list, max_order: int = CHRF_MAX_ORDER,
              tokens: bool = True, chars: bool = True) -> DataFrame:
    """One row per (key, order, item, side) occurrence (H3); ``cases`` carries ``__np``/``__nr``/``__scored``.

    Order 0 are whitespace tokens; a text shorter than an order is itself that order's one gram.
    """
    scored = F.col("__scored")
    sides = cases.select(*key_cols, F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.when(scored, F.col(_NP)).otherwise(F.lit("")).alias("t")),
        F.struct(F.lit(1).alias("side"), F.when(scored, F.col(_NR)).otherwise(F.lit("")).alias("t")),
    )).alias("s")).select(*key_cols, F.col("s.side").alias("side"), F.col("s.t").alias("t"))
    sides = sides.where(F.col("t") != "")
    # One linear regex pass per text yields, at every position, the window of the next
    # ``max_order`` characters (shorter near the end); the n-gram starting there is the window's
    # n-character prefix.  (A positional substring would rescan the UTF-8 text from its start
    # for every gram.)  A text shorter than n contributes itself once, at position 1.
    t = F.col("t")
    parts = []
    if tokens:
        parts.append(sides.select(*key_cols, "side", F.lit(0).alias("ord"), F.explode(F.split(t, " ")).alias("item")))
    if chars:
        # each match consumes one code point, so none starts inside a surrogate pair
        windows = F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{1,{max_order}}}))."), F.lit(1))
        pos = sides.select(*key_cols, "side", F.length(t).alias("len"), F.posexplode(windows).alias("i", "w"))
        grams = pos.select(*key_cols, "side", "len", "i", "w", F.inline(F.array(*[
            F.struct(F.lit(n).alias("ord"), F.left(F.col("w"), F.lit(n)).alias("item")) for n in range(1, max_order + 1)])))
        keep = (F.length("w") >= F.col("ord")) | ((F.col("i") == 0) & (F.col("len") < F.col("ord")))
        parts.append(grams.where(keep).select(*key_cols, "side", "ord", "item"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bag_counts(cases: DataFrame, key_cols: list, max_order: int = CHRF_MAX_ORDER) -> DataFrame:
    """``side, ord, n_grams, n_distinct`` per key (H3): the size of every bag of characters, and its different grams.

    A key's one row is counted where it is; building the plan runs a job that looks for keys of several rows,
    whose bags are the union of the rows' (``bag_items``).  A side without text has no row.
    """
    orders = range(1, max_order + 1)

    @F.arrow_udf("array<struct<side:int,ord:int,n_grams:bigint,n_distinct:bigint>>")
    def counts(p: pa.Array, r: pa.Array) -> pa.Array:
        _, sizes, different = bags.counted(p, r, max_order)
        sizes, different = (x[1:].transpose(2, 1, 0) for x in (sizes, different))     # by row, side and order
        there = sizes > 0
        side, order = (np.broadcast_to(x, there.shape)[there] for x in (np.arange(2, dtype=np.int32)[:, None], np.array(orders, np.int32)))
        items = pa.StructArray.from_arrays([pa.array(x) for x in (side, order, sizes[there], different[there])],
                                           ["side", "ord", "n_grams", "n_distinct"])
        offsets = np.concatenate(([0], np.cumsum(there.sum(axis=(1, 2)))))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)

    def text(name: str) -> Column:
        return F.when(F.col("__scored"), F.coalesce(F.col(name), F.lit(""))).otherwise(F.lit(""))

    def rows_of(some: DataFrame) -> DataFrame:
        # not evaluated again for the filter that Spark derives from the explosion
        each = counts.asNondeterministic()(text(_NP), text(_NR))
        return some.select(*key_cols, each.alias("__n")).select(*key_cols, F.inline("__n"))

    again = (cases.groupBy(*[F.col(c).alias(f"__{i}") for i, c in enumerate(key_cols)]).agg(F.count(F.lit(1)).alias("__m"))
             .where("__m > 1").drop("__m"))
    several = again.limit(BROADCAST_KEYS + 1).count()
    if not several:
        return rows_of(cases)
    if several <= BROADCAST_KEYS:
        again = F.broadcast(again)
    same = functools.reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(key_cols)])
    union = bag_items(cases.join(again, same, "left_semi"), key_cols, max_order, tokens=False).groupBy(*key_cols, "side", "ord").agg(
        F.count(F.lit(1)).alias("n_grams"), F.count_distinct("item").alias("n_distinct"))
    return rows_of(cases.join(again, same, "left_anti")).unionByName(union)


def bag_overlap(pred, ref, max_order: int = CHRF_MAX_ORDER, blank: bool = True) -> Column:
    """Multiset intersection sizes of two normalised texts (H5): tokens, then orders 1 to ``max_order``; null where
    either is null or, without ``blank``, where both are empty."""
    @F.arrow_udf("array<bigint>")
    def shared(p: pa.Array, r: pa.Array) -> pa.Array:
        known = pc.and_(pc.is_valid(p), pc.is_valid(r))
        if not blank:
            known = pc.and_(known, pc.fill_null(pc.or_kleene(pc.not_equal(p, ""), pc.not_equal(r, "")), False))
        found, _ = bags.overlaps(pc.fill_null(p, ""), pc.fill_null(r, ""), max_order)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, 1 + max_order), pa.int32()), pa.array(found.T.reshape(-1)))
        return pc.if_else(known, lists, pa.scalar(None, lists.type))
    # not evaluated again for a filter that Spark derives from an explosion
    return shared.asNondeterministic()(pred, ref)


def score_predictions(df: DataFrame, key=None, pred: str = "prediction", ref: str = "reference_text",
                      metrics=("exact_match", "token_f1", "chrf_like"), max_order: int = CHRF_MAX_ORDER,
                      beta: float = CHRF_BETA) -> DataFrame:
    """All metrics, one row per case (H6); metrics are null when the reference is empty.

    ``key`` names the columns that identify a case; scoring needs none of them.
    """
    orders = max_order if "chrf_like" in metrics else 0

    @F.arrow_udf("exact_match int, token_f1 double, chrf_like double")
    def scores(p: pa.Array, r: pa.Array) -> pa.Array:
        found, sizes = bags.overlaps(pc.fill_null(p, ""), pc.fill_null(r, ""), orders)
        by_order = [bags.f_scores(found[k], sizes[k], beta if k else 1.0) for k in range(orders + 1)]
        mean = sum(by_order[1:]) / orders if orders else np.zeros(len(p))
        unscored = pc.is_null(r)
        return pa.StructArray.from_arrays(
            [pc.fill_null(pc.equal(p, r), False).cast(pa.int32()), pa.array(by_order[0]), pa.array(mean)],
            ["exact_match", "token_f1", "chrf_like"], mask=unscored)

    scored = F.col(ref).isNotNull() & (F.col(ref) != "")
    keep = [c for c in df.columns if c not in metrics]
    if tuple(metrics) == ("exact_match",):
        return df.select(*keep, exact_match(F.coalesce(F.col(pred), F.lit("")), ref).alias("exact_match"))
    found = scores(normalize_text(F.coalesce(F.col(pred), F.lit(""))), F.when(scored, normalize_text(ref)))
    return df.withColumn(_SCORES, found).select(*keep, *[F.col(_SCORES)[m].alias(m) for m in metrics])


def token_f1(df: DataFrame, key, pred: str = "prediction", ref: str = "reference_text") -> DataFrame:
    """Token-bag F1 per case (H2)."""
    return score_predictions(df, key, pred, ref, metrics=("token_f1",))


def chrf_like(df: DataFrame, key, pred: str = "prediction", ref: str = "reference_text",
              max_order: int = CHRF_MAX_ORDER, beta: float = CHRF_BETA) -> DataFrame:
    """Mean over orders 1..max_order of the per-order character n-gram F-beta (H4)."""
    return score_predictions(df, key, pred, ref, metrics=("chrf_like",), max_order=max_order, beta=beta)

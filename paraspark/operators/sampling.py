"""Splitting, sampling and re-weighting.

Every draw is ``seeded_hash(seed, key)``: order-free, so results do not depend on partitioning,
retries or executor loss.  Which rows are chosen differs from a sequential generator; the
guarantees (split share, no leak across splits, exact sample sizes, quotas, top-up, factor
multiplicity) are kept exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraspark.constants import DEFAULT_SEED, DEFAULT_VALIDATION_RATIO
from paraspark.functions.hashing import HASH_SPACE, seeded_hash
from paraspark.functions.permutation import permuted
from paraspark.operators.bottomk import balanced_bottom
from paraspark.operators.identity import with_row_index


def _keys(key):
    return [key] if isinstance(key, str) else list(key)


def split_bernoulli(df: DataFrame, key, ratio: float = DEFAULT_VALIDATION_RATIO,
                    seed: int = DEFAULT_SEED, name: str = "split") -> DataFrame:
    """Each source row goes to validation with probability ``ratio``.

    Apply before direction expansion so both directions of a row share a split (no leak).
    """
    draw = seeded_hash(seed, *_keys(key))
    return df.withColumn(name, F.when(draw < F.lit(ratio * HASH_SPACE), F.lit("validation")).otherwise(F.lit("train")))


def split_explicit(train: DataFrame, validation: DataFrame, name: str = "split") -> DataFrame:
    """Two given inputs become the two splits."""
    return train.withColumn(name, F.lit("train")).unionByName(validation.withColumn(name, F.lit("validation")))


def split_train_all(df: DataFrame, name: str = "split") -> DataFrame:
    """Everything goes to train; validation stays empty."""
    return df.withColumn(name, F.lit("train"))


def sample_uniform(df: DataFrame, key, n: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement.

    ``orderBy(..).limit(n)`` plans a TakeOrderedAndProject: each task keeps its own best ``n``
    and only those are merged, so the work is one scan plus ``n`` rows per task.
    """
    keys = _keys(key)
    return (df.withColumn("__h", seeded_hash(seed, *keys))
              .orderBy("__h", *keys).limit(n).drop("__h"))


def sample_balanced(df: DataFrame, key, n: int, by: str = "direction", seed: int = DEFAULT_SEED,
                    top_up: bool = True) -> DataFrame:
    """Balanced sample (E5) with top-up.

    Quota ``n div k`` per group, the remainder to the alphabetically first groups, each capped by
    the group size.  When short groups leave the total below ``min(n, rows)``, the rest is filled
    from the rows not chosen, lowest draw first.

    One scan: every task keeps each group's ``n`` smallest draws and its size, and these summaries are merged.
    """
    keys = _keys(key)
    return balanced_bottom(df, seeded_hash(seed, *keys), keys, by, n, top_up)


def replicate(df: DataFrame, factors: dict, by: str = "direction", copy_col: str = "copy") -> DataFrame:
    """Each row repeated by its group's factor, other groups once, 0 drops the row."""
    for d, f in factors.items():
        if int(f) < 0:
            raise ValueError(f"a repeat count is negative: {d}={f}")
    factor = F.lit(1)
    expr = None
    for d, f in factors.items():
        expr = F.when(F.col(by) == d, F.lit(int(f))) if expr is None else expr.when(F.col(by) == d, F.lit(int(f)))
    factor = expr.otherwise(F.lit(1)) if expr is not None else factor
    return df.select("*", F.posexplode(F.array_repeat(F.lit(0), factor)).alias(copy_col, "__zero")).drop("__zero")


def shuffle(df: DataFrame, key, seed: int = DEFAULT_SEED, copy_col: str = "copy", name: str = "position",
            number: str | None = None, rows: int | None = None) -> DataFrame:
    """Seeded global permutation (E8): every row's dense position as a projection of its dense number.

    ``number`` names a column of dense numbers from 0 and ``rows`` how many there are: then nothing moves.  Without
    them the rows are numbered by key and copy first; rows of one key and copy are permuted as well.
    """
    if number is not None:
        if rows is None:
            raise ValueError("the permutation of given numbers needs the number of rows")
        return df.withColumn(name, permuted(seed, number, F.lit(rows)))
    keys = _keys(key)
    ident = keys + ([copy_col] if copy_col in df.columns else [])
    numbered = with_row_index(df, ident, name="__number", total="__rows")
    return numbered.withColumn(name, permuted(seed, "__number", "__rows")).drop("__number", "__rows")


def reweight(train: DataFrame, validation: DataFrame, key, factors: dict, seed: int = DEFAULT_SEED,
             do_shuffle: bool = True, weight_validation: bool = False) -> DataFrame:
    """Re-weight the train split (and validation only when asked)."""
    def weigh(df):
        out = replicate(df, factors)
        return shuffle(out, key, seed) if do_shuffle else out

    t = weigh(train).withColumn("split", F.lit("train"))
    if weight_validation:
        v = weigh(validation)
    else:
        v = validation.withColumn("copy", F.lit(0))
        if do_shuffle:
            v = v.withColumn("position", F.lit(None).cast("bigint"))
    return t.unionByName(v.withColumn("split", F.lit("validation")), allowMissingColumns=True)

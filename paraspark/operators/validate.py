"""Validation, quarantine and guards.

Checks that must stop a run are one small aggregate evaluated before anything is written; the
rows themselves never travel to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paraspark.constants import DIRECTIONS, REQUIRED_PAIR_FIELDS
from paraspark.operators.identity import with_row_index


def is_missing(df: DataFrame, field: str) -> Column:
    """Rule 1.3: absent, null or '' (JSON readers add a truthiness flag for 0 / false / [])."""
    flag = f"__falsy_{field}"
    if flag in df.columns:
        return F.col(flag)
    if field not in df.columns:
        return F.lit(True)
    c = F.col(field)
    return c.isNull() | (c.cast("string") == "")


def missing_fields(df: DataFrame, required=REQUIRED_PAIR_FIELDS) -> Column:
    """Names of the missing required fields, sorted."""
    names = sorted(required)
    return F.array_compact(F.array(*[F.when(is_missing(df, f), F.lit(f)) for f in names]))


def with_missing(df: DataFrame, required=REQUIRED_PAIR_FIELDS, name: str = "missing") -> DataFrame:
    return df.withColumn(name, missing_fields(df, required))


def error_message(source: Column, row_number: Column, missing: Column) -> Column:
    quoted = F.transform(missing, lambda x: F.concat(F.lit("'"), x, F.lit("'")))
    return F.concat(source, F.lit(" row "), row_number.cast("string"),
                    F.lit(" missing required fields: ["), F.array_join(quoted, ", "), F.lit("]"))


def require_valid(df: DataFrame, required=REQUIRED_PAIR_FIELDS, source: str | list = "input",
                  row_col: str = "row_number", source_col: str | None = None) -> DataFrame:
    """Strict mode (C2): the first invalid row fails the run, before anything is written.

    With several inputs ``source`` lists their names in order and ``source_col`` holds a row's
    name: the first invalid row of the earliest input is reported.
    """
    names = [source] if isinstance(source, str) else list(source)
    place = F.lit(0) if source_col is None else F.array_position(F.array(*map(F.lit, names)), F.col(source_col)).cast("int") - 1
    bad = with_missing(df, required).where(F.size("missing") > 0).agg(F.min(F.struct(
        place.alias("place"), F.col(row_col).alias("row"), F.col("missing"))).alias("first")).first()
    if bad and bad["first"] is not None:
        first = bad["first"]
        raise ValueError(f"{names[first['place']]} row {first['row']} missing required fields: {list(first['missing'])}")
    return df


INVALID = "row of an input lacks required fields"


def failing_on_invalid(df: DataFrame, source_col: str, row_col: str = "row_number") -> DataFrame:
    """Strict mode while rows pass: the ``valid`` column fails the job that meets an invalid row.

    A sink that commits all its tasks together then leaves nothing, and no pass of its own is needed.
    """
    message = F.concat(F.lit(INVALID + ": "), error_message(F.col(source_col), F.col(row_col), F.col("missing")))
    return df.withColumn("valid", F.when(F.col("valid"), True).otherwise(F.raise_error(message).cast("boolean")))


def quarantine(df: DataFrame, required=REQUIRED_PAIR_FIELDS, source: str = "input",
               row_col: str = "row_number"):
    """Skip-invalid mode (C3): ``(valid rows, rejected rows as T3 records)``."""
    checked = with_missing(df, required)
    row_fields = [F.col(f) for f in required if f in df.columns]
    valid = checked.where(F.size("missing") == 0).drop("missing")
    rejected = checked.where(F.size("missing") > 0).select(
        F.lit(source).alias("source"),
        F.col(row_col).cast("bigint").alias("row_number"),
        error_message(F.lit(source), F.col(row_col), F.col("missing")).alias("error"),
        F.struct(*row_fields).alias("row"),
        *[c for c in checked.columns if c not in (*required, "missing", row_col) and not c.startswith("__")],
    )
    return valid, rejected


def limit_source(df: DataFrame, n: int | None, row_col: str = "row_number", first: int = 1) -> DataFrame:
    """First ``n`` source rows, invalid rows included (C4).  Apply per source."""
    if n is None:
        return df
    return df.where(F.col(row_col) < F.lit(first + n))


RANGES = 1024       # counted parts of a key range


def take_first(df: DataFrame, n: int | None, order_cols, by: str | None = "split") -> DataFrame:
    """First ``n`` rows in key order, per split.

    A key that is one integer column is cut by order statistics: rounds of counts over ``RANGES`` parts of the range
    in which the n-th key lies find it exactly, and the cap is a filter, ``key <= cut`` for each split, with no window
    or sort for any ``n``.  Other keys, null ones and keys that are shared around the cut are numbered densely instead.
    """
    if n is None:
        return df
    cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    numeric = len(cols) == 1 and dict(df.dtypes)[cols[0]] in ("bigint", "int", "smallint", "tinyint")
    if numeric and (cuts := key_at_rank(df, cols[0], n, by)) is not None:
        if by is None:
            return df if not cuts else df.where(F.col(cols[0]) <= cuts[None])
        keep = F.lit(True)
        for split, cut in cuts.items():
            keep = F.when(F.col(by).eqNullSafe(F.lit(split)), F.col(cols[0]) <= cut).otherwise(keep)
        return df.where(keep)
    if by is None:
        return df.orderBy(*cols).limit(n)
    numbered = with_row_index(df, [by, *cols], name="__rn")
    starts = (df.groupBy(F.col(by).alias("__split")).agg(F.count(F.lit(1)).alias("__m"))     # a row per split
              .select("__split", (F.sum("__m").over(Window.orderBy("__split")) - F.col("__m")).alias("__start")))
    return (numbered.join(F.broadcast(starts), F.col(by).eqNullSafe(F.col("__split")))
            .where(F.col("__rn") - F.col("__start") < n).select(*df.columns))


def key_at_rank(df: DataFrame, key: str, n: int, by: str | None = None) -> dict | None:
    """The ``n``-th smallest key of every split with more than ``n`` rows; None if a key is null or shared around the cut.

    Every round counts the rows of each split's open range in at most ``RANGES`` parts, so the driver sees
    that many numbers a split; a range of 64-bit keys is closed after seven rounds at most.
    """
    split = F.col(by) if by else F.lit(None).cast("string")
    bounds = (df.groupBy(split.alias("s")).agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("m"),
                                               F.count_if(F.col(key).isNull()).alias("nulls")).collect())
    if any(r["nulls"] for r in bounds):
        return None
    if n <= 0:
        return {r["s"]: r["lo"] - 1 for r in bounds}
    open_, cuts = {r["s"]: (r["lo"], r["hi"], n) for r in bounds if r["m"] > n}, {}
    while open_:
        part, inside = F.lit(None).cast("bigint"), F.lit(False)
        for s, (lo, hi, _) in open_.items():
            mine = split.eqNullSafe(F.lit(s)) & F.col(key).between(lo, hi)
            width = (hi - lo) // RANGES + 1
            part = F.when(mine, F.call_function("div", F.col(key).cast("decimal(20,0)") - lo, F.lit(width).cast("decimal(20,0)"))).otherwise(part)
            inside = inside | mine
        counts = df.where(inside).groupBy(split.alias("s"), part.alias("part")).agg(F.count(F.lit(1)).alias("m")).collect()
        for s, (lo, hi, rank) in list(open_.items()):
            width = (hi - lo) // RANGES + 1
            for r in sorted((r for r in counts if r["s"] == s), key=lambda r: r["part"]):
                if rank <= r["m"]:
                    break
                rank -= r["m"]
            lo, hi = lo + r["part"] * width, min(hi, lo + (r["part"] + 1) * width - 1)
            if lo < hi:
                open_[s] = (lo, hi, rank)
            else:
                del open_[s]
                if r["m"] != rank:
                    return None     # the rows of the n-th key do not end with the n-th row
                cuts[s] = lo
    return cuts


def filter_direction(df: DataFrame, direction: str, col: str = "direction") -> DataFrame:
    """Direction filter (C6): an empty direction takes the argument, which must then not be
    ``both``; directions not asked for are dropped."""
    if direction != "both" and direction not in DIRECTIONS:
        raise ValueError(f"unknown direction {direction!r}: expected both or one of {', '.join(DIRECTIONS)}")
    wanted = list(DIRECTIONS) if direction == "both" else [direction]
    raw = F.col(col)
    resolved = F.when(raw.isNotNull() & (raw != ""), raw).otherwise(F.lit(direction))
    if direction == "both":
        require_rows_where(df, raw.isNull() | (raw == ""), None,
                           "has no direction, so the direction argument must be en-es or es-en, not both")
    out = df.withColumn("direction", resolved).where(F.col("direction").isin(wanted))
    return out.drop(col) if col != "direction" else out


def require_columns(df: DataFrame, names, what: str = "input") -> None:
    """Schema guard."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")


def require_rows(df: DataFrame, what: str = "rows") -> DataFrame:
    """Guard (C9): fail on an empty frame (one-row probe, not a count)."""
    if df.isEmpty():
        raise ValueError(f"nothing left to work on: {what}")
    return df


def require_rows_where(df: DataFrame, bad: Column, row_col: str | None, message: str) -> None:
    """Fail when any row meets ``bad``; reports the first offending row number."""
    probe = df.where(bad)
    if row_col is None:
        if not probe.isEmpty():
            raise ValueError(message)
        return
    first = probe.agg(F.min(row_col).alias("r")).first()
    if first and first["r"] is not None:
        raise ValueError(f"line {first['r']} {message}")


def require_sample_size(df: DataFrame, n: int, what: str = "input") -> None:
    """Guard (C9): a strict sample may not ask for more rows than exist."""
    rows = df.count()
    if n > rows:
        raise ValueError(f"{what}: {n} rows wanted, {rows} available")

"""Seeded permutations of 0 .. n-1 as Column expressions.

A generalised Feistel network permutes ``a * b`` numbers, ``a`` about the square root of ``n`` and ``a * b`` the least such
product that holds ``n``: a number is ``(left, right)`` with ``left < a`` and ``right < b``, and every round adds a
hash of one side to the other.  Numbers beyond ``n`` are walked on along their cycle until one below ``n`` comes,
which keeps it a permutation.  There are fewer than ``a`` of them, so a walk of ``a`` steps
always ends, and one of ``WALK`` steps fails to with a probability of about ``n ** (-WALK / 2)``; that is an error, never
a wrong number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 4
WALK = 24


def _sides(n: Column) -> tuple[Column, Column]:
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("bigint"), F.lit(1).cast("bigint"))
    return a, F.call_function("div", n + a - 1, a)


def _draw(seed: int, number: Column, value: Column) -> Column:
    text = F.concat(F.lit(f"{int(seed)}:"), number.cast("string"), F.lit(":"), value.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def _network(seed: int, x: Column, a: Column, b: Column) -> Column:
    def step(at: Column, number: Column) -> Column:
        even = number % 2 == 0
        left = F.when(even, (at["left"] + _draw(seed, number, at["right"])) % a).otherwise(at["left"])
        right = F.when(even, at["right"]).otherwise((at["right"] + _draw(seed, number, at["left"])) % b)
        return F.struct(left.alias("left"), right.alias("right"))

    start = F.struct((x % a).alias("left"), F.call_function("div", x, a).alias("right"))
    return F.aggregate(F.array(*[F.lit(k) for k in range(ROUNDS)]), start, step, lambda at: at["right"] * a + at["left"])


def permuted(seed: int, number: str | Column, n: str | Column) -> Column:
    """The place of ``number`` in the permutation of ``0 .. n-1`` that the seed picks; ``n`` is a column or a literal."""
    x = (F.col(number) if isinstance(number, str) else number).cast("bigint")
    n = (F.col(n) if isinstance(n, str) else n).cast("bigint")
    a, b = _sides(n)
    start = F.struct(x.alias("at"), F.lit(False).alias("done"))

    def walk(state: Column, _: Column) -> Column:
        # through an array of one, so that the network is evaluated once
        moved = F.transform(F.array(_network(seed, state["at"], a, b)), lambda m: F.struct(m.alias("at"), (m < n).alias("done")))
        return F.when(state["done"], state).otherwise(F.get(moved, F.lit(0)))
    steps = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, walk, lambda s: F.when(s["done"], s["at"]))
    return F.coalesce(steps, F.when(x.isNotNull() & n.isNotNull(), F.raise_error(F.lit("a walk along a cycle did not end")).cast("bigint")))

"""Order-free seeded draws.

A sequential random generator makes every draw depend on row order, which a cluster does not
have.  Draws are instead a pure function of ``(seed, key)``: the first 32 bits of
``md5("<seed>:<key>")``.  The value survives repartitioning, retries and lost executors, and
DuckDB computes the same number with ``cast('0x' || substr(md5(...), 1, 8) as bigint)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SPACE = 2 ** 32


def _key_string(*cols) -> Column:
    parts = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(":"))
        parts.append((F.col(c) if isinstance(c, str) else c).cast("string"))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def seeded_hash(seed: int, *key_cols) -> Column:
    """Uniform integer in [0, 2^32) drawn from ``seed`` and the key column(s)."""
    text = F.concat(F.lit(str(int(seed))), F.lit(":"), _key_string(*key_cols))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")

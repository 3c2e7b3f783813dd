"""Text normalisation as JVM-side Column expressions.

Python's ``str.split()``/``strip()`` and ``re`` ``\\s`` treat all Unicode whitespace plus the
separators 0x1c-0x1f as whitespace.  Java's ``\\s`` is ASCII-only and ``trim`` strips only spaces,
so one explicit class is shared by every operator here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paraspark.constants import STOP_MARKERS

# Java regex class equal to Python's whitespace definition.
WS = r"[\s\x1c-\x1f\x85\p{Z}]"
# The same class for RE2 (DuckDB oracle SQL); RE2's \s lacks \x0b.
WS_RE2 = r"[\t\n\x0b\f\r\x1c-\x1f\x85\p{Z}]"
# The same set spelled out (29 code points), for char-set functions that need no regex:
# btrim strips them from both ends, translate maps them all to a plain space.
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
            + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col) -> Column:
    """Python ``str.strip()``: drop leading and trailing whitespace (char-set trim, no regex)."""
    return F.btrim(_c(col), F.lit(WS_CHARS))


def collapse_ws(col) -> Column:
    """Every whitespace run becomes one space: map the set to spaces, then squeeze spaces."""
    spaced = F.translate(_c(col), WS_CHARS, " " * len(WS_CHARS))
    return F.regexp_replace(spaced, " {2,}", " ")


def flatten_text(col) -> Column:
    """All whitespace runs become one space, ends trimmed (``" ".join(text.split())``)."""
    return collapse_ws(strip(col))


def normalize_text(col) -> Column:
    """Lower-case, strip, collapse whitespace: the form every metric compares."""
    return collapse_ws(strip(F.lower(_c(col))))


def clean_prediction(col) -> Column:
    """Cut a generation at the earliest stop marker, then strip (plain substring search)."""
    x = _c(col)
    cut = None
    for marker in STOP_MARKERS:
        pos = F.instr(x, marker)
        pos = F.when(pos > 0, pos)
        cut = pos if cut is None else F.least(cut, pos)   # least skips nulls
    return strip(F.when(cut.isNull(), x).otherwise(x.substr(F.lit(1), cut - 1)))


def split_ws(col, most: int | None = None) -> Column:
    """``text.split()`` as an array column (empty text gives an empty array), the first ``most`` tokens
    only: splitting stops there and leaves the rest of the text alone."""
    if most is None:
        flat = flatten_text(col)
        return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))
    text = F.translate(strip(col), WS_CHARS, " " * len(WS_CHARS))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.slice(F.split(text, " +", most + 1), 1, most))


def token_count(col) -> Column:
    """Number of whitespace-separated tokens."""
    return F.size(split_ws(col))


def title_case(col) -> Column:
    """Python ``str.title()``: a letter is upper-cased unless the previous character is a letter."""
    chars = F.split(_c(col), "")

    def cased(ch):
        return F.lower(ch) != F.upper(ch)

    return F.array_join(
        F.transform(
            chars,
            lambda ch, i: F.when((i > 0) & cased(F.get(chars, i - 1)), F.lower(ch)).otherwise(F.upper(ch)),
        ),
        "",
    )

"""Quality rules: plain counts and tokeniser fertility with rejection bands per language.

Plain counts are DataFrame functions, but for the repeated 8-word windows, which are hashed in
numpy.  Fertility comes from a public vocabulary (``sentencepiece_fst``): characters per token,
share of byte-fallback tokens, and entropy of the text's tokens over the most it could be.

Bands are taken from the whole corpus: per language and size class (power of two of tokens), the
quartiles over distinct measurements of texts that pass the plain rules, so that a large group of
copies weighs as one text.  A text is rejected where a measure lies further than ``REACH``
interquartile ranges from the median; ranges have lower limits.  In classes of fewer than
``LEAST_TEXTS`` measurements the language's own band, twice as wide, stands in; languages of fewer
texts, and texts of fewer than ``LEAST_TOKENS`` tokens, reject nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paraspark.llm.common import sized_broadcast, stored, table, text_or_empty, trimmed
from paraspark.llm.sentencepiece_fst import MODEL_PATH, SLICE, cache_of, share_model
from paraspark.llm.shingles import grams, word_hashes

LEAST_WORDS = 20
MOST_REPEATED = 30      # percent of words in repeated windows
WINDOW = 8              # words
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
REACH = 4.0
LEAST_TEXTS = 50
LEAST_TOKENS = 32
BROADCAST_ROWS = 100_000
#: Lower limits of the interquartile ranges: of characters per token as a share of the median.
FLOOR = {"chars_per_token": 0.02, "byte_share": 0.01, "entropy": 0.02}


def repeated_words(words: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more in the text, the first included."""
    found = grams(words, window)
    if len(found) < 2:
        return 0
    ordered = np.sort(found)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    order = np.argsort(found, kind="stable")
    again = found[order][1:] == found[order][:-1]
    twice = np.zeros(len(found), bool)
    twice[order[1:][again]] = True
    twice[order[:-1][again]] = True
    covered = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    covered[at] += 1
    covered[at + window] -= 1
    return int(np.count_nonzero(np.cumsum(covered)[:-1] > 0))


def _entropy(ids: np.ndarray) -> float:
    """Entropy of the tokens in bits over that of as many different tokens; 1 for a single token."""
    if len(ids) < 2:
        return 1.0
    ordered = np.sort(ids)
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True])))
    share = np.diff(starts) / len(ids)
    return float(-(share * np.log2(share)).sum() / np.log2(len(ids)))


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            model_path: str = MODEL_PATH) -> DataFrame:
    """``id, lang``, the plain counts and the fertility measures of every whole text."""
    shared = share_model(df.sparkSession, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = cache_of(shared)
        model = cache.model
        lo, hi = (min(model.byte.values()), max(model.byte.values())) if model.byte else (0, -1)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                n_words, repeats = [], []
                for words in word_hashes(batch.column("text"), fold=False):
                    n_words.append(len(words))
                    repeats.append(repeated_words(words))
                paths = model.encode_all(batch.column("text").to_pylist(), cache)
                byte = [int(np.count_nonzero((p >= lo) & (p <= hi))) for p in paths]
                kept = [c for c in batch.schema.names if c != "text"]
                yield pa.record_batch(
                    [batch.column(c) for c in kept] + [
                        pa.array(n_words, pa.int64()), pa.array(repeats, pa.int64()),
                        pa.array([len(p) for p in paths], pa.int64()), pa.array(byte, pa.int64()),
                        pa.array([_entropy(p) for p in paths], pa.float64())],
                    names=[*kept, "n_words", "n_repeat_words", "n_tokens", "n_byte_tokens", "entropy"])

    text = text_or_empty(text_col)
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, WHITE, "") != "")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"),
                     text.alias("text"), F.length(text).cast("long").alias("n_chars"),
                     F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
                     (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                     (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))
    return rows.mapInArrow(trimmed(run), "id long, lang string, n_chars long, word_chars long, n_symbols long, n_dup_lines long, "
                                "n_words long, n_repeat_words long, n_tokens long, n_byte_tokens long, entropy double")


def _bands(measured: DataFrame, by: list[str], reach: float) -> DataFrame:
    """Per group the accepted interval of every measure."""
    distinct = (measured.where(~F.col("base_failed") & F.col("size_class").isNotNull())
                .select("lang_key", "size_class", *FLOOR).distinct())
    quartiles = [F.percentile_approx(c, F.array(*map(F.lit, (0.25, 0.5, 0.75))), 2000).alias(c) for c in FLOOR]
    found = distinct.groupBy(*by).agg(F.count("*").alias("texts"), *quartiles)

    def far(c: str) -> Column:
        least = F.lit(FLOOR[c]) * (F.col(c)[1] if c == "chars_per_token" else F.lit(1.0))
        return F.lit(reach) * F.greatest(F.col(c)[2] - F.col(c)[0], least)

    bands = found.where(F.col("texts") >= LEAST_TEXTS).select(
        *by, (F.col("chars_per_token")[1] - far("chars_per_token")).alias("chars_lo"),
        (F.col("chars_per_token")[1] + far("chars_per_token")).alias("chars_hi"),
        (F.col("byte_share")[1] + far("byte_share")).alias("byte_hi"), (F.col("entropy")[1] - far("entropy")).alias("entropy_lo"))
    return stored(bands, "bands")


def _inside(prefix: str = "") -> Column:
    """Whether a text lies in its band; null without a band."""
    lo, hi, byte_hi, entropy_lo = (F.col(prefix + c) for c in ("chars_lo", "chars_hi", "byte_hi", "entropy_lo"))
    inside = F.col("chars_per_token").between(lo, hi) & (F.col("byte_share") <= byte_hi)
    # entropy falls with length, so it is compared within a size class only
    return inside & (F.col("entropy") >= entropy_lo) if not prefix else inside


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  model_path: str = MODEL_PATH) -> DataFrame:
    """One row per input row: id, the counts, ``base_failed, kept`` and the fertility measures.

    ``base_failed``: fewer than 20 words, or over 30 % of them in repeated 8-word windows.  ``kept`` is
    false for these and for texts outside a band.  Null texts have no words; null languages are one
    language; texts of equal measures share their verdict, so repeated rows do.  Fertility of a text
    without tokens is null.  An empty table gives no rows; other columns are ignored.
    """
    tokens = F.when(F.col("n_tokens") > 0, F.col("n_tokens"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    measured = measure(df, id_col, text_col, lang_col, model_path)
    measured = stored(measured.select(
        "*", failed.alias("base_failed"), (F.col("n_chars") / tokens).alias("chars_per_token"),
        (F.col("n_byte_tokens") / tokens).alias("byte_share"),
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("lang_key"),
        F.when(F.col("n_tokens") >= LEAST_TOKENS, F.floor(F.log2("n_tokens")).cast("int")).alias("size_class")), "quality")
    classes = _bands(measured, ["lang_key", "size_class"], REACH)
    languages = _bands(measured, ["lang_key"], 2 * REACH)
    languages = languages.toDF("lang_key", *(f"lang_{c}" for c in languages.columns[1:]))
    judged = (measured.join(sized_broadcast(classes, classes.count(), BROADCAST_ROWS), ["lang_key", "size_class"], "left")
              .join(sized_broadcast(languages, languages.count(), BROADCAST_ROWS), "lang_key", "left"))
    inside = F.col("size_class").isNull() | F.coalesce(_inside(), _inside("lang_"), F.lit(True))
    return judged.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"),
                         F.col("lang").alias(lang_col), "n_tokens", "chars_per_token", "byte_share", "entropy")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))

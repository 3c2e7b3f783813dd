"""Tokenise, mask and filter chat examples for supervised training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraspark.constants import DEFAULT_MAX_SEQ_LEN
from paraspark.functions.tokens import chat_markup, has_supervised, mask_labels, truncate, whitespace_tokenizer


def encode(df: DataFrame, tokenizer=None, max_len: int = DEFAULT_MAX_SEQ_LEN,
           messages: str = "messages") -> DataFrame:
    """Encode the full conversation and its prompt part (all but the last turn, with a generation
    cue), each cut to ``max_len`` tokens, then build the label mask (F1, F2)."""
    m = F.col(messages)
    prompt_msgs = F.slice(m, 1, F.greatest(F.size(m) - 1, F.lit(0)))
    full_text, prompt_text = chat_markup(m), chat_markup(prompt_msgs, generation_cue=True)
    if tokenizer is None:
        # the built-in tokenizer can stop at the cut instead of hashing every token first
        tok = whitespace_tokenizer()
        full_ids, prompt_ids = tok(full_text, max_len), tok(prompt_text, max_len)
    else:
        full_ids, prompt_ids = truncate(tokenizer(full_text), max_len), truncate(tokenizer(prompt_text), max_len)
    out = df.withColumn("input_ids", full_ids).withColumn("__prompt_ids", prompt_ids)
    out = out.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
    out = out.withColumn("labels", mask_labels(F.col("input_ids"), F.col("__prompt_ids")))
    return out.withColumn("prompt_len", F.size("__prompt_ids")).drop("__prompt_ids")


def supervised_only(df: DataFrame, labels: str = "labels", prompt_len: str = "prompt_len") -> DataFrame:
    """Keep rows with at least one supervised label (F3): the prompt ends before the labels do.

    With the encoded lengths at hand the labels need no second look.
    """
    if prompt_len in df.columns:
        return df.where(F.col(prompt_len) < F.size(labels))
    return df.where(has_supervised(F.col(labels)))

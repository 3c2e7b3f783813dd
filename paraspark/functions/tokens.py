"""Token-label helpers (F1-F3) as Column expressions.

The tokenizer is pluggable: any ``Column -> array<int>`` function, e.g. a pandas UDF wrapping a
sub-word tokenizer.  The default is a JVM-side whitespace tokenizer with hashed ids, which keeps
the hot path inside codegen and is what the tests use.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paraspark.constants import LABEL_IGNORE, TURN_END, TURN_START
from paraspark.functions.text import split_ws

DEFAULT_VOCAB = 1 << 20


def whitespace_tokenizer(vocab: int = DEFAULT_VOCAB):
    """Whitespace tokens with hashed ids; ``max_len`` stops hashing once the cut is reached."""
    def tokenize(text: Column, max_len: int | None = None) -> Column:
        tokens = split_ws(text, max_len)
        return F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(vocab)).cast("int"))
    return tokenize


def chat_markup(messages, generation_cue: bool = False) -> Column:
    """Every turn as ``<|im_start|>role\\ncontent<|im_end|>\\n``; optional assistant cue."""
    m = F.col(messages) if isinstance(messages, str) else messages
    turns = F.transform(m, lambda x: F.concat(F.lit(TURN_START), F.coalesce(x["role"], F.lit("")), F.lit("\n"),
                                              F.coalesce(x["content"], F.lit("")), F.lit(TURN_END + "\n")))
    text = F.array_join(turns, "")
    return F.concat(text, F.lit(TURN_START + "assistant\n")) if generation_cue else text


def truncate(ids: Column, max_len: int) -> Column:
    return F.slice(ids, 1, max_len)


def mask_labels(full_ids: Column, prompt_ids: Column) -> Column:
    """Labels = full ids with the first ``min(len(prompt), len(full))`` positions ignored (F2)."""
    # no lambda over outer values: Catalyst may inline ``n`` into a lambda body, which would
    # re-tokenise the texts once per array element
    n = F.least(F.size(prompt_ids), F.size(full_ids))
    kept = F.slice(full_ids, n + 1, F.greatest(F.size(full_ids) - n, F.lit(0)))
    return F.concat(F.array_repeat(F.lit(LABEL_IGNORE), n), kept)


def has_supervised(labels: Column) -> Column:
    """Any label that is not ignored."""
    return F.exists(labels, lambda x: x != LABEL_IGNORE)

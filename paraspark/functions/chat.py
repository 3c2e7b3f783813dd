"""Chat-message construction and rendering as Column expressions.

``messages`` is ``array<struct<role:string, content:string>>`` throughout; ``metadata`` is a
struct that may lack any field.  Everything here is a projection: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paraspark.constants import (
    BASELINE_SYSTEM_PROMPT, DEFAULT_ROLE_NAME, DIRECTION_LANGUAGES, EN_ES_MARKERS,
    ES_EN_MARKERS, LENGTH_BUCKETS, OVERFLOW_BUCKET, ROLE_NAMES, SIMPLE_SYSTEM_PROMPTS,
    SOURCE_MARKERS, SYSTEM_PROMPTS, TURN_END, TURN_START, UNKNOWN_DIRECTION,
)
from paraspark.functions.text import strip, title_case, token_count

MESSAGE_TYPE = "array<struct<role:string,content:string>>"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _s(col) -> Column:
    """A value as it appears when interpolated into a prompt (null -> '')."""
    return F.coalesce(_c(col).cast("string"), F.lit(""))


def message(role, content) -> Column:
    role_col = F.lit(role) if isinstance(role, str) else role
    return F.struct(role_col.alias("role"), _c(content).cast("string").alias("content"))


def _by_direction(direction, mapping: dict) -> Column:
    d = _c(direction)
    expr = None
    for key, value in mapping.items():
        expr = F.when(d == key, F.lit(value)) if expr is None else expr.when(d == key, F.lit(value))
    return expr.otherwise(F.raise_error(F.concat(F.lit("unknown direction: "), F.coalesce(d, F.lit("null")))).cast("string"))


def source_language(direction) -> Column:
    return _by_direction(direction, {k: v[0] for k, v in DIRECTION_LANGUAGES.items()})


def target_language(direction) -> Column:
    return _by_direction(direction, {k: v[1] for k, v in DIRECTION_LANGUAGES.items()})


def system_prompt(direction) -> Column:
    return _by_direction(direction, SYSTEM_PROMPTS)


def prompt_structured(direction, style, target_length, text) -> Column:
    """``Direction: A to B / Style / Target length / A: text`` user turn (D3)."""
    src = source_language(direction)
    return F.concat(
        F.lit("Direction: "), src, F.lit(" to "), target_language(direction), F.lit("\n"),
        F.lit("Style: "), _s(style), F.lit("\n"),
        F.lit("Target length: about "), _s(target_length), F.lit(" words\n"),
        src, F.lit(": "), _s(text),
    )


def prompt_simple(direction, text) -> Column:
    """Simple template: direction-specific system line, the raw source as user turn."""
    return F.array(
        message("system", _by_direction(direction, SIMPLE_SYSTEM_PROMPTS)),
        message("user", _s(text)),
    )


def prompt_structured_messages(direction, style, target_length, text) -> Column:
    return F.array(
        message("system", system_prompt(direction)),
        message("user", prompt_structured(direction, style, target_length, text)),
    )


def prompt_baseline(text) -> Column:
    """Fixed system text plus ``English: <text>``."""
    return F.array(
        message("system", F.lit(BASELINE_SYSTEM_PROMPT)),
        message("user", F.concat(F.lit("English: "), _s(text))),
    )


def source_text_for(direction, english, spanish) -> Column:
    return F.when(_c(direction) == "en-es", _c(english)).otherwise(_c(spanish))


def target_text_for(direction, english, spanish) -> Column:
    return F.when(_c(direction) == "en-es", _c(spanish)).otherwise(_c(english))


def chat_example(direction="direction", term="term", target_length="target_length", style="style",
                 english="english_scenario", spanish="spanish_translation") -> Column:
    """Three-turn chat example plus metadata for one direction."""
    src = source_text_for(direction, english, spanish)
    tgt = target_text_for(direction, english, spanish)
    return F.struct(
        F.array(
            message("system", system_prompt(direction)),
            message("user", prompt_structured(direction, style, target_length, src)),
            message("assistant", tgt),
        ).alias("messages"),
        F.struct(
            _c(term).cast("string").alias("term"),
            _c(target_length).cast("string").alias("target_length"),
            _c(style).cast("string").alias("style"),
            _c(direction).alias("direction"),
        ).alias("metadata"),
    )


def user_text(messages) -> Column:
    """All user turns joined by newline."""
    users = F.filter(_c(messages), lambda m: m["role"] == "user")
    return F.array_join(F.transform(users, lambda m: F.coalesce(m["content"], F.lit(""))), "\n")


def infer_direction(messages="messages", metadata_direction=None) -> Column:
    """Metadata wins when non-empty; otherwise markers in the user turns."""
    text = user_text(F.coalesce(_c(messages), F.array().cast(MESSAGE_TYPE)))
    es_en = None
    for marker in ES_EN_MARKERS:
        cond = F.instr(text, marker) > 0
        es_en = cond if es_en is None else (es_en | cond)
    en_es = None
    for marker in EN_ES_MARKERS:
        cond = F.instr(text, marker) > 0
        en_es = cond if en_es is None else (en_es | cond)
    inferred = F.when(es_en, F.lit("es-en")).when(en_es, F.lit("en-es")).otherwise(F.lit(UNKNOWN_DIRECTION))
    if metadata_direction is None:
        return inferred
    md = _c(metadata_direction)
    return F.when(md.isNotNull() & (md != ""), md).otherwise(inferred)


def last_message(messages) -> Column:
    return F.try_element_at(_c(messages), F.lit(-1))


def ends_with_assistant(messages) -> Column:
    return F.coalesce(last_message(messages)["role"] == "assistant", F.lit(False))


def prompt_messages(messages) -> Column:
    """Messages without a final assistant turn (D7, first half)."""
    m = F.coalesce(_c(messages), F.array().cast(MESSAGE_TYPE))
    return F.when(ends_with_assistant(m), F.slice(m, 1, F.greatest(F.size(m) - 1, F.lit(0)))).otherwise(m)


def reference_of(messages) -> Column:
    """Content of a final assistant turn, else '' (D7, second half)."""
    m = F.coalesce(_c(messages), F.array().cast(MESSAGE_TYPE))
    return F.when(ends_with_assistant(m), F.coalesce(last_message(m)["content"], F.lit(""))).otherwise(F.lit(""))


def role_display(role: Column) -> Column:
    expr = F.when(role.isNull(), F.lit(DEFAULT_ROLE_NAME))
    for raw, shown in ROLE_NAMES.items():
        expr = expr.when(role == raw, F.lit(shown))
    return expr.otherwise(title_case(role))


def render_plain(messages, generation_cue: bool = False) -> Column:
    """``System: ..`` / ``User: ..`` lines, optional trailing ``Assistant:``."""
    parts = F.transform(
        _c(messages),
        lambda m: F.concat(role_display(m["role"]), F.lit(": "), F.coalesce(m["content"], F.lit(""))),
    )
    if generation_cue:
        parts = F.concat(parts, F.array(F.lit("Assistant:")))
    return F.array_join(parts, "\n")


def render_prompt_only(messages) -> Column:
    """Marked-up turns without any assistant turn, newline-joined, final newline."""
    kept = F.filter(_c(messages), lambda m: m["role"].isNull() | (m["role"] != "assistant"))
    turns = F.transform(
        kept,
        lambda m: F.concat(F.lit(TURN_START), F.coalesce(m["role"], F.lit("None")), F.lit("\n"),
                           F.coalesce(m["content"], F.lit("")), F.lit(TURN_END)),
    )
    return F.concat(F.array_join(turns, "\n"), F.lit("\n"))


def format_texts(messages) -> Column:
    """(prompt with generation cue, full text with a non-empty reference, reference)."""
    pm = prompt_messages(messages)
    ref = reference_of(messages)
    full = F.when(ref != "", F.concat(pm, F.array(message("assistant", ref)))).otherwise(pm)
    return F.struct(
        render_plain(pm, generation_cue=True).alias("prompt"),
        render_plain(full).alias("full_text"),
        ref.alias("reference"),
    )


def length_bucket(n) -> Column:
    """Inclusive upper bounds 512 .. 8192, else ``8k_plus``."""
    n = _c(n)
    expr = None
    for bound, label in LENGTH_BUCKETS:
        expr = F.when(n <= bound, F.lit(label)) if expr is None else expr.when(n <= bound, F.lit(label))
    return expr.otherwise(F.lit(OVERFLOW_BUCKET))


def prompt_token_length(messages) -> Column:
    return token_count(render_prompt_only(prompt_messages(messages)))


def source_text(messages, markers=SOURCE_MARKERS) -> Column:
    """Last user turn; the text after the first marker found, stripped; '' without a user turn."""
    users = F.filter(F.coalesce(_c(messages), F.array().cast(MESSAGE_TYPE)), lambda m: m["role"] == "user")
    content = F.coalesce(F.try_element_at(users, F.lit(-1))["content"], F.lit(""))
    expr = None
    for marker in markers:
        pos = F.instr(content, marker)
        cut = content.substr(pos + len(marker), F.lit(2 ** 31 - 1))
        expr = F.when(pos > 0, cut) if expr is None else expr.when(pos > 0, cut)
    picked = expr.otherwise(content)
    return F.when(F.size(users) > 0, strip(picked)).otherwise(F.lit(""))


def result_column(label: str) -> str:
    """Output column name for a model label."""
    return f"{label.lower().replace('-', '_')}_translation"

"""Chat formatting: a record's schema fingerprint selects the mapping that makes it canonical turns.

A record is a VARIANT (or JSON text) in any of many layouts: prompt and completion, instruction with
input, lists of messages.  The paths of its nested fields, read from the variant's own schema, are
sorted and hashed; each declared ``Layout`` is known by the hashes of the field sets it allows,
so one map lookup per record picks the mapping.  All mappings are Column expressions that yield
``array<struct<role, text>>``.  One template then marks the turns up; control strings inside
roles and texts are escaped reversibly, and ``parse_chat`` reads the turns back.

Everything here is built-in functions: no Python runs on the data.  A conversation is one output string, so
it has to fit a row (and a VARIANT of 128 MB); rows are grouped only where a caller groups them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paraspark.llm.common import table

IGNORED = ("id", "metadata", "source")      # top-level fields that say nothing about the layout

# tokens of a variant's schema: a field's name, the ends and starts of nested types, a plain type
_TOKENS = r"(?:`(?:[^`]|``)*`|[A-Za-z0-9_]+): |OBJECT<|ARRAY<|>|[A-Z][A-Z_]*(?:\(\d+, ?\d+\))?"
_TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Say:
    """One turn of a fixed role; of several fields, the non-empty ones are joined."""

    role: str
    paths: tuple[str, ...]
    joiner: str = "\n\n"
    optional: bool = False      # no turn where all fields are null or absent; else an empty text

    def turns(self, record: Column) -> Column:
        parts = [F.try_variant_get(record, f"$.{p}", "string") for p in self.paths]
        first, rest = parts[0], [F.when(p != "", p) for p in parts[1:]]
        text = F.concat_ws(self.joiner, first, *rest) if rest else F.coalesce(first, F.lit(""))
        one = F.array(F.struct(F.lit(self.role).alias("role"), text.alias("text")))
        if not self.optional:
            return one
        return F.when(F.coalesce(*parts).isNotNull(), one).otherwise(F.array().cast(_TURNS))


@dataclass(frozen=True)
class Each:
    """One turn per element of a list; ``aliases`` renames roles, ``part`` reads a text given as a list of parts."""

    path: str
    role: str
    text: str
    aliases: dict[str, str] = field(default_factory=dict)
    part: str | None = None

    def turns(self, record: Column) -> Column:
        kind = f"array<struct<{self.part}:string>>" if self.part else "string"
        listed = F.try_variant_get(record, f"$.{self.path}" if self.path else "$",
                                   f"array<struct<{self.role}:string,{self.text}:{kind}>>")
        renamed = F.create_map(*[F.lit(x) for pair in self.aliases.items() for x in pair]) if self.aliases else None

        def turn(m: Column) -> Column:
            role, text = m[self.role], m[self.text]
            if renamed is not None:
                role = F.coalesce(F.try_element_at(renamed, F.coalesce(role, F.lit(""))), role)
            if self.part:
                text = F.array_join(F.transform(text, lambda p: p[self.part]), "")
            return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

        return F.coalesce(F.transform(listed, turn), F.array().cast(_TURNS))


@dataclass(frozen=True)
class Layout:
    """A named mapping and the field paths that it is for: all ``required`` and any of ``optional``."""

    name: str
    required: tuple[str, ...]
    says: tuple[Say | Each, ...]
    optional: tuple[str, ...] = ()

    def fingerprints(self) -> list[str]:
        return [paths_fingerprint(self.required + extra)
                for n in range(len(self.optional) + 1) for extra in combinations(self.optional, n)]

    def turns(self, record: Column) -> Column:
        return F.concat(*[s.turns(record) for s in self.says])


SHARED_ROLES = {"human": "user", "gpt": "assistant"}
LAYOUTS = (
    Layout("prompt_response", ("prompt", "response"), (
        Say("system", ("system",), optional=True), Say("user", ("prompt",)), Say("assistant", ("response",))), ("system",)),
    Layout("prompt_completion", ("completion", "prompt"), (
        Say("system", ("system",), optional=True), Say("user", ("prompt",)), Say("assistant", ("completion",))), ("system",)),
    Layout("question_answer", ("answer", "question"), (
        Say("user", ("question", "context")), Say("assistant", ("answer",))), ("context",)),
    Layout("instruction", ("instruction", "output"), (
        Say("system", ("system",), optional=True), Say("user", ("instruction", "input")), Say("assistant", ("output",))),
        ("input", "system")),
    Layout("messages", ("messages[].content", "messages[].role"), (Each("messages", "role", "content"),)),
    Layout("message_parts", ("messages[].content[].text", "messages[].content[].type", "messages[].role"), (
        Each("messages", "role", "content", part="text"),)),
    Layout("conversations", ("conversations[].from", "conversations[].value"), (
        Say("system", ("system",), optional=True), Each("conversations", "from", "value", SHARED_ROLES)), ("system",)),
    Layout("bare_messages", ("[].content", "[].role"), (Each("", "role", "content"),)),
    Layout("no_messages", ("messages[]",), (Each("messages", "role", "content"),)),
)


def paths_fingerprint(paths: Sequence[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def field_paths(record: Column) -> Column:
    """The paths of a variant's plain values: ``a.b``, list elements as ``a[]``; odd names stay in backquotes.

    A fold over the tokens of the variant's schema with a stack of the open values' paths.
    """
    start = F.struct(F.array(F.lit("")).alias("open"), F.array().cast("array<string>").alias("paths"))

    def step(at: Column, token: Column) -> Column:
        top = F.try_element_at(at["open"], F.lit(-1))
        rest = F.slice(at["open"], F.lit(1), F.greatest(F.size(at["open"]) - 1, F.lit(0)))
        name = F.concat(top, F.when(top == "", "").otherwise("."), F.substring(token, F.lit(1), F.length(token) - 2))
        is_name = F.endswith(token, F.lit(": "))
        plain = ~is_name & ~token.isin("OBJECT<", "ARRAY<", ">")
        return F.struct(
            F.when(is_name, F.concat(at["open"], F.array(name)))
            .when(token == "ARRAY<", F.concat(at["open"], F.array(F.concat(top, F.lit("[]")))))
            .when(token == "OBJECT<", at["open"]).otherwise(rest).alias("open"),
            F.when(plain, F.concat(at["paths"], F.array(top))).otherwise(at["paths"]).alias("paths"))

    tokens = F.regexp_extract_all(F.schema_of_variant(record), F.lit(_TOKENS), F.lit(0))
    return F.aggregate(tokens, start, step, lambda at: F.array_sort(F.array_distinct(at["paths"])))


def fingerprint(record: Column, ignored: Sequence[str] = IGNORED) -> Column:
    """SHA-256 of the record's field paths without those under the ignored top-level fields."""
    def counts(path: Column) -> Column:
        return ~F.regexp_extract(path, r"^(?:`(?:[^`]|``)*`|[^.\[`]*)", 0).isin(*ignored) if ignored else F.lit(True)
    return F.sha2(F.array_join(F.filter(field_paths(record), counts), "\n"), 256)


def select_layout(print_: Column, layouts: Sequence[Layout] = LAYOUTS) -> Column:
    """The name of the layout with this fingerprint, null if there is none."""
    known: dict[str, str] = {}
    for layout in layouts:
        for p in layout.fingerprints():
            if known.setdefault(p, layout.name) != layout.name:
                raise ValueError(f"layouts {known[p]} and {layout.name} share a set of fields")
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), print_)


def canonical_turns(record: Column, layout: Column, layouts: Sequence[Layout] = LAYOUTS) -> Column:
    turns = F.lit(None).cast(_TURNS)
    for known in reversed(layouts):
        turns = F.when(layout == known.name, known.turns(record)).otherwise(turns)
    return turns


@dataclass(frozen=True)
class Template:
    """``start role \\n text end \\n`` per turn; the text of a ``learned`` role is under the loss mask."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        if not (self.start.startswith("<|") and self.end.startswith("<|")):
            raise ValueError("control strings start with <|, which is what texts are escaped against")

    @staticmethod
    def escape(text: Column) -> Column:
        """One more backslash between ``<`` and ``|``, so no control string is left; always reversible."""
        return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")

    @staticmethod
    def unescape(text: Column) -> Column:
        return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")

    def escape_role(self, role: Column) -> Column:
        """As a text, and without the line end that closes a role."""
        return F.replace(F.replace(self.escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))

    def unescape_role(self, role: Column) -> Column:
        return self.unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))

    def segments(self, turns: Column) -> Column:
        """``array<struct<text, loss>>``; the formatted text is these texts one after the other."""
        def one(t: Column) -> Column:
            head = F.concat(F.lit(self.start), self.escape_role(t["role"]), F.lit("\n"))
            return F.array(F.struct(head.alias("text"), F.lit(False).alias("loss")),
                           F.struct(self.escape(t["text"]).alias("text"), t["role"].isin(*self.learned).alias("loss")),
                           F.struct(F.lit(self.end + "\n").alias("text"), F.lit(False).alias("loss")))
        return F.flatten(F.transform(turns, one))

    def parse(self, formatted: Column) -> Column:
        """The turns of a formatted text, as they were."""
        pieces = F.split(formatted, "\\Q" + self.end + "\n\\E", -1)

        def one(piece: Column) -> Column:
            at = F.instr(piece, "\n")
            return F.struct(
                self.unescape_role(F.substring(piece, F.lit(len(self.start) + 1), at - len(self.start) - 1)).alias("role"),
                self.unescape(F.substring(piece, at + 1, F.length(piece))).alias("text"))
        return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), one)


CHAT_TEMPLATE = Template()


def parse_chat(formatted: Column, template: Template = CHAT_TEMPLATE) -> Column:
    return template.parse(formatted)


def learned_text(segments: Column, template: Template = CHAT_TEMPLATE) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    kept = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(kept, lambda s: template.unescape(s["text"])), "")


def format_chats(df: DataFrame, id_col: str = "conv_id", record_col: str = "record", layouts: Sequence[Layout] = LAYOUTS,
                 template: Template = CHAT_TEMPLATE, ignored: Sequence[str] = IGNORED) -> DataFrame:
    """One row per record: ``id, fingerprint, layout, turns, segments, formatted``.

    A null record, unreadable JSON (repeated keys too) and a record whose fields fit no layout keep their row,
    with null layout, turns, segments and formatted text; the fingerprint tells which layouts are missing.
    Null texts and roles are empty; a record without messages has no turns and an empty formatted text.
    Texts of any length stay whole up to the size of a VARIANT.  Repeated ids and records are formatted one
    by one; other columns of the input are ignored.
    """
    record = F.col(record_col)
    if dict(df.dtypes)[record_col] == "string":
        record = F.try_parse_json(record)
    known = df.select(F.col(id_col).alias("id"), record.alias("record")).select(
        "id", "record", fingerprint(F.col("record"), ignored).alias("fingerprint"))
    picked = known.withColumn("layout", select_layout(F.col("fingerprint"), layouts))
    turned = picked.select("id", "fingerprint", "layout", canonical_turns(F.col("record"), F.col("layout"), layouts).alias("turns"))
    marked = turned.withColumn("segments", template.segments(F.col("turns")))
    formatted = F.when(F.col("segments").isNotNull(), F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    return marked.select(F.col("id").alias(id_col), "fingerprint", "layout", "turns", "segments", formatted.alias("formatted"))


def conversation_records(rows: DataFrame) -> DataFrame:
    """``conv_id, record``: each conversation as one VARIANT, in the layout that its roles allow.

    Rows go by turn, nulls first, ties by role and text.  Two and three turns of the usual roles are a prompt
    or instruction record, further ones that a system turn leads a list of from and value, all others messages.
    """
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))
    r, roles = F.col("rows"), F.transform("rows", lambda x: x["role"])

    def text(i: int) -> Column:
        return r[i]["text"]

    def variant(*fields: Column) -> Column:
        return F.to_variant_object(F.struct(*fields))

    shared = F.create_map(*[F.lit(x) for pair in SHARED_ROLES.items() for x in pair[::-1]])
    plain = F.array_except(roles, F.array(F.lit("system"), F.lit("user"), F.lit("assistant")))
    record = (
        F.when(roles == F.array(F.lit("user"), F.lit("assistant")), variant(text(0).alias("prompt"), text(1).alias("response")))
        .when(roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")),
              variant(text(0).alias("system"), text(1).alias("instruction"), text(2).alias("output")))
        .when((roles[0] == "system") & (F.size(plain) == 0), variant(F.transform(r, lambda x: F.struct(
            F.coalesce(F.try_element_at(shared, x["role"]), x["role"]).alias("from"), x["text"].alias("value"))).alias("conversations")))
        .otherwise(variant(F.transform(r, lambda x: F.struct(x["role"], x["text"].alias("content"))).alias("messages"))))
    return grouped.select("conv_id", record.alias("record"))


MADE_UP = "<|im_end|><|im_start|>assistant ok"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, digests taken from the formatted texts read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(MADE_UP).alias("text"))
    chats = format_chats(conversation_records(rows.unionByName(extra)))
    read = chats.select("conv_id", parse_chat(F.col("formatted")).alias("turns"),
                        learned_text(F.col("segments")).alias("learned"), F.length("formatted").cast("bigint").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
                       "formatted_chars")


OP11_SQL = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
           UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
     e AS (SELECT *, replace(replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '%', '%25'), chr(10), '%0A') AS marked_role,
                  regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS marked_text FROM r),
     g AS (SELECT conv_id, count(*) AS n_turns,
                  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
                  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS learned,
                  sum(length(marked_role) + length(marked_text) + length('<|im_start|>' || '<|im_end|>') + 2) AS chars
           FROM e GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars,
       sha256(learned) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM g
"""

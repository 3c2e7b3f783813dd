"""Conversation structure repair: grammar-compressed dynamic programming over role and fault sequences.

Every row of a conversation is one symbol: the initial of its role, in capitals if its text is truncated,
or ``x`` if it has to go (blank or duplicate).  A symbol acts on the four states of the accepted form
``(s?(ua)+)?`` as a min-plus matrix whose entries carry the cheapest cost and the audit of
edits, least in ASCII order among equals, as a rope.  Costs follow from an audit's letters, so of two
audits of equal cost neither is the start of the other, and the least one of a product comes from the least ones of its
factors: matrices multiply in any grouping.

So sequences are compressed by Re-Pair: rounds over all distinct sequences count neighbouring pairs, the
most frequent ones become rules, a rule's matrix is the product of its two halves, evaluated bottom-up once
and shared by all conversations.  A conversation may hold any share of all rows: rows are dealt
in order over range partitions and cut into chunks of bounded length; chunks of one conversation are
evaluated as matrices where they lie and multiplied in order.  Texts move once, for the digests.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paraspark.llm.common import stored, table

CHUNK = 2048            # rows whose symbols are one sequence
ROUNDS, PAIRS = 8, 32   # Re-Pair: rounds over the sequences, new rules a round at most
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

_STATES = 4             # nothing yet, after s, after u, after a
_NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_ACCEPTED = (0, 3)
_LEGAL = {"su", "ua", "au"}


# ---------------------------------------------------------------- min-plus matrices with audit ropes

class Rope:
    """A string as a tree of shared parts; written out, and kept, only when it is compared or returned."""

    __slots__ = ("left", "right", "text")

    def __init__(self, text: str | None = None, left: Rope | None = None, right: Rope | None = None) -> None:
        self.text, self.left, self.right = text, left, right

    def __str__(self) -> str:
        if self.text is None:
            parts, todo = [], [self]
            while todo:
                rope = todo.pop()
                if rope.text is None:
                    todo += (rope.right, rope.left)
                else:
                    parts.append(rope.text)
            self.text, self.left, self.right = "".join(parts), None, None
        return self.text


Matrix = list  # of rows, one per state before; an entry is (cost, Rope) or None


def _least(found: list[tuple[int, Rope]]) -> tuple[int, Rope] | None:
    if not found:
        return None
    cost = min(f[0] for f in found)
    ropes = [f[1] for f in found if f[0] == cost]
    return cost, ropes[0] if len(ropes) == 1 else min(ropes, key=str)


def row_times(row: list, matrix: Matrix) -> list:
    return [_least([(a[0] + b[0], Rope(None, a[1], b[1])) for a, m in zip(row, matrix) if a and (b := m[q])])
            for q in range(_STATES)]


def times(left: Matrix, right: Matrix) -> Matrix:
    return [row_times(row, right) for row in left]


def identity() -> Matrix:
    return [[(0, Rope("")) if p == q else None for q in range(_STATES)] for p in range(_STATES)]


def _inserts() -> Matrix:
    """Any number of inserted users and assistants; more than two in a row never lead to a new state."""
    one = [[next(((INSERT, Rope("I")) for c in "ua" if _NEXT[c].get(p) == q), None) for q in range(_STATES)]
           for p in range(_STATES)]
    found = identity()
    for _ in range(2):
        more = times(found, one)
        found = [[_least([e for e in (found[p][q], more[p][q]) if e]) for q in range(_STATES)] for p in range(_STATES)]
    return found


INSERTS = _inserts()


def symbol_matrix(symbol: str) -> Matrix:
    """Inserts, then what may happen to one row."""
    extra = TRUNCATED if symbol.isupper() else 0
    edits: list[list[list]] = [[[] for _ in range(_STATES)] for _ in range(_STATES)]
    for p in range(_STATES):
        edits[p][p].append((DELETE, Rope("D")))
        if symbol == "x":
            continue
        kept = _NEXT.get(symbol.lower(), {}).get(p)
        if kept is not None:
            edits[p][kept].append((KEEP + extra, Rope("K")))
        for c in "ua":
            if p in _NEXT[c]:
                edits[p][_NEXT[c][p]].append((REROLE + extra, Rope("R")))
    return times(INSERTS, [[_least(e) for e in row] for row in edits])


class Grammar:
    """Re-Pair rules, their matrices bottom-up, and the evaluation of sequences with them."""

    def __init__(self, rules: list[str]) -> None:
        self.rules = rules
        self.matrices = {s: symbol_matrix(s) for s in "suaoSUAOx"}
        for k, (left, right) in enumerate(rules):
            self.matrices[rule_symbol(k)] = times(self.matrices[left], self.matrices[right])

    def compress(self, sequence: str) -> str:
        for k, pair in enumerate(self.rules):
            sequence = sequence.replace(pair, rule_symbol(k))
        return sequence

    def row(self, sequence: str, row: list) -> list:
        for s in self.compress(sequence):
            row = row_times(row, self.matrices[s])
        return row

    def matrix(self, sequence: str) -> Matrix:
        return [self.row(sequence, row) for row in identity()]


def rule_symbol(k: int) -> str:
    return chr(0x100 + k)


def accepted(row: list) -> tuple[int, str]:
    """The cheapest end of a row of states after all symbols."""
    cost, rope = _least([e for q, e in enumerate(row_times(row, INSERTS)) if e and q in _ACCEPTED])
    return cost, str(rope)


# ---------------------------------------------------------------- rows to symbols

def _seen(row: Column) -> Column:
    return row.rlike(r"[^\x20\x09-\x0D]")


def row_marks(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, said, initial, blank, truncated`` and whether role and text were said at an earlier turn.

    ``said`` is a digest of role and text.  The earliest turn of each is aggregated before it is joined back, so
    a text that a conversation repeats without end is a join of many rows to one, which Spark may split.
    """
    said = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    marks = rows.select("conv_id", "turn", said.alias("said"), F.substring("role", 1, 1).alias("initial"),
                        (~_seen(F.col("text"))).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"))
    first = (marks.groupBy(F.col("conv_id").alias("c"), F.col("said").alias("s"))
             .agg(F.min(F.struct("turn")).alias("first")))
    joined = marks.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")))
    return joined.select("conv_id", "turn", "said", "initial", "blank", "truncated",
                         (~F.col("turn").eqNullSafe(F.col("first.turn"))).alias("again"))


_CHUNK_FIELDS = [("part", T.IntegerType()), ("chunk", T.LongType()), ("whole", T.BooleanType()), ("symbols", T.StringType()),
                 ("first_turn", T.LongType()), ("last_turn", T.LongType()), ("least", T.LongType()), ("most", T.LongType()),
                 ("turns", T.LongType()), ("blank", T.LongType()), ("duplicate", T.LongType()), ("truncated", T.LongType()),
                 ("illegal", T.LongType()), ("first_initial", T.StringType()), ("last_initial", T.StringType())]
_COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*[c.to_pylist() for c in batch.columns])


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def _new_chunk(conv, part: int, chunk: int, turn, initial: str) -> dict:
    return {"conv_id": conv, "part": part, "chunk": chunk, "whole": False, "symbols": [], "first_turn": turn, "last_turn": turn,
            "least": turn, "most": turn, "turns": 0 if turn is None else 1, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0,
            "first_initial": initial, "last_initial": None}


def chunk_rows(marks: DataFrame, size: int = CHUNK) -> DataFrame:
    """The conversations' rows in order as chunks: symbols, counts and the ends at which chunks meet.

    ``whole``: the conversation is this one chunk.  A conversation at a partition's edge may go on in the next.
    """
    schema = T.StructType([marks.schema["conv_id"], *[T.StructField(n, t) for n, t in _CHUNK_FIELDS]])
    order = ["conv_id", "turn", "said"]
    ordered = marks.repartitionByRange(*order).sortWithinPartitions(*order)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, part = _arrow(schema), TaskContext.get().partitionId()
        at, done, before, convs, n = None, [], None, 0, 0

        def close(ends: bool) -> None:
            # the first and the last conversation of a partition may have rows elsewhere
            at["whole"] = bool(ends and convs > 1 and at["chunk"] == 0)
            at["symbols"] = "".join(at["symbols"])
            done.append(at)

        for batch in batches:
            for conv, turn, said, initial, blank, truncated, again in _rows(batch):
                if before is None or conv != before[0]:
                    if at is not None:
                        close(True)
                    convs, n = convs + 1, 0
                    at = _new_chunk(conv, part, n, turn, initial)
                elif len(at["symbols"]) == size:
                    close(False)
                    n += 1
                    at = _new_chunk(conv, part, n, turn, initial)
                else:
                    at["illegal"] += at["last_initial"] + initial not in _LEGAL
                    at["turns"] += turn is not None and turn != at["last_turn"]
                again = again or before == (conv, turn, said)
                fault = "blank" if blank else "duplicate" if again else "truncated" if truncated else None
                if fault:
                    at[fault] += 1
                kind = initial if initial and initial in "sua" else "o"
                at["symbols"].append("x" if fault in ("blank", "duplicate") else kind.upper() if fault else kind)
                at["last_initial"], at["last_turn"], before = initial, turn, (conv, turn, said)
                if turn is not None:
                    at["least"] = turn if at["least"] is None else at["least"]
                    at["most"] = turn
            if done:
                yield _batch(done, arrow)
                done = []
        if at is not None:
            close(False)
            yield _batch(done, arrow)

    return ordered.select("conv_id", "turn", "said", "initial", "blank", "truncated", "again").mapInArrow(chunks, schema)


# ---------------------------------------------------------------- the grammar

def learn_rules(sequences: DataFrame, rounds: int = ROUNDS, pairs: int = PAIRS) -> list[str]:
    """Re-Pair over ``symbols, count``: each round's most frequent pairs that do not get in each other's way.

    Only the best pairs of a round come to the driver.  Sequences stay distributed, and rules are applied to them anew.
    """
    rules: list[str] = []
    for _ in range(rounds):
        known = list(rules)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: Counter = Counter()
            for batch in batches:
                for sequence, times_ in _rows(batch):
                    for k, pair in enumerate(known):
                        sequence = sequence.replace(pair, rule_symbol(k))
                    last = None
                    for pair in map("".join, zip(sequence, sequence[1:])):
                        if pair == last and pair[0] == pair[1]:     # aaa holds one pair aa
                            last = None
                            continue
                        found[pair] += times_
                        last = pair
            yield pa.RecordBatch.from_pydict({"pair": list(found), "n": list(found.values())},
                                             schema=pa.schema([("pair", pa.string()), ("n", pa.int64())]))

        best = (sequences.mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
                .where("n > 1").orderBy(F.desc("n"), "pair").limit(pairs).collect())
        lefts, rights, new = set(), set(), []
        for row in best:
            left, right = row["pair"]
            if left not in rights and right not in lefts:
                new.append(row["pair"])
                lefts.add(left)
                rights.add(right)
        if not new:
            break
        rules += new
    return rules


# ---------------------------------------------------------------- evaluation

_MATRIX = [("costs", T.ArrayType(T.LongType())), ("audits", T.ArrayType(T.StringType()))]
_RESULT = [*[(n, T.LongType()) for n in ("gaps", *_COUNTS, "cost")], ("audit", T.StringType())]


def _gaps(least, most, turns: int) -> int:
    return 0 if least is None else most - least + 1 - turns


def evaluate(chunks: DataFrame, rules: list[str]) -> DataFrame:
    """Chunks with the result of a whole conversation, or with the matrix of a part of one."""
    fields = {f.name: f for f in chunks.schema}
    schema = T.StructType([f for f in fields.values() if f.name != "symbols"]
                          + [T.StructField(n, t) for n, t in [*_MATRIX, ("gaps", T.LongType()), ("cost", T.LongType()),
                                                              ("audit", T.StringType())]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, arrow, known = Grammar(rules), _arrow(schema), {}
        for batch in batches:
            out = batch.to_pylist()
            for chunk in out:
                symbols = chunk.pop("symbols")
                if chunk["whole"]:
                    if symbols not in known:
                        if len(known) > 4096:
                            known.clear()
                        known[symbols] = accepted(grammar.row(symbols, identity()[0]))
                    chunk["cost"], chunk["audit"] = known[symbols]
                    chunk["gaps"] = _gaps(chunk["least"], chunk["most"], chunk["turns"])
                else:
                    entries = [e for row in grammar.matrix(symbols) for e in row]
                    chunk["costs"] = [e and e[0] for e in entries]
                    chunk["audits"] = [e and str(e[1]) for e in entries]
            yield _batch(out, arrow)

    return chunks.mapInArrow(run, schema)


def fold_parts(parts: DataFrame) -> DataFrame:
    """The results of conversations of several chunks: matrices multiplied and ends compared, in order, as a stream."""
    schema = T.StructType([parts.schema["conv_id"], *[T.StructField(n, t) for n, t in _RESULT]])
    wanted = ["conv_id", "part", "chunk", "first_turn", "last_turn", "least", "most", "turns", *_COUNTS,
              "first_initial", "last_initial", "costs", "audits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, at, row, done = _arrow(schema), None, None, []

        def close() -> None:
            cost, audit = accepted(row)
            done.append({"conv_id": at["conv_id"], "gaps": _gaps(at["least"], at["most"], at["turns"]),
                         **{c: at[c] for c in _COUNTS}, "cost": cost, "audit": audit})

        for batch in batches:
            for chunk in batch.to_pylist():
                if at is not None and chunk["conv_id"] == at["conv_id"]:
                    for c in _COUNTS:
                        at[c] += chunk[c]
                    at["illegal"] += at["last_initial"] + chunk["first_initial"] not in _LEGAL
                    at["turns"] += chunk["turns"] - (chunk["first_turn"] is not None and chunk["first_turn"] == at["last_turn"])
                    at["least"] = chunk["least"] if at["least"] is None else at["least"]
                    at["most"] = at["most"] if chunk["most"] is None else chunk["most"]
                    at["last_turn"], at["last_initial"] = chunk["last_turn"], chunk["last_initial"]
                else:
                    if at is not None:
                        close()
                    at, row = chunk, identity()[0]
                entries = iter([None if c is None else (c, Rope(a)) for c, a in zip(chunk["costs"], chunk["audits"])])
                row = row_times(row, [[next(entries) for _ in range(_STATES)] for _ in range(_STATES)])
            if done:
                yield _batch(done, arrow)
                done = []
        if at is not None:
            close()
            yield _batch(done, arrow)

    ordered = parts.select(*wanted).repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk")
    return ordered.mapInArrow(run, schema)


def replay(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The repaired ``(role, text)`` rows: kept ones, and users and assistants in turn."""
    state = 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if state == 2 else "user"
        state = _NEXT[role[:1]][state]
        yield role, text


def repaired_digests(rows: DataFrame, results: DataFrame, ids: DataFrame) -> DataFrame:
    """Results of all ids with the SHA-256 of the repaired rows, which pass by in order and are never held."""
    schema = T.StructType([results.schema["conv_id"], *[T.StructField(n, t) for n, t in _RESULT], T.StructField("repaired_sha256", T.StringType())])
    names = [n for n, _ in _RESULT]
    none = [F.lit(None).cast(t).alias(n) for n, t in _RESULT]
    said = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    texts = rows.select("conv_id", F.lit(1).alias("kind"), "turn", said.alias("said"), "role", "text", *none)
    no_text = [F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("said"),
               F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text")]
    heads = results.select("conv_id", F.lit(0).alias("kind"), *no_text, *names)
    asked = ids.select("conv_id").distinct().select("conv_id", F.lit(2).alias("kind"), *no_text, *none)
    ordered = (heads.unionByName(texts).unionByName(asked).repartition("conv_id")
               .sortWithinPartitions("conv_id", "kind", "turn", "said")
               .select("conv_id", "kind", "role", "text", *names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow(schema)
        rest = (row for batch in batches for row in _rows(batch))
        ahead = next(rest, None)
        done, chars = [], 0
        while ahead is not None:
            conv, result, digest, first = ahead[0], [0, 0, 0, 0, 0, 0, ""], hashlib.sha256(), True
            if ahead[1] == 0:
                result, ahead = list(ahead[4:]), next(rest, None)

                def texts_() -> Iterator[tuple[str, str]]:
                    nonlocal ahead
                    while ahead is not None and ahead[0] == conv and ahead[1] == 1:
                        row, ahead = ahead, next(rest, None)
                        yield row[2], row[3]

                mine = texts_()
                for role, text in replay(result[-1], mine):
                    digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                    first = False
                for _ in mine:
                    raise RuntimeError("a conversation has rows that its audit does not know")
            while ahead is not None and ahead[0] == conv:
                ahead = next(rest, None)
            done.append({"conv_id": conv, **dict(zip(names, result)), "repaired_sha256": digest.hexdigest()})
            chars += len(result[-1])
            if len(done) == 5000 or chars > 1 << 24:
                yield _batch(done, arrow)
                done, chars = [], 0
        if done:
            yield _batch(done, arrow)

    return ordered.mapInArrow(run, schema)


def repair_conversations(rows: DataFrame, ids: DataFrame | None = None, chunk: int = CHUNK, rounds: int = ROUNDS,
                         pairs: int = PAIRS) -> DataFrame:
    """Faults, cheapest repair and digest of the repaired rows of every conversation.

    ``rows``: ``conv_id, turn, role, text``; null roles and texts count as one space (a blank text, an initial that
    cannot stay), null turns come first, rows of one turn go by the digest of role and text, and equal rows of a
    turn are duplicates of the first.  An empty role has no initial: its row is reroled or deleted.  ``ids`` (default: those of
    ``rows``): conversations to return; one without rows has zeros, an empty audit and the empty string's digest.  A null
    conv_id is a conversation too; other columns are ignored.  Long texts and conversations stay whole: only
    the symbols of a chunk and one batch of texts are held at a time; an audit is as long as its conversation.
    """
    clean = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"))
    chunks = stored(chunk_rows(row_marks(clean), chunk), "repair-chunks")
    sequences = stored(chunks.groupBy("symbols").agg(F.count("*").alias("n")), "repair-sequences")
    found = stored(evaluate(chunks, learn_rules(sequences, rounds, pairs)), "repair-parts")
    names = ["conv_id", *[n for n, _ in _RESULT]]
    results = found.where("whole").select(*names).unionByName(fold_parts(found.where("NOT whole")))
    return repaired_digests(clean, results, clean if ids is None else ids)


# ---------------------------------------------------------------- the query

def damaged(rows: DataFrame) -> DataFrame:
    """Rows broken on purpose by crc32 of ``conv_id:turn``: dropped, emptied, unpunctuated, repeated, made a user's."""
    blank = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"),
                            F.coalesce(F.col("turn").cast("string"), blank))) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    broken = rows.select(
        "conv_id", "turn", kind.alias("kind"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return broken.where("kind <> 0").select("conv_id", "turn", "role", "text", copies.alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair_conversations(damaged(rows), rows.select("conv_id"))


OP13_SQL = r"""
WITH RECURSIVE crcs AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_concat([b], range(8)),
         lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
         FROM (SELECT unnest(range(256)) AS b))),
     keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                      coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
     hashed AS (SELECT keyed.*, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT)),
                    lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), 4294967295) % 20 AS kind FROM keyed, crcs),
     broken AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                       CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                       unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM hashed WHERE kind <> 0),
     dealt AS (SELECT *, sha256(length(role) || ':' || role || text) AS said, substr(role, 1, 1) AS initial FROM broken),
     placed AS (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, said ORDER BY turn NULLS FIRST, copy) AS nth,
                       lag(initial) OVER w AS before
                FROM dealt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, said, copy)),
     marked AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
                               WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM placed),
     ins(p, q, c, a) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (1, 2, 5, 'I'), (3, 2, 5, 'I'),
                                (2, 3, 5, 'I'), (0, 3, 10, 'II'), (1, 3, 10, 'II')),
     edits(initial, p, q, c, a) AS (VALUES ('s', 0, 1, 0, 'K'), ('u', 0, 2, 0, 'K'), ('u', 1, 2, 0, 'K'), ('u', 3, 2, 0, 'K'), ('a', 2, 3, 0, 'K'),
                                ('*', 0, 2, 1, 'R'), ('*', 1, 2, 1, 'R'), ('*', 3, 2, 1, 'R'), ('*', 2, 3, 1, 'R'),
                                ('*', 0, 0, 2, 'D'), ('*', 1, 1, 2, 'D'), ('*', 2, 2, 2, 'D'), ('*', 3, 3, 2, 'D')),
     steps AS (SELECT conv_id, i, ins.p, edits.q, ins.c + edits.c + CASE WHEN fault = 'truncated' AND edits.a <> 'D' THEN 5 ELSE 0 END AS c,
                      ins.a || edits.a AS a
               FROM marked JOIN edits ON edits.initial IN ('*', marked.initial) AND (edits.a = 'D' OR fault NOT IN ('blank', 'duplicate'))
                    JOIN ins ON ins.q = edits.p),
     ids AS (SELECT DISTINCT conv_id FROM conversations),
     paths AS (SELECT conv_id, 0::BIGINT AS i, 0 AS q, {'c': 0, 'a': ''} AS best FROM ids
               UNION ALL
               SELECT paths.conv_id, paths.i + 1, steps.q, min({'c': best.c + steps.c, 'a': best.a || steps.a})
               FROM paths JOIN steps ON steps.conv_id IS NOT DISTINCT FROM paths.conv_id AND steps.i = paths.i + 1 AND steps.p = paths.q
               GROUP BY paths.conv_id, paths.i, steps.q),
     sizes AS (SELECT ids.conv_id, count(marked.i) AS n, coalesce(count_if(fault = 'blank'), 0) AS blank,
                      coalesce(count_if(fault = 'duplicate'), 0) AS duplicate, coalesce(count_if(fault = 'truncated'), 0) AS truncated,
                      coalesce(count_if(before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')), 0) AS illegal,
                      coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps
               FROM ids LEFT JOIN marked ON marked.conv_id IS NOT DISTINCT FROM ids.conv_id GROUP BY ids.conv_id),
     ends AS (SELECT sizes.conv_id, min({'c': best.c + ins.c, 'a': best.a || ins.a}) AS best
              FROM sizes JOIN paths ON paths.conv_id IS NOT DISTINCT FROM sizes.conv_id AND paths.i = sizes.n
                   JOIN ins ON ins.p = paths.q AND ins.q IN (0, 3) GROUP BY sizes.conv_id),
     letters AS (SELECT conv_id, unnest(range(1, length(best.a) + 1)) AS j, unnest(string_split(best.a, '')) AS e FROM ends),
     taken AS (SELECT *, count_if(e <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS i FROM letters),
     kept AS (SELECT taken.conv_id, taken.j, e, role, text, initial,
                     row_number() OVER (PARTITION BY taken.conv_id ORDER BY j) AS k, first_value(e = 'K' AND initial = 's') OVER (PARTITION BY taken.conv_id ORDER BY j) AS led
              FROM taken LEFT JOIN marked ON marked.conv_id IS NOT DISTINCT FROM taken.conv_id AND marked.i = taken.i AND e <> 'I' WHERE e <> 'D'),
     said AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (k - CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END
                     || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS whole FROM kept GROUP BY conv_id)
SELECT sizes.conv_id, gaps::BIGINT AS gaps, blank::BIGINT AS blank, duplicate::BIGINT AS duplicate, truncated::BIGINT AS truncated,
       illegal::BIGINT AS illegal, best.c::BIGINT AS cost, best.a AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM sizes JOIN ends ON ends.conv_id IS NOT DISTINCT FROM sizes.conv_id LEFT JOIN said ON said.conv_id IS NOT DISTINCT FROM sizes.conv_id
"""

import hashlib
import heapq
import random
import re
import zlib
from functools import lru_cache

from pyspark.sql import functions as F

from paraspark.llm.conversation_repair import (
    Grammar, accepted, damaged, identity, learn_rules, op13_conversation_repair, repair_conversations)
from tests.llm.helpers import rows_by

ROWS = "conv_id long, turn long, role string, text string"
FORM = re.compile(r"(s?(ua)+)?")
TEXTS = ["Fine.", "Yes!", "cut off", "", "  \n", None, "Why? \t", ".x", "a.\u0085", "é😀漢."]
ROLES = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "ux", "User"]


@lru_cache(None)
def cheapest(symbols):
    """Least (cost, audit): every edit tried in order of cost, then audit."""
    def after(state, initial):
        out = {"": "", "s": "s", "u": "u", "a": "ua"}[state] + initial
        return {"s": "s", "u": "u", "su": "u", "uau": "u", "ua": "a"}.get(out)

    todo, done = [(0, "", 0, "")], set()
    while todo:
        cost, audit, at, state = heapq.heappop(todo)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(symbols) and state in ("", "a"):
            return cost, audit
        for c in "ua":
            if after(state, c):
                heapq.heappush(todo, (cost + 5, audit + "I", at, after(state, c)))
        if at < len(symbols):
            kind = symbols[at]
            heapq.heappush(todo, (cost + 2, audit + "D", at + 1, state))
            extra = 5 if kind.isupper() else 0
            for c, edit in ((kind.lower(), "K"), ("u", "R"), ("a", "R")):
                if kind != "x" and after(state, c):
                    heapq.heappush(todo, (cost + extra + (edit == "R"), audit + edit, at + 1, after(state, c)))


def brute(rows):
    """rows of one conversation after damage, null roles and texts as spaces."""
    def digest(r):
        return hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
    rows = sorted(((t, r or "" if r is not None else " ", " " if x is None else x) for t, r, x in rows),
                  key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
    seen, symbols, faults = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
        symbols += "x" if fault in ("blank", "duplicate") else kind.upper() if fault else kind
    cost, audit = cheapest(symbols)
    out, left = [], list(rows)
    for e in audit:
        role, text = ("", "") if e == "I" else left.pop(0)[1:]
        if e in "RI":
            role = "assistant" if out and out[-1][0][0] == "u" else "user"
        if e != "D":
            out.append((role, text))
    assert not left and FORM.fullmatch("".join(r[0] for r, _ in out))
    turns = [r[0] for r in rows if r[0] is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **faults,
            "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()}


def check(got, rows, ids):
    assert set(got) == set(ids)
    for conv, row in got.items():
        want = brute([r[1:] for r in rows if r[0] == conv])
        assert {k: row[k] for k in want} == want, conv


def random_rows(rng, convs):
    rows = []
    for c in range(convs):
        for k in range(rng.randint(1, 9)):
            rows.append((c, rng.choice([k, k, k, k // 2, None, -3]), rng.choice(ROLES), rng.choice(TEXTS)))
    return rows


def test_matches_brute_force_in_one_chunk_and_many(spark):
    rng = random.Random(5)
    rows = random_rows(rng, 120) + [(None, 0, "user", "A."), (None, 1, "assistant", "B.")]
    # a conversation over several partitions: five hundred rows, a third of all, many of them said before
    rows += [(1000, k, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice(["Hm.", "cut", f"Row {k}."]))
             for k in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, ROWS).withColumn("cost", F.lit("x"))
    for chunk in (2048, 7):
        check(rows_by(repair_conversations(df, chunk=chunk), "conv_id"), rows, {r[0] for r in rows})


def test_empty_tables_and_ids_without_rows(spark):
    none = spark.createDataFrame([], ROWS)
    assert repair_conversations(none).count() == 0
    ids = spark.createDataFrame([(4,), (4,), (None,)], "conv_id long")
    got = rows_by(repair_conversations(none, ids), "conv_id")
    assert set(got) == {4, None}
    assert got[4]["audit"] == "" and got[4]["cost"] == got[4]["gaps"] == 0
    assert got[4]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


def test_grammar_changes_nothing(spark):
    rng = random.Random(8)
    seqs = ["".join(rng.choice("suaoSUAOx" + "ua" * 9) for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["ua" * 700, "x" * 900]
    df = spark.createDataFrame([(s, rng.randint(1, 5)) for s in seqs], "symbols string, n long")
    rules = learn_rules(df, rounds=4, pairs=8)
    assert len(rules) > 10 and len(Grammar(rules).compress("ua" * 700)) < 200
    for s in seqs[:60] + seqs[-2:]:
        with_, without = Grammar(rules), Grammar([])
        want = accepted(without.row(s, identity()[0]))
        assert accepted(with_.row(s, identity()[0])) == want
        if len(s) < 300:
            assert want == cheapest(s)


def test_damage_by_crc(spark):
    rows = [(c, t, "assistant", "Who? Me! No.") for c in range(20) for t in range(10)] + [(None, None, None, None)]
    got = [tuple(r) for r in damaged(spark.createDataFrame(rows, ROWS)).collect()]
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", " " if text is None else text
        row = (c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        want += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_query_returns_every_conversation(spark, tmp_path):
    rng = random.Random(9)
    rows = random_rows(rng, 60)
    spark.createDataFrame(rows, ROWS).write.parquet(f"{tmp_path}/conversations.parquet")
    after = [tuple(r) for r in damaged(spark.createDataFrame(rows, ROWS)).collect()]
    check(rows_by(op13_conversation_repair(spark, str(tmp_path)), "conv_id"), after, {r[0] for r in rows})

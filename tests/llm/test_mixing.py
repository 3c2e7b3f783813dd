import hashlib
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from paraspark.llm.mixing import NOISE, OP8_SQL, mix_sources
from tests.llm.helpers import DOCS, WORDS, edge_texts, rows_by, sentence


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS)


def brute(rows):
    size = {i: len(WORDS.findall(t or "")) for i, t, _ in rows}
    names = sorted({s for _, _, s in rows if s is not None}) + ([None] if any(s is None for _, _, s in rows) else [])
    total = {n: sum(size[i] for i, _, s in rows if s == n) for n in names}
    weight = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
    target, open_names, left = {}, list(names), 1.5 * sum(total.values())
    while True:
        share = {n: left * weight[n] / sum(weight[m] for m in open_names) for n in open_names}
        over = [n for n in open_names if share[n] > 2 * total[n]]
        if not over:
            target |= share
            break
        for n in over:
            target[n] = 2.0 * total[n]
            left -= target[n]
            open_names.remove(n)
    taken = {}
    for n in names:
        def key(row):
            i, t, _ = row
            u = (int(hashlib.md5(f"mix-1:{i}".encode()).hexdigest()[:13], 16) + 1) / 2 ** 52
            clean = sum(c not in NOISE for c in t or "")
            return -math.log(u) / ((1 + 9 * clean / len(t)) / 10 if t else 1.0), i
        epochs = int(target[n] // total[n]) if total[n] else 0
        start, rest = 0, target[n] - epochs * total[n]
        for row in sorted((r for r in rows if r[2] == n), key=key):
            taken[row[0]] = size[row[0]] * (epochs + (start + size[row[0]] / 2 <= rest))
            start += size[row[0]]
    return {i: (size[i], total[s], target[s], taken[i]) for i, _, s in rows}


@pytest.mark.parametrize("cells", [1024, 3])
def test_matches_brute_force_and_meets_targets(spark, cells):
    rng = random.Random(6)
    rows = [(i, t, "hot") for i, t in enumerate(edge_texts())]
    rows += [(100 + i, " ".join(sentence(rng, rng.randint(0, 60))) + "#1" * (i % 3), rng.choice(["hot", "hot", "a", "é", "😀", None])) for i in range(300)]
    want = brute(rows)
    got = rows_by(mix_sources(table(spark, rows), cells=cells), "doc_id")
    assert set(got) == set(want)
    for i, (size, total, target, taken) in want.items():
        r = got[i]
        assert (r["size"], r["source_size"], r["taken"]) == (size, total, taken)
        assert r["target"] == pytest.approx(target)
        assert r["taken"] <= 2 * r["size"]
    for name in ("a", "é", "😀", None):
        members = [r for r in got.values() if r["source"] == name]
        assert abs(sum(r["taken"] for r in members) - members[0]["target"]) <= max(r["size"] for r in members) / 2 + 1


def test_sql_agrees(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(sentence(rng, 20)), rng.choice(["x", "y", None])) for i in range(60)] + [(99, None, "y")]
    documents = table(spark, rows).toPandas()
    con = duckdb.connect()
    con.register("documents", documents)
    want = {r[0]: r[1:] for r in con.execute(OP8_SQL).fetchall()}
    got = {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in mix_sources(table(spark, rows)).drop("source").collect()}
    assert got == want


def test_empty_table_repeated_rows_null_ids_and_extra_columns(spark):
    assert mix_sources(table(spark, [])).count() == 0
    rows = [(1, "a b", "s"), (1, "a b", "s"), (None, "c", "s"), (2, None, None)]
    clash = table(spark, rows).withColumn("cell", F.lit("x")).withColumn("target", F.lit(0)).withColumn("name", F.lit(1))
    got = mix_sources(clash).collect()
    assert sorted((r.doc_id or 0, r.size) for r in got) == [(0, 1), (1, 2), (1, 2), (2, 0)]
    assert mix_sources(table(spark, [(1, "", "s"), (2, None, "t")])).agg(F.sum("taken")).first()[0] == 0

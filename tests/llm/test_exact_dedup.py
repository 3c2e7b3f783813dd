import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from paraspark.llm.exact_dedup import build_directory, exact_dedup
from tests.llm.helpers import docs, edge_texts, rows_by


def brute(pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[t or ""].append(i)
    return {(i, t): (max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]),
                     hashlib.sha256((t or "").encode()).hexdigest()) for i, t in pairs}


def test_matches_brute_force_on_edges_and_hot_groups(spark):
    texts = edge_texts() + ["hot copy"] * 300 + [f"text {i % 40}" for i in range(120)]
    pairs = list(enumerate(texts))
    want = {i: v for (i, _), v in brute(pairs).items()}
    got = rows_by(exact_dedup(docs(spark, pairs), capacity=8), "doc_id")
    assert len(got) == len(pairs)
    for i, row in got.items():
        assert (row["keep_id"], row["group_size"], row["kept"], row["text_sha256"]) == want[i]


def test_directory_doubles_until_buckets_fit(spark):
    entries = docs(spark, [f"t{i}" for i in range(500)] + ["same"] * 500).select(F.xxhash64("text").alias("key"))
    depth, directory = build_directory(entries, capacity=16)
    assert len(directory) == 1 << depth
    held = defaultdict(set)
    for (key,) in entries.collect():
        held[directory[(key % (1 << 64)) >> (64 - depth)][0]].add(key)
    assert max(map(len, held.values())) <= 16
    assert sum(map(len, held.values())) == 501


def test_repeated_ids_null_ids_empty_table_and_extra_columns(spark):
    repeated = docs(spark, [(7, "a"), (7, "a"), (7, "b"), (None, "b")])
    got = sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_dedup(repeated).collect())
    assert got == [(0, 7, 2, False), (7, 7, 2, True), (7, 7, 2, True), (7, 7, 2, True)]
    assert exact_dedup(docs(spark, [])).count() == 0
    clash = docs(spark, ["a", "a"]).withColumn("key", F.lit(1)).withColumn("kept", F.lit("x")).withColumn("bucket", F.lit(2))
    assert sorted(r.kept for r in exact_dedup(clash).collect()) == [False, True]

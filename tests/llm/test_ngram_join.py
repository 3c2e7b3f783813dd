import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paraspark.llm import ngram_join as N
from paraspark.llm.components import components
from paraspark.llm.shingles import shingle_set, word_hashes
from tests.llm.helpers import docs, edge_texts, find_components, jaccard_linked, rows_by, sentence, shingles


def corpus(copies: int) -> list:
    """Edge texts, a group of near copies of several distances, and a passage many texts share."""
    rng = random.Random(11)
    base, passage = sentence(rng, 120), sentence(rng, 40)
    texts = edge_texts()
    for k in range(copies):
        words = list(base)
        for at in rng.sample(range(len(words)), k % 5):
            words[at] = f"edit{k}x{at}"
        texts.append(" ".join(words))
    for _ in range(copies):
        texts.append(" ".join(sentence(rng, rng.randint(5, 60)) + passage))
    for n in (1, 4, 5, 6, 9):
        short = sentence(rng, n)
        texts += [" ".join(short), " ".join(short).upper(), " ".join([*short, "end"])]
    return texts


def expected(texts):
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    comps = find_components(list(sets), lambda a, b: jaccard_linked(sets[a], sets[b]))
    return {i: (len(sets[i]), comps[i]) for i in sets}


@pytest.mark.parametrize(("block", "rare"), [(256, 39), (4, 39), (4, 0)])
def test_matches_brute_force(spark, monkeypatch, block, rare):
    # small blocks: groups are split by length and block; no rare tokens: all are aggregated first
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "RARE_LEVEL", rare)
    texts = corpus(40)
    want = expected(texts)
    got = rows_by(N.ngram_join(docs(spark, texts)), "doc_id")
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want


def test_repeated_ids_null_ids_empty_and_extra_columns(spark):
    text = " ".join(f"w{i}" for i in range(30))
    got = [tuple(r) for r in N.ngram_join(docs(spark, [(5, text), (5, text), (None, text), (9, text + " z"), (3, "other words")]))
           .select("doc_id", "component_id").collect()]
    assert sorted(got, key=str) == sorted([(5, 5), (5, 5), (None, 5), (9, 5), (3, 3)], key=str)
    assert N.ngram_join(docs(spark, [])).count() == 0
    clash = docs(spark, [text, text]).withColumn("node", F.lit(1)).withColumn("tokens", F.lit("x")).withColumn("n", F.lit(2))
    assert {r.component_id for r in N.ngram_join(clash).collect()} == {0}


def test_prefixes_of_linked_sets_meet_under_every_order():
    rng = np.random.default_rng(5)
    levels = np.zeros(1 << 12, np.uint8)
    levels[rng.integers(0, 1 << 12, 900)] = 7
    for _ in range(200):
        n = int(rng.integers(5, 80))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        drop = int(len(a) * 0.1)
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, drop).astype(np.uint64)]))
        shared = N.common(a, b)
        if 100 * shared >= 80 * (len(a) + len(b) - shared):
            for k in range(2):
                p, q = (N.other_prefix(x, N.ranks(x, levels), k, 80) for x in (a, b))
                assert N.common(p, q)


def test_words_are_hashed_alike_whatever_the_batch():
    texts = [t or "" for t in edge_texts()] + ["a\x0bb\x0cc\rd  e", "é é", "x" * 3_000_000 + " tail"]
    whole = [w.tolist() for w in word_hashes(pa.array(texts))]
    single = [next(word_hashes(pa.array([t]))).tolist() for t in texts]
    assert whole == single
    assert [len(w) for w in whole[-3:]] == [5, 2, 2]
    assert len(shingle_set(next(word_hashes(pa.array(["A b c"]))), 5)) == 1


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(200, 200), (300, 301), (301, 300), (None, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 0 for k in range(1, 61)} | {k: 100 for k in range(101, 160)} | {301: 300}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

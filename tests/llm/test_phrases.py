import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from paraspark.llm import phrases as P
from tests.llm.helpers import DOCS, edge_texts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [[w for w in re.split(r"[\x20\x09]+", p) if w] for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def brute(rows, least, top):
    langs = {}
    for _, text, lang in rows:
        f = langs.setdefault(lang if lang is not None else "und", Counter())
        for p in pieces(text):
            for k in range(1, 6):
                f.update(tuple(p[i:i + k]) for i in range(len(p) - k + 1))
    out = []
    for lang, f in langs.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            if any(f[q] >= a and any(q[j:j + len(p)] == p for j in range(len(q) - len(p) + 1))
                   for q in f if len(q) > len(p) and f[q] >= least):
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def made(rng, count, vocabulary=12):
    words = ["Alpha", "BETA", "é", "漢字", "x😀", "d-e", "f g"] + [f"w{k}" for k in range(vocabulary)]
    rows = [(i, t, "en") for i, t in enumerate(edge_texts()[:-2])]
    for i in range(count):
        text = "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", " ", " ", ", ", "\n", ".", " "]) for _ in range(rng.randint(0, 40)))
        rows.append((100 + i, text + rng.choice(["", "the same tail of words here", "Alpha beta w1"]), rng.choice(["en", "en", "de", None, "und"])))
    return rows + rows[-3:]


def mined(spark, rows, **options):
    df = spark.createDataFrame([(i, t, g, "s", 0) for i, t, g in rows], DOCS)
    return sorted(tuple(r) for r in P.collocations(df.repartition(3), **options).collect())


@pytest.mark.parametrize("least, top", [(4, 2000), (9, 7)])
def test_matches_brute_force(spark, least, top):
    rows = made(random.Random(11), 150)
    assert mined(spark, rows, least=least, top=top) == brute(rows, least, top)


def test_same_without_shared_counts_and_with_hot_pairs_spread(spark):
    rng = random.Random(12)
    # a third of all suffixes start with one pair
    rows = made(rng, 60) + [(1000 + i, "hot pair " + " ".join(rng.choice(["hot pair", "a", "b", "c"]) for _ in range(20)), "en") for i in range(60)]
    want = brute(rows, 5, 2000)
    assert mined(spark, rows, least=5, shared=0) == want
    assert mined(spark, rows, least=5, task_suffixes=100) == want


def test_empty_and_blank_tables(spark):
    assert mined(spark, [(1, None, "en"), (2, " .,\n", None)], least=1) == []
    assert mined(spark, [], least=1) == []
    assert mined(spark, [(1, "one two", None)], least=1) == [("und", 1, "one two", 1, 1, 1, 2, 2000)]


def test_quicksort_counts_every_prefix():
    rng = np.random.RandomState(3)
    words = rng.randint(1, 5, size=(3000, 5))
    for row, end in enumerate(rng.randint(2, 6, size=3000)):
        words[row, end:] = 0
    weight = rng.randint(1, 4, size=3000)
    want = Counter()
    for row, w in zip(words.tolist(), weight.tolist()):
        for k in range(1, 6):
            if row[k - 1]:
                want[tuple(row[:k])] += w
    for least in (1, 40, 10 ** 6):
        got = {tuple(words[r, :d].tolist()): n for d, r, n in P.multikey_counts(words, weight, least)}
        assert got == {k: n for k, n in want.items() if n >= least}


def test_long_texts_are_cut_at_pieces_and_long_words_hashed_whole(monkeypatch):
    monkeypatch.setattr(P, "SLICE_BYTES", 64)
    text = "one two three. " * 30 + "a" * 700 + " four\n" + "five six, " * 20
    found = [P.Words(*s, 1) for s in P._slices(pa.array([None, "ab CD", text, "", "cd"]))]
    words = [(int(w.text[k]), w.word(k).decode(), bool(w.goes_on[k])) for w in found for k in range(len(w.start))]
    want = [(i, w, k + 1 < len(p)) for i, t in enumerate([None, "ab CD", text, "", "cd"]) for p in pieces(t) for k, w in enumerate(p)]
    assert words == want
    ids = {}
    for w in found:
        for k, h in enumerate(w.hash):
            assert ids.setdefault(w.word(k), h) == h
    assert len(set(ids.values())) == len(ids)


def test_clash_is_noticed(monkeypatch):
    ids, check = np.array([7, 7, 9]), np.array([1, 2, 3])
    with pytest.raises(P.Clash):
        P._distinct(np.zeros(3, int), ids, check, np.ones(3, int))
    lang, ids, _, n = P._distinct(np.array([0, 0, 1]), np.array([7, 7, 7]), np.array([1, 1, 5]), np.ones(3, int))
    assert n.tolist() == [2, 1]

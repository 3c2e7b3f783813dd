"""Segmented bag intersections against bags counted pair by pair."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from paraspark.functions import bags


def grams(text, n):
    if n == 0:
        return Counter(text.split(" ") if text else [])
    if not text:
        return Counter()
    return Counter(text[i:i + n] for i in range(len(text) - n + 1)) if len(text) >= n else Counter([text])


def made(rng, alphabet, rows, longest):
    out = []
    for _ in range(rows):
        a = " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, longest)))
        b = rng.choice([a, "", a[1:], a.replace(alphabet[0], alphabet[-1]), a[::-1], a[:3]]).strip()
        out.append((a, " ".join(b.split())))
    return out


@pytest.mark.parametrize("slice_", [1 << 17, 40])
@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh", "é😀漢字́x", [chr(0x4e00 + k) for k in range(6000)]])
def test_overlaps_match_counters(monkeypatch, slice_, alphabet):
    monkeypatch.setattr(bags, "SLICE", slice_)
    pairs = made(random.Random(len(alphabet)), alphabet, 200, 12) + [("", ""), ("a", "a"), ("a", "b"), ("ab", "ab cd")]
    pred, ref = (pa.array(x) for x in zip(*pairs))
    shared, sizes = bags.overlaps(pred, ref, 6)
    for k, (p, r) in enumerate(pairs):
        for n in range(7):
            a, b = grams(p, n), grams(r, n)
            assert sizes[n, :, k].tolist() == [a.total(), b.total()]
            assert shared[n, k] == (a & b).total(), (p, r, n)


def test_sliced_arrays_no_rows_and_a_long_pair():
    rng = random.Random(1)
    long = "".join(rng.choice("abc ") for _ in range(700_000)).strip()
    pairs = [("x y", "y x"), (long, long[:-3] + "ddd"), ("same", "same")]
    pred, ref = (pa.array(["skip", *x]).slice(1) for x in zip(*pairs))
    shared, sizes = bags.overlaps(pred, ref, 6)
    for n in range(7):
        for k, (p, r) in enumerate(pairs):
            assert shared[n, k] == (grams(p, n) & grams(r, n)).total()
    shared, sizes = bags.overlaps(pa.array([], pa.string()), pa.array([], pa.string()), 6)
    assert shared.shape == (7, 0)


def test_f_scores():
    sizes = np.array([[0, 0, 4, 4, 2], [0, 3, 0, 4, 4]])
    assert bags.f_scores(np.array([0, 0, 0, 0, 2]), sizes, 1.0).tolist() == [1.0, 0.0, 0.0, 0.0, 2 / 3]


@pytest.mark.parametrize("slice_", [1 << 16, 40])
@pytest.mark.parametrize("alphabet", ["ab", "é😀漢字́x", [chr(0x4e00 + k) for k in range(6000)]])
def test_different_items_match_counters(monkeypatch, slice_, alphabet):
    monkeypatch.setattr(bags, "SLICE", slice_)
    pairs = made(random.Random(7 + len(alphabet)), alphabet, 150, 12) + [("", ""), ("a", "a"), ("", "ab"), ("aaaaaaa", "a a a")]
    shared, sizes, different = bags.counted(*(pa.array(x) for x in zip(*pairs)), 6)
    for k, (p, r) in enumerate(pairs):
        for n in range(7):
            a, b = grams(p, n), grams(r, n)
            assert different[n, :, k].tolist() == [len(a), len(b)] and sizes[n, :, k].tolist() == [a.total(), b.total()]
            assert shared[n, k] == (a & b).total()

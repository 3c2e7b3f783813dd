"""Fixture rows and brute-force versions shared by the tests of the subpackage."""

from __future__ import annotations

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rows_by(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def docs(spark, texts, lang="en", source="s"):
    """(id, text) pairs, or texts numbered from 0, as a documents table."""
    pairs = list(enumerate(texts)) if not texts or not isinstance(texts[0], tuple) else texts
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t in pairs], DOCS)


def sentence(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def edge_texts() -> list:
    """Null, empty, blank, one word, ties and a very long text."""
    rng = random.Random(3)
    long = " ".join(sentence(rng, 30_000))
    return [None, "", "  \n\t ", "word", "word", "two words", "Two  Words", "é😀漢 x " * 30, long, long + " tail"]


def shingles(text: str | None) -> set:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = WORDS.findall((text or "").translate(str.maketrans(upper, upper.lower())))
    if not words:
        return set()
    if len(words) < 5:
        return {tuple(words)}
    return {tuple(words[k:k + 5]) for k in range(len(words) - 4)}


def find_components(nodes, linked) -> dict:
    """node -> smallest node of its component; ``linked`` is asked for every pair."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ordered = sorted(nodes)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1:]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def jaccard_linked(a: set, b: set) -> bool:
    shared = len(a & b)
    return bool(a and b) and 100 * shared >= 80 * (len(a) + len(b) - shared)

import random
import time
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from paraspark.llm import common
from paraspark.llm import passage_dedup as P
from tests.llm.helpers import WORDS, docs, edge_texts, sentence


def planted(rng):
    """Texts with passages of 50 to 90 words inside long lines, near passages, copies and clean texts."""
    passages = [sentence(rng, n) for n in (50, 55, 70, 90)]
    texts = []
    for k in range(24):
        host = sentence(rng, 120)
        at = rng.randint(0, 120)
        texts.append(" ".join(host[:at] + passages[k % 4] + host[at:]))
    near = sentence(rng, 100)
    for k in range(4):
        words = list(near)
        words[50] = f"edit{k}"
        texts.append(" ".join(sentence(rng, 30) + words))
    # a run of 30 words that many texts share, alone or in one of two passages, must not hide the passages
    run = sentence(rng, 30)
    longer = [sentence(rng, 15) + run + sentence(rng, 15) for _ in range(2)]
    texts += [" ".join(sentence(rng, 40) + (longer[k % 2] if k % 3 else run) + sentence(rng, 40)) for k in range(18)]
    texts += [" ".join(near[:49])] + [" ".join(sentence(rng, 200)) for _ in range(10)]
    copy = " ".join(sentence(rng, 80))
    return texts + [copy] * 5 + edge_texts()


def brute_covered(texts):
    """id -> word places in a run of 50 words that another text, or another place, has."""
    seen: dict = {}
    words = {i: WORDS.findall((t or "").lower()) for i, t in enumerate(texts)}
    for i, w in words.items():
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k:k + 50]), []).append((i, k))
    covered: dict = {}
    for places in seen.values():
        if len({i for i, _ in places}) > 1:
            for i, k in places:
                covered.setdefault(i, set()).update(range(k, k + 50))
    return covered


@pytest.mark.parametrize("partners", [512, 2])
def test_finds_every_repeat_and_leaves_clean_texts(spark, monkeypatch, partners):
    monkeypatch.setattr(P, "PARTNERS", partners)
    texts = planted(random.Random(4))
    rows = P.repeated_passages(docs(spark, texts)).collect()
    spans: dict = {}
    for r in rows:
        spans.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
        assert r.n_words == r.end_word - r.start_word >= 50
    covered = brute_covered(texts)
    for i, places in covered.items():
        assert places <= spans[i]
    near = set(range(24, 28))
    assert set(spans) <= set(covered) | near
    # one span of each cluster stays, that of the smallest id
    clusters: dict = {}
    for r in rows:
        clusters.setdefault(r.cluster_id, []).append(r)
    for members in clusters.values():
        assert sum(not r.removed for r in members) == 1
        assert min(r.doc_id for r in members) == next(r.keep_id for r in members if not r.removed)


def test_equal_paragraphs_share_a_key_in_every_band():
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 1 << 63, 50).astype(np.uint64)
    for _ in range(100):
        texts = [np.concatenate([rng.integers(0, 1 << 63, rng.integers(0, 60)).astype(np.uint64), passage,
                                 rng.integers(0, 1 << 63, rng.integers(0, 60)).astype(np.uint64)]) for _ in range(2)]
        found = [set(P.grams(t, P.RUN)[P.anchors(t, 1)].tolist()) for t in texts]
        assert found[0] & found[1]
    assert P.bands_for(0.8, 0.95) == 2


def test_empty_table_null_ids_and_extra_columns(spark):
    assert P.repeated_passages(docs(spark, [])).count() == 0
    assert P.repeated_passages(docs(spark, edge_texts()[:7])).count() == 0
    text = " ".join(f"w{k}" for k in range(60))
    clash = docs(spark, [(None, text), (4, text), (2, text)]).withColumn("key", F.lit(1)).withColumn("node", F.lit("x"))
    got = {r.doc_id: (r.removed, r.keep_id) for r in P.repeated_passages(clash).collect()}
    assert got == {None: (True, 2), 4: (True, 2), 2: (False, 2)}


def survives(rows, texts, run):
    """Whether some text still has the words ``run`` side by side, none of them in a removed span."""
    gone: dict = {}
    for r in rows:
        if r.removed:
            gone.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    for i, text in enumerate(texts):
        words = text.split()
        for k in range(len(words) - len(run) + 1):
            if words[k:k + len(run)] == run and not gone.get(i, set()) & set(range(k, k + len(run))):
                return True
    return False


def test_copies_of_a_text_with_shared_passages_leave_one_of_everything(spark):
    rng = random.Random(11)
    p, q, other = sentence(rng, 60), sentence(rng, 60), sentence(rng, 80)
    copied = p + other + q
    texts = [sentence(rng, 20) + p, copied, copied, copied, sentence(rng, 20) + q, sentence(rng, 9) + q]
    texts = [" ".join(t) for t in texts]
    rows = P.repeated_passages(docs(spark, texts)).collect()
    for run in (p, q, other):
        assert survives(rows, texts, run)
    assert {(r.doc_id, r.removed) for r in rows if r.n_words == 200} == {(1, False), (2, True), (3, True)}
    assert {(r.doc_id, r.start_word, r.removed) for r in rows if r.n_words == 60} == {
        (0, 20, False), (1, 0, True), (1, 140, False), (4, 20, True), (5, 9, True)}


def keys_of(text, bands):
    words = next(iter(P.word_hashes(P.pa.array([text]))))
    return set(P.grams(words, P.RUN)[P.anchors(words, bands)].tolist())


def with_pivot_first(spark, make, before=None):
    """Texts of ``make(rng)`` where text 0 has the smallest hash and all keys of one band that the last two texts share.

    ``before``: it has each of them first before this word.
    """
    for seed in range(2000):
        texts = [" ".join(t) for t in make(random.Random(seed))]
        shared = keys_of(texts[-2], 1) & keys_of(texts[-1], 1)
        words = next(iter(P.word_hashes(P.pa.array(texts[:1]))))
        at = P.anchors(words, 1)
        if shared and shared <= set(P.grams(words, P.RUN)[at[at < (before or len(words))]].tolist()):
            nodes = [r.h for r in docs(spark, texts).orderBy("doc_id").select(F.xxhash64("text").alias("h")).collect()]
            if min(nodes) == nodes[0]:
                return texts
    raise AssertionError("no seed")


def spans_of(spark, texts):
    spans: dict = {}
    for r in P.repeated_passages(docs(spark, texts), recall=0.3).collect():     # one band
        spans.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    return spans


def test_a_match_elsewhere_does_not_hide_an_equal_paragraph(spark):
    def make(rng):
        run, ends = sentence(rng, 44), sentence(rng, 6)
        # text 0 shares a passage with text 1, and has only a run of the paragraph that 1 and 2 share
        shared, lone = sentence(rng, 60), ends[:3] + run + ends[3:]
        return [shared + sentence(rng, 30) + run + sentence(rng, 30), shared + sentence(rng, 20) + lone + sentence(rng, 20),
                sentence(rng, 50) + lone + sentence(rng, 40)]
    texts = with_pivot_first(spark, make)
    spans = spans_of(spark, texts)
    for i, places in brute_covered(texts).items():
        assert places <= spans[i]


def test_a_pivot_with_the_run_in_another_context_first_keeps_its_equal_paragraph(spark):
    def make(rng):
        run, ends = sentence(rng, 44), sentence(rng, 6)
        lone = ends[:3] + run + ends[3:]
        return [sentence(rng, 30) + run + sentence(rng, 30) + lone + sentence(rng, 30), sentence(rng, 45) + lone + sentence(rng, 40)]
    texts = with_pivot_first(spark, make, 60)
    spans = spans_of(spark, texts)
    for i, places in brute_covered(texts).items():
        assert places <= spans[i]


@pytest.mark.parametrize("block", [256, 1])
def test_near_paragraphs_meet_beside_a_pivot_with_only_their_run(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block, raising=False)

    def make(rng):
        before, run, after = (sentence(rng, n) for n in (10, 30, 18))
        near = [before + run + [edit] + after for edit in ("one", "two")]
        return [sentence(rng, 40) + run + sentence(rng, 40), sentence(rng, 20) + near[0] + sentence(rng, 30),
                sentence(rng, 40) + near[1] + sentence(rng, 20)]
    spans = spans_of(spark, with_pivot_first(spark, make))
    assert set(spans) == {1, 2} and set(range(20, 70)) <= spans[1] and set(range(40, 90)) <= spans[2]


def test_bands_let_paragraphs_with_a_changed_word_share_a_key():
    rng = np.random.default_rng(5)
    bands = P.bands_for(P.key_share(), P.RECALL)
    assert bands == 6
    for size in (50, 52, 55, 60):
        shared = 0
        for k in range(400):
            passage = rng.integers(0, 1 << 63, size).astype(np.uint64)
            edited = passage.copy()
            edited[size // 2 - 4 + k % 9] += np.uint64(1)
            keys = []
            for p in (passage, edited):
                ends = (rng.integers(0, 1 << 63, 60).astype(np.uint64) for _ in range(2))
                words = np.concatenate([next(ends), p, next(ends)])
                keys.append(set(P.grams(words, P.RUN)[P.anchors(words, bands)].tolist()))
            shared += bool(keys[0] & keys[1])
        print(size, shared / 400)
        assert shared >= P.RECALL * 400


def test_uses_the_bands_of_its_key(spark, monkeypatch):
    used = []
    monkeypatch.setattr(P, "_Passages", lambda texts, bands: used.append(bands) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        P.repeated_passages(docs(spark, []))
    assert used == [P.bands_for(P.key_share(), P.RECALL)]


def near_keys(words, make, *given):
    """Every key that ``make`` gives to all possible places, or to the given ones, with what it tells of them."""
    runs = P._Runs(words)
    at = given[0] if given else np.arange(max(0, len(words) - P.RUN + 1))
    return [(int(k), int(x), *(int(np.broadcast_to(m, len(keys))[i]) for m in more))
            for keys, _, first, *more in make(runs, at, np.ones(len(at), bool), *given[1:])
            for i, (k, x) in enumerate(zip(keys, first, strict=True))]


@pytest.mark.parametrize("edit", ["change", "add", "none"])
@pytest.mark.parametrize("size", [50, 53, 60])
def test_every_round_of_near_keys_lets_paragraphs_one_edit_apart_meet(edit, size):
    rng = np.random.default_rng(size)

    def draw(n):
        return rng.integers(0, 1 << 32, n).astype(np.uint32)
    for place in range(P.RUN, size - P.RUN, 3):
        passage = draw(size)
        other = passage.copy()
        if edit == "change":
            other[place] += 1
        elif edit == "add":
            other = np.insert(passage, place, draw(1))
        else:
            other = draw(size)
        texts = [np.concatenate([draw(40), x, draw(45)]) for x in (passage, other)]
        loose = [{k for k, *_ in near_keys(t, P._loose)} for t in texts]
        edits = [near_keys(t, P._edits) for t in texts]
        told = [[(k, at, kind, gap, word) for k, at, kind, gap, word in e if kind not in (2, 3)] for e in edits]
        words = {}
        for side, rows in enumerate(told):
            for k, *_, word in rows:
                words.setdefault(k, {}).setdefault(side, set()).add(word)
        met = {k for k, x in words.items() if len(x) == 2 and len(x[0] | x[1]) > 1}
        exact = []
        for t, rows in zip(texts, told, strict=True):
            rows = [r for r in rows if r[0] in met]
            at, kinds, gaps = (np.array([r[c] for r in rows], np.int64) for c in (1, 2, 3))
            exact.append({k: start for k, start, _ in near_keys(t, P._exact, at, kinds, gaps)})
        shared = exact[0].keys() & exact[1].keys()
        if edit == "none":
            assert not loose[0] & loose[1] and not shared
            continue
        assert loose[0] & loose[1] and shared
        for k in shared:
            a, b = (t[e[k]:e[k] + P.WINDOW] for t, e in zip(texts, exact, strict=True))
            p, q = (set(P.grams(x.astype(np.uint64), P.WIDTH).tolist()) for x in (a, b))
            assert len(a) == len(b) == P.WINDOW and 100 * len(p & q) >= P.PERCENT * len(p | q)


def test_near_paragraphs_share_a_key_for_certain():
    rng = np.random.default_rng(8)
    bands = P.bands_for(P.key_share(), P.RECALL)
    for k in range(3000):
        passage = rng.integers(0, 1 << 63, 50).astype(np.uint64)
        edited = passage.copy()
        edited[20 + k % 10] += np.uint64(1)
        keys = []
        for p in (passage, edited):
            ends = (rng.integers(0, 1 << 63, 40).astype(np.uint64) for _ in range(2))
            words = np.concatenate([next(ends), p, next(ends)])
            keys.append(set(P.grams(words, P.RUN)[P.anchors(words, bands)].tolist()))
        assert keys[0] & keys[1], k


def test_short_texts_near_by_a_run_in_the_middle_are_linked(spark):
    rng = random.Random(21)
    texts = []
    for first in range(6):      # of 50 words, 45 in a row are equal and others stand before and after them
        run = sentence(rng, 45)
        texts += [sentence(rng, first) + run + sentence(rng, 5 - first) for _ in range(2)]
    rows = P.repeated_passages(docs(spark, [" ".join(t) for t in texts])).collect()
    assert sorted((r.doc_id, r.keep_id) for r in rows) == [(k, k // 2 * 2) for k in range(12)]


def test_matches_elsewhere_do_not_hide_a_near_paragraph(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(8):
        # 1 and 2 are near by 25 and 24 words beside another one; each run lies in a passage that 0 or 5 share with 1, 3 or 4 with 2
        left, right, far = (sentence(rng, n) for n in (25, 24, 200))
        ends = [far[k:k + 30] for k in (0, 30, 60, 90)]
        texts += [ends[0] + left, ends[0] + left + ["one"] + right + ends[1], ends[2] + left + ["two"] + right + ends[3],
                  ends[2] + left, right + ends[3], right + ends[1]]
    rows = P.repeated_passages(docs(spark, [" ".join(t) for t in texts])).collect()
    clusters = {}
    for r in rows:
        clusters.setdefault(r.doc_id // 6, set()).add(r.cluster_id)
    assert len(rows) >= 48 and {k: len(c) for k, c in clusters.items()} == dict.fromkeys(range(8), 1)


def test_tables_of_places_that_may_be_broadcast_hold_plain_numbers(spark, monkeypatch):
    rng = random.Random(5)
    passage, near = sentence(rng, 60), sentence(rng, 60)
    texts = [" ".join(sentence(rng, 20) + passage + sentence(rng, 20)) for _ in range(3)]
    texts = docs(spark, texts + [" ".join(near), " ".join(near[:30] + ["other"] + near[31:])])
    asked = []
    sized = P.sized_broadcast

    def noted(df, rows, limit):
        asked.extend(f.dataType.simpleString() for f in df.schema.fields if f.name in ("seeds", "places"))
        return sized(df, rows, limit)

    monkeypatch.setattr(P, "sized_broadcast", noted)
    found = sorted(map(tuple, P.repeated_passages(texts).collect()), key=str)
    # a seed or place as a struct takes the driver 32 bytes and more
    assert len(asked) >= 4 and set(asked) <= {"array<bigint>", "array<int>"}
    assert len(found) == 5


def test_broadcasts_are_bounded_by_places_too(spark, monkeypatch):
    hinted = []
    monkeypatch.setattr(P, "sized_broadcast", lambda df, rows, limit: hinted.append(rows <= limit))
    few = spark.createDataFrame([(1, [1, 2]), (2, [3])], "node long, places array<long>")
    monkeypatch.setattr(P, "BROADCAST_PLACES", 3)
    P._sized(few, "places")
    monkeypatch.setattr(P, "BROADCAST_PLACES", 2)
    P._sized(few, "places")
    P._sized(few.limit(0), "places")
    assert hinted == [True, False, True]


def test_packed_places_come_back(spark):
    rows = [(0, 0, 1, True), (7, 1, 0, False), ((1 << 31) - 1, 1, 1, True)]
    frame = spark.createDataFrame(rows, "place int, kind int, gap int, opened boolean")
    packed = np.array([r[0] for r in frame.select(P._packed(["place", "kind", "gap"])).collect()])
    opened, given = P._unpacked(packed, 3)
    assert list(zip(*(x.tolist() for x in given), opened.tolist(), strict=True)) == rows


def test_used_up_tables_are_dropped(spark, monkeypatch):
    rng = random.Random(31)
    base = sentence(rng, 120)
    texts = [" ".join(sentence(rng, 10) + base[:20 + 9 * k] + [f"edit{k}"] + base[21 + 9 * k:]) for k in range(8)]
    written, stored = [], P.stored

    def noted(df, name):
        out = stored(df, name)
        written.append((name, [urlparse(f).path for f in out.inputFiles()]))
        return out

    monkeypatch.setattr(P, "stored", noted)
    rows = P.repeated_passages(docs(spark, texts)).collect()
    assert {r.doc_id for r in rows} == set(range(8))
    large = {"passage-keys", "passage-marked", "passage-loose", "passage-edits", "passage-narrow", "passage-exact"}
    assert large <= {name for name, _ in written}
    assert {name for name, files in written if name in large and any(Path(f).exists() for f in files)} == set()


def test_a_written_step_leaves_no_shuffle_files(spark):
    def shuffles():
        return set(Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data"))
    before = shuffles()
    out = common.stored(spark.range(20_000).groupBy("id").count(), "test-steps")
    assert out.count() == 20_000
    for _ in range(50):     # executors delete them soon after
        left = {f for f in shuffles() - before if f.exists() and f.stat().st_size > 10_000}
        if not left:
            break
        time.sleep(0.1)
    assert not left


def test_settings_are_as_before_after_a_step_that_fails(spark):
    name = common._CLEANUP_SETTING
    before = spark.conf.get(name, "false")
    with pytest.raises(Exception, match="no such thing"):
        common.stored(spark.range(1).select(F.raise_error(F.lit("no such thing"))), "test-fails")
    assert spark.conf.get(name, "false") == before


@pytest.mark.parametrize("edit", ["change", "add"])
def test_edits_that_share_a_paragraph_key_share_one_of_two(edit):
    rng = np.random.default_rng(13)

    def draw(n):
        return rng.integers(0, 1 << 32, n).astype(np.uint32)
    for place in range(5, 45):
        passage, other = draw(50), None
        other = passage.copy()
        if edit == "change":
            other[place] += 1
        else:
            other = np.insert(passage, place, draw(1))
        texts = [np.concatenate([draw(30), x, draw(30)]) for x in (passage, other)]
        given = [[np.array(x) for x in zip(*((at, kind, gap) for _, at, kind, gap, _ in near_keys(t, P._edits) if kind in (0, 1)), strict=True)]
                 for t in texts]
        exact, narrow = ([{k for k, *_ in near_keys(t, make, *g)} for t, g in zip(texts, given, strict=True)] for make in (P._exact, P._narrow))
        if exact[0] & exact[1]:
            assert narrow[0] & narrow[1]
            # of the edits that meet, only those with a shared key go on, and they give the same paragraphs
            met = narrow[0] & narrow[1]
            for t, g, keys in zip(texts, given, exact, strict=True):
                on = [np.array(x) for x in zip(*{(at, kind, gap) for k, at, kind, gap, _ in near_keys(t, P._narrow, *g) if k in met}, strict=True)]
                assert exact[0] & exact[1] <= {k for k, *_ in near_keys(t, P._exact, *on)} <= keys

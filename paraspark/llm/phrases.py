"""Phrase collocation mining: multikey three-way quicksort of suffixes, routed by their leading words.

Texts are split into pieces and words; a suffix is the up to five words of a piece from one word on.  Suffixes
that start with the same words are dealt to one task each and sorted there by multikey three-way
quicksort down to the longest phrase: the weight of an equal partition is the count of a phrase, and a
partition below the least count is abandoned.  Two global counts come first, so that little has to be
dealt: words, then pairs of frequent words.  A phrase cannot be more frequent than its parts, so a suffix ends
at the first pair that is rare, equal suffixes of a batch travel once with their number, and all that a batch has
for a task is one block.

A word is known by 63 bits of a hash.  The vocabulary is counted by the words themselves, and
another seed is taken if two words of a language ever share a hash, so the counts are exact.
Leading words that hold a large share of all suffixes are dealt by all their words instead, and
the partial counts are added up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paraspark.llm.common import stored, table
from paraspark.llm.shingles import _POWERS, SLICE_BYTES, mix

LONGEST, LEAST_COUNT, TOP = 5, 100, 2000
SHARED_ENTRIES = 4_000_000      # frequent words or pairs that tasks may be given; beyond that suffixes are not cut by them
TASK_SUFFIXES = 500_000         # suffixes dealt to a task, on average at most
LONG_WORD = 512                 # bytes; longer words take a cryptographic hash

_U = np.uint64
_KIND = np.zeros(256, np.int8)  # 1 ends a word, 2 ends a piece
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
WORDS_TYPE = ", ".join(f"w{k} long" for k in range(1, LONGEST + 1))
_W = [f"w{k}" for k in range(1, LONGEST + 1)]


class Clash(Exception):
    """Two words share a hash."""


def _table(seed: int) -> np.ndarray:
    values = np.random.RandomState(seed).randint(0, 1 << 62, size=256, dtype=np.int64).astype(_U) * _U(4) + _U(1)
    values[65:91] = values[97:123]
    return values


def _slices(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets of the texts in them, numbers of the texts); a long text is cut where a piece ends."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        if to > at + 1 or offsets[to] - offsets[at] <= SLICE_BYTES:
            yield data[offsets[at]:offsets[to]], offsets[at:to] - offsets[at], np.arange(at, to)
        else:
            begin, end = offsets[at], offsets[to]
            while begin < end:
                stop = min(end, begin + SLICE_BYTES)
                while stop < end:
                    cut = np.flatnonzero(_KIND[data[stop:stop + SLICE_BYTES]] == 2)
                    stop = stop + int(cut[0]) if len(cut) else min(end, stop + SLICE_BYTES)
                    if len(cut):
                        break
                yield data[begin:stop], np.zeros(1, np.int64), np.array([at])
                begin = stop
        at = to


class Words:
    """The words of a slice: where they are, their hashes, their texts' numbers, and which go on in the same piece."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, numbers: np.ndarray, seed: int) -> None:
        kind = _KIND[raw]
        inside = kind == 0
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cut = offsets[(offsets > 0) & (offsets < len(raw))]
        first[cut] |= inside[cut]
        last[cut - 1] |= inside[cut - 1]
        self.raw, self.start, self.end = raw, np.flatnonzero(first), np.flatnonzero(last) + 1
        owner = np.searchsorted(offsets, self.start, side="right") - 1
        # the last of several texts that begin at one place is the one with the word
        self.text = numbers[owner] if len(numbers) else owner
        piece = np.cumsum(kind == 2, dtype=np.int64)[self.start] + owner
        self.goes_on = np.zeros(len(self.start), bool)
        self.goes_on[:-1] = piece[1:] == piece[:-1]
        self.hash = self.hashes(seed)

    def hashes(self, seed: int) -> np.ndarray:
        """Odd 63-bit numbers, so zero is no word."""
        if not len(self.start):
            return np.empty(0, np.int64)
        up, down = _POWERS.upto(len(self.raw) + 1)
        run = np.cumsum(_table(seed)[self.raw] * up[:len(self.raw)], dtype=_U)
        total = run[self.end - 1]
        total[self.start > 0] -= run[self.start[self.start > 0] - 1]
        found = mix(total * down[self.start] + (self.end - self.start).astype(_U))
        for k in np.flatnonzero(self.end - self.start > LONG_WORD):
            found[k] = int.from_bytes(hashlib.blake2b(self.word(k), digest_size=8, salt=b"%d" % seed).digest(), "little")
        return (found >> _U(1) | _U(1)).astype(np.int64)

    def word(self, k: int) -> bytes:
        return self.raw[self.start[k]:self.end[k]].tobytes().translate(_FOLD)


def _languages(batch: pa.RecordBatch) -> tuple[np.ndarray, list[str]]:
    coded = batch.column("lang").dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def _equal_runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts of runs of equal rows in that order)."""
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    return order, np.flatnonzero(new)


def _distinct(lang, ids, check, n, *rest) -> tuple:
    """One row per (language, id), ``n`` added up; ``Clash`` if the second hash of equal ids differs."""
    order, starts = _equal_runs(lang, ids)
    head = order[starts]
    if (check[order] != np.repeat(check[head], np.diff(np.append(starts, len(order))))).any():
        raise Clash("two words share a hash")
    total = np.add.reduceat(n[order], starts) if len(starts) else n
    return lang[head], ids[head], check[head], total, *[r[head] for r in rest]


def count_words(docs: DataFrame, seed: int) -> DataFrame:
    """``lang, word, id, n`` of all words; raises ``Clash`` in a task if two words of a batch share a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, names = _languages(batch)
            held, raws = [], []
            for raw, offsets, numbers in _slices(batch.column("text")):
                found = Words(raw, offsets, numbers, seed)
                held.append(_distinct(codes[found.text], found.hash, found.hashes(seed + 1), np.ones(len(found.hash), np.int64),
                                      np.full(len(found.hash), len(raws)), found.start, found.end))
                raws.append(raw)
            if not held or not sum(len(h[0]) for h in held):
                continue
            lang, ids, _, n, slice_, start, end = _distinct(*[np.concatenate(c) for c in zip(*held)])
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array(names, pa.string()).take(pa.array(lang)),
                "word": pa.array([raws[s][a:b].tobytes().translate(_FOLD) for s, a, b in zip(slice_, start, end)]).cast(pa.string()),
                "id": ids, "n": n})

    return docs.mapInArrow(run, "lang string, word string, id long, n long").groupBy("lang", "word", "id").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame) -> tuple[DataFrame, int]:
    """The counted words under the first seed whose hashes tell all words of a language apart."""
    for seed in range(1, 100, 2):
        try:
            words = stored(count_words(docs, seed), "phrase-words")
        except Exception as e:  # noqa: BLE001 - a clash in a task arrives as the job's error
            if "Clash" not in str(e):
                raise
            continue
        if words.groupBy("lang", "id").count().where("count > 1").isEmpty():
            return words, seed
    raise RuntimeError("no seed tells the words apart")


def _shared(frequent: DataFrame, columns: list[str], limit: int) -> dict[str, np.ndarray] | None:
    """Sorted values by language, for all tasks; none if there are too many."""
    if frequent.count() > limit:
        return None
    rows = frequent.select("lang", *columns).toArrow()
    langs = rows.column("lang").to_pylist()
    values = np.column_stack([rows.column(c).to_numpy() for c in columns]) if langs else np.empty((0, len(columns)), np.int64)
    names = np.array(langs, dtype=object)
    return {lang: values[names == lang][np.lexsort(values[names == lang].T[::-1])] for lang in set(langs)}


class Cutter:
    """Which neighbours in a piece may be part of a frequent phrase, by the frequent words and pairs."""

    def __init__(self, words: dict | None, pairs: dict | None) -> None:
        self.words = None if words is None else {k: v[:, 0] for k, v in words.items()}
        self.pairs = None
        if pairs is not None and self.words is not None:
            self.pairs = {k: np.sort(self._pack(self._place(k, v[:, 0])[0], self._place(k, v[:, 1])[0])) for k, v in pairs.items()}

    def _place(self, lang: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = self.words.get(lang, np.empty(0, np.int64))
        place = np.searchsorted(known, ids)
        return place, np.append(known, 0)[place] == ids if len(known) else np.zeros(len(ids), bool)

    @staticmethod
    def _pack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(np.int64) << 32 | b

    def linked(self, lang: str, ids: np.ndarray, goes_on: np.ndarray) -> np.ndarray:
        """Whether each word and the next may be neighbours in a phrase."""
        if self.words is None or not len(ids):
            return goes_on.copy()
        place, frequent = self._place(lang, ids)
        link = goes_on & frequent
        link[:-1] &= frequent[1:]
        if self.pairs is not None:
            at = np.flatnonzero(link)
            known = self.pairs.get(lang, np.empty(0, np.int64))
            packed = self._pack(place[at], place[at + 1])
            found = np.append(known, -1)[np.searchsorted(known, packed)] == packed
            link[at[~found]] = False
        return link


def _by_language(batch: pa.RecordBatch, seed: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(language, word ids, goes on) of every slice; words of one language keep their order and pieces."""
    codes, names = _languages(batch)
    for raw, offsets, numbers in _slices(batch.column("text")):
        found = Words(raw, offsets, numbers, seed)
        lang = codes[found.text]
        for code in np.unique(lang):
            mine = lang == code
            yield names[code], found.hash[mine], found.goes_on[mine]


def count_pairs(docs: DataFrame, seed: int, cutter) -> DataFrame:
    """``lang, a, b, n`` of neighbouring frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = cutter.value
        for batch in batches:
            held: dict[str, list] = {}
            for lang, ids, goes_on in _by_language(batch, seed):
                at = np.flatnonzero(cut.linked(lang, ids, goes_on))
                held.setdefault(lang, []).append(np.column_stack([ids[at], ids[at + 1]]))
            for lang, parts in held.items():
                both = np.concatenate(parts)
                order, starts = _equal_runs(both[:, 0], both[:, 1])
                head = order[starts]
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang]).take(pa.array(np.zeros(len(head), np.int64))), "a": both[head, 0], "b": both[head, 1],
                    "n": np.diff(np.append(starts, len(order)))})

    return docs.mapInArrow(run, "lang string, a long, b long, n long").groupBy("lang", "a", "b").agg(F.sum("n").alias("n"))


def _spread_key(words: np.ndarray) -> np.ndarray:
    key = np.zeros(len(words), _U)
    for column in words.T:
        key = mix(key * _U(31) + column.astype(_U))
    return key


def suffixes(docs: DataFrame, seed: int, cutter, tasks: int, hot: dict[str, np.ndarray]) -> DataFrame:
    """``route, lang, spread, words, n``: blocks of equal suffixes' words and numbers for the tasks that sort them.

    A suffix has the words from one word on as far as pairs are frequent, three at least; 0 after the end.
    It goes where its first two words lead, and by all its words (``spread``) if these two are hot.
    """

    def blocks(lang: str, rows: np.ndarray) -> Iterator[dict]:
        order, starts = _equal_runs(*rows.T)
        words, n = rows[order[starts]], np.diff(np.append(starts, len(order)))
        lead = _spread_key(words[:, :2])
        spread = np.isin(lead, hot.get(lang, np.empty(0, _U)))
        route = (np.where(spread, _spread_key(words), lead) % _U(tasks)).astype(np.int64)
        order, starts = _equal_runs(route, spread)
        for mine in np.split(order, starts[1:]) if len(order) else []:
            mine = np.sort(mine)        # words in order compress better
            yield {"route": int(route[mine[0]]), "lang": lang, "spread": bool(spread[mine[0]]),
                   "words": words[mine].tobytes(), "n": n[mine].tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = cutter.value
        schema = pa.schema([("route", pa.int32()), ("lang", pa.string()), ("spread", pa.bool_()), ("words", pa.binary()), ("n", pa.binary())])
        for batch in batches:
            held: dict[str, list] = {}
            for lang, ids, goes_on in _by_language(batch, seed):
                link = cut.linked(lang, ids, goes_on)
                at = np.flatnonzero(link[:-1] & link[1:])
                rows = np.zeros((len(at), LONGEST), np.int64)
                alive = np.ones(len(at), bool)
                for d in range(LONGEST):
                    alive = alive & link[np.minimum(at + d - 1, len(link) - 1)] if d else alive
                    rows[alive, d] = ids[at[alive] + d]
                held.setdefault(lang, []).append(rows)
            for lang, parts in held.items():
                yield pa.RecordBatch.from_pylist(list(blocks(lang, np.concatenate(parts))), schema=schema)

    return docs.mapInArrow(run, "route int, lang string, spread boolean, words binary, n binary")


def multikey_counts(words: np.ndarray, weight: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, a row that begins so, weight) of every prefix of at least the least weight.

    Multikey three-way quicksort: rows are parted by one word into less, equal, greater; only the equal
    part goes on to the next word.  Parts below the least weight are abandoned.
    """
    pointers = np.arange(len(words))
    todo = [(0, len(words), 0)] if len(words) else []
    while todo:
        lo, hi, depth = todo.pop()
        part = pointers[lo:hi]
        if weight[part].sum() < least:
            continue
        column = words[part, depth]
        pivot = np.sort(column[[0, len(column) // 2, -1]])[1]
        less, more = column < pivot, column > pivot
        equal = part[~(less | more)]
        n_less = int(np.count_nonzero(less))
        pointers[lo:hi] = np.concatenate([part[less], equal, part[more]])
        todo += [(lo, lo + n_less, depth), (lo + n_less + len(equal), hi, depth)]
        if pivot:
            found = int(weight[equal].sum())
            if found >= least:
                yield depth + 1, int(equal[0]), found
                if depth + 1 < words.shape[1]:
                    todo.append((lo + n_less, lo + n_less + len(equal), depth + 1))


def count_phrases(blocks: DataFrame, least: int) -> DataFrame:
    """``lang, w1..w5, n, part`` of the phrases of three words and more in every task's suffixes; ``part``: not all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            for block in batch.to_pylist():
                held.setdefault((block["lang"], block["spread"]), []).append(
                    (np.frombuffer(block["words"], np.int64).reshape(-1, LONGEST), np.frombuffer(block["n"], np.int64)))
        for (lang, spread), parts in held.items():
            words, weight = (np.concatenate(x) for x in zip(*parts))
            found = [f for f in multikey_counts(words, weight, 1 if spread else least) if f[0] > 2]
            if found:
                depth, row, n = (np.array(x, np.int64) for x in zip(*found))
                kept = np.where(np.arange(LONGEST) < depth[:, None], words[row], 0)
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(n), **dict(zip(_W, kept.T)), "n": n, "part": [spread] * len(n)})

    return blocks.select("lang", "spread", "words", "n").mapInArrow(run, f"lang string, {WORDS_TYPE}, n long, part boolean")


def phrase_counts(docs: DataFrame, words: DataFrame, seed: int, least: int = LEAST_COUNT, shared: int = SHARED_ENTRIES,
                  task_suffixes: int = TASK_SUFFIXES) -> DataFrame:
    """``lang, w1..w5, n``: phrases of two to five words that occur at least ``least`` times."""
    context = docs.sparkSession.sparkContext
    known = _shared(words.where(F.col("n") >= least), ["id"], shared)
    pairs = stored(count_pairs(docs, seed, context.broadcast(Cutter(known, None))).where(F.col("n") >= least), "phrase-pairs")
    total = pairs.agg(F.sum("n")).first()[0] or 0       # suffixes are as many at most
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // task_suffixes))
    # pairs that would fill half a task by themselves: fewer than two a task
    hot = {lang: _spread_key(v) for lang, v in _shared(pairs.where(F.col("n") > total // (2 * tasks)), ["a", "b"], 2 * tasks).items()}
    cut = context.broadcast(Cutter(known, _shared(pairs, ["a", "b"], shared)))
    dealt = suffixes(docs, seed, cut, tasks, hot).repartitionById(tasks, F.col("route"))
    found = stored(count_phrases(dealt, least), "phrase-counts")
    added = (found.where("part").groupBy("lang", *_W).agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    two = pairs.select("lang", F.col("a").alias("w1"), F.col("b").alias("w2"), *[F.lit(0).cast("long").alias(w) for w in _W[2:]], "n")
    return two.unionByName(found.where("NOT part").drop("part")).unionByName(added)


def collocations(docs: DataFrame, least: int = LEAST_COUNT, top: int = TOP, shared: int = SHARED_ENTRIES,
                 task_suffixes: int = TASK_SUFFIXES) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases of two to five words.

    ``docs``: ``text, lang``.  Null and empty texts have no words, a null language is ``und``, repeated rows count
    again, texts of any length count whole, and other columns are ignored; an empty table gives no rows.
    A phrase occurs ``a >= least`` times; its lowest-scoring cut into ``l`` and ``r`` counts, ties to the
    shortest first part.  Phrases inside a longer one that is as frequent are dropped.  Ties of score and count go by the
    phrase in UTF-8 order.  ``score`` is ``floor(1000 a n / (l r))``, in decimals of 38 digits.
    """
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words, seed = vocabulary(docs)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.where(F.col("n") >= least)
    counted = phrase_counts(docs, words, seed, least, shared, task_suffixes)
    found = stored(counted.select("lang", F.filter(F.array(*_W), lambda w: w != 0).alias("ids"), F.col("n").alias("a")), "phrases")

    parts = found.select("lang", "ids", "a").unionByName(frequent.select("lang", F.array("id").alias("ids"), F.col("n").alias("a")))
    longer = found.where(F.size("ids") > 2).select("lang", "a", F.explode(F.array(
        F.slice("ids", F.lit(1), F.size("ids") - 1), F.slice("ids", F.lit(2), F.size("ids") - 1))).alias("ids"))
    around = longer.groupBy("lang", "ids").agg(F.max("a").alias("outer_a"))
    kept = (found.join(around, ["lang", "ids"], "left").where("outer_a IS NULL OR outer_a < a").select("lang", "ids", "a"))

    cuts = kept.select("lang", "ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k")).select(
        "lang", "ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("head"),
        F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")).alias("tail"))
    cuts = (cuts.join(parts.select("lang", F.col("ids").alias("head"), F.col("a").alias("l")), ["lang", "head"])
            .join(parts.select("lang", F.col("ids").alias("tail"), F.col("a").alias("r")), ["lang", "tail"])
            .join(totals, "lang"))

    def exact(name: str) -> Column:
        return F.col(name).cast("decimal(19,0)")
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * exact("a") * exact("n"), exact("l") * exact("r"))
    best = (cuts.withColumn("score", score).groupBy("lang", "ids", "a", "n")
            .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
            .select("lang", "ids", "a", "n", "cut.score", "cut.l", "cut.r"))
    order = [F.desc("score"), F.desc("a")]
    near = stored(best.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order)))
                  .where(F.col("place") <= top).drop("place"), "phrase-top")       # ties of the last place are all here
    spelled = (near.select("lang", "ids", F.posexplode("ids").alias("at", "id"))
               .join(frequent.select("lang", "id", "word"), ["lang", "id"])
               .groupBy("lang", "ids").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"))
               .select("lang", "ids", F.array_join(F.transform("words", lambda w: w["word"]), " ").alias("phrase")))
    ranked = near.join(spelled, ["lang", "ids"]).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("bigint"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
     pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
     words AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
     grams AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM words),
     f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS n FROM grams, range(1, 6) AS ks(k)
           WHERE i + k - 1 <= len(ws) GROUP BY ALL),
     totals AS (SELECT lang, sum(n)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY lang),
     c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND n >= 100),
     around AS (SELECT lang, array_to_string(ws[j:j + m - 1], ' ') AS phrase, max(a) AS outer_a
                FROM c, range(2, 5) AS ms(m), range(1, 5) AS js(j) WHERE m < k AND j + m - 1 <= k GROUP BY ALL),
     kept AS (SELECT c.* FROM c LEFT JOIN around USING (lang, phrase) WHERE outer_a IS NULL OR 100 * outer_a < 100 * a),
     cuts AS (SELECT kept.lang, kept.phrase, a, j, l.n AS l, r.n AS r, totals.n AS n,
                     (1000::HUGEINT * a * totals.n) // (l.n::HUGEINT * r.n) AS score
              FROM kept, range(1, 5) AS js(j), f AS l, f AS r, totals
              WHERE j < kept.k AND l.lang = kept.lang AND l.phrase = array_to_string(ws[1:j], ' ') AND l.k = j
                AND r.lang = kept.lang AND r.phrase = array_to_string(ws[j + 1:kept.k], ' ') AND r.k = kept.k - j AND totals.lang = kept.lang),
     best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS nth FROM cuts),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE nth = 1)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""

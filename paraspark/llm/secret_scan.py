"""Secret scans: plain patterns, and formats learned by grammar inference.

The plain patterns label credentials.  From a bounded sample of them, one probabilistic automaton
per kind is inferred by state merging: a prefix tree of the values, whose states are merged as long
as their stopping and next-symbol frequencies agree within the Hoeffding bound, children included.
Two more are inferred from ordinary runs: those without digits, and others without letters.  Every kind that has
a labelled value has an automaton, in a table of any size.

Candidates are the runs of ``LEAST_VALUE`` and more credential characters that the plain spans leave, of every text,
and, where such a run is no secret as a whole, its pieces between ``/``, ``=`` and ``.``.  A candidate's score is the
log-likelihood ratio of its best kind against ordinary runs, for kinds under which its likelihood is typical,
within ``DEVIATIONS`` of what the labelled values have.  Candidates of ``threshold`` per character and
``EVIDENCE`` in all are added.

The sample takes the values with the smallest hashes, ``SAMPLE`` of each kind, so it does not
depend on partitioning; only it and the automata go through the driver.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paraspark.llm.common import stored, table, text_or_empty

KINDS = ("assign", "access", "hex")
ORDINARY = ("word", "number")       # runs without digits, runs without letters
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
# runs of one character class match whole, so a least length and dropping short matches are the same
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
_PIECE = re.compile(r"[^/=.]{6,}")
SAMPLE = 2000       # labelled values, and ordinary words, that an automaton is fitted on
LITERAL = 4         # leading characters that the automata read as such
ALPHA = 0.05        # of the Hoeffding bound
THRESHOLD = 1.0     # nats per character
DEVIATIONS = 3.0    # standard deviations of the likelihood per character, for the value's length
EVIDENCE = 16.0     # nats of a whole candidate
PRIOR = 2.0         # values that smooth the deviation of a kind
LONGEST = 256       # symbols of a value that an automaton is fitted on; a longer one teaches no end


def plain_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the plain patterns, leftmost first and non-overlapping per kind."""
    spans = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end() - m.start(2) >= LEAST_VALUE]
    spans += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, k, b in sorted((a, k, b) for a, b, k in spans)]


def labelled_values(text: str) -> list[tuple[str, str]]:
    """(kind, value) of the labelled credentials of a text."""
    found = [("assign", m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    found += [("access", m[0]) for m in _ACCESS.finditer(text)]
    return found + [("hex", m[0]) for m in _HEX.finditer(text)]


def ordinary(run: str) -> str:
    """The kind of an ordinary run, empty for others."""
    if run.isalpha() or not any(map(str.isdigit, run)):
        return "word"
    return "" if any(map(str.isalpha, run)) else "number"


# ---- grammar inference -------------------------------------------------------------------------

def symbol(c: str) -> str:
    """The class of a character."""
    if c.isdigit():
        return "9"
    if c in "abcdef":
        return "f"
    if c in "ABCDEF":
        return "F"
    return "z" if c.islower() else "Z" if c.isupper() else c


_SYMBOLS = {c: symbol(c) for c in map(chr, range(128))}


def symbols(value: str) -> list[str]:
    """The first ``LITERAL`` characters as they are, so that fixed prefixes are learned, then classes."""
    return ["=" + c for c in value[:LITERAL]] + [_SYMBOLS.get(c) or symbol(c) for c in value[LITERAL:]]


class _State:
    __slots__ = ("count", "ends", "next")

    def __init__(self) -> None:
        self.count, self.ends, self.next = 0, 0, {}     # symbol -> [times, state]


class Automaton:
    """A deterministic probabilistic automaton over character classes."""

    def __init__(self, states: list[tuple[float, dict[str, tuple[float, int]]]], unseen: float) -> None:
        self.states, self.unseen = states, unseen
        self.mean, self.spread = 0.0, math.inf

    def calibrate(self, values: list[str]) -> None:
        """Mean log-likelihood per character of the values, and its deviation at one character.

        The deviation is smoothed by ``PRIOR`` values that are one nat off, so few values judge loosely.
        """
        each = [(self.log_likelihood(v[:LONGEST], len(v) <= LONGEST) / min(len(v), LONGEST), min(len(v), LONGEST)) for v in values]
        self.mean = sum(x for x, _ in each) / len(each)
        self.spread = math.sqrt((sum((x - self.mean) ** 2 * n for x, n in each) + PRIOR) / (len(each) + PRIOR))

    def typical(self, score: float, length: int) -> bool:
        return abs(score / length - self.mean) <= DEVIATIONS * (self.spread + 0.05) / math.sqrt(min(length, LONGEST))

    def typical_likelihood(self, steps: list[str]) -> float | None:
        """The log-likelihood of a whole value's symbols if it is typical; given up as soon as it cannot be."""
        n = len(steps)
        reach = n * DEVIATIONS * (self.spread + 0.05) / math.sqrt(min(n, LONGEST))
        least, at, total, states = n * self.mean - reach, 0, 0.0, self.states
        for c in steps:
            step = states[at][1].get(c)
            if step is None:
                total += self.unseen
            else:
                total += step[0]
                at = step[1]
            if total < least:       # it only falls
                return None
        total += states[at][0]
        return total if least <= total <= n * self.mean + reach else None

    def log_likelihood(self, value: str, ends: bool = True) -> float:
        """Of the value's symbols and, if asked, its end; unseen steps cost ``unseen`` and stay in the state."""
        at, total, states = 0, 0.0, self.states
        for c in symbols(value):
            step = states[at][1].get(c)
            if step is None:
                total += self.unseen
            else:
                total += step[0]
                at = step[1]
        return total + states[at][0] if ends else total


def _agree(f1: int, n1: int, f2: int, n2: int, alpha: float) -> bool:
    bound = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))
    return abs(f1 / n1 - f2 / n2) <= bound


def _compatible(a: _State, b: _State, alpha: float) -> bool:
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        if not x.count or not y.count:
            continue
        if not _agree(x.ends, x.count, y.ends, y.count, alpha):
            return False
        for s in {*x.next, *y.next}:
            p, q = x.next.get(s), y.next.get(s)
            if not _agree(p[0] if p else 0, x.count, q[0] if q else 0, y.count, alpha):
                return False
            if p and q:
                todo.append((p[1], q[1]))
    return True


def _fold(red: _State, blue: _State) -> None:
    """Add the tree below ``blue`` to ``red``."""
    todo = [(red, blue)]
    while todo:
        x, y = todo.pop()
        x.count += y.count
        x.ends += y.ends
        for s, (n, child) in y.next.items():
            if s in x.next:
                x.next[s][0] += n
                todo.append((x.next[s][1], child))
            else:
                x.next[s] = [n, child]


def infer(values: list[str], alpha: float = ALPHA) -> Automaton:
    """Prefix tree of the values, merged state by state where the statistics agree."""
    root = _State()
    for value in sorted(values):
        at = root
        at.count += 1
        for c in symbols(value[:LONGEST]):
            step = at.next.setdefault(c, [0, _State()])
            step[0] += 1
            at = step[1]
            at.count += 1
        if len(value) > LONGEST:
            at.count -= 1       # nothing is known of what follows
        else:
            at.ends += 1
    red, queue = [root], [(root, s) for s in sorted(root.next)]
    known = {id(root)}
    while queue:
        parent, s = queue.pop(0)
        blue = parent.next[s][1]
        if id(blue) in known:
            continue
        # a state that only cut values reach goes on like the state that is visited most
        for candidate in red if blue.count else [max(red, key=lambda x: x.count)]:
            if _compatible(candidate, blue, alpha):
                parent.next[s][1] = candidate
                _fold(candidate, blue)
                queue += [(r, t) for r in red for t in sorted(r.next) if id(r.next[t][1]) not in known and (r, t) not in queue]
                break
        else:
            red.append(blue)
            known.add(id(blue))
            queue += [(blue, t) for t in sorted(blue.next)]
    number = {id(x): k for k, x in enumerate(red)}
    states, alphabet = [], 64
    for x in red:
        total = x.count + 1
        states.append((math.log((x.ends + 0.5) / total),
                       {s: (math.log(n / total), number[id(child)]) for s, (n, child) in x.next.items()}))
    inferred = Automaton(states, math.log(1 / (alphabet * (len(values) + 1))))
    if values:
        inferred.calibrate(values)
    return inferred


# ---- the scan ----------------------------------------------------------------------------------

def _sampled(rows: DataFrame, sample: int) -> dict[str, list[str]]:
    """Per kind the ``sample`` distinct values of smallest hash: at most five times ``sample`` rows."""
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # each task keeps as many as could be chosen at last
        least: dict[str, dict[str, bytes]] = {k: {} for k in KINDS + ORDINARY}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = labelled_values(text)
                found += [(kind, m[0]) for m in CANDIDATE.finditer(text) if (kind := ordinary(m[0]))]
                for kind, value in found:
                    value = value[:LONGEST + 1]     # one more tells that the value goes on
                    if value not in least[kind]:
                        least[kind][value] = hashlib.md5(value.encode()).digest()
            for kind, kept in least.items():
                if len(kept) > 4 * sample:
                    least[kind] = dict(sorted(kept.items(), key=lambda x: x[1])[:sample])
        out = [(k, v) for k, kept in least.items() for v, _ in sorted(kept.items(), key=lambda x: x[1])[:sample]]
        yield pa.record_batch([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], names=["kind", "value"])

    values = stored(rows.select("text").mapInArrow(collect, "kind string, value string").distinct(), "secret-values")
    chosen: dict[str, list[str]] = {}
    for kind in KINDS + ORDINARY:
        # each is a top-k: tasks keep their own first k
        first = values.where(F.col("kind") == kind).orderBy(F.md5("value"), "value").limit(sample)
        chosen[kind] = [r["value"] for r in first.collect()]
    return chosen


def fit_formats(df: DataFrame, text_col: str = "text", sample: int = SAMPLE, alpha: float = ALPHA) -> dict[str, Automaton]:
    """Automata of the kinds that have labelled values, and of ordinary runs."""
    chosen = _sampled(df.select(text_or_empty(text_col).alias("text")), sample)
    return {k: infer(v, alpha) for k, v in chosen.items() if v}


def best_kind(value: str, formats: dict[str, Automaton]) -> tuple[float, str]:
    """(log-likelihood ratio per character against ordinary runs, kind) of the likeliest format."""
    steps, best = symbols(value), (-math.inf, "")
    for kind in KINDS:
        if kind in formats and (score := formats[kind].typical_likelihood(steps)) is not None:
            best = max(best, (score, kind))
    if not best[1]:
        return best
    plain = max((formats[k].log_likelihood(value) for k in ORDINARY if k in formats), default=-math.log(64) * len(value))
    return (best[0] - plain) / len(value), best[1]


def candidates(text: str, base: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """(start, end) of the runs of credential characters that the plain spans leave, in order."""
    taken: list[list[int]] = []     # the spans as disjoint ranges
    for start, end, _ in base:
        if taken and start <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], end)
        else:
            taken.append([start, end])
    at = 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        while at < len(taken) and taken[at][0] < end:
            if taken[at][0] - start >= LEAST_VALUE:
                yield start, taken[at][0]
            start = max(start, taken[at][1])
            if start >= end:
                break       # the span may reach into the next run
            at += 1
        if end - start >= LEAST_VALUE:
            yield start, end


def secrets_in(value: str, formats: dict[str, Automaton], threshold: float = THRESHOLD) -> list[tuple[int, int, str]]:
    """(start, end, kind) of a candidate: itself if it is a secret as a whole, else those of its pieces that are."""
    def kind_of(part: str) -> str:
        score, kind = best_kind(part, formats)
        return kind if score >= threshold and score * len(part) >= EVIDENCE else ""

    if kind := kind_of(value):
        return [(0, len(value), kind)]
    pieces = [m.span() for m in _PIECE.finditer(value) if len(m[0]) < len(value)]
    return [(a, b, kind) for a, b in pieces if (kind := kind_of(value[a:b]))]


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", formats: dict[str, Automaton] | None = None,
                 threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``id, n_assign, n_access, n_hex, base_sha256, spans, n_learned``.

    Counts, ``base_sha256`` and ``spans`` are in code points of the whole text; null texts are empty:
    no spans, and the SHA-256 of nothing.  ``spans`` lists the plain spans and the added candidates
    as ``kind:start:end``, by start, then kind as listed.  Without labelled credentials (an empty
    table, say) nothing is added.  Very long texts cost their length; of labelled values over ``LONGEST`` characters the
    automata learn the first ``LONGEST``, but score whole candidates.  Repeated rows and ids give a row each; other columns are ignored.
    """
    formats = fit_formats(df, text_col) if formats is None else formats
    shared = df.sparkSession.sparkContext.broadcast(formats)
    listed = {k: i for i, k in enumerate(KINDS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formats = shared.value
        learned = any(k in formats for k in KINDS)
        known: dict[str, list[tuple[int, int, str]]] = {}
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column("text").to_pylist():
                base = plain_spans(text)
                added = []
                for a, b in candidates(text, base) if learned else ():
                    value = text[a:b]
                    found = known.get(value)
                    if found is None:
                        found = secrets_in(value, formats, threshold)
                        if b - a <= 64:
                            if len(known) >= 200_000:
                                known.clear()
                            known[value] = found
                    added += [(a + x, a + y, kind) for x, y, kind in found]
                joined = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
                every = sorted(base + added, key=lambda x: (x[0], listed[x[2]]))
                kinds = Counter(k for _, _, k in base)
                out.append((*(kinds[k] for k in KINDS), hashlib.sha256(joined.encode()).hexdigest(),
                            ",".join(f"{k}:{a}:{b}" for a, b, k in every), len(added)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.record_batch([batch.column("id"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]],
                                  names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_learned"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    out = rows.mapInArrow(run, "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_learned long")
    return out.withColumnRenamed("id", id_col)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))

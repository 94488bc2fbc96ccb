"""Secret scans with guess costs."""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.shared import slices, small_batches, whole

#: Kinds in the order in which spans of one start are told.
KINDS = ("assign", "access", "hex", "guess")
#: A value in a credential's place whose guess cost is at least this (log10 of guesses) is a secret.
LEAST_COST = 8.0
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
#: Other places of credentials: names, headers, and URLs with a password. The names above are here
#: too, for values that _ASSIGN can't take. A quoted value ends at its quote. A value that is itself
#: a name with a separator and a value apart isn't one, as finditer() would pass over the inner value.
_NAME, _SEP = rb"(?:password|passwd|secret|token|api_?key|pwd|passphrase|pass|credentials?|auth|private_key|access_key|secret_key|client_id|session_?id|cookie|signature)[\"']?", rb"\s*(?::=|=>|[:=])"
_FREE = rb"""[^\s"'<>@,;]{6,}"""
_CONTEXT = re.compile(
    rb"(?:" + _NAME + _SEP + rb"""\s*["']?(?:(?:bearer|basic)\x20+)?"""
    rb"""|bearer\x20+|authorization["']?\s*[:=]\s*["']?(?:basic\x20+)?|://[A-Za-z0-9._-]{1,64}:)"""
    rb"(?![\w.-]{0,32}?" + _NAME + _SEP + rb"""(?:\s+["']?|["'])""" + _FREE + rb")"
    rb"""((?<=")[^\s"]{6,}(?=")|(?<=')[^\s']{6,}(?=')|""" + _FREE + rb")",
    re.I,
)
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True
#: Words that people use in passwords, most frequent first; behind them stand those of a vocabulary (words()).
WORDS = """password love admin welcome secret login qwerty monkey dragon master hello letmein sunshine princess football
test user guest root token example change changeme default pass demo sample dummy temp private public server access system manager
service super shadow summer winter spring autumn monday sunday january december money happy angel baby soccer baseball hunter killer
orange apple banana cookie coffee cheese pepper ginger silver golden purple yellow computer internet google office mobile world
freedom forever friend family mother father michael daniel jordan thomas robert charlie jennifer jessica ashley batman superman
pokemon starwars trust enter the and you for one two three your key api data base local host null none true false value string""".split()
_LEET = str.maketrans("@4301!5$7", "aaeoiisst")
_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "1qaz2wsx3edc4rfv5tgb6yhn7ujm")
_NEXT = {x + y for row in _ROWS for a in (row, row[::-1]) for x, y in zip(a, a[1:])}
_DAY, _MONTH, _YEAR = r"(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|1[0-2])", r"(?:19|20)\d\d"
#: The forms of dates, each of one length at a place, and their costs.
_DATES = [
    (re.compile(x), 2.1 if x == _YEAR else 4.6)
    for x in (
        _YEAR, rf"{_YEAR}[-./_]?{_MONTH}", rf"{_YEAR}[-./_]?{_MONTH}[-./_]?{_DAY}",
        *(rf"{d}[-./_]{m}[-./_]{y}" for d in (r"[1-9]", _DAY) for m in (r"[1-9]", _MONTH) for y in (r"\d\d", _YEAR)),
    )
]
#: The longest unit of a repeat.
_UNIT = 8
#: log10 of what each segment of a split adds, as its place must be guessed too.
SEGMENT = 0.5


def _spread(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100)


@dataclass(frozen=True)
class Words:
    """Words by rank, from 1 on, and the length of the longest."""

    rank: dict[str, int]
    longest: int


@lru_cache(4)
def words(vocabulary: str | None = None) -> Words:
    """WORDS, then the whole words of 3 letters a-z or more of a BPE vocabulary with word ends, whose ids are in order
    of frequency: some 30,000 for the default one. Made once a worker."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    with open(vocabulary, encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    whole_words = [t.removesuffix("</w>") for t in sorted(ids, key=ids.get) if t.endswith("</w>")]
    ranked = dict.fromkeys([*WORDS, *(w for w in whole_words if len(w) > 2 and w.isascii() and w.isalpha())])
    return Words({w: i for i, w in enumerate(ranked, 1)}, max(map(len, ranked)))


def guess_cost(value: str, known: Words | None = None) -> float:
    """log10 of the guesses that find ``value``, at the cheapest split into words (plain, capital or
    with digits for letters), dates, repeats, keyboard or alphabet walks, and brute force.

    Dynamic programming over end places, over all segments. Words and dates are of bounded
    length. Repeats of a unit and walks go on from any start to any end; as only the log of
    their length counts, the cheapest start is kept in a queue (_Starts). So the work is
    near linear in the length."""
    known = known or words()
    n = len(value)
    low = value.lower()
    plain = low.translate(_LEET)
    ends: dict[int, list[tuple[int, float]]] = defaultdict(list)
    for i in range(n):
        for k in range(3, min(known.longest, n - i) + 1):
            for text, more in ((low, 0.0), (plain, 0.7)):
                if rank := known.rank.get(text[i : i + k]):
                    ends[i + k].append((i, math.log10(rank + 1) + more + (0.3 if value[i : i + k] != low[i : i + k] else 0)))
                    break
        if value[i].isdigit():
            for form, cost in _DATES:
                if m := form.match(value, i):
                    ends[m.end()].append((i, cost))
    cost_to = [0.0]
    for x in value:
        cost_to.append(cost_to[-1] + _spread(x))
    best, brute = [0.0] + [math.inf] * n, [math.inf] * (n + 1)
    walks = _Starts()
    repeats: list[dict[int, _Starts]] = [{} for _ in range(_UNIT + 1)]  # by unit, then by place modulo the unit
    for e in range(1, n + 1):
        brute[e] = min(brute[e - 1], best[e - 1] + SEGMENT) + _spread(value[e - 1])
        found = [brute[e], *(best[s] + c + SEGMENT for s, c in ends.get(e, ()))]
        step = low[e - 2 : e] in _NEXT if e > 1 else False
        if not step and walks.kept:
            walks = _Starts()
        if step and e > 2 and low[e - 3 : e - 1] in _NEXT:
            walks.add(e - 3, best[e - 3])
            found.append(walks.cheapest(e) + 1.7 + SEGMENT)
        for u in range(1, min(_UNIT, e // 2) + 1):
            s, of = e - 2 * u, repeats[u]
            if value[e - 1] != value[e - 1 - u]:
                of.clear()
            elif value[s : s + u] == value[s + u : e]:
                starts = of.setdefault(e % u, _Starts())
                starts.add(s, best[s] + cost_to[s + u] - cost_to[s])
                found.append(starts.cheapest(e) + SEGMENT)
        best[e] = min(found)
    return best[n]


class _Starts:
    """Starts s with a cost c each: the least c + log10(e - s) for ends e that only grow.

    Of two starts the later one gains less by each further end, as the log's slope falls
    with the length: once the earlier one is no dearer, it stays so. So starts are kept
    in order as a stack whose last is the cheapest, each with the end from which the
    one before it takes over."""

    def __init__(self) -> None:
        self.kept: list[tuple[int, float, float]] = []

    def add(self, s: int, c: float) -> None:
        """A new start; ends asked for afterwards lie beyond it."""
        while self.kept:
            last, cost, until = self.kept[-1]
            at = self._over(last, cost, s, c)
            if at <= s + 1:
                return
            if at < until:
                break
            self.kept.pop()
        self.kept.append((s, c, self._over(*self.kept[-1][:2], s, c) if self.kept else math.inf))

    @staticmethod
    def _over(early: int, a: float, late: int, b: float) -> float:
        """The end from which ``early`` with cost a is no dearer than ``late`` with cost b."""
        k = 10 ** min(a - b, 300)
        # a + log(e - early) <= b + log(e - late)  <=>  k (e - early) <= e - late
        return math.inf if k >= 1 else (late - k * early) / (1 - k)

    def cheapest(self, e: int) -> float:
        while len(self.kept) > 1 and self.kept[-1][2] <= e:
            self.kept.pop()
        s, c, _ = self.kept[-1]
        return c + math.log10(e - s)


def _runs(flags: np.ndarray, least: int) -> list[tuple[int, int]]:
    edge = np.diff(flags.view("i1"), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - start >= least
    return list(zip(start[long].tolist(), end[long].tolist(), strict=True))


def find(text: bytes, known: Words | None = None) -> tuple[list[tuple[int, int, int]], dict[tuple[int, int, int], float]]:
    """Spans (start, end, kind) in code points, sorted, and the guess cost of the values in credentials' places."""
    low = text.translate(_LOWER)
    found: list[tuple[int, int, int]] = []
    costs: dict[tuple[int, int, int], float] = {}
    if any(k in low for k in (b"passw", b"secret", b"token", b"api")):
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                found.append((m.start(), m.end(), 0))
                costs[found[-1]] = guess_cost(m[2].decode(), known)
    if b"AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if len(text) >= 24:
        found += [(s, e, 2) for s, e in _runs(_HEX[np.frombuffer(text, "u1")], 24)]
    if any(k in low for k in (b"pwd", b"pass", b"cred", b"auth", b"_key", b"client_id", b"session", b"cookie", b"signature", b"bearer", b"://", b"secret", b"token", b"api")):
        told_of = [[x for x in found if x[2] == k] for k in (0, 1)]  # in order, without overlap
        for m in _CONTEXT.finditer(text):
            before = [own[bisect_right(own, (m.start(1), math.inf, 0)) - 1] for own in told_of if own and own[0][0] <= m.start(1)]
            if any(m.end(1) <= e for _, e, _ in before):
                continue
            cost = guess_cost(m[1].decode("utf-8", "replace"), known)
            if cost >= LEAST_COST:
                found.append((m.start(1), m.end(1), 3))
                costs[found[-1]] = cost
    if found and not text.isascii():
        heads = np.flatnonzero((np.frombuffer(text, "u1") & 0xC0) != 0x80)
        place = lambda at: int(np.searchsorted(heads, at))
        costs = {(place(s), place(e), k): c for (s, e, k), c in costs.items()}
        found = [(place(s), place(e), k) for s, e, k in found]
    return sorted(set(found), key=lambda x: (x[0], x[2], x[1])), costs


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Secrets in whole texts: doc_id, n_assign, n_access, n_hex, n_guess (long), base_spans, spans
    (strings of kind:start:end in code points, by start, then kind), and max_cost, the
    highest guess cost (log10) of a value in a credential's place.

    Assignments span the whole match, name and value. Three kinds are patterns alone; the
    fourth, ``guess``, are values in any place of credentials, beyond what the first three
    tell, whose cheapest way to guess costs LEAST_COST or more; so placeholders and words aren't told. Words
    come from the file ``vocabulary`` (words()), which every worker must reach.

    Null text counts as empty: no spans, null max_cost. Repeated rows give repeated
    results; an empty table an empty one. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words(vocabulary)
        for batch in (part for whole_batch in batches for part in slices(whole_batch, 1)):
            out = [find(t, known) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            counts = [pa.array([sum(x[2] == k for x in spans) for spans, _ in out], pa.int64()) for k in range(4)]
            base, every = pa.array([told([x for x in spans if x[2] < 3]) for spans, _ in out], pa.string()), pa.array([told(spans) for spans, _ in out], pa.string())
            cost = pa.array([max(c.values(), default=None) for _, c in out], pa.float64())
            yield pa.record_batch([batch.column(0), *counts, base, every, cost], names=["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_spans", "spans", "max_cost"])

    return docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("body")).mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_guess long, base_spans string, spans string, max_cost double")

"""License scans with ordered signature rules."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.license_rules import Rule, rules
from quantloom.llm.shared import slices, small_batches, whole

#: Phrases that are always reported, by the place of their words, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_RUN = re.compile("[ \t-\r]{2,}")
_SEP, _IN = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", rb"[0-9a-z\x80-\xff]"


@lru_cache(1)
def _compiled():
    """The keyword automaton, each keyword's rules, and the base phrases."""
    import ahocorasick

    by: dict[str, list[tuple[Rule, re.Pattern]]] = defaultdict(list)
    for r in rules():
        by[r.keyword].append((r, re.compile(r.regex, re.S | re.A)))
    gate = ahocorasick.Automaton()
    for keyword in by:
        gate.add_word(keyword, keyword)
    gate.make_automaton()
    base = [(words.split()[0].encode(), re.compile(rb"(?<!" + _IN + rb")" + _SEP.join(words.encode().split()) + rb"(?!" + _IN + rb")"), label) for words, label in BASE.items()]
    return gate, by, base


def unsuppressed(found: list[tuple[int, int, int, str, float]]) -> list[tuple[int, int, int, str, float]]:
    """Of detections (start, end, priority, label, score) those that lie within no other that is
    of higher priority, or of equal priority and longer. Of equal ones one label each stays."""
    kept: list[tuple[int, int, int, str, float]] = []
    above: list[tuple[int, int]] = []  # spans of all higher priorities
    starts: list[int] = []
    reach: list[int] = []  # the furthest end of the spans above up to each start
    for _, level in groupby(sorted(set(found), key=lambda d: (-d[2], d[0], -d[1], d[3])), key=lambda d: d[2]):
        furthest, spans = -1, []
        for (start, end), same in groupby(level, key=lambda d: d[:2]):  # by start, the longest first
            k = bisect_right(starts, start)
            if furthest < end and not (k and reach[k - 1] >= end):
                kept += same
            furthest = max(furthest, end)
            spans.append((start, end))
        above = sorted(above + spans)
        starts, reach = [s for s, _ in above], list(accumulate((e for _, e in above), max))
    return sorted(kept)


def collapsed(low: str) -> tuple[str, Callable[[int], int]]:
    """The text with one space for each run of ASCII white space, and the place in ``low`` of each place there."""
    runs = [m.span() for m in _RUN.finditer(low)]
    if not runs:
        return low, lambda at: at
    removed = list(accumulate((end - start - 1 for start, end in runs), initial=0))
    places = [start - gone for (start, _), gone in zip(runs, removed)]
    return _RUN.sub(" ", low), lambda at: at + removed[bisect_left(places, at)]


def detections(low: str, gate, by) -> list[tuple[int, int, int, str, float]]:
    """What the rules find in lower-case text; only rules whose keyword is there are run. Keywords are
    looked up with each run of white space as one space, as the rules take any run.

    Rules run over the text with such runs as one space too, and places are carried back: neighbouring optional
    blanks of a rule then have one character at most to share, so that a rule takes time in proportion to any run of blanks, hyphens or commas."""
    keywords = {k for _, k in gate.iter(" ".join(low.split()))}
    if not keywords:
        return []
    flat, place = collapsed(low)
    found = []
    for keyword in keywords:
        for rule, regex in by[keyword]:
            found += [(place(m.start()), place(m.end() - 1) + 1, rule.priority, rule.label, rule.score) for m in regex.finditer(flat)]
    return unsuppressed(found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licenses named in whole texts, with A-Z in lower case.

    A row per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, and detections, an array of (start, end, label, score, priority) in code points.
    Words are runs of letters, digits and all characters beyond ASCII; base phrases are found
    wherever their words stand in a row. The rules (license_rules.py) are gated by one
    keyword automaton over the text; detections within one of higher priority are
    suppressed. ``score`` is the best surviving detection's, 1 with a base phrase.

    Null text counts as empty: no words, null first and last, empty labels, score 0.
    Repeated rows give repeated results; an empty table an empty one. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("score", pa.float64()), ("priority", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gate, by, base = _compiled()
        for batch in (part for whole_batch in batches for part in slices(whole_batch, 1)):
            out = defaultdict(list)
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                low = text.translate(_LOWER)
                word = _WORD[np.frombuffer(low, "u1")]
                starts = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]])) if len(word) else np.zeros(0, int)
                hits = [(m.start(), label) for first, regex, label in base if first in low for m in regex.finditer(low)]
                places = np.searchsorted(starts, [at for at, _ in hits])
                found = detections(low.decode("utf-8", "replace"), gate, by)
                names = {label for _, label in hits}
                out["n_words"].append(len(starts))
                out["n_base"].append(len(hits))
                out["first_word"].append(int(places.min()) if hits else None)
                out["last_word"].append(int(places.max()) if hits else None)
                out["base_labels"].append(",".join(sorted(names)))
                out["labels"].append(",".join(sorted(names | {d[3] for d in found})))
                out["score"].append(1.0 if hits else max((d[4] for d in found), default=0.0))
                out["detections"].append([{"start": s, "end": e, "label": label, "score": score, "priority": p} for s, e, p, label, score in found])
            types = {k: pa.int64() for k in ("n_words", "n_base", "first_word", "last_word")} | {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "detections": span}
            yield pa.record_batch([batch.column(0), *(pa.array(out[k], t) for k, t in types.items())], names=["doc_id", *types])

    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start:long,end:long,label:string,score:double,priority:int>>"
    return docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("body")).mapInArrow(run, schema)

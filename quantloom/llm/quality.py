"""Quality classification by ordinal cumulative-link regression on graded ratings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.shared import cut, slices, small_batches, smallest_hashes, whole
from quantloom.llm.shingles import _BYTE, CHUNK, _powers, mix

#: Hashed features; behind them stand BINS one-hot bins for each of SHAPES measures of the whole text.
DIMS, BINS, SHAPES = 1 << 18, 24, 7
PREFIXES = (4, 5, 6)
#: Labelled rows that a shard has at least; a smaller sample is gone over in fewer shards.
LEAST_ROWS = 1500
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True


def _hashes(data: bytes) -> list[np.ndarray]:
    b = np.frombuffer(data, "u1")
    power, inverse = _powers(1 << max(16, int(len(b)).bit_length()))
    edge = np.diff(_WORD[b].view("i1"), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.concatenate([np.zeros(1, "u8"), np.cumsum(_BYTE[b] * power[: len(b)], dtype="u8")])
    out = [mix((total[end] - total[start]) * inverse[start])]
    for k in PREFIXES:
        long = start[end - start > k]
        out.append(mix((total[long + k] - total[long]) * inverse[long] + np.uint64(k)))
    left, right = end[:-1], start[1:]  # what stands between words
    out.append(mix((total[right] - total[left]) * inverse[left] + np.uint64(1)))
    return out


def features(text: bytes) -> np.ndarray:
    """Indices of what a whole text has: its words, their first PREFIXES bytes, what
    stands between words, and bins of its shape (length, share of symbols, of distinct words, of digits, of capitals, mean
    word length, share of words that repeat the one before)."""
    found, words, distinct, again, at = [], 0, [], 0, 0
    while at < len(text):
        end = min(len(text), at + CHUNK)
        while end < len(text) and end - at < 2 * CHUNK and not _GAP[text[end]]:
            end += 1
        own = _hashes(text[at:end])
        words += len(own[0])
        distinct.append(np.unique(own[0]))
        again += int((own[0][1:] == own[0][:-1]).sum())
        found.append(np.unique(np.concatenate(own) & np.uint64(DIMS - 1)).astype("i8"))
        at = end
    b = np.bincount(np.frombuffer(text, "u1"), minlength=256)
    n, letters = max(1, len(text)), int(b[_WORD].sum())
    gaps = int(b[_GAP].sum())
    kinds = len(np.unique(np.concatenate(distinct))) if distinct else 0
    caps, digits = int(b[65:91].sum()), int(b[48:58].sum())
    shape = (np.log2(1 + words) / 20, np.sqrt((len(text) - letters - gaps) / n), kinds / max(1, words), np.sqrt(digits / n), np.sqrt(caps / n), min(1.0, letters / max(1, words) / 24), again / max(1, words))
    bins = [DIMS + k * BINS + min(BINS - 1, int(x * BINS)) for k, x in enumerate(shape)]
    return np.concatenate([*([np.unique(np.concatenate(found))] if found else []), np.array(bins)])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Model:
    """Shared weights and one threshold below each grade but the lowest: P(grade > k) = sigmoid(score - threshold k)."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(DIMS + BINS * SHAPES))
    thresholds: np.ndarray = field(default_factory=lambda: np.array([-1.0, 0.0]))

    def tails(self, indices: np.ndarray) -> np.ndarray:
        return _sigmoid(self.weights[indices].sum() - self.thresholds)


def loss_and_slopes(score: float, thresholds: np.ndarray, grade: int) -> tuple[float, float, list[tuple[int, float]]]:
    """-ln P(grade), its derivative by the score, and by each threshold beside the grade as (place, slope)."""
    up = _sigmoid(thresholds[grade] - score) if grade < len(thresholds) else 1.0
    down = _sigmoid(thresholds[grade - 1] - score) if grade else 0.0
    p = max(1e-9, up - down)
    slopes = [(grade, -up * (1 - up) / p), (grade - 1, down * (1 - down) / p)]
    return float(-np.log(p)), float(1 - up - down), [(k, x) for k, x in slopes if 0 <= k < len(thresholds)]


def _fit_shard(rows: pd.DataFrame, model: Model, epochs: int, rate: float, decay: float, seed: int) -> tuple[Model, np.ndarray]:
    """AdaGrad steps over a shard's rows from ``model`` on; also which weights moved."""
    w, theta = model.weights.copy(), model.thresholds.copy()
    seen, seen_t = np.full(len(w), 1.0), np.full(len(theta), 1.0)
    moved = np.zeros(len(w), bool)
    rng = np.random.Generator(np.random.PCG64(seed))
    index, grade = [np.asarray(x) for x in rows["indices"]], rows["grade"].to_numpy()
    for _ in range(epochs):
        for k in rng.permutation(len(grade)).tolist():
            x = index[k]
            _, g, slopes = loss_and_slopes(w[x].sum(), theta, int(grade[k]))
            step = g + decay * w[x]
            seen[x] += step * step
            w[x] -= rate * step / np.sqrt(seen[x])
            moved[x] = True
            for at, slope in slopes:
                slope = float(np.clip(slope, -2, 2))
                seen_t[at] += slope * slope
                theta[at] -= rate * slope / np.sqrt(seen_t[at])
            theta = np.maximum.accumulate(theta + np.array([0, 1e-3]) * (np.diff(theta, prepend=theta[0] - 1) <= 0))
    return Model(w, theta), moved


def _trainer(model: Model, common: np.ndarray, epochs: int, rate: float, decay: float, seed: int):
    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id", kind="stable")
        rows["indices"] = [x[common[x]] for x in map(np.asarray, rows["indices"])]
        own, moved = _fit_shard(rows, model, epochs, rate, decay, seed)
        at = np.flatnonzero(moved)
        return pd.DataFrame({"at": [at.astype("i4").tobytes()], "w": [own.weights[at].tobytes()], "t": [own.thresholds.tobytes()]})

    return train


def fit(docs: DataFrame, grades: DataFrame, sample: int = 24_000, shards: int = 8, rounds: int = 5, epochs: int = 3, rate: float = 0.2, decay: float = 1e-3, least_docs: int = 3) -> Model:
    """Fit on ``sample`` labelled rows at most, those whose ids have the smallest hashes.

    ``docs`` (doc_id, body) and ``grades`` (doc_id, grade 0..2). Features are made in Spark
    and written once. In each round, each of up to ``shards`` tasks goes over its share of the
    sample from the same model; a weight becomes the mean over the shards that moved it. Features in fewer than
    ``least_docs`` documents of the sample get no weight, as they would only learn rows by heart.
    What reaches the driver is a list of features and ``shards`` models a round, each bounded by DIMS, whatever the input's size. Without
    labelled rows the model stays neutral.
    """
    ids = cut(smallest_hashes(cut(grades, "grades"), "doc_id", sample), "graded")
    rows = docs.join(F.broadcast(ids), "doc_id")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, "body")):
            yield pa.record_batch({"doc_id": b.column("doc_id"), "grade": b.column("grade"), "indices": pa.array([features(t).astype("i4") for t in b.column("body").cast(pa.binary()).to_pylist()], pa.list_(pa.int32()))})

    table = cut(rows.select("doc_id", "grade", "body").mapInArrow(index, "doc_id long, grade int, indices array<int>"), "grade-features")
    shards = max(1, min(shards, ids.count() // LEAST_ROWS))
    table = table.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(shards)).cast("int")).repartition(shards, "shard")
    model, common = Model(), np.zeros(DIMS + BINS * SHAPES, bool)
    often = table.select(F.explode("indices").alias("i")).groupBy("i").count().where(F.col("count") >= least_docs).select("i")
    common[often.toArrow().column(0).to_numpy()] = True
    for k in range(rounds):
        train = _trainer(model, common, epochs, rate / (1 + k / 2), decay, k)
        parts = sorted(table.groupBy("shard").applyInPandas(train, "at binary, w binary, t binary").collect(), key=lambda r: bytes(r["t"]))
        if not parts:
            return model
        total, times = np.zeros(len(model.weights)), np.zeros(len(model.weights))
        for r in parts:
            at = np.frombuffer(r["at"], "i4")
            total[at] += np.frombuffer(r["w"])
            times[at] += 1
        model = Model(np.where(times > 0, total / np.maximum(times, 1), model.weights), np.mean([np.frombuffer(r["t"]) for r in parts], axis=0))
    return model


def graded(labels: DataFrame) -> DataFrame:
    """One grade an id: 0 toxic, 1 poor, 2 good; of several labels the lowest. Labels with null are left out unless toxic."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).where("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def classify(docs: DataFrame, labels: DataFrame, keep_from: float = 0.5, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, **how) -> DataFrame:
    """Grade every document: doc_id (cast to long), expected_grade (0 to 2), p_not_toxic (grade 1 or more),
    p_good (grade 2), kept (p_good of ``keep_from`` or more); with ``carry`` a struct ``row`` of the input's columns.

    Null text counts as empty and is graded by its shape alone. Repeated rows are graded alike. With no labels
    every grade comes from the neutral thresholds, and all is kept. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    # With the row goes its text, so that it isn't sent twice.
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.struct("*").alias("row") if carry else whole(text_col).alias("body"))
    model = fit(docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("body")), graded(labels), **how)
    weights, thresholds, place = model.weights.astype("f4"), model.thresholds, docs.columns.index(text_col)
    own = docs.sparkSession.sparkContext.broadcast(weights)  # a fixed 1 MB

    def text_of(batch: pa.RecordBatch) -> pa.Array:
        return batch.column("row").field(place) if carry else batch.column("body")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = own.value
        for b in (part for batch in batches for part in slices(batch, text_of)):
            s = np.array([w[features(t or b"")].sum(dtype="f8") for t in text_of(b).cast(pa.binary()).to_pylist()])
            some, good = (_sigmoid(s - t) for t in thresholds)
            cols = {"doc_id": b.column("doc_id"), "expected_grade": pa.array(some + good), "p_not_toxic": pa.array(some), "p_good": pa.array(good), "kept": pa.array(good >= keep_from)}
            yield pa.record_batch(cols | ({"row": b.column("row")} if carry else {}))

    row = f", row {base.schema['row'].dataType.simpleString()}" if carry else ""
    return base.mapInArrow(score, f"doc_id long, expected_grade double, p_not_toxic double, p_good double, kept boolean{row}")


def drop_poor(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that classify() keeps, with the input's columns, whatever their names. Null and empty
    texts and null ids are graded like any other row; repeated rows stay or go together; an empty table gives an empty one."""
    return classify(docs, labels, carry=True, **how).where("kept").select("row.*")

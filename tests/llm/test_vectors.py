import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import queries, vector_codes, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, code string, x string, index int, row string, vector int, uid int, n string, whitened string, _label int, at int"
EXTRA = ("c", "x", 1, "r", 2, 3, "n", "w", 4, 5)


def vectors(wide, n, seed=1, spread=1.0):
    """Random vectors with nulls, ties, repeated rows and null labels and ids."""
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, spread) for _ in range(wide)], rng.choice([0, 1, None])) for i in range(n)]
    rows += [(i, list(rows[i][1]), 2) for i in range(min(n, 5))] + [(n + i, list(rows[0][1]), 3) for i in range(10)]
    rows += [(None, [0.5] * wide, None), (n + 20, None, 1), (n + 21, [None] + [0.0] * (wide - 1), 1), (n + 22, [math.inf] * wide, 1), (n + 23, [math.nan] * wide, 1), (n + 24, [-math.inf] + [1.0] * (wide - 1), 1)]
    rng.shuffle(rows)
    return [(*r, *EXTRA) for r in rows]


def _kept(rows):
    return [(r[0], np.array(r[1], "f4").astype("f8"), r[2]) for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]


def _plain_codes(rows, parts, entries, rounds):
    kept = sorted(((i, np.floor(256 * v).astype("i8").reshape(parts, -1), k) for i, v, k in _kept(rows)), key=lambda r: (r[0] is None, r[0] or 0, r[1].ravel().tolist()))
    books = np.stack([v for _, v, _ in kept[:entries]], 1)
    near = lambda v, p: min((int(((v[p] - e) ** 2).sum()), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        at = [[near(v, p)[1] for p in range(parts)] for _, v, _ in kept]
        new = books.copy()
        for p in range(parts):
            for e in range(books.shape[1]):
                own = [v[p] for (_, v, _), a in zip(kept, at) if a[p] == e]
                if own:
                    new[p, e] = [sum(c) // len(own) for c in np.array(own).T.tolist()]
        books = new
    out = [(i, k, [near(v, p) for p in range(parts)]) for i, v, k in kept]
    text = hashlib.sha256(",".join(str(c) for p in books.tolist() for e in p for c in e).encode()).hexdigest()
    errors = {}
    for _, k, own in out:
        errors[k] = errors.get(k, 0) + sum(d for d, _ in own)
    return sorted((str(i), "".join(f"{e:02x}" for _, e in own), sum(d for d, _ in own), errors[k], text) for i, k, own in out)


def test_equal_average_search_equals_brute_force():
    rng = np.random.default_rng(3)
    for spread in (2, 5, 300):
        for wide in (1, 4, 7):
            book, x = rng.integers(-spread, spread + 1, (40, wide)), rng.integers(-spread, spread + 1, (500, wide))
            at, far = vector_codes.nearest(x, book)
            all_far = ((x[:, None] - book) ** 2).sum(2)
            assert (far == all_far.min(1)).all() and (at == all_far.argmin(1)).all()


@pytest.mark.parametrize("n,seed", [(150, 1), (20, 2), (1, 3)])
def test_codes(spark, n, seed):
    rows = vectors(16, n, seed)
    out = vector_codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(3), parts=4, entries=32)
    assert {"x", "index", "row", "vector", "uid", "n", "whitened"} <= set(out.columns) and "embedding" not in out.columns
    assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in out.collect()) == _plain_codes(rows, 4, 32, 2)


def test_codes_by_shuffled_joins(spark, shuffled):
    test_codes(spark, 60, 5)


def test_codes_of_odd_tables(spark):
    df = spark.createDataFrame(vectors(16, 30), SCHEMA)
    assert vector_codes.compress(df.limit(0), parts=4).count() == 0
    assert vector_codes.compress(df.where("embedding is null"), parts=4).count() == 0
    for bad in ([1.0] * 15, [1.0] * 32, [3e38] * 16):
        with pytest.raises(Exception):
            vector_codes.compress(df.unionByName(df.limit(1).withColumn("embedding", F.lit(bad).cast("array<float>"))), parts=4).count()


def test_codes_equal_their_sql(spark, tmp_path):
    import duckdb

    rows = [(r[0], r[1], r[2]) for r in vectors(64, 150, 7, 0.12) if r[0] is not None]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(queries.OP13_SQL).fetchall()
    assert sorted(want) == sorted(tuple(r) for r in queries.op13_vector_codes(spark, str(tmp_path)).collect())


def _check_white(rows, out, most):
    kept = _kept(rows)
    x = np.array([np.floor(64 * v).astype("i8") + 1_000_000 for _, v, _ in kept])
    n, s = len(x), x.sum(0)
    centred = (n * x - s) / n
    variance = centred.T @ centred / n
    values, parts = np.linalg.eigh(variance)
    values, parts = values[::-1][:most], parts[:, ::-1][:, :most]
    values = values[values > values[0] * 1e-11]
    assert sorted((str(r["vec_id"]), r["deviation"]) for r in out) == sorted((str(i), sum((n * int(c) - int(t)) ** 2 for c, t in zip(v, s))) for (i, _, _), v in zip(kept, x))
    assert {r["n"] for r in out} == {n} and all(len(r["whitened"]) == len(r["explained"]) == len(values) for r in out)
    assert np.allclose(out[0]["explained"], values / np.trace(variance), rtol=1e-9)
    white = centred @ (parts[:, : len(values)] / np.sqrt(values))
    got, want = (sorted(np.round(np.abs(m), 6).tolist()) for m in ([r["whitened"] for r in out], white))
    assert np.allclose(got, want, atol=2e-6)
    mine = np.array([r["whitened"] for r in out])
    assert np.abs(np.cov(mine.T, bias=True) - np.eye(len(values))).max() < 1e-9 and len({r["identity_error"] for r in out}) == 1
    assert 0 <= out[0]["identity_error"] < 1e-9


@pytest.mark.parametrize("n,wide,most,blocks", [(300, 8, 5, 16), (300, 8, 32, 1024), (40, 3, 2, 7), (6, 12, 32, 4)])
def test_whitening(spark, n, wide, most, blocks, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", blocks)
    rows = vectors(wide, n, n + wide)
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(3), components=most)
    assert {"x", "index", "row", "vector", "uid", "code"} <= set(out.columns)
    _check_white(rows, out.collect(), most)


def test_whitening_by_shuffled_joins(spark, shuffled, monkeypatch):
    test_whitening(spark, 50, 4, 3, 16, monkeypatch)


def test_whitening_of_odd_tables(spark):
    df = spark.createDataFrame(vectors(4, 30), SCHEMA)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("embedding is null")).count() == 0
    same = whitening.whiten(df.where("vec_id is null").unionByName(df.where("vec_id is null"))).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"]) for r in same] == [(2, 0, [], [])] * 2
    with pytest.raises(ValueError):
        whitening.whiten(df.unionByName(df.limit(1).withColumn("embedding", F.lit([1.0]).cast("array<float>"))))

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from quantloom.llm import decontaminate, exact_dedup, line_dedup, minhash
from quantloom.llm.components import components
from quantloom.llm.shingles import CHUNK, shingle_sets


def _lower(s):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), s)


@pytest.mark.parametrize("first,growth", [(48, 8), (2, 2)])
def test_exact_dedup_equals_grouping(docs, rows, first, growth):
    norm = [re.sub("[ \t-\r]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (i, _), t in zip(rows, norm):
        groups[t].append(i)
    least = {t: min((i for i in g if i is not None), default=None) for t, g in groups.items()}
    want = sorted((str(i), str(least[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(rows, norm))
    out = exact_dedup.exact_dedup(docs, first=first, growth=growth).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in out) == want
    kept = [r for r in out if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_drop_copies_keeps_columns(docs, rows, none):
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns and out.count() == len({re.sub("[ \t-\r]+", " ", t or "") for _, t in rows})
    assert exact_dedup.drop_copies(none).count() == 0


@pytest.mark.parametrize("least,chars", [(2, 1), (10, 1), (3, 0), (2, 5)])
def test_line_dedup_equals_brute_force(docs, rows, least, chars):
    key = lambda line: _lower(line.strip(" \t\n\x0b\x0c\r"))
    # Rows of one id are one document; a row without id is one of its own.
    times = Counter(k for k, _ in {(key(x), (at if i is None else -1, i)) for at, (i, t) in enumerate(rows) for x in (t or "").split("\n")})
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < chars or times[key(x)] < least]
        want.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    out = line_dedup.line_dedup(docs, least, chars).collect()
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept_text"]) for r in out) == sorted(want)


def test_line_dedup_of_nothing(none):
    assert line_dedup.line_dedup(none).count() == 0


def _sets(rows, n):
    out = {}
    for i, t in rows:
        w = [x for x in re.split("[ \t-\r]+", _lower(t or "")) if x]
        out[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    return out


def test_line_counts_are_of_distinct_ids(spark):
    rows = [(1, "common line\nown")] * 10 + [(2, "Common line ")] + [(i, "ten of them") for i in range(3, 13)] + [(None, "no id")] * 10
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()
    assert {(r["doc_id"], r["n_dropped"]) for r in out} == {(1, 0), (2, 0), (None, 1), *((i, 1) for i in range(3, 13))}


def test_lines_by_shuffled_joins(docs, rows, shuffled):
    test_line_dedup_equals_brute_force(docs, rows, 3, 0)


def test_copies_by_shuffled_joins(docs, rows, shuffled):
    test_exact_dedup_equals_grouping(docs, rows, 48, 8)


@pytest.mark.parametrize("n,percent,hot,block,shingles", [(3, 85, 64, 200, 1 << 21), (5, 80, 4, 200, 900)])
def test_near_duplicates_equal_brute_force(docs, rows, n, percent, hot, block, shingles, monkeypatch):
    monkeypatch.setattr(minhash, "HOT", hot)
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", shingles)
    sets = _sets(rows, n)
    ids = sorted(i for i in sets if i is not None)
    find = {i: i for i in ids}

    def root(i):
        while find[i] != i:
            i = find[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                find[max(x, y)] = min(x, y)
    out = {r["doc_id"]: r for r in minhash.near_duplicates(docs, n, percent).collect()}
    assert {i: (out[i]["component_id"], out[i]["n_shingles"]) for i in ids} == {i: (root(i), len(sets[i])) for i in ids}
    assert out[None]["kept"] and out[None]["component_id"] is None


def test_near_duplicates_by_shuffled_joins(docs, rows, shuffled, monkeypatch):
    test_near_duplicates_equal_brute_force(docs, rows, 3, 85, 4, 7, 1 << 21, monkeypatch)


def test_rows_of_one_id_are_one_document(spark):
    rng = random.Random(4)
    a, b = (" ".join(f"w{rng.randrange(900)}" for _ in range(80)) for _ in range(2))
    rows = [(1, a), (2, b), (5, a), (5, b), (5, ""), (6, a + " end"), (7, "alone here"), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = minhash.near_duplicates(df, 3, 85).collect()
    by = {i: {r["component_id"] for r in out if r["doc_id"] == i} for i in (1, 2, 5, 6, 7)}
    assert by[1] == by[6] == {1} and by[2] == {2} and by[5] in ({1}, {2}) and by[7] == {7}
    kept = sorted(r["doc_id"] for r in minhash.drop_near_duplicates(df, 3, 85).collect())
    assert kept == [1, 2, 7, 7]


def test_one_text_in_all_rows(spark):
    df = spark.createDataFrame([(i, "the same five words here and more") for i in range(40)], "doc_id long, text string")
    assert [r["doc_id"] for r in minhash.drop_near_duplicates(df).collect()] == [0]
    assert [r["doc_id"] for r in exact_dedup.drop_copies(df).collect()] == [0]


def test_a_smaller_miss_asks_for_fewer_matches():
    assert minhash.least_matches(80, miss=1e-12) < minhash.least_matches(80) < minhash.least_matches(80, miss=0.01)


def test_near_duplicates_of_nothing(none):
    assert minhash.drop_near_duplicates(none).count() == 0


def test_shingles_don_t_depend_on_chunks():
    text = ("Ab cd éf " * 40_000).encode()
    assert len(text) > CHUNK
    one, = shingle_sets([text], 3)
    two, = shingle_sets([b"ab CD \xc3\xa9f\nab\x0bcd \xc3\xa9f AB cd"], 3)
    assert one.tolist() == two.tolist()
    giant, = shingle_sets([b"x" * (3 * CHUNK) + b" y z"], 3)
    assert len(giant) == 1


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


@pytest.mark.parametrize("make", ["sorted chain", "shuffled chain", "star of the largest", "tree"])
def test_components_take_logarithmic_rounds(spark, make):
    n, rng = 10_000, random.Random(3)
    name = list(range(n + 1))
    if make == "shuffled chain":
        rng.shuffle(name)
    pairs = [(name[i], name[i + 1]) for i in range(n)] if "chain" in make else [(n, i) for i in range(n)] if make.startswith("star") else [(i, rng.randrange(i)) for i in range(1, n + 1)]
    rounds = []
    out = components(spark.createDataFrame(pairs, "a long, b long"), rounds)
    assert out.count() == n + 1 and out.where("component <> 0").isEmpty() and len(rounds) < 20, rounds


def test_components_of_many_small_graphs(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(600), rng.randrange(600)) for _ in range(350)] + [(None, 1), (1, None)]
    find = {}
    root = lambda x: x if find.setdefault(x, x) == x else root(find[x])
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            find[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for x in find}


def test_containment_equals_brute_force(spark, docs, rows):
    long = next(t for i, t in rows if i == 100).split()
    items = [(1, " ".join(long[500:530])), (2, " ".join(long[900:920] + ["zz"] * 1)), (3, "one TWO, three four five six"), (4, "One two"), (5, None), (6, " ".join(long[10:30] + long[4000:4020])), (7, "not there at all in any text")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    cut = lambda t: [x for x in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower()) if x]
    gram = lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    texts, tests = {i: gram(cut(t)) for i, t in rows if i is not None}, {i: gram(cut(t)) for i, t in items}
    want = sorted((d, b, len(s & g)) for d, s in texts.items() for b, g in tests.items() if g and 100 * len(s & g) >= 80 * len(g))
    got = decontaminate.contaminated(docs, bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["shared"]) for r in got) == want and len(want) > 4
    kept = decontaminate.decontaminate(docs, bench)
    bad = {d for d, _, _ in want}
    assert kept.columns == docs.columns and kept.count() == sum(i not in bad for i, _ in rows)


def test_containment_by_shuffled_joins(spark, docs, rows, shuffled):
    test_containment_equals_brute_force(spark, docs, rows)


def test_classes_bound_what_is_probed(spark, monkeypatch):
    """Of a document's shingles only those within its classes' bounds are probed, and none is missed for it."""
    rng = random.Random(6)
    text = [f"w{rng.randrange(3000)}" for _ in range(4000)]
    items = [(k, " ".join(text[at : at + n])) for k, (at, n) in enumerate([(0, 9), (200, 40), (500, 150), (1000, 600)])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(text[:30])), (3, " ".join(text[190:250])), (4, "none of it")], "doc_id long, text string")
    probed = []
    passed = decontaminate.passed
    from quantloom.llm import shared

    monkeypatch.setattr(shared, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(decontaminate, "passed", lambda probes, sketch: probed.append(probes.count()) or passed(probes, sketch))
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (3, 1)] and probed[0] < 3000


def test_containment_of_nothing(docs, none, spark):
    assert decontaminate.contaminated(none, docs.select(docs["doc_id"].alias("item_id"), "text")).count() == 0
    assert decontaminate.contaminated(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_native_plans_run_no_python(docs, spark):
    bench = docs.select(docs["doc_id"].alias("item_id"), "text").limit(3)
    for df in (line_dedup.line_dedup(docs), decontaminate.contaminated(docs, bench)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())

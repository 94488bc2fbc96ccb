import random

import pytest

#: Edge cases: nulls, empty and blank texts, ties, repeated rows, a very long text, no words, odd characters.
EDGES = [
    (1, None), (2, ""), (3, " \t\n "), (4, "One two"), (5, "ONE  two"), (6, "one two"), (7, "one two three four five six seven"),
    (8, "one two three four five six seven"), (8, "one two three four five six seven"), (9, "..!!\n--"), (10, "é Ü ß 你好 \U0001f600 end"), (11, "\x1c\x85 ſecret KKey"), (12, "same line\nother\n\nsame line\n"), (None, "no id here at all, really"),
]


#: Names that the operators use inside or in their results.
CLASHES = ["__gone", "__bad", "__uid", "__bucket", "__rank", "_salt", "_n", "uid", "bucket", "rank", "rep", "token", "body_hash", "set_hash", "component_id", "kept", "item_id", "bound", "layout", "turns", "piece", "start", "indices"]


def words(rng, n, kinds=400):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Edge cases, random texts, exact and near copies, all with extra columns of clashing names."""
    rng = random.Random(5)
    rows = list(EDGES) + [(100, words(rng, 60_000))]
    for i in range(101, 180):
        rows.append((i, words(rng, rng.randrange(1, 120)) + "\n" + rng.choice(["shared line", "Shared LINE ", "own %d" % i])))
    base = words(rng, 200).split()
    for i in range(200, 290):  # near copies of one text, some only slightly
        own = list(base)
        for _ in range(i % 13):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    for i in range(300, 330):
        rows.append((i, "copied   text number %d" % (i % 3)))
    schema = "doc_id long, text string, pos int, key string, n long, row string, body string, gid int, h long, shared int, length int, sequence_id int, own int, " + ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([(i, t, 0, "k", 1, "r", "b", 2, 3, 4, 5, 6, 7, *CLASHES) for i, t in rows], schema)


@pytest.fixture
def shuffled(monkeypatch):
    """Nothing is small enough to be broadcast."""
    from quantloom.llm import shared

    monkeypatch.setattr(shared, "BROADCAST_BYTES", -1)


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)

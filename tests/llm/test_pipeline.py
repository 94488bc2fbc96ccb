import random
import re
import zlib

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from quantloom.llm import packing, quality, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_one_query_for_each_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.fixture(scope="module")
def corpus(spark, rows, tmp_path_factory):
    """The edge cases with the columns of documents, labels for some of them, and test items of which some stand in documents."""
    root, rng = tmp_path_factory.mktemp("corpus"), random.Random(9)
    long = next(t for i, t in rows if i == 100).split()
    docs = [(i, t, None if k % 5 == 0 else "en", f"s{k % 3}", None if k % 4 == 0 else len(t or "")) for k, (i, t) in enumerate(rows)]
    docs += [(2000 + k, "bad &&& " * 4 + " ".join(f"q{rng.randrange(300)}" for _ in range(20)), "en", "s", 1) for k in range(60)]
    labels = [(i, 1, 0) for i, _ in rows if i and 100 <= i < 330] + [(2000 + k, 0, 0) for k in range(40)] + [(2040, 1, 1), (None, 0, 0), (1, None, None)]
    items = [(1, " ".join(long[500:530])), (2, "not in any document at all, I think"), (3, None), (4, ""), (None, " ".join(long[0:30])), (5, "copied text number 1")]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def _sets(texts, n=5, gap="[ \t-\r]+"):
    for t in texts:
        w = [x for x in re.split(gap, re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) if x]
        yield {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def test_quality_stage_keeps_what_the_classifier_keeps(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    out = corpus_pipeline.quality_stage(spark, docs, corpus)
    kept = {str(r["doc_id"]): r["kept"] for r in quality.classify(docs, spark.read.parquet(f"{corpus}/labels.parquet")).collect()}
    assert out.columns == docs.columns and len(kept) > 200
    assert _rows(out) == sorted((r for r in _rows(docs) if kept[str(r[0])]), key=str)
    assert not any(2000 <= (r[0] or 0) < 2060 for r in _rows(out)) and sum(100 <= (r[0] or 0) < 330 for r in _rows(out)) > 190


def test_exact_stage_keeps_the_first_of_each_text(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    out, first = corpus_pipeline.exact_stage(spark, docs, corpus), {}
    for r in sorted(_rows(docs), key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(re.sub("[ \t-\r]+", " ", r[1] or ""), r[0])
    assert out.columns == docs.columns and sorted(str(r[0]) for r in _rows(out)) == sorted(str(i) for i in first.values())


def test_near_stage_keeps_one_of_each_group(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").where("doc_id is null or doc_id <> 100")
    rows = [r for r in _rows(docs)]
    sets = list(_sets([r[1] for r in rows]))
    find = {r[0]: r[0] for r in rows if r[0] is not None}
    root = lambda x: x if find[x] == x else root(find[x])
    for a in range(len(rows)):
        for b in range(a):
            s, t = sets[a], sets[b]
            if s and t and rows[a][0] is not None and rows[b][0] is not None and 100 * len(s & t) >= 80 * len(s | t):
                x, y = root(rows[a][0]), root(rows[b][0])
                find[max(x, y)] = min(x, y)
    out = corpus_pipeline.near_stage(spark, docs, corpus)
    assert out.columns == docs.columns and _rows(out) == sorted((r for r in rows if r[0] is None or root(r[0]) == r[0]), key=str)


def test_benchmark_stage_drops_what_holds_an_item(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    items = [r[1] for r in _rows(spark.read.parquet(f"{corpus}/benchmark.parquet")) if r[0] is not None]
    gap = "[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    rows = _rows(docs)
    tests = [s for s in _sets(items, gap=gap) if s]
    bad = {r[0] for r, s in zip(rows, _sets([(r[1] or "").lower() for r in rows], gap=gap)) if r[0] is not None and any(100 * len(s & t) >= 80 * len(t) for t in tests)}
    out = corpus_pipeline.benchmark_stage(spark, docs, corpus)
    assert out.columns == docs.columns and _rows(out) == sorted((r for r in rows if r[0] not in bad), key=str) and {100, 301} <= bad


def test_packing_stage_places_every_token(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    coder, want = tokens.coder(tokens.default_path()), []
    for r in _rows(docs):
        ids = coder._whole(r[1] or "") + (1).to_bytes(4, "little")
        want += [(str(r[0]), k, at // 4, len(ids[at : at + 16384]) // 4, zlib.crc32(ids[at : at + 16384])) for k, at in enumerate(range(0, len(ids), 16384))]
    out = corpus_pipeline.packing_stage(spark, docs, corpus).collect()
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(want)
    ends = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 4096 and len(ends) == packing.plan({n: sum(r["length"] == n for r in out) for n in {r["length"] for r in out}}, 4096)[1]


def test_stages_of_nothing(spark, corpus):
    none = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, corpus)
        assert out.count() == 0 and (name == "best-fit packing" or out.columns == none.columns)


def test_stages_take_what_the_one_before_kept(spark, corpus, monkeypatch):
    """Each stage gets the rows and columns that the one before returned, and the last one's rows come out."""
    docs, seen = spark.read.parquet(f"{corpus}/documents.parquet"), []

    def watched(stage):
        def run(spark, given, sf_dir):
            out = stage(spark, given, sf_dir)
            seen.append((given, out))
            return out

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, watched(stage)) for name, stage in corpus_pipeline.STAGES])
    ran = corpus_pipeline.run(spark, corpus)
    assert _rows(seen[0][0]) == _rows(docs) and len(seen) == 5 and all(out.columns == docs.columns for _, out in seen[:-1])
    counts = [given.count() for given, _ in seen]
    assert counts == sorted(counts, reverse=True) and counts[-1] < counts[0]
    assert {str(r["doc_id"]) for r in ran.collect()} == {str(r[0]) for r in _rows(seen[-1][0])} and not {"100", "301"} & {str(r["doc_id"]) for r in ran.collect()}

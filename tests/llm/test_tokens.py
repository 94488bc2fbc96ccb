import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import chat_format, packing, tiered_packing, token_store, tokens

CODER = tokens.coder(tokens.default_path())


def test_ids_equal_the_library_s(rows):
    rng = random.Random(2)
    bits = list("aB9 '.\n\x1c\x85 ́ΣσßÉ×ªİ") + ["<|endoftext|>", "'ll", "<|", "你", "\U0001f600", "é"]
    texts = [t or "" for _, t in rows[:40]] + ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(3000)]
    assert all(CODER.encode(t) == CODER._whole(t) for t in texts)


def test_other_vocabularies_are_encoded_text_by_text(tmp_path):
    """A file's name doesn't matter, its rules do."""
    import json

    import public_tokenizers

    rules = json.load(open(tokens.default_path(), encoding="utf-8"))
    assert tokens.splits_at_blanks(rules)
    rules["normalizer"]["normalizers"].pop()
    (tmp_path / "word_bpe_own.json").write_text(json.dumps(rules))
    for path in (str(tmp_path / "word_bpe_own.json"), public_tokenizers.path("byte_bpe_50k.json")):
        own = tokens.WordCoder(path)
        assert not own.by_word and all(own.encode(t) == own._whole(t) for t in ("Two WORDS  and\nmore", "it's <|endoftext|> 'LL", ""))


def test_a_full_cache_changes_nothing(monkeypatch):
    coder = tokens.WordCoder(tokens.default_path())
    coder.words.most = coder.pieces.most = 3
    for k in range(200):
        t = f"word{k} other, éa{k} 你{k % 7}"
        assert coder.encode(t) == coder._whole(t)
    assert len(coder.words) <= 3


def test_store_round_trip(spark, docs, rows, none):
    manifest = token_store.write_store(docs.repartition(3))
    out = sorted((r.asDict() for r in token_store.read_store(spark, manifest, ids=True).collect()), key=lambda r: r["start"])
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for r, (i, t) in zip(out, want, strict=True):
        ids = CODER._whole(t or "") + (2).to_bytes(4, "little")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], np.array(r["ids"], "<u4").tobytes()) == (i, start, len(ids) // 4, zlib.crc32(ids), ids)
        start += len(ids) // 4
    assert sorted(r["doc_id"] for r in token_store.read_store(spark, manifest, wanted=[4, 8, 100]).collect()) == [4, 8, 8, 100]
    assert token_store.read_store(spark, token_store.write_store(none)).count() == 0


def _check_packing(pieces, capacity):
    by = {}
    for r in pieces:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_dictionary_s_sample_leaves_out_nulls_and_repeats(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(f"w{rng.randrange(300)} some words" for _ in range(200))) for i in range(60)]
    train = lambda rows: token_store.train_dictionary(spark.createDataFrame(rows, "doc_id long, body string"), tokens.default_path(), 2, sample_docs=20, size=2048)
    plain = train(texts)
    assert plain
    assert train(texts + [(None, "nothing")] * 100) == plain
    assert train(texts + texts[:30] * 20 + [(i, texts[i][1] + " later") for i in range(60)]) == plain


@pytest.mark.parametrize("n,ids,texts", [(1, True, "text"), (7, True, "text"), (8, True, "text"), (40, True, "text"), (8, True, ""), (1, True, None), (7, False, "text"), (1, False, None)])
def test_every_store_has_a_dictionary(spark, n, ids, texts):
    rows = [(i if ids else None, texts and f"{texts} number {i} of a few") for i in range(n)]
    manifest = token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["dictionary"] for r in manifest.collect()}.isdisjoint({hashlib.sha256(b"").hexdigest()})
    got = token_store.read_store(spark, manifest, ids=True).collect()
    assert sorted(np.array(r["ids"], "<u4").tobytes() for r in got) == sorted(CODER._whole(t or "") + (2).to_bytes(4, "little") for _, t in rows)


def test_packing_by_shuffled_joins(spark, docs, rows, none, shuffled, monkeypatch):
    test_packing_of_documents(spark, docs, rows, none, 5, monkeypatch)


def test_packing_keeps_other_columns(spark):
    df = spark.createDataFrame([(i, 1 + i % 9, "u", "b", "r", -1) for i in range(50)], "id int, length int, __uid string, bucket string, row string, offset int")
    out = packing.pack(df, 10)
    assert out.columns == ["id", "length", "__uid", "bucket", "row", "sequence_id", "offset"] and {(r["__uid"], r["bucket"], r["row"]) for r in out.collect()} == {("u", "b", "r")}
    _check_packing(out.collect(), 10)
    for bad in (0, 11, None):
        with pytest.raises(ValueError):
            packing.pack(spark.createDataFrame([(bad,)], "length int"), 10)


def test_a_plan_of_many_equal_items_is_short():
    counts, start = {1400: 5_000_000, 1348: 5_000_000}, time.time()
    runs, bins = packing.plan(counts, 4096)
    assert time.time() - start < 1 and len(runs) < 40
    assert -(-sum(x * n for x, n in counts.items()) // 4096) <= bins <= _plain(counts, 4096)


@pytest.mark.parametrize("bucket", [20_000, 5])
def test_packing_of_documents(spark, docs, rows, none, bucket, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", bucket)
    out = packing.pack(packing.token_pieces(docs, capacity=256), capacity=256).collect()
    want = []
    for i, t in rows:
        ids = CODER._whole(t or "") + (1).to_bytes(4, "little")
        want += [(str(i), k, at // 4, len(ids[at : at + 1024]) // 4, zlib.crc32(ids[at : at + 1024])) for k, at in enumerate(range(0, len(ids), 1024))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(want)
    total = sum(r["length"] for r in out)
    assert -(-total // 256) <= _check_packing(out, 256) <= _plain(Counter(r["length"] for r in out), 256)
    assert packing.pack(packing.token_pieces(none)).count() == 0


def _plain(counts, capacity):
    """Bins of best-fit decreasing without the reduction."""
    left = np.zeros(capacity + 1, "i8")
    for length, n in counts.items():
        left[length] = n
    return sum(n for n, _ in packing.best_fit(left, capacity))


def _fewest(items, capacity):
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in {b for b in bins if b + items[i] <= capacity}:
            k = bins.index(room)
            bins[k] += items[i]
            go(i + 1, bins)
            bins[k] -= items[i]
        bins.append(items[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


def test_reduction_keeps_an_optimum():
    rng = random.Random(4)
    for _ in range(150):
        capacity = rng.choice([10, 17, 30])
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        left = np.zeros(capacity + 1, "i8")
        for x in items:
            left[x] += 1
        fixed = packing.reduce_dominated(left, capacity)
        rest = sorted((x for x in range(capacity + 1) for _ in range(int(left[x]))), reverse=True)
        assert sum(n for n, _ in fixed) + (_fewest(rest, capacity) if rest else 0) == _fewest(items, capacity)
        assert all(sum(x * k for x, k in own) <= capacity for _, own in fixed)


def test_equal_triples_are_one_run():
    for counts, capacity, bins in (({1365: 30_000}, 4096, 10_000), ({40: 9_000, 33: 9_000, 26: 9_000}, 100, 9_000)):
        runs, n = packing.plan(counts, capacity)
        assert n == bins and len(runs) < 40
        assert all(sum(each * length for length, _, first, each, _ in runs.tolist() if first == b) <= capacity for b in set(runs[:, 2].tolist()))


def test_plan_places_every_item_once():
    rng = random.Random(6)
    counts = {x: rng.randint(1, 400) for x in rng.sample(range(1, 513), 200)}
    runs, bins = packing.plan(counts, 512)
    total = sum(x * n for x, n in counts.items())
    assert -(-total // 512) <= bins <= _plain(counts, 512)
    out = []
    for length, n in counts.items():
        own = runs[runs[:, 0] == length]
        for rank in range(n):
            r = own[np.searchsorted(own[:, 1], rank, "right") - 1]
            q = rank - r[1]
            out.append({"sequence_id": int(r[2] + q // r[3]), "offset": int(r[4] + q % r[3] * length), "length": length})
    assert _check_packing(out, 512) == bins


LAYOUTS = [
    ("messages", {"messages": [{"role": "human", "content": "a"}, {"role": "gpt", "content": "b"}]}, [("user", "a"), ("assistant", "b")]),
    ("system", {"system": "s", "messages": [{"role": "user", "content": None}]}, [("system", "s"), ("user", "")]),
    ("prompt", {"prompt": "p", "response": "r"}, [("user", "p"), ("assistant", "r")]),
    ("instruction", {"instruction": "i", "input": "x", "output": "o"}, [("user", "i\nx"), ("assistant", "o")]),
    ("no input", {"instruction": "i", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ("unknown", {"prompt": "p", "output": "o"}, None),
]


def test_layouts_choose_mappings(spark):
    kind = "struct<messages:array<struct<role:string,content:string>>,prompt:string,response:string,instruction:string,input:string,output:string,system:string>"
    df = spark.createDataFrame([(k, r) for k, r, _ in LAYOUTS], f"k string, record {kind}")
    out = {r["k"]: r for r in chat_format.canonical(df, "record").collect()}
    assert {k: r["turns"] and [tuple(t) for t in r["turns"]] for k, r in out.items()} == {k: want for k, _, want in LAYOUTS}
    assert len({r["layout"] for r in out.values()}) == len(LAYOUTS)


def test_formatting_is_reversible(spark):
    rng = random.Random(8)
    bits = ["<", "|", "\\", "turn", "|>", "<|end|>\n", "</s>", "[INST]", "[/INST]", "[\\INST]", "\n", "é", "\U0001f600", "<\\n>", "<<SYS>>", " "]
    some = lambda n: "".join(rng.choice(bits) for _ in range(rng.randrange(n)))
    convs = [(i, [(rng.choice(["user", "assistant", some(4)]), some(9)) for _ in range(rng.randrange(6))]) for i in range(300)]
    df = spark.createDataFrame(convs, "k long, turns array<struct<role:string,text:string>>")
    out = {r["k"]: r for r in chat_format.read_back(chat_format.format_chats(df, "k"), "k").collect()}
    for k, turns in convs:
        assert [tuple(t) for t in out[k]["turns"]] == turns
        assert out[k]["loss_text"] == "".join(t for r, t in turns if r == "assistant")
    assert chat_format.read_back(chat_format.format_chats(df.limit(0), "k"), "k").count() == 0


def test_rows_of_one_key_stay_apart(spark):
    kind = "k long, turns array<struct<role:string,text:string>>, layout int"
    one, two = [("user", "a"), ("assistant", "b")], [("user", "c"), ("assistant", "d"), ("assistant", None)]
    rows = [(1, one, 0), (1, two, 0), (1, one, 0), (None, one, 0), (None, two, 0), (2, None, 0), (3, [], 0), (4, [(None, None)], 0), (5, [None, ("user", "x")], 0)]
    made = chat_format.format_chats(spark.createDataFrame(rows, kind), "k").collect()
    text = lambda turns: "".join(f"<|turn|>{r or ''}\n{t or ''}<|end|>\n" for r, t in (x for x in turns or [] if x))
    assert sorted((str(r["k"]), r["formatted"]) for r in made) == sorted((str(k), text(t)) for k, t, _ in rows)
    read = chat_format.read_back(chat_format.format_chats(spark.createDataFrame(rows, kind), "k"), "k").collect()
    assert sorted((str(r["k"]), r["loss_text"], len(r["turns"])) for r in read) == sorted((str(k), "".join(x or "" for r, x in (y for y in t or [] if y) if r == "assistant"), len([y for y in t or [] if y])) for k, t, _ in rows)


def test_reading_a_very_long_conversation_is_linear(spark):
    took = []
    for n in (2_000, 20_000):
        df = spark.range(1).select("id", F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(F.when(i % 2 == 0, "assistant").otherwise("user").alias("role"), F.repeat(F.lit("é word </s> "), 10).alias("text"))).alias("turns"))
        start = time.time()
        r = chat_format.read_back(chat_format.format_chats(df, "id"), "id").first()
        took.append(time.time() - start)
        assert len(r["turns"]) == n and r["loss_text"] == "é word </s> " * 10 * (n // 2)
    assert took[1] < 8 * took[0] + 2


def test_native_plan_of_chats_runs_no_python(spark):
    df = spark.createDataFrame([(1, [("user", "a")])], "k long, turns array<struct<role:string,text:string>>")
    plan = chat_format.read_back(chat_format.format_chats(df, "k"), "k")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def _check_tiers(runs, counts, tiers):
    """Every item is cut without gap into parts, every sequence is filled without gap."""
    items, sequences = {}, {}
    for item, start, rank, n, length, sequence, offset, tier, _ in runs.tolist():
        for q in range(n):
            items.setdefault((item, rank + q), []).append((start, length))
            sequences.setdefault(sequence + q, [tier]).append((offset, length))
    assert Counter(x for x, _ in items) == Counter({x: n for x, n in counts.items() if n}) and Counter(s[0] for s in sequences.values()) == tiers
    for own, whole in [*((v, k[0]) for k, v in items.items()), *((v[1:], v[0]) for v in sequences.values())]:
        at = 0
        for start, length in sorted(own):
            assert start == at and length > 0
            at += length
        assert at == whole


def test_tier_plans_have_no_padding():
    rng = random.Random(9)
    for _ in range(60):
        counts = {x: rng.randint(1, 40) for x in rng.sample(range(1, 257), rng.randint(1, 50))}
        runs, tiers = tiered_packing.plan(counts, 256, 32)
        assert all(t & (t - 1) == 0 and t <= 256 for t in tiers)
        _check_tiers(runs, counts, tiers)
    for counts in ({}, {1: 1}, {256: 3}, {1: 3000}, {255: 500}, {129: 77, 128: 1}):
        _check_tiers(*(lambda p: (p[0], counts, p[1]))(tiered_packing.plan(counts, 256, 32)))


def test_tier_plans_don_t_grow_with_the_corpus():
    rng = random.Random(10)
    counts = {x: rng.randint(1, 90) for x in range(1, 2049)}
    small, large = (tiered_packing.plan({x: n * k for x, n in counts.items()}) for k in (1, 10_000))
    assert len(large[0]) < 5 * len(small[0]) and sum(large[0][:, 3] * large[0][:, 4]) == 10_000 * sum(x * n for x, n in counts.items())
    start = time.time()
    runs, _ = tiered_packing.plan({1025: 10**9, 3: 10**9})
    assert time.time() - start < 2 and len(runs) < 20_000


def test_steps_are_balanced():
    tiers = {256: 1000, 64: 777, 32: 5, 8: 1}
    tier = np.concatenate([np.full(n, t) for t, n in tiers.items()])
    step = tiered_packing.steps(tier, np.concatenate([np.arange(n) for n in tiers.values()]), tiers, 1024)
    assert set(step.tolist()) == set(range(step.max() + 1))
    for s in range(step.max() + 1):
        own = tier[step == s]
        assert len(set(own.tolist())) == 1 and len(own) <= 1024 // own[0]
    for t, n in tiers.items():
        sizes = Counter(step[tier == t].tolist()).values()
        assert max(sizes) - min(sizes) <= 1 and len(sizes) == -(-n * t // 1024)


def test_tiered_packing_of_documents(spark, docs, rows, none):
    out = tiered_packing.pack_tiers(tiered_packing.token_items(docs.repartition(5), capacity=256), 256, 32, 1024).collect()
    ids = {}
    for i, t in rows:
        ids.setdefault(str(i), []).append(CODER._whole(t or "") + (1).to_bytes(4, "little"))
    for i, own in ids.items():
        mine = [r for r in out if str(r["doc_id"]) == i]
        for r in mine:
            assert any(zlib.crc32(x[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"] and 4 * r["doc_tokens"] == len(x) for x in own)
        if len(own) == 1:
            ends = sorted(r["start"] + r["length"] for r in mine)
            assert sorted(r["start"] for r in mine) == [0, *ends[:-1]] and ends[-1] == len(own[0]) // 4
        assert sum(r["length"] for r in mine) == sum(len(x) for x in own) // 4
    full = {r["sequence_id"]: r["tier"] for r in out}
    assert all(t & (t - 1) == 0 for t in full.values()) and _check_packing(out, 256) == len(full)
    assert {s: sum(r["length"] for r in out if r["sequence_id"] == s) for s in full} == full
    assert len({(r["sequence_id"], r["step"]) for r in out}) == len(full)
    assert tiered_packing.pack_tiers(tiered_packing.token_items(none)).count() == 0


def test_tiered_packing_by_shuffled_joins(spark, docs, rows, none, shuffled):
    test_tiered_packing_of_documents(spark, docs, rows, none)


def test_chats_are_dealt_once(spark, tmp_path):
    """One exchange an operator, and one for both and the query where rows are dealt by conversation before."""
    from quantloom.llm import queries

    df = spark.createDataFrame([(1, [("user", "a")])], "k long, turns array<struct<role:string,text:string>>")
    spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", None)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = lambda d: d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        made = chat_format.format_chats(df, "k")
        assert plan(made) == 1 and plan(chat_format.read_back(made, "k")) == 2
        assert plan(chat_format.read_back(chat_format.format_chats(df.repartition("k"), "k"), "k")) == 1
        assert plan(queries.op5_chat_format(spark, str(tmp_path))) == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("most", [(50, 1 << 40), (10**9, 3_000)])
def test_shards_are_bounded(spark, monkeypatch, most):
    """Many rows of one id and of none: shards of few documents or bytes, several a task, and the starts of one whole store."""
    monkeypatch.setattr(token_store, "SHARD_DOCS", most[0])
    monkeypatch.setattr(token_store, "SHARD_BYTES", most[1])
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, f"text {k * 7919 % 1000} of many" + " more" * (k % 50)) for k in range(1200)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    shards = manifest.orderBy("start").collect()
    assert max(r["n_docs"] for r in shards) <= most[0] and len(shards) >= (20 if most[0] == 50 else 8) and max(r["part"] for r in shards) > 0
    assert len({r["task"] for r in shards if r["first_id"] == 7}) > 1 and len({r["task"] for r in shards if r["first_id"] is None}) > 1
    out = sorted((r.asDict() for r in token_store.read_store(spark, manifest, ids=True).collect()), key=lambda r: r["start"])
    start = 0
    for r, (i, t) in zip(out, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])), strict=True):
        ids = CODER._whole(t) + (2).to_bytes(4, "little")
        assert (r["doc_id"], r["start"], np.array(r["ids"], "<u4").tobytes()) == (i, start, ids)
        start += len(ids) // 4


def test_a_very_long_turn_is_read_back(spark):
    """Two million characters with control strings in one turn, and as many in its role."""
    long = "é </s> <|end|>\n [INST] \\ " * 80_000
    turns = [("user", long), ("assistant", long + "x"), (long, "short")]
    df = spark.createDataFrame([(1, turns)], "k long, turns array<struct<role:string,text:string>>")
    r = chat_format.read_back(chat_format.format_chats(df, "k"), "k").first()
    assert [tuple(t) for t in r["turns"]] == turns and r["loss_text"] == long + "x"

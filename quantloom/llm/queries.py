"""The queries of this subpackage, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import chat_format, decontaminate, exact_dedup, license_scan, line_dedup, minhash, packing, quality, secret_scan, tiered_packing, token_store, vector_codes, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents")).drop("detections")


def op2_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(_table(spark, sf_dir, "documents")))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_guess", "max_cost")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') FROM benchmark),
grams AS (
  SELECT DISTINCT side, id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS g
  FROM words WHERE len(w) > 0),
sizes AS (SELECT id, count(*) AS item_shingles FROM grams WHERE side = 'b' GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*) AS shared, any_value(item_shingles) AS item_shingles,
       count(*) / any_value(item_shingles)::DOUBLE AS containment
FROM grams d JOIN grams b ON d.g = b.g AND d.side = 'd' AND b.side = 'b' JOIN sizes s ON s.id = b.id
GROUP BY d.id, b.id HAVING count(*) * 100 >= any_value(item_shingles) * 80
"""


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as message records, and -7 as a prompt and response record; both
    go through their layout's mapping. The digests are read back from the formatted text. Rows are dealt by conversation once."""
    said, blank = F.lit("</s>[INST] ok [/INST]"), F.lit(None).cast("string")
    row = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content"))
    told = _table(spark, sf_dir, "conversations").select("conv_id", row.alias("row"), blank.alias("said"))
    own = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(None).cast(told.schema["row"].dataType).alias("row"), said.alias("said"))
    rows = told.unionByName(own).groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"), F.max("said").alias("said"))
    messages = F.transform("rows", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    record = F.struct(F.when(F.col("said").isNull(), messages).alias("messages"), F.col("said").alias("prompt"), F.col("said").alias("response"))
    made = chat_format.format_chats(chat_format.canonical(rows.select("conv_id", record.alias("record")), "record"), "conv_id")
    read = chat_format.read_back(made, "conv_id")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v),
e AS (SELECT *, replace(text, '\', '\\') AS x FROM t),
f AS (SELECT *, length(x) + (length(x) - length(replace(x, '<|', ''))) / 2 + (length(x) - length(replace(x, '<s>', ''))) / 3
  + (length(x) - length(replace(x, '</s>', ''))) / 4 + (length(x) - length(replace(x, '[INST]', ''))) / 6 + (length(x) - length(replace(x, '[/INST]', ''))) / 7
  + (length(x) - length(replace(x, '<<SYS>>', ''))) / 7 + (length(x) - length(replace(x, '<</SYS>>', ''))) / 8 AS n FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(17 + length(role) + n)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), n=3, percent=85)


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r) AS component_id, min(r) = d.doc_id AS kept
FROM documents d JOIN reach ON reach.id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_store(spark, token_store.write_store(_table(spark, sf_dir, "documents")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN frequent f ON k.key = f.key GROUP BY doc_id
"""


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256 FROM n
"""


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(_table(spark, sf_dir, "embeddings"), components=32)
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "pair")
    return out.select("vec_id", "n", "deviation", "identity_error", each).select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "pair.whitened", "pair.explained", "identity_error")


def op12_tiered_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiered_packing.pack_tiers(tiered_packing.token_items(_table(spark, sf_dir, "documents")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _assigned(books: str) -> str:
    """Each part's nearest entry of a codebook: rows (id, p, v, label, d * 64 + e)."""
    return f"""SELECT x.r, x.p, any_value(x.v) AS v, min(list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 64 + b.e) AS best
  FROM parts x JOIN {books} b ON x.p = b.p GROUP BY x.r, x.p"""


def _moved(books: str, assigned: str) -> str:
    return f"""SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM {books} b LEFT JOIN (
    SELECT p, e, list(floor(total::DOUBLE / n)::BIGINT ORDER BY c) AS v FROM (
      SELECT p, best % 64 AS e, c, sum(y)::BIGINT AS total, count(*) AS n FROM (SELECT p, best, unnest(v) AS y, unnest(range(len(v))) AS c FROM {assigned}) GROUP BY p, best % 64, c) GROUP BY p, e
  ) m ON m.p = b.p AND m.e = b.e"""


OP13_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT r, p, v[p * len(v) // 16 + 1:(p + 1) * len(v) // 16] AS v FROM (SELECT r, v, unnest(range(16)) AS p FROM kept)),
b0 AS (SELECT p, r AS e, v FROM parts WHERE r < 64),
a0 AS ({_assigned("b0")}),
b1 AS ({_moved("b0", "a0")}),
a1 AS ({_assigned("b1")}),
b2 AS ({_moved("b1", "a1")}),
a2 AS ({_assigned("b2")}),
codes AS (SELECT r, string_agg(printf('%02x', best % 64), '' ORDER BY p) AS code, sum(best // 64)::BIGINT AS error FROM a2 GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256
FROM kept JOIN codes USING (r)
"""

QUERIES = {f.__name__: f for f in (op1_license_scan, op2_best_fit_pack, op3_secret_scan, op4_decontaminate, op5_chat_format, op6_minhash_near_dedup, op7_quality, op8_token_store, op9_line_dedup, op10_exact_dedup, op11_embedding_whitening, op12_tiered_pack, op13_vector_codes)}
SQL = {"op4_decontaminate": OP4_SQL, "op5_chat_format": OP5_SQL, "op6_minhash_near_dedup": OP6_SQL, "op9_line_dedup": OP9_SQL, "op10_exact_dedup": OP10_SQL, "op13_vector_codes": OP13_SQL}

"""Posts: entity tagging, weights, spam, and time-decayed sentiment aggregates."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.scalars import last_by
from quantloom.functions.tables import cut, join_keyed


#: What spam says: fixed values.
SPAM = "giveaway|airdrop|claim now|join my"


def tag_entities(posts: DataFrame, aliases: DataFrame, key: str, text: str, default: str | None = "GENERAL") -> DataFrame:
    """A row per (post, ticker) whose text holds one of the ticker's terms between non-alphanumerics, in any case.

    The posts' tokens that any term has are written, without their texts, and counted. A term is looked for where its rarest token stands, so that
    one of frequent words meets few posts; a post's terms come to it by ``key``, which is unique, and the whole term with its boundaries is looked for
    in the text where that is. Posts without a hit get ``default``, or go if it is None. Texts are read twice and shuffled once."""
    tokens = lambda c: F.array_distinct(F.array_remove(F.split(F.lower(c), "[^a-z0-9]+"), ""))
    terms = cut(aliases.select("ticker", F.lower("term").alias("term"), F.explode(tokens(F.col("term"))).alias("__t")).distinct(), "terms")
    words = cut(terms.select("__t").distinct(), "words")
    there = cut(join_keyed(posts.select(key, F.explode(tokens(F.col(text))).alias("__t")), words, ["__t"]), "tokens")
    counts = there.groupBy("__t").agg(F.count("*").alias("__n"))
    rarest = cut(terms.join(counts, "__t").groupBy("ticker", "term").agg(F.min_by("__t", F.struct("__n", "__t")).alias("__t")), "rarest")
    near = join_keyed(there, rarest, ["__t"]).groupBy(key).agg(F.collect_set(F.struct("ticker", "term")).alias("__near"))
    found = lambda term: F.concat(F.lit("(^|[^a-z0-9])"), F.regexp_replace(term, "([^a-z0-9 ])", "\\\\$1"), F.lit("($|[^a-z0-9])"))
    hits = F.array_distinct(F.transform(F.filter("__near", lambda x: F.regexp_like(F.lower(text), found(x["term"]))), lambda x: x["ticker"]))
    out = posts.join(near, key, "left").withColumn("ticker", F.explode_outer(hits)).drop("__near")
    return out.withColumn("ticker", F.coalesce("ticker", F.lit(default))) if default is not None else out.where("ticker is not null")


def is_spam(text: Column, followers: Column, name: Column) -> Column:
    """Give-away words, under 25 followers (null passes), or a blank display name."""
    return F.coalesce(text.rlike(f"(?i){SPAM}"), F.lit(False)) | F.coalesce(followers < 25, F.lit(False)) | (F.trim(F.coalesce(name, F.lit(""))) == "")


def retain(df: DataFrame, ts: str, cutoff) -> DataFrame:
    """Rows from ``cutoff`` on, which is a parameter, never the clock."""
    return df.where(F.col(ts) >= cutoff)


def take_until_old(df: DataFrame, feed: str, seq: str, ts: str, cutoff) -> DataFrame:
    """Of each feed in order, the rows before its first one older than ``cutoff``: one aggregate a feed, then a filter."""
    first = df.where(F.col(ts) < cutoff).groupBy(feed).agg(F.min(seq).alias("__first"))
    return df.join(first, feed, "left").where(F.col("__first").isNull() | (F.col(seq) < F.col("__first"))).drop("__first")


def latest_sentiment(df: DataFrame) -> DataFrame:
    """The last day's row of each (ticker, source)."""
    return last_by(df, ["ticker", "source"], ["date"])


def prepare_text(df: DataFrame, channel: str | Column) -> DataFrame:
    """Text and raw engagement by channel, a name or a column of names: news has its title; reddit title and body; x its body. Text and engagement of other channels are null."""
    at = F.lit(channel) if isinstance(channel, str) else channel
    title, body = F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))
    text = F.when(at == "news", title).when(at == "reddit", F.trim(F.concat(title, F.lit("\n"), body), F.lit(" \n\t\r"))).when(at == "x", body)
    raw = F.when(at == "news", 0.0).when(at.isin("reddit", "x"), F.greatest(F.coalesce("score", F.lit(0)), F.lit(0)).cast("double"))
    return df.withColumns({"text": text, "engagement_raw": raw, "source_label": F.when(at != "x", F.col("source_label"))})


def engagement(c: Column) -> Column:
    return F.log1p(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))) + 1.0


def source_quality(df: DataFrame, weights: DataFrame, label: str = "source_label", default: float = 0.5) -> DataFrame:
    """Weight of a label in any case, ``default`` if unknown."""
    w = weights.select(F.lower(F.trim("name")).alias("__name"), F.col("weight").alias("source_weight"))
    return df.join(w, F.lower(F.trim(label)) == F.col("__name"), "left").withColumn("source_weight", F.coalesce("source_weight", F.lit(default))).drop("__name")


def confidence(neutral: Column) -> Column:
    return F.coalesce(F.greatest(1.0 - neutral, F.lit(0.1)), F.lit(0.1))


def importance(df: DataFrame) -> DataFrame:
    return df.withColumn("weight", engagement(F.col("engagement_raw")) * F.col("source_weight") * confidence(F.col("neutral")))


def hash_key(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 16)


def enrich_distinct(df: DataFrame, key: str, enrich: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """An expensive function once for each distinct key, joined back to all rows."""
    return df.join(enrich(df.select(key).where(F.col(key).isNotNull()).distinct()), key, "left")


def page_text(html: Column) -> Column:
    """The text of a page without scripts, styles, tags and repeated white space."""
    plain = F.regexp_replace(F.regexp_replace(html, "(?is)<(script|style)\\b.*?</\\1>", " "), "(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(plain, "\\s+", " "))


def asof_expand(items: DataFrame, k: int, key: str = "ticker") -> DataFrame:
    """Each item on every day whose trailing ``k`` days hold it, up to its key's last day: a range join by explode."""
    days = items.withColumn("__last", F.max("date").over(Window.partitionBy(key))).withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return days.withColumn("asof", F.date_add("date", F.col("offset"))).where(F.col("asof") <= F.col("__last")).drop("__last")


def aggregate_sentiment(scored: DataFrame, weight: str = "weight", baseline: int = 90) -> DataFrame:
    """By (ticker, day, source) with items in seven days: decayed weighted means over 3 and 7 days (half-lives 1.5 and 3),
    shares of positive and negative, counts, and the day's count as a z-score among active days of the trailing ``baseline``.

    ``scored`` has ticker, source, date, polarity and the weight. Items are first summed by
    (ticker, source, day), so what is spread over days is a row a day at most, however many items a day has."""
    scored = scored.withColumn("__key", F.struct("ticker", "source")).withColumn("__w", F.greatest(F.col(weight), F.lit(0.0)))
    day = scored.groupBy("__key", "date").agg(
        F.count("*").alias("n"), F.sum("__w").alias("w"), F.sum(F.col("__w") * F.col("polarity")).alias("wp"), F.sum((F.col("polarity") > 0.1).cast("int")).alias("pos"), F.sum((F.col("polarity") < -0.1).cast("int")).alias("neg")
    )
    week = asof_expand(day, 7, "__key")
    decay = lambda hl: F.exp(-math.log(2) * F.col("offset") / hl)
    near = F.col("offset") < 3
    mean = lambda hl, ok: F.sum(F.when(ok, F.col("wp") * decay(hl))) / F.nullif(F.sum(F.when(ok, F.col("w") * decay(hl))), F.lit(0.0))
    out = week.groupBy("__key", "asof").agg(
        mean(1.5, near).alias("sent_mean_3d"), mean(3.0, F.lit(True)).alias("sent_mean_7d"), (F.sum("pos") / F.sum("n")).alias("sent_pos_share"), (F.sum("neg") / F.sum("n")).alias("sent_neg_share"),
        F.coalesce(F.sum(F.when(near, F.col("n"))), F.lit(0)).alias("n_3d"), F.sum("n").alias("n_7d"), F.coalesce(F.sum(F.when(F.col("offset") == 0, F.col("n"))), F.lit(0)).alias("today"),
    )
    # A day's own row is in its trailing window or has no items, so active days alone make the baseline. All is by key by now: no further exchange.
    w = Window.partitionBy("__key").orderBy(F.datediff("asof", F.lit("1970-01-01").cast("date"))).rangeBetween(-(baseline - 1), 0)
    active = F.when(F.col("today") > 0, F.col("today").cast("double"))
    out = out.withColumns({"__mean": F.avg(active).over(w), "__std": F.stddev_pop(active).over(w)})
    z = F.coalesce(F.when(F.col("__std") > 1e-12, (F.col("today") - F.col("__mean")) / F.col("__std")), F.lit(0.0)).alias("sent_volume_z")
    return out.select("__key.ticker", F.col("asof").alias("date"), "__key.source", "sent_mean_3d", "sent_mean_7d", "sent_pos_share", "sent_neg_share", z, "n_3d", "n_7d")


def score_text(df: DataFrame, text: str, scorer: Callable[[], Callable[[list[str]], pd.DataFrame]], batch: int = 32, longest: int = 512) -> DataFrame:
    """Adds positive, negative, neutral, polarity from a model: ``scorer()`` is made once a task and called on lists of ``batch`` texts, each cut to ``longest`` as the model reads no more."""
    names = ["positive", "negative", "neutral", "polarity"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = scorer()
        for rows in batches:
            texts = rows[text].fillna("").str.slice(0, longest).tolist()
            parts = [score(texts[i : i + batch]) for i in range(0, len(texts), batch)]
            scores = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=names)
            yield pd.concat([rows.reset_index(drop=True), scores[names].astype("float64")], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, schema + "".join(f", {n} double" for n in names))


def lexicon_scores(df: DataFrame, text: str, positive: list[str], negative: list[str]) -> DataFrame:
    """The default scorer: shares of words of two lists, in SQL functions."""
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z]+")
    hits = lambda ws: F.size(F.filter(words, lambda x: x.isin(ws)))
    n = F.greatest(hits(positive) + hits(negative), F.lit(1)).cast("double")
    df = df.withColumns({"positive": hits(positive) / n, "negative": hits(negative) / n})
    return df.withColumns({"neutral": 1.0 - F.col("positive") - F.col("negative"), "polarity": F.col("positive") - F.col("negative")})


def documents(df: DataFrame, key: str, item: str, fields: list[str], order: str, most: int = 1000) -> DataFrame:
    """Documents of a key, each a map of its items, the last of each item winning; rows without item key are left out. A
    document has about ``most`` items: a key with more has several, numbered by ``part``, to which items are dealt by hash."""
    rows = df.where(F.col(item).isNotNull())
    parts = rows.groupBy(key).agg(F.ceil(F.count("*") / most).alias("__parts"))
    rows = rows.join(parts, key).withColumn("part", F.pmod(F.xxhash64(item), F.col("__parts")).cast("int"))
    w = Window.partitionBy(key, "part", item).orderBy(F.col(order).desc())
    rows = rows.withColumn("__k", F.row_number().over(w)).where("__k = 1")
    return rows.groupBy(key, "part").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(item), F.struct(*fields))))).alias("items"), F.max(order).alias("scrape_date"))

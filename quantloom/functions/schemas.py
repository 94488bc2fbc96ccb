"""Schema-time work on column names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.scalars import parse_date

CANONICAL = ("Date", "Open", "High", "Low", "Close", "Adj Close", "Volume")
#: Names of date columns, the preferred first.
DATES = ("date", "datetime", "timestamp", "trading date", "date str", "time")


class FeatureError(ValueError):
    """Columns that an operator needs are missing; the message lists those at hand."""


def name_words(name: str) -> tuple[str, ...]:
    """A header as its words in lower case; blanks and underscores part words."""
    return tuple(re.findall(r"[^\s_]+", name.lower()))


def resolve_schema(names: list[str], symbol: str | None = None) -> tuple[dict[str, str], list[str]]:
    """Canonical name to header, and the canonical names without one.

    Each header gets a grade for a canonical name: the name itself, the name with the
    symbol (or symbol.NS) behind it, a date synonym in order, or any words behind the name. The
    best grade wins, the first header on ties; the last grade counts only where one free header has it."""
    parsed = [(name_words(n), n) for n in names]
    tails = {(), *(((symbol.lower(),), (f"{symbol.lower()}.ns",)) if symbol else ())}
    found: dict[str, str] = {}
    for c in CANONICAL:
        stem = name_words(c)
        graded = []
        for at, (words, header) in enumerate(parsed):
            tail = words[len(stem) :] if words[: len(stem)] == stem else None
            if tail in tails:
                graded.append((0 if not tail else 1, at, header))
            elif c == "Date" and " ".join(words) in DATES:
                graded.append((2 + DATES.index(" ".join(words)), at, header))
            elif tail:
                graded.append((99, at, header))
        sure = [g for g in graded if g[0] < 99]
        loose = [g for g in graded if g[0] == 99 and g[2] not in found.values()]
        if sure or len(loose) == 1:
            found[c] = min(sure or loose)[2]
    return found, [c for c in CANONICAL if c not in found and c != "Adj Close"]


def canonicalize(df: DataFrame, symbol: str | None = None) -> DataFrame:
    """The columns under their canonical names; adj close falls back to close."""
    found, missing = resolve_schema(df.columns, symbol)
    if missing:
        raise FeatureError(f"missing {missing}; there are {df.columns}")
    out = df.select(*[F.col(f"`{v}`").alias(k.lower().replace(" ", "_")) for k, v in found.items()])
    return out.withColumn("adj_close", F.coalesce("adj_close", "close") if "adj_close" in out.columns else F.col("close"))


def find_ohlcv(names: list[str]) -> dict[str, str]:
    """All five of open, high, low, close, volume, or an error."""
    found, _ = resolve_schema(names)
    out = {c.lower(): found[c] for c in ("Open", "High", "Low", "Close", "Volume") if c in found}
    if len(out) < 5:
        raise FeatureError(f"open, high, low, close and volume are needed; there are {names}")
    return out


def find_close(names: list[str]) -> str | None:
    """The header close, else the first whose first word is close."""
    heads = [(name_words(n), n) for n in names]
    return next((n for w, n in heads if w == ("close",)), None) or next((n for w, n in heads if w[:1] == ("close",)), None)


def find_date(names: list[str], df: DataFrame | None = None) -> str | None:
    """A preferred name, else one that tells of date or time, else (given the table) the first column if all its values are days."""
    by_name = {" ".join(name_words(n)): n for n in reversed(names)}
    named = next((by_name[d] for d in DATES if d in by_name), None) or next((n for n in names if re.search("date|time", n, re.I)), None)
    if named or df is None or not names:
        return named
    first = F.col(f"`{names[0]}`").cast("string")
    bad = df.where(first.isNotNull() & parse_date(first).isNull())
    return names[0] if bad.isEmpty() and not df.where(first.isNotNull()).isEmpty() else None


def clean_headers(names: list[str]) -> list[str]:
    """Non-blank headers that are distinct in any case, as columns of a DataFrame must be: blanks at the end go, others are called Column_n by their
    place, and of equal ones the second and later get the next number, from 2 on, that no other header has behind its name."""
    filled = [n.strip() for n in names]
    filled = filled[: max((k for k, n in enumerate(filled, 1) if n), default=0)]
    filled = [n if n else f"Column_{k}" for k, n in enumerate(filled, 1)]
    taken, seen, out = {n.lower() for n in filled}, set(), []
    for n in filled:
        own, k = n, 2
        while own.lower() in seen or (own != n and own.lower() in taken):
            own, k = f"{n}_{k}", k + 1
        seen.add(own.lower())
        out.append(own)
    return out


_LABEL = re.compile(r"^(y_logret_h\d+|has_labels)$")


def assert_no_labels(names: list[str], more: tuple[str, ...] = ()) -> list[str]:
    """The feature names, or an error if any tells the outcome."""
    if bad := [n for n in names if _LABEL.match(n) or n in more]:
        raise FeatureError(f"labels among the features: {bad}")
    return names


def drop_labels(df: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    return df.drop(*[c for c in df.columns if _LABEL.match(c) or c in more])


def project_features(df: DataFrame, cols: list[str], keys: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """The features in order, 0 where a column is missing or null."""
    assert_no_labels(cols)
    return df.select(*keys, *[(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)).alias(c) for c in cols])


def ensure_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    have = {c.lower() for c in df.columns}
    return df.withColumns({c: F.lit(None).cast("string") for c in cols if c.lower() not in have})

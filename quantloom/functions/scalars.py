"""Column helpers: parsing, cleaning, ratios, dates and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Date formats that are tried in order.
FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "dd-MM-yyyy", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy/MM/dd", "dd-MMM-yyyy", "yyyyMMdd")

#: What a text of a format must be like.
SHAPES = {
    "yyyy-MM-dd": "%-__-__", "yyyy-MM-dd HH:mm:ss": "%-__-__ __:__:__", "dd-MM-yyyy": "__-__-%", "dd/MM/yyyy": "__/__/%", "MM/dd/yyyy": "__/__/%",
    "yyyy/MM/dd": "%/__/__", "dd-MMM-yyyy": "__-%-%", "yyyyMMdd": "",
}


def parse_date(c: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """A day from text in any of the formats; null if none fits. A format is tried on texts with its separators only, as a failing try costs an exception."""
    text = F.trim(c)

    def tried(f: str) -> Column:
        value = F.try_to_timestamp(text, F.lit(f))
        return F.when(text.like(SHAPES[f]) if f != "yyyyMMdd" else ~text.contains("/"), value) if f in SHAPES else value

    return F.to_date(F.coalesce(*[tried(f) for f in formats]))


def to_number(c: Column) -> Column:
    """A finite double from text with thousands separators; else null."""
    x = F.regexp_replace(F.trim(c.cast("string")), ",", "").try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def ffill(c: str, keys: list[str], order: str) -> Column:
    """The last value so far, else 0."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(0.0))


def clean_cell(c: Column, booleans: str = "number") -> Column:
    """Text for export: "" for null, nan, none and nat of any case and infinities; booleans as 1 and 0, or as True and
    False where ``booleans`` is "text", as decision columns have them."""
    s = F.trim(c.cast("string"))
    low = F.lower(s)
    out = F.when(s.isNull() | low.isin("nan", "none", "nat", "infinity", "-infinity", "inf", "-inf"), "")
    if booleans == "text":
        return out.when(low.isin("true", "false"), F.initcap(low)).otherwise(s)
    return out.when(low == "true", "1").when(low == "false", "0").otherwise(s)


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def yoy(now: Column, before: Column) -> Column:
    """Change by the absolute value a year ago."""
    return (now - before) / F.nullif(F.abs(before), F.lit(0.0))


def truthy(a: Column, b: Column) -> Column:
    """a unless it is null or 0, then b."""
    return F.coalesce(F.nullif(a, F.lit(0.0)), b)


def quarter_label(date: Column) -> Column:
    return F.concat(F.year(date), F.lit("Q"), F.quarter(date))


def safe_market_date(ts: Column, zone: str = "Asia/Kolkata", close_hour: int = 16, weekends: bool = False) -> Column:
    """The last day whose market has closed at a UTC time; with ``weekends``, back to Friday from Saturday and Sunday."""
    local = F.from_utc_timestamp(ts, zone)
    day = F.date_sub(F.to_date(local), F.when(F.hour(local) < close_hour, 1).otherwise(0))
    return F.date_sub(day, F.when(F.weekday(day) == 5, 1).when(F.weekday(day) == 6, 2).otherwise(0)) if weekends else day


def row_hash(*cells: Column) -> Column:
    """SHA-256 of a row's trimmed cells as a JSON array, without its trailing blanks."""
    all_ = F.array(*[F.trim(F.coalesce(c.cast("string"), F.lit(""))) for c in cells])
    filled = F.transform(all_, lambda x, i: F.when(x != "", i + 1).otherwise(0))
    return F.sha2(F.to_json(F.slice(all_, F.lit(1), F.array_max(filled))), 256)


def last_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in an explicit order. Without keys all rows would be one group, so that is an error."""
    if not keys:
        raise ValueError("last_by() needs a key")
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")

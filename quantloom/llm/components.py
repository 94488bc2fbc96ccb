"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.shared import cut


def components(links: DataFrame, report: list[int] | None = None) -> DataFrame:
    """The smallest id that each linked id reaches: columns id, component, from links (a, b).

    Alternating large and small stars (Kiveris and others, 2014). A large star ties
    every id's larger neighbours to its smallest one, a small star its smaller neighbours
    and itself. On a chain each round doubles the reach, so rounds are logarithmic in the
    longest path, whatever its order; a star is done in one. It ends when every id has one
    smaller neighbour or only larger ones. Minima are pre-aggregated, joins are with one row an
    id and may be split at hot ids, and each step ends in a written table. Ids without links
    aren't in the result; null ids link nothing. ``report`` gets the number of links of each round.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("a <> b").distinct(), "links")
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        smaller = F.col("v") < F.col("u")
        seen = both.groupBy("u").agg(F.min("v").alias("v"), F.count_if(smaller).alias("down"), F.count_if(~smaller).alias("up"))
        # Settled: one smaller neighbour, or larger ones alone.
        seen = cut(seen.select("u", F.least("u", "v").alias("m"), ((F.col("down") > 1) | ((F.col("down") == 1) & (F.col("up") > 0))).alias("open")), "least")
        if report is not None:
            report.append(edges.count())
        if seen.where("open").isEmpty():
            return seen.select(F.col("u").alias("id"), F.col("m").alias("component"))
        large = cut(both.where("v > u").join(seen.select("u", "m"), "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "large-stars")
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(low.select("hi", F.col("m").alias("lo")))
        edges = cut(small.distinct(), "small-stars")

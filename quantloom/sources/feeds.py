"""Paged feeds as a Spark data source, for batches and streams.

A feed's pages are folders ``feed=<name>/page=<number>`` under a root, of files with a nested JSON listing a line. Pages are in time: one of a
higher number has nothing older than the newest post of a lower one, and new pages only come on top, as a listing is read from the newest post back.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition

SCHEMA = "feed string, page long, title string, body string, score long, num_comments long, ts timestamp, url string, subreddit string"
_KINDS = pa.schema([("feed", pa.string()), ("page", pa.int64()), ("title", pa.string()), ("body", pa.string()), ("score", pa.int64()), ("num_comments", pa.int64()), ("ts", pa.timestamp("us", "UTC")), ("url", pa.string()), ("subreddit", pa.string())])
_FOLDER = re.compile(r"/feed=([^/]+)/page=(\d+)/[^/_.][^/]*$")
#: Files of one feed that a partition reads, one after the other.
FILES = 64


@dataclass
class Pages(InputPartition):
    """Files (page, path) of one feed, from the newest page down."""

    feed: str
    files: list[tuple[int, str]]


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _seconds(at: dt.datetime | str | float) -> float:
    """A time as seconds since 1970; times without zone are UTC."""
    if isinstance(at, (int, float)):
        return float(at)
    at = dt.datetime.fromisoformat(at) if isinstance(at, str) else at
    return (at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)).timestamp()


def listed(root: str) -> dict[str, list[tuple[int, str]]]:
    """The files of each feed by falling page."""
    system, path = _system(root)
    out: dict[str, list[tuple[int, str]]] = {}
    for info in system.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=True)):
        if info.type == fs.FileType.File and (m := _FOLDER.search(info.path)):
            out.setdefault(m[1], []).append((int(m[2]), info.path))
    return {feed: sorted(files, key=lambda f: (-f[0], f[1])) for feed, files in sorted(out.items())}


def planned(pages: dict[str, list[tuple[int, str]]], files: int = FILES) -> list[Pages]:
    return [Pages(feed, own[at : at + files]) for feed, own in pages.items() for at in range(0, len(own), files)]


def posts(root: str, part: Pages, cutoff: float | None) -> Iterator[pa.RecordBatch]:
    """The posts of a partition's pages, a batch a file. Behind a page with nothing from the cutoff on, all pages are older still, so the rest isn't opened;
    a partition further down opens one page to see that. Lines that aren't a listing are an error, posts without time are left out where a cutoff is set."""
    system, _ = _system(root)
    page, newest = None, None
    for number, path in part.files:
        if cutoff is not None and number != page and page is not None and (newest is None or newest < cutoff):
            return
        newest = newest if number == page else None
        page, rows = number, []
        with system.open_input_stream(path) as f:
            lines = f.read().decode("utf-8").splitlines()
        for line in filter(str.strip, lines):
            for child in json.loads(line)["data"]["children"]:
                post = child.get("data") or {}
                at = post.get("created_utc")
                if at is not None:
                    newest = max(at, newest) if newest is not None else at
                if cutoff is None or at is not None and at >= cutoff:
                    link = post.get("permalink")
                    rows.append({"feed": part.feed, "page": number, "title": post.get("title"), "body": post.get("selftext"), "score": post.get("score"), "num_comments": post.get("num_comments"), "ts": at if at is None else round(at * 1_000_000), "url": link and "https://www.reddit.com" + link, "subreddit": post.get("subreddit")})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _KINDS)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.files = options["path"], int(options.get("files", FILES))
        self.cutoff = _seconds(options["cutoff"]) if "cutoff" in options else None
        self.feeds: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Feeds choose folders and a least time ends each feed early; Spark checks all filters on the rows that come."""
        for f in filters:
            match f:
                case EqualTo(("feed",), feed):
                    self.feeds = {feed} & (self.feeds if self.feeds is not None else {feed})
                case In(("feed",), feeds):
                    self.feeds = set(feeds) & (self.feeds if self.feeds is not None else set(feeds))
                case GreaterThanOrEqual(("ts",), at) | GreaterThan(("ts",), at):
                    self.cutoff = max(_seconds(at), self.cutoff or float("-inf"))
            yield f

    def partitions(self) -> list[Pages]:
        return planned({feed: own for feed, own in listed(self.root).items() if self.feeds is None or feed in self.feeds}, self.files) or [Pages("", [])]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        return posts(self.root, partition, self.cutoff)


class _StreamReader(DataSourceStreamReader):
    """Offsets are each feed's newest page. The first batch goes from there back to the cutoff, later ones to the page before."""

    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.files = options["path"], int(options.get("files", FILES))
        self.cutoff = _seconds(options["cutoff"]) if "cutoff" in options else None

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {feed: own[0][0] for feed, own in listed(self.root).items()}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        fresh = {feed: [f for f in own if start.get(feed, -1) < f[0] <= end.get(feed, -1)] for feed, own in listed(self.root).items()}
        return planned(fresh, self.files) or [Pages("", [])]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        return posts(self.root, partition, self.cutoff)


class PagedFeed(DataSource):
    """``spark.read.format("paged_feed")`` after register(). Options: path; cutoff (ISO time or seconds since 1970), before which nothing is
    read; files, how many a partition reads."""

    @classmethod
    def name(cls) -> str:
        return "paged_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and lets its filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedFeed)


def read_feed(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """Posts (SCHEMA) of all feeds; filters on feed and a least ts open only the pages that they need."""
    register(spark)
    return spark.read.format("paged_feed").options(**options).load(root)


def stream_feed(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """The same as a stream, a batch of what pages came since the last one."""
    register(spark)
    return spark.readStream.format("paged_feed").options(**options).load(root)


def write_pages(df: DataFrame, root: str, per_line: int = 50) -> None:
    """Posts (feed, page, seq, post struct) as pages, in listings of about ``per_line`` posts a line; lines are dealt by page, and a page of many lines to several files."""
    lines = df.groupBy("feed", "page", F.floor(F.col("seq") / per_line).alias("line")).agg(F.collect_list(F.struct(F.col("post").alias("data"))).alias("children"))
    text = lines.select("feed", "page", F.to_json(F.struct(F.struct("children").alias("data"))).alias("value"))
    text.hint("rebalance", "feed", "page").write.mode("append").partitionBy("feed", "page").text(root)

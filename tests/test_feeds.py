import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from quantloom.sources import feeds

DAY = 86_400


def page(root, feed, number, times, text=None):
    os.makedirs(folder := f"{root}/feed={feed}/page={number}", exist_ok=True)
    listing = {"data": {"children": [{"data": {"title": f"{feed}-{number}-{k}", "created_utc": t, "permalink": f"/{k}", "score": k}} for k, t in enumerate(times)]}}
    with open(f"{folder}/part-0.json", "w") as f:
        f.write(text or json.dumps(listing))


@pytest.fixture
def root(tmp_path):
    """Feed a: ten pages, the five oldest unreadable; feed b: one page, unreadable."""
    for k in range(10):
        page(tmp_path, "a", k, [k * DAY, k * DAY + 10], "not a listing" if k < 5 else None)
    page(tmp_path, "b", 0, [], "neither")
    return str(tmp_path)


def titles(df):
    return sorted(r["title"] for r in df.collect())


def test_filters_reach_the_pages(spark, root):
    df = feeds.read_feed(spark, root, files="4")
    at = lambda day: F.lit(dt.datetime(1970, 1, 1 + day)).cast("timestamp")
    # Pages 9 to 6 are one partition, 5 to 2 another, which opens 5 and ends there; the third would open page 1, so it is cut by the root below.
    some = df.where((F.col("feed") == "a") & (F.col("ts") >= at(6)))
    with pytest.raises(Exception):
        some.count()
    for k in (0, 1):
        page(root, "a", k, [k * DAY])
    assert some.rdd.getNumPartitions() == 3 and titles(some) == [f"a-{k}-{j}" for k in range(6, 10) for j in (0, 1)]
    assert titles(df.where((F.col("feed").isin("a", "x")) & (F.col("ts") > at(9)))) == ["a-9-1"]
    assert df.where("feed = 'x'").count() == 0 and df.where("feed = 'a' and feed = 'b'").count() == 0
    with pytest.raises(Exception):
        df.where("feed = 'b'").count()
    assert feeds.read_feed(spark, root + "/none").count() == 0


def test_a_feed_ends_at_its_first_old_page(spark, root):
    for k in (9, 8):  # a page of several files ends only where all are old
        with open(f"{root}/feed=a/page={k}/part-1.json", "w") as f:
            f.write(json.dumps({"data": {"children": [{"data": {"title": f"old-{k}", "created_utc": 1.5}}, {"data": None}]}}) + "\n\n")
    os.remove(f"{root}/feed=b/page=0/part-0.json")
    assert titles(feeds.read_feed(spark, root, cutoff="1970-01-08")) == [f"a-{k}-{j}" for k in range(7, 10) for j in (0, 1)]


def test_a_stream_reads_new_pages_only(spark, root, tmp_path_factory):
    os.remove(f"{root}/feed=b/page=0/part-0.json")
    seen, checkpoint = [], str(tmp_path_factory.mktemp("c"))

    def run():
        feed = feeds.stream_feed(spark, root, cutoff="1970-01-08")
        feed.writeStream.foreachBatch(lambda df, _: seen.extend(titles(df)) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(120)
        out = sorted(seen)
        seen.clear()
        return out

    assert run() == [f"a-{k}-{j}" for k in range(7, 10) for j in (0, 1)]
    page(root, "a", 10, [10 * DAY])
    page(root, "c", 0, [8 * DAY])
    assert run() == ["a-10-0", "c-0-0"] and run() == []

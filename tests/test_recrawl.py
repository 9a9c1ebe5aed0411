"""Rows before state: a crawl that fails between the two writes loses and repeats nothing."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from admitlake.streaming import recrawl

SCHEMA = "key string, status int, rendered boolean, etag string, last_modified string, content string, links array<string>, fetched_at long"
CRAWLS = [
    [("a", 200, False, "e1", "m1", "text a", ["x"], 1), ("b", 200, True, "e2", "m2", "text b", ["y"], 1), ("b", 200, False, None, None, "later", None, 2), ("c", 304, False, "e3", None, None, None, 1), (None, 200, False, None, None, "no key", None, 1)],
    [("a", 304, False, None, None, None, None, 5), ("b", 200, True, None, None, "Text   B", None, 5), ("c", 200, False, "e3", None, "text c", [], 5)],
    [("a", 200, False, "e9", None, "text a anew", ["z"], 9), ("c", 200, False, "e4", "m4", "text c", ["q"], 9), ("d", 200, None, None, None, None, None, 9)],
]


def crawl(spark, folder, k):
    spark.createDataFrame(CRAWLS[k], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def run(spark, folder):
    stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
    query = recrawl.recrawled(stream, f"{folder}/rows", f"{folder}/state", f"{folder}/check", attempts=1)
    query.awaitTermination(120)


def stored(spark, folder):
    return sorted((r["batch"], r["key"], r["action"], r["content"]) for r in recrawl.committed(spark, f"{folder}/rows", f"{folder}/state").collect())


WANT = [(0, "a", "new", "text a"), (0, "b", "new", "text b"), (1, "c", "new", "text c"), (2, "a", "changed", "text a anew"), (2, "d", "new", None)]


@pytest.mark.parametrize("failing", [None, "put_rows", "put_state"])
def test_failures_between_the_writes(spark, tmp_path, monkeypatch, failing):
    folder = f"file://{tmp_path}"
    for k in range(3):
        crawl(spark, folder, k)
        if failing and k == 1:
            put = getattr(recrawl, failing)
            monkeypatch.setattr(recrawl, failing, lambda *_: (_ for _ in ()).throw(OSError("the store is away")))
            with pytest.raises(Exception, match="the store is away"):
                run(spark, folder)
            assert [r for r in stored(spark, folder) if r[0] == 1] == []
            monkeypatch.setattr(recrawl, failing, put)
        run(spark, folder)
    assert stored(spark, folder) == sorted(WANT, key=str) or stored(spark, folder) == WANT
    state = {r["key"]: (r["etag"], r["last_modified"], r["links"]) for r in recrawl.latest_state(spark, f"{folder}/state").collect()}
    assert state == {"a": ("e9", None, ["z"]), "b": (None, None, []), "c": ("e4", "m4", ["q"]), "d": (None, None, [])}
    middle = {r["key"]: (r["etag"], r["links"]) for r in recrawl.latest_state(spark, f"{folder}/state", 2).collect()}
    assert middle["a"] == ("e1", ["x"])  # a page that did not change keeps its links


def test_tries_again_and_then_gives_up():
    waits, calls = [], []

    def put():
        calls.append(1)
        if len(calls) < 4:
            raise OSError("away")

    recrawl.persistently(put, wait=waits.append)
    assert waits == [1, 2, 4]
    with pytest.raises(OSError):
        recrawl.persistently(lambda: (_ for _ in ()).throw(OSError("gone")), attempts=3, wait=waits.append)
    assert waits == [1, 2, 4, 1, 2]


def test_no_pages_and_no_state(spark, tmp_path):
    assert recrawl.latest_state(spark, f"file://{tmp_path}/none").count() == 0
    none = spark.createDataFrame([], SCHEMA)
    assert recrawl.told_apart(none, spark.createDataFrame([], recrawl.STATE)).where(F.lit(True)).count() == 0

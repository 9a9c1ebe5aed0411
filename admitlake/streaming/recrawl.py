"""Repeated crawls as a stream: what changed since the last one, rows written before the state that lets later crawls skip them."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import content_hash
from ..storage import written

#: Tries of a write before the stream ends; seconds between them at most; rows of a file.
ATTEMPTS, LONGEST_WAIT, FILE_ROWS = 10, 30, 200
STATE = "key string, etag string, last_modified string, content_hash string, links array<string>"


def told_apart(pages: DataFrame, state: DataFrame) -> DataFrame:
    """pages (key, status, rendered, etag, last_modified, content, links) with `action`, content_hash and links, by what state (STATE) knows of them.

    not_modified: the server says so (304), and the stored links stand in for those it did not send. same_content: the
    hash is the stored one; the page's own links count. changed, new: rows to store. missing: a 304 for a page that
    state does not know, which must be fetched in full. Rendered pages have no etag and no date of change. A
    key has at most one row in either table.
    """
    old = state.select("key", F.col("content_hash").alias("_hash"), F.col("links").alias("_links"), F.col("etag").alias("_etag"), F.col("last_modified").alias("_modified"), F.lit(True).alias("_known"))
    both = pages.join(old, "key", "left")
    untouched, own = F.coalesce(F.col("status") == 304, F.lit(False)), content_hash(F.coalesce("content", F.lit("")))
    known = F.col("_known").isNotNull()
    action = F.when(untouched & ~known, "missing").when(untouched, "not_modified").when(F.col("_hash") == own, "same_content").when(known, "changed").otherwise("new")
    none = F.array().cast("array<string>")
    header = lambda name, kept: F.when(untouched, F.coalesce(name, kept)).when(~F.coalesce("rendered", F.lit(False)), F.col(name))
    return both.withColumns({
        "action": action, "content_hash": F.when(untouched, F.col("_hash")).otherwise(own), "links": F.when(untouched, F.coalesce("_links", none)).otherwise(F.coalesce("links", none)),
        "etag": header("etag", "_etag"), "last_modified": header("last_modified", "_modified"),
    }).drop("_hash", "_links", "_etag", "_modified", "_known")


def latest_state(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Of each key the state that the last batch (before that number) wrote; none where nothing is written yet."""
    if not _exists(spark, path):
        return spark.createDataFrame([], STATE)
    rows = spark.read.schema(STATE + ", batch long").parquet(path)
    rows = rows if before is None else rows.where(F.col("batch") < before)
    last = rows.groupBy("key").agg(F.max_by(F.struct("etag", "last_modified", "content_hash", "links"), "batch").alias("s"))
    return last.select("key", "s.*")


def committed(spark: SparkSession, rows: str, state: str) -> DataFrame:
    """The rows of the batches whose state is written, too."""
    done = spark.read.schema("batch long").parquet(state).select("batch").distinct()
    return spark.read.parquet(rows).join(F.broadcast(done), "batch", "left_semi")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def persistently(put: Callable[[], None], attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep) -> None:
    """put, tried again after 1, 2, 4 ... seconds; the last failure is raised and ends the stream."""
    for n in range(attempts):
        try:
            return put()
        except Exception:  # noqa: BLE001  a store may fail in any way; what it said last is raised
            if n == attempts - 1:
                raise
            wait(min(2**n, LONGEST_WAIT))


def put_rows(rows: DataFrame, path: str, number: int) -> None:
    rows.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).parquet(f"{path}/batch={number}")


def put_state(state: DataFrame, path: str, number: int) -> None:
    state.write.mode("overwrite").parquet(f"{path}/batch={number}")


def recrawled(stream: DataFrame, rows: str, state: str, checkpoint: str, at: str = "fetched_at", attempts: int = ATTEMPTS, available_now: bool = True, every: str = "2 seconds") -> StreamingQuery:
    """A stream of pages as told_apart reads them, with a time `at`: changed and new pages are stored, then the state of all.

    Each micro-batch first writes its rows and then its state, both under its number. A batch that failed between
    the two is run again under the same number, compares with the state of the batches before it, and replaces
    its rows: nothing is lost or stored twice, and no state speaks of rows that are not there. Of several rows
    of a key in a batch the first by time claims it.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        others = [c for c in batch.columns if c != "key"]
        first = batch.where("key is not null").groupBy("key").agg(F.min_by(F.struct(*others), F.struct(at, F.xxhash64(*others))).alias("s")).select("key", "s.*")
        found = written(told_apart(first, latest_state(spark, state, number)))
        persistently(lambda: put_rows(found.where(F.col("action").isin("new", "changed")), rows, number), attempts)
        persistently(lambda: put_state(found.where("action <> 'missing'").select("key", "etag", "last_modified", "content_hash", "links"), state, number), attempts)

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()

"""The crawl's stateful loops as Structured Streaming: first copies, token buckets, a sink that survives repeats."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_copies(pages: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """A stream's rows without those whose key was seen within `late` before; the state of older keys is let go."""
    return pages.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def aligned(columns: list[str]) -> Column:
    """Whether all array columns have the same length, none null."""
    sizes = [F.size(c) for c in columns]
    same = F.lit(True)
    for c, n in zip(columns, sizes, strict=True):
        same = same & F.col(c).isNotNull() & (n == sizes[0])
    return F.coalesce(same, F.lit(False))


def write_batches(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True, every: str = "2 seconds") -> StreamingQuery:
    """Appends each micro-batch to a folder of its own, so that one run again after a failure replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def token_bucket(requests: DataFrame, key: str, at: str, capacity: float = 6.0, refill: float = 2.0) -> DataFrame:
    """Per row of a stream (key, seconds as a double): the wait until a token is free, and the tokens left after it took one.

    A bucket starts full. The state is two numbers per key; rows of one key in one micro-batch are
    taken in order of time, batch by batch as Arrow hands them over, and rows of earlier time refill nothing.
    """

    def serve(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        left, last = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(frames)).sort_values(at, kind="stable")
        waits, lefts = [], []
        for now in rows[at]:
            if last is not None:
                left = min(capacity, left + max(now - last, 0.0) * refill)
            last = now if last is None else max(last, now)
            waits.append(max(1.0 - left, 0.0) / refill)
            left = max(left - 1.0, 0.0)
            lefts.append(left)
        state.update((left, last))
        yield pd.DataFrame({"key": keys[0], "at": rows[at].to_numpy(), "wait": waits, "left_over": lefts})

    kind = requests.schema[key].dataType.simpleString()
    return requests.where(F.col(at).isNotNull()).groupBy(key).applyInPandasWithState(
        serve, f"key {kind}, at double, wait double, left_over double", "left_over double, last double", "append", GroupStateTimeout.NoTimeout
    )

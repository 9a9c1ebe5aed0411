"""Sides of unknown size: broadcast in blocks of bounded size, or where a count proves them small."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written

#: Rows of a block; at a thousand doubles a row a block is about 32 MB.
BLOCK_ROWS = 4096
#: Rows up to which a side of a few columns is sent to all tasks.
SENT_ROWS = 200_000


def in_blocks(side: DataFrame, key: str, use: Callable[[DataFrame], DataFrame], rows: int = BLOCK_ROWS) -> DataFrame:
    """The union of use(block) over blocks of `side`, each of about `rows` rows and marked for broadcast; `key` differs between rows."""
    n = max(1, ceil(side.count() / rows))
    if n == 1:
        return use(F.broadcast(side))
    dealt = F.pmod(F.xxhash64(key), F.lit(n))
    return reduce(DataFrame.unionByName, [use(F.broadcast(side.where(dealt == k))) for k in range(n)])


def counted(side: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """side written once and marked for broadcast if it has few rows; a larger one as it is, where the engine splits skewed partitions."""
    kept = written(side)
    return F.broadcast(kept) if kept.limit(rows + 1).count() <= rows else kept

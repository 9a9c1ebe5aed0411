"""Seeded shuffles and samples: an order by hash, so that the same rows give the same sample however they are dealt out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .placing import placed


def draw(seed: int, *keys: str) -> Column:
    """32 hexadecimal digits that a row's keys and the seed fix; a null key counts as empty."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))


def sampled(df: DataFrame, k: int, *keys: str, seed: int = 42) -> DataFrame:
    """k rows of smallest draw, all if there are fewer. Tasks keep their own k before they meet; rows with equal keys may stand for each other."""
    return df.withColumn("_draw", draw(seed, *keys)).orderBy("_draw", *keys).limit(k).drop("_draw")


def sampled_by(df: DataFrame, group: str, k: int, *keys: str, seed: int = 42) -> DataFrame:
    """Of each group the k rows of smallest draw, with their `turn` from 1; the null group is one.

    Each task keeps the k best of every group it has before the shuffle, so a group of any size
    sends k rows for each task, and no task sorts a whole group.
    """
    turn = F.row_number().over(Window.partitionBy(group).orderBy("_draw", *keys))
    return df.withColumn("_draw", draw(seed, *keys)).withColumn("turn", turn).where(F.col("turn") <= k).drop("_draw")


def shuffled(df: DataFrame, *keys: str, seed: int = 42) -> DataFrame:
    """df with each row's `place` in a shuffled order, from 1; sorted by ranges of the draw, not in one task."""
    return placed(df.withColumn("_draw", draw(seed, *keys)), "_draw", *keys).drop("_draw")

"""Keeping a corpus in order: duplicates, upserts, replacements, deltas, frontiers, runs of failures."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import shared_dir

#: Rows whose weights in a moving average of up to 0.8 of the old value are not nothing.
MEMORY = 3400


def kept_best(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each group of rows with equal keys the one with the largest values of `order`, the first of them deciding."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    best = F.max(F.struct(*order, *rest)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("_best")[c].alias(c) for c in (*order, *rest)])


def resumed(work: DataFrame, done: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """What of the work the sink has not yet by key, and what it has."""
    return work.join(done, key, "left_anti"), work.join(done, key, "left_semi")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and rows of old whose key new lacks."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def replaced(old: DataFrame, new: DataFrame, keys: list[str], source: Column) -> DataFrame:
    """old without the rows of `source` whose keys stand in new, and new."""
    gone = new.select(*keys).distinct().withColumn("_new", F.lit(True))
    kept = old.join(gone, keys, "left").where(F.col("_new").isNull() | ~source).drop("_new")
    return kept.unionByName(new)


def duplicate_counts(df: DataFrame, group: str, key: str) -> DataFrame:
    """Per group: rows, rows beyond the first of each key."""
    return df.groupBy(group, key).agg(F.count(F.lit(1)).alias("n")).groupBy(group).agg(F.sum("n").alias("total"), F.sum(F.col("n") - 1).alias("duplicates"))


def delta(before: DataFrame, now: DataFrame, key: str, digest: str) -> DataFrame:
    """Each key of either snapshot as new, changed, unchanged or gone."""
    old = before.select(key, F.col(digest).alias("_old"))
    both = now.select(key, F.col(digest).alias("_new")).join(old, key, "full")
    state = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "gone").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("changed")
    return both.select(key, state.alias("state"))


def frontier(edges: DataFrame, seeds: DataFrame, most_depth: int | None = None, most_nodes: int | None = None) -> DataFrame:
    """Nodes reachable from the seeds with their distance, hop by hop; each hop is written in the shared folder, so none is computed twice.

    most_nodes: the nearest so many, of the last hop's the smallest; a seed counts, too.
    """
    spark, base = seeds.sparkSession, f"{shared_dir(seeds.sparkSession)}/frontier-{uuid.uuid4().hex}"
    schema, depth, n = None, 0, 0
    last = seeds.select("node").distinct()
    while True:
        if most_nodes is not None:
            last = last.orderBy("node").limit(max(0, most_nodes - n))
        last.withColumn("depth", F.lit(depth)).write.parquet(f"{base}/hop={depth}")
        schema = schema or last.withColumn("depth", F.lit(depth)).schema
        last = spark.read.schema(schema).parquet(f"{base}/hop={depth}")
        found = last.count()
        n, depth = n + found, depth + 1
        seen = spark.read.schema(schema).parquet(base).select("node", "depth")
        if not found or most_depth is not None and depth > most_depth or most_nodes is not None and n >= most_nodes:
            return seen
        last = edges.join(last.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")


def failure_runs(log: DataFrame, key: str, order: str, failed: Column) -> DataFrame:
    """Runs of failures without a success between them: first, last and length of each."""
    success = F.sum(F.when(failed, 0).otherwise(1)).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return log.withColumn("_run", success).where(failed).groupBy(key, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("length")).drop("_run")


def moving_average(log: DataFrame, key: str, order: list[str], value: str, old: float = 0.8) -> DataFrame:
    """Per key the exponential moving average after the last row, seeded by the first.

    As a weighted sum: a value `back` rows before the last counts (1 - old) * old ** back, the first one old ** (n - 1).
    Weights beyond MEMORY rows are nothing in 64 bits, so each key keeps that many rows, before they are shuffled too.
    """
    weight = F.pow(F.lit(old), F.col("_back"))
    back = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])) - 1
    last = log.select(key, *order, value).withColumn("_back", back).where(F.col("_back") < MEMORY)
    late = last.groupBy(key).agg(F.sum(F.col(value) * weight * (1 - old)).alias("late"), F.max("_back").alias("reach"))
    every = log.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min_by(value, F.struct(*order)).alias("first"))
    seed = F.when(F.col("n") <= MEMORY, F.col("first") * F.pow(F.lit(old), F.col("n") - 1) * old).otherwise(0.0)
    return every.join(late, key).select(key, "n", (F.col("late") + seed).alias("ema"))

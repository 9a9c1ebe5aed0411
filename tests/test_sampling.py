"""Samples and shuffles by hash."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import functions as F

from admitlake.operators import sampling


def rank(seed, *keys):
    return md5(":".join([str(seed), *["" if k is None else str(k) for k in keys]]).encode()).hexdigest()


def test_smallest_draws_of_each_group(spark):
    rows = [(i, "hot" if i % 3 else None if i % 2 else f"g{i % 7}") for i in range(900)] + [(None, "hot"), (None, None)]
    df = spark.createDataFrame(rows, "id long, g string")
    for parts in (1, 7):
        found = {(r["g"], r["turn"]): r["id"] for r in sampling.sampled_by(df.repartition(parts), "g", 4, "id", seed=5).collect()}
        for g in {g for _, g in rows}:
            want = sorted((i for i, h in rows if h == g), key=lambda i: rank(5, i))[:4]
            assert [found[g, k + 1] for k in range(len(want))] == want
    plan = sampling.sampled_by(df.repartition(3), "g", 4, "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # before the shuffle and after it


def test_sample_of_all_and_shuffle(spark):
    df = spark.range(500).repartition(6)
    want = sorted(range(500), key=lambda i: rank(1, i))
    assert sorted(r["id"] for r in sampling.sampled(df, 20, "id", seed=1).collect()) == sorted(want[:20])
    assert [r["id"] for r in sampling.shuffled(df, "id", seed=1).orderBy("place").collect()] == want
    assert sampling.sampled(df, 999, "id").count() == 500 and sampling.sampled(df.limit(0), 3, "id").count() == 0
    assert sampling.shuffled(df.limit(0), "id").count() == 0
    twice = sampling.shuffled(df.union(df), "id", seed=1)
    assert twice.agg(F.countDistinct("place"), F.max("place")).first()[:] == (1000, 1000)

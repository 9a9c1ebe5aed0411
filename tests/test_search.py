"""Fronts against brute force, samplers on losses whose best setting is known, and a short search of boosters."""

from __future__ import annotations

from math import inf, nan

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from admitlake.operators import search
from admitlake.operators.boosting import Settings
from admitlake.plans import QUERIES

SPACE = {"x": (0.001, 10.0, False, True), "n": (2, 30, True, False), "z": (-1.0, 1.0, False, False)}


def dominated(rows, r):
    return any(q[1] <= r[1] and q[2] <= r[2] and (q[1] < r[1] or q[2] < r[2]) for q in rows)


@pytest.mark.parametrize("kind", ["scattered", "ties", "falling"])
def test_front_and_crowding_are_brute_force(spark, kind):
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 9, 300), rng.integers(0, 9, 300)) if kind == "ties" else (rng.random(300), rng.random(300))
    b = -np.sort(-b)[np.argsort(np.argsort(a))] if kind == "falling" else b
    rows = [(i, float(p), float(q)) for i, (p, q) in enumerate(zip(a, b))]
    rows += [(900, None, 0.0), (901, 0.0, None), (902, nan, -1.0), (903, inf, -5.0), rows[0]]
    df = spark.createDataFrame(rows, "id long, a double, b double").repartition(7)
    whole = [r for r in rows if None not in r and r[1] == r[1]]
    want = [r for r in whole if not dominated(whole, r)]
    front = search.front(df, "a", "b")
    assert sorted(map(tuple, front.collect())) == sorted(want)
    points = sorted({r[1:] for r in want if r[1] < inf})
    found = {(r["a"], r["b"]): r["crowding"] for r in search.crowding(front.where("a < 1e9"), "a", "b").collect()}
    wide, high = points[-1][0] - points[0][0] or 1.0, points[0][1] - points[-1][1] or 1.0
    for k, p in enumerate(points):
        ends = k in (0, len(points) - 1)
        assert found[p] == (inf if ends else pytest.approx((points[k + 1][0] - points[k - 1][0]) / wide + (points[k - 1][1] - points[k + 1][1]) / high))
    rank, crowd = search.ranks_and_crowding([r[1:] for r in whole])
    assert {r for r, k in zip(whole, rank) if k == 0} == set(want)
    left, level = list(whole), 0
    while left:
        here = [r for r in left if not dominated(left, r)]
        assert all(rank[whole.index(r)] == level for r in here)
        left, level = [r for r in left if r not in here], level + 1


def loss(p):
    return (np.log10(p["x"]) - 0.3) ** 2 + ((p["n"] - 20) / 28) ** 2 + p["z"] ** 2


def test_density_ratio_comes_nearer_than_chance_and_repeats(spark):
    best = []
    for seed in range(5):
        rng, done = np.random.default_rng(seed), []
        for _ in range(60):
            p = search.density_ratio(done, SPACE, rng)
            assert all(SPACE[n][0] <= v <= SPACE[n][1] for n, v in p.items()) and p["n"] == int(p["n"])
            done.append((p, loss(p)))
        chance = [loss(search.random_params(SPACE, np.random.default_rng(1000 * seed + k))) for k in range(60)]
        best.append((min(x for _, x in done), min(chance), np.mean([x for _, x in done[30:]]), np.mean(chance)))
    nearest, by_chance, late, usual = np.array(best).sum(0)
    assert nearest < 0.8 * by_chance and late < 0.5 * usual
    one, two = (search.searched(spark, lambda p: (loss(p),), SPACE, 15, 7).collect() for _ in range(2))
    assert one == two and [r["trial"] for r in one] == list(range(15)) and all(r["second"] is None for r in one)
    search.density_ratio([({"x": 1.0, "n": 3.0, "z": 0.0}, nan)] * 12, SPACE, np.random.default_rng(1))


def test_two_losses_spread_along_the_front(spark):
    rows = search.searched(spark, lambda p: (p["x"], abs(p["z"] - 0.5) + 1 / p["x"]), SPACE, 120, 3)
    front = search.front(rows, "loss", "second").count()
    late = rows.where("trial >= 60").agg(F.avg(F.col("second") - 1 / F.col("loss"))).first()[0]
    early = rows.where("trial < 20").agg(F.avg(F.col("second") - 1 / F.col("loss"))).first()[0]
    assert front >= 8 and late < 0.7 * early


def test_stepwise_takes_the_best_value_of_each():
    best, least = search.stepwise(lambda p: loss(p), {"x": 5.0, "n": 3.0, "z": 1.0}, [("x", [0.1, 2.0, 9.0]), ("n", [20.0, 21.0]), ("z", [-0.5, 0.5, 0.5])])
    assert best == {"x": 2.0, "n": 20.0, "z": -0.5} and least == loss(best)


def test_boosters_are_searched(spark):
    rng = np.random.default_rng(0)
    rows = [(float(x), float(rng.random() < 1 / (1 + np.exp(-x))), int(k)) for x, k in zip(rng.normal(size=300) * 2, rng.integers(0, 2, 300))]
    train = spark.createDataFrame(rows, "x double, y double, fold int")
    space = {"rate": (0.05, 0.5, False, True), "depth": (1, 2, True, False)}
    base = Settings(trees=2, bins=8)
    found = search.searched(spark, search.boosting_losses(train, ["x"], "y", "fold", 2, base, two=True), space, 2).collect()
    assert all(-1 <= r["loss"] < -0.6 and 0 < r["second"] < 0.25 for r in found)
    one = search.boosting_losses(train, ["x"], "y", "fold", 2, base)
    assert 0 < one({"rate": 0.3, "depth": 2.0})[0] < 0.25


def test_boosted_chances_cover_all_requests(spark):
    found = QUERIES["boosted_chances"](spark, SF)
    assert found.count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert found.where("error is null and (probability is null or probability < low or probability > high)").isEmpty()
    assert [r["place"] for r in found.orderBy("place").limit(3).collect()] == [1, 2, 3] and found.where("error is null").agg(F.countDistinct("probability")).first()[0] > 5

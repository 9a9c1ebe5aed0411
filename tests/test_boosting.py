"""Constrained boosting against a plain loop, and what the constraints promise."""

from __future__ import annotations

from math import exp, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from admitlake.operators import boosting, learning, metrics, predicting
from admitlake.operators.boosting import Settings

NAMES = ["a", "b", "c", "d"]


def made(n=600, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (n, 4)).astype(float)
    chance = 1 / (1 + np.exp(-(0.4 * x[:, 0] - 0.3 * x[:, 1] + 0.8 * (x[:, 2] > 6) * (x[:, 3] > 6) - 1)))
    y = (rng.random(n) < chance).astype(float)
    x[rng.random((n, 4)) < 0.08] = np.nan
    return x, y, rng.integers(1, 4, n).astype(float), rng.random(n) < 0.25


@pytest.fixture(scope="module")
def table(spark):
    x, y, w, held = made()
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], float(t), float(u), bool(h)) for i, (r, t, u, h) in enumerate(zip(x, y, w, held))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y double, w double, held boolean").repartition(5)


def plain(x, y, w, cuts, s, monotone, groups):
    """The same trees, one split and one row at a time; gives the margins of all rows."""
    rate = (y * w).sum() / w.sum()
    bins = [[-1 if np.isnan(v) else sum(v > e for e in cuts[k]) for k, v in enumerate(r)] for r in x]
    margin = [log(rate / (1 - rate))] * len(x)

    def value(g, h, low, high):
        return min(max(-(abs(g) - s.l1 if abs(g) > s.l1 else 0) * (1 if g > 0 else -1) / (h + s.l2), low), high)

    def worth(g, h, v):
        return -(g * v + (h + s.l2) * v * v / 2 + s.l1 * abs(v))

    for _ in range(s.trees):
        p = [1 / (1 + exp(-m)) for m in margin]
        g, h = [w[i] * (p[i] - y[i]) for i in range(len(x))], [w[i] * p[i] * (1 - p[i]) for i in range(len(x))]
        nodes = [(list(range(len(x))), set(), -np.inf, np.inf, 0.0)]
        done = []
        for _ in range(s.depth):
            after = []
            for rows, used, low, high, v in nodes:
                G, H = sum(g[i] for i in rows), sum(h[i] for i in rows)
                parent, best = worth(G, H, value(G, H, low, high)), None
                for f in range(4):
                    if not any(used <= k and f in k for k in groups):
                        continue
                    for missing_left in (False, True):
                        for cut in range(len(cuts[f]) + 1):
                            left = [i for i in rows if (missing_left if bins[i][f] < 0 else bins[i][f] <= cut)]
                            a, b = sum(g[i] for i in left), sum(h[i] for i in left)
                            u, t = value(a, b, low, high), value(G - a, H - b, low, high)
                            gain = round(worth(a, b, u) + worth(G - a, H - b, t) - parent, 9)
                            if min(b, H - b) >= s.least_hessian and monotone[f] * (t - u) >= 0 and gain > s.least_gain and (best is None or gain > best[0]):
                                best = (gain, f, left, u, t)
                if best is None:
                    done.append((rows, v))
                    continue
                _, f, left, u, t = best
                inside, mid = set(left), (u + t) / 2
                after.append((left, used | {f}, mid if monotone[f] < 0 else low, mid if monotone[f] > 0 else high, u))
                after.append(([i for i in rows if i not in inside], used | {f}, mid if monotone[f] > 0 else low, mid if monotone[f] < 0 else high, t))
            nodes = after
        for rows, v in done + [(n[0], n[4]) for n in nodes]:
            for i in rows:
                margin[i] += s.rate * v
    return [1 / (1 + exp(-m)) for m in margin]


@pytest.mark.parametrize(("monotone", "groups", "l1"), [([0, 0, 0, 0], None, 0.0), ([1, -1, 0, 0], [[0, 1], [2]], 0.5)])
def test_same_trees_as_a_plain_loop(spark, table, monotone, groups, l1):
    s = Settings(trees=3, depth=3, rate=0.3, bins=8, least_hessian=2.0, l1=l1)
    model = boosting.fit_boosted(table, NAMES, "y", "w", settings=s, monotone=monotone, groups=groups)
    assert len(model.trees) == 3 and model.held_losses == []
    x, y, w, _ = made()
    want = plain(x, y, w, model.cuts, s, monotone, [{0, 1}, {2}, {3}] if groups else [set(range(4))])
    got = [r["score"] for r in boosting.boosted_scores(model, table).orderBy("id").collect()]
    assert got == pytest.approx(want, abs=1e-9)


def test_monotone_and_groups_hold(spark, table, monkeypatch):
    monkeypatch.setattr(boosting, "PENDING", 3)
    groups = [[0, 1], [2, 3]]
    model = boosting.fit_boosted(table, NAMES, "y", "w", settings=Settings(trees=10, depth=4, rate=0.3, bins=16), monotone=[1, -1, 0, 0], groups=groups)
    rng = np.random.default_rng(9)
    for f, sign in ((0, 1), (1, -1)):
        base = rng.integers(0, 12, (200, 4)).astype(float)
        base[rng.random((200, 4)) < 0.1] = np.nan
        along = []
        for v in np.arange(-1, 13, 0.5):
            base[:, f] = v
            along.append(sum(t.values(model.binned(base)) for t in model.trees))
        steps = np.diff(np.array(along), axis=0) * sign
        assert steps.min() >= -1e-12 and steps.max() > 0
    for tree in model.trees:

        def paths(node, used):
            if tree.feature[node] < 0:
                assert any(used <= set(g) for g in groups)
            else:
                for child in (tree.left[node], tree.right[node]):
                    paths(child, used | {tree.feature[node]})

        paths(0, set())
    gains = model.importance()
    assert [g for _, g in gains] == sorted((g for _, g in gains), reverse=True) and {n for n, _ in gains} == set(NAMES)


def test_stops_when_held_out_rows_gain_nothing(spark, table):
    s = Settings(trees=60, depth=4, rate=0.6, bins=16, least_hessian=0.5, l2=0.1, patience=4)
    model = boosting.fit_boosted(table, NAMES, "y", "w", held="held", settings=s)
    losses = model.held_losses
    assert len(model.trees) < 60 and len(losses) == len(model.trees) + 5 and min(losses) == losses[len(model.trees)]
    p = F.col("score")
    rows = boosting.boosted_scores(model, table).where("held")
    assert rows.agg(F.sum(-F.col("w") * F.log(F.when(F.col("y") == 1, p).otherwise(1 - p))) / F.sum("w")).first()[0] == pytest.approx(min(losses))


def test_shares_of_rows_and_features_repeat(spark, table):
    s = Settings(trees=3, depth=2, rows=0.5, columns=0.5, bins=8)
    one, two = (boosting.fit_boosted(t, NAMES, "y", "w", settings=s) for t in (table, table.repartition(2)))
    shape = lambda m: [(t.feature, t.cut, t.left) for t in m.trees]
    assert shape(one) == shape(two)
    assert all(len({f for f in t.feature if f >= 0}) <= 2 for t in one.trees)


def test_nothing_to_learn_from_and_models_on_disk(spark, table, tmp_path):
    none = boosting.fit_boosted(table.limit(0), NAMES, "y")
    assert none.trees == [] and boosting.boosted_scores(none, table.limit(3)).select("score").distinct().collect()[0][0] == 0.5
    alike = boosting.fit_boosted(table.withColumn("y", F.lit(1)).withColumn("a", F.lit(None).cast("double")), NAMES, "y", settings=Settings(trees=2, depth=2))
    assert boosting.boosted_scores(alike, table).where("score < 0.99").isEmpty()
    model = boosting.fit_boosted(table, NAMES, "y", settings=Settings(trees=2, depth=2))
    boosting.save_boosters(spark, {"reach": model, "match": none}, f"file://{tmp_path}/m", {"gpa_mean": 3.1})
    found, manifest = boosting.load_boosters(spark, f"file://{tmp_path}/m", ["reach", "match", "safety"])
    assert found == {"reach": model, "match": none} and manifest["about"] == {"gpa_mean": 3.1} and manifest["buckets"]["reach"]["trees"] == 2


def test_constraints_of_the_catalogue(spark, table):
    names = ["gpa", "sat_below_25th", "student_size", "other"]
    renamed = table.toDF("id", *names, "y", "w", "held")
    model = boosting.fit_boosted(renamed, names, "y", "w", settings=Settings(trees=3, depth=3), monotone=predicting.monotone_vector(names), groups=predicting.interaction_groups(names))
    assert all(len({f for f in t.feature if f >= 0}) for t in model.trees)
    base = np.full((14, 4), 5.0)
    base[:, 0] = np.arange(14)
    assert (np.diff(sum(t.values(model.binned(base)) for t in model.trees)) >= 0).all()


def test_importance_is_the_loss_of_a_shuffle(spark, table):
    model = boosting.fit_boosted(table, NAMES, "y", settings=Settings(trees=4, depth=3, rate=0.3), groups=[[0, 1]])
    found = {r["feature"]: r for r in boosting.importance_by_permutation(model, table, "y", "id", repeats=3).collect()}
    used = {NAMES[f] for t in model.trees for f in t.feature if f >= 0}
    assert found.keys() == set(NAMES) and all(found[n]["mean"] == 0 and found[n]["is_low"] for n in set(NAMES) - used)
    rows = table.select("id", "y", *NAMES).toPandas()
    x = rows[NAMES].to_numpy()
    hashes = {k: [r[0] for r in table.select(F.xxhash64(F.lit(42), F.lit(k), "id"), "id").orderBy("id").collect()] for k in range(3)}

    def loss(values):
        p = 1 / (1 + np.exp(-(model.base + sum(t.values(model.binned(values)) for t in model.trees))))
        return -np.log(np.where(rows["y"] > 0, p, 1 - p)).mean()

    rows = rows.sort_values("id").reset_index(drop=True)
    x = rows[NAMES].to_numpy()
    for f, n in enumerate(NAMES):
        drops = []
        for k in range(3):
            order = np.argsort(hashes[k], kind="stable")
            mixed = x.copy()
            mixed[order, f] = x[np.roll(order, -1), f]
            drops.append(loss(mixed) - loss(x))
        assert found[n]["mean"] == pytest.approx(np.mean(drops), abs=1e-9) and found[n]["std"] == pytest.approx(np.std(drops), abs=1e-9)


def test_calibration_is_chosen_on_other_rows_and_buckets_are_pooled(spark, table):
    rng = np.random.default_rng(3)
    rows = [(i, float(p), float(rng.random() < p**2)) for i, p in enumerate(rng.random(800))]
    held = spark.createDataFrame(rows, "id long, p double, y double")
    kind, model = learning.calibrate(held, "p", "y")
    assert kind in ("isotonic", "sigmoid", "venn_abers")
    out = learning.calibrated(held, kind, model, "p")
    raw, better = out.agg(F.avg((F.col("p") - F.col("y")) ** 2), F.avg((F.col("calibrated") - F.col("y")) ** 2)).first()
    assert better < raw - 0.01 and out.columns == ["id", "p", "y", "calibrated"]
    assert learning.calibrate(held.where("y = 1"), "p", "y")[0] == "sigmoid"
    grid = learning.venn_abers(held, "p", "y")
    assert learning.calibrated(held, "venn_abers", grid, "p").where("calibrated between 0 and 1").count() == 800
    bucketed = table.withColumn("bucket", F.when(F.col("id") % 3 == 0, "reach").when(F.col("id") % 3 == 1, "match"))
    s = Settings(trees=2, depth=2)
    models = {k: boosting.fit_boosted(bucketed.where(F.col("bucket") == k), NAMES, "y", settings=s) for k in ("reach", "match")}
    pooled = boosting.pooled_by_bucket(models, bucketed, "bucket")
    assert pooled.count() == 600 and pooled.where("score is null").count() == 200
    assert metrics.auc(pooled.where("score is not null"), "score", "y").first()["auc"] > 0.6


def test_rows_are_kept_in_blocks_and_sums_are_made_for_features_that_may_split(spark, table, monkeypatch):
    kept, levels = [], []
    keep, level = boosting.written, boosting._level

    def seen(*given):
        sums, loss = level(*given)
        levels.append((given[3], sums))
        return sums, loss

    monkeypatch.setattr(boosting, "written", lambda df: kept.append(keep(df)) or kept[-1])
    monkeypatch.setattr(boosting, "_level", seen)
    monkeypatch.setattr(boosting, "PENDING", 1)
    boosting.fit_boosted(table, NAMES, "y", "w", settings=Settings(trees=2, depth=2), groups=[[0, 1], [2, 3]])
    assert len(kept) == 3 and all(0 < df.count() <= table.rdd.getNumPartitions() for df in kept)
    for may, sums in levels:
        wanted = {f for features in may.values() for f in features}
        assert all(not sums[node][f].any() for node in sums for f in set(range(4)) - wanted)
    assert any(0 < len({f for features in may.values() for f in features}) < 4 for may, _ in levels)

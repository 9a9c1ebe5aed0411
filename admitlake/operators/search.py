"""Search of settings: density-ratio sampling for one loss, a genetic search along the front for two, and the front itself over any table.

What a trial costs is its Spark jobs; the samplers only see the trials so far, a number that the caller sets.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from math import exp, inf, log, pi, sqrt
from statistics import median

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import written
from .boosting import Settings, boosted_scores, fit_boosted
from .metrics import auc
from .placing import placed

#: name -> (low, high, whether whole numbers, whether even on a logarithmic scale).
Space = dict[str, tuple[float, float, bool, bool]]
Params = dict[str, float]
#: Trials drawn at random first; the share of trials that counts as good, and at most how many; draws that are weighed.
STARTUP, GOOD, MOST_GOOD, DRAWS = 10, 0.1, 25, 24
BOOSTING: Space = {
    "rate": (0.01, 0.2, False, True), "depth": (3, 7, True, False), "columns": (0.5, 1.0, False, False), "rows": (0.5, 1.0, False, False), "l1": (1e-6, 10.0, False, True),
    "l2": (1e-6, 10.0, False, True), "least_gain": (0.0, 0.5, False, False), "least_hessian": (1e-3, 30.0, False, True),
}


def _unit(space: Space, name: str, value: float) -> float:
    low, high, _, scale = space[name]
    return (log(value / low) / log(high / low)) if scale else (value - low) / (high - low)


def _value(space: Space, name: str, unit: float) -> float:
    low, high, whole, scale = space[name]
    found = low * (high / low) ** unit if scale else low + (high - low) * unit
    return float(min(max(round(found), low), high)) if whole else min(max(found, low), high)


def random_params(space: Space, rng: np.random.Generator) -> Params:
    return {name: _value(space, name, float(rng.random())) for name in space}


def _widths(at: list[float]) -> list[float]:
    """For each point the larger distance to a neighbour, the ends of 0..1 among them, neither tiny nor more than 1."""
    order = sorted(at)
    edges = [0.0, *order, 1.0]
    width = {v: max(edges[k + 1] - edges[k], edges[k + 2] - edges[k + 1]) for k, v in enumerate(order)}
    return [min(1.0, max(width[v], 1 / min(100, len(at) + 2))) for v in at]


def _density(x: float, at: list[float], widths: list[float]) -> float:
    """A mixture of one normal density for each point and an even one over 0..1."""
    return (1 + sum(exp(-0.5 * ((x - m) / s) ** 2) / (s * sqrt(2 * pi)) for m, s in zip(at, widths))) / (len(at) + 1)


def density_ratio(trials: list[tuple[Params, float]], space: Space, rng: np.random.Generator) -> Params:
    """The next setting: for each parameter, of DRAWS values drawn near those of the good trials the one that is likeliest there against the rest. Trials without a finite loss count as the rest."""
    if len(trials) < STARTUP:
        return random_params(space, rng)
    order = sorted(range(len(trials)), key=lambda k: (trials[k][1] if trials[k][1] == trials[k][1] else inf, k))
    n = min(MOST_GOOD, max(1, int(np.ceil(GOOD * len(trials)))))
    found = {}
    for name in space:
        good, rest = ([_unit(space, name, trials[k][0][name]) for k in part] for part in (order[:n], order[n:]))
        wide, others = _widths(good), _widths(rest)
        best = (-inf, 0.0)
        for _ in range(DRAWS):
            k = int(rng.integers(0, len(good) + 1))
            x = float(rng.random()) if k == len(good) else float(np.clip(rng.normal(good[k], wide[k]), 0, 1))
            best = max(best, (log(_density(x, good, wide)) - log(_density(x, rest, others)), x))
        found[name] = _value(space, name, best[1])
    return found


def ranks_and_crowding(losses: list[tuple[float, float]]) -> tuple[list[int], list[float]]:
    """For each pair the number of its front (0 is not dominated by any), and how far apart its neighbours in the front are."""
    left, rank, crowd, front = set(range(len(losses))), [0] * len(losses), [0.0] * len(losses), 0
    while left:
        least, here = inf, []
        for k in sorted(left, key=lambda k: losses[k]):
            if losses[k][1] < least or here and losses[k] == losses[here[-1]]:
                here.append(k)
                least = losses[k][1]
        for k in here:
            rank[k] = front
        span = [losses[here[-1]][0] - losses[here[0]][0] or 1.0, losses[here[0]][1] - losses[here[-1]][1] or 1.0]
        for at, k in enumerate(here):
            ends = at in (0, len(here) - 1)
            crowd[k] = inf if ends else (losses[here[at + 1]][0] - losses[here[at - 1]][0]) / span[0] + (losses[here[at - 1]][1] - losses[here[at + 1]][1]) / span[1]
        left -= set(here)
        front += 1
    return rank, crowd


def front_child(trials: list[tuple[Params, tuple[float, float]]], space: Space, rng: np.random.Generator, population: int = 20) -> Params:
    """The next setting for two losses: two parents, each the better of two (front, then crowding) of the best `population`; parameters from either, one in len(space) drawn anew."""
    if len(trials) < population:
        return random_params(space, rng)
    rank, crowd = ranks_and_crowding([t[1] for t in trials])
    alive = sorted(range(len(trials)), key=lambda k: (rank[k], -crowd[k], k))[:population]
    place = {k: at for at, k in enumerate(alive)}
    a, b = (min((alive[int(rng.integers(0, len(alive)))] for _ in range(2)), key=place.__getitem__) for _ in range(2))
    return {name: _value(space, name, float(rng.random())) if rng.random() < 1 / len(space) else trials[a if rng.random() < 0.5 else b][0][name] for name in space}


def searched(spark: SparkSession, losses: Callable[[Params], tuple[float, ...]], space: Space, trials: int, seed: int = 42) -> DataFrame:
    """(trial, params, loss, second): `trials` settings, each drawn after what those before it lost. One loss goes by density ratio, two along the front; second is null for one."""
    rng, done = np.random.default_rng(seed), []
    for _ in range(trials):
        two = bool(done) and len(done[0][1]) == 2
        params = front_child(done, space, rng) if two else density_ratio([(p, x[0]) for p, x in done], space, rng)
        done.append((params, losses(params)))
    rows = [(k, p, float(x[0]), float(x[1]) if len(x) == 2 else None) for k, (p, x) in enumerate(done)]
    return spark.createDataFrame(rows, "trial int, params map<string,double>, loss double, second double")


def stepwise(losses: Callable[[Params], float], start: Params, steps: list[tuple[str, list[float]]]) -> tuple[Params, float]:
    """One parameter after the other, each at the value of least loss given those before; of equals the earlier one, the present one first."""
    best, least = dict(start), losses(start)
    for name, values in steps:
        for v in values:
            if v != best[name] and (found := losses(best | {name: v})) < least:
                best, least = best | {name: v}, found
    return best, least


def boosting_losses(train: DataFrame, features: list[str], label: str, fold: str, folds: int = 3, base: Settings | None = None, two: bool = False, pruned: bool = True, **limits) -> Callable[[Params], tuple[float, ...]]:
    """What a setting of boosters loses on folds left out: the Brier score, or with `two` minus the AUC and the Brier score.

    fold: a column of 0..folds - 1, equal for rows that belong together. pruned (one loss only): a setting whose
    mean so far is above the median of those before it at the same fold is not fitted further, once there are STARTUP.
    """
    seen: list[list[float]] = [[] for _ in range(folds)]

    def losses(params: Params) -> tuple[float, ...]:
        s = replace(base or Settings(), **{k: int(v) if k == "depth" else v for k, v in params.items()})
        briers, areas = [], []
        for k in range(folds):
            marked = train.withColumn("_held", F.col(fold) == k)
            out = written(boosted_scores(fit_boosted(marked, features, label, held="_held", settings=s, **limits), marked.where("_held"), "_score").select("_score", label))
            briers.append(out.agg(F.avg((F.col("_score") - F.col(label)) ** 2)).first()[0])
            if two:
                areas.append(-(auc(out, "_score", label).first()["auc"] or 0.5))
            elif pruned:
                mean = sum(briers) / len(briers)
                late = len(seen[k]) >= STARTUP and mean > median(seen[k])
                seen[k].append(mean)
                if late:
                    break
        return (sum(areas) / len(areas), sum(briers) / len(briers)) if two else (sum(briers) / len(briers),)

    return losses


def front(df: DataFrame, a: str, b: str) -> DataFrame:
    """The rows that no other row dominates: none is at most as large in both columns and smaller in one.

    Equal rows stay together; rows with a null or NaN in either column go. A row stays if its b is below that of
    every smaller a: each range of a is swept by itself, below the least b of the ranges before it.
    """
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    known = df.where(x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    least = known.groupBy(x.alias("_a")).agg(F.min(y).alias("_b"))
    rows = written(least.repartitionByRange("_a").sortWithinPartitions("_a").withColumn("_part", F.spark_partition_id()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    parts = rows.groupBy("_part").agg(F.min("_b").alias("_least")).select("_part", F.min("_least").over(earlier).alias("_before"))
    here = F.min("_b").over(Window.partitionBy("_part").orderBy("_a").rowsBetween(Window.unboundedPreceding, -1))
    swept = rows.withColumn("_here", here).join(F.broadcast(parts), "_part")
    kept = swept.where(F.col("_b") < F.least(F.coalesce("_here", F.lit(inf)), F.coalesce("_before", F.lit(inf)))).select("_a", "_b")
    return known.withColumns({"_a": x, "_b": y}).join(kept, ["_a", "_b"], "left_semi").drop("_a", "_b")


def crowding(front: DataFrame, a: str, b: str, name: str = "crowding") -> DataFrame:
    """The distinct points of a front with how far apart each one's neighbours are, in shares of the front's width in a and in b; infinite at both ends."""
    points = written(placed(front.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).distinct(), "a"))
    spans = points.agg(F.max("a") - F.min("a"), F.max("b") - F.min("b")).first()
    near = lambda by, c: points.select((F.col("place") + by).alias("place"), F.col("a").alias(f"a{c}"), F.col("b").alias(f"b{c}"))
    joined = points.join(near(1, 0), "place", "left").join(near(-1, 1), "place", "left")
    far = (F.col("a1") - F.col("a0")) / F.lit(spans[0] or 1.0) + (F.col("b0") - F.col("b1")) / F.lit(spans[1] or 1.0)
    return joined.select(F.col("a").alias(a), F.col("b").alias(b), F.coalesce(far, F.lit(inf)).alias(name))

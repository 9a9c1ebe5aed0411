"""Boosted trees under constraints: histogram trees grown level by level from grouped sums over all rows.

Features are cut into bins once and rows written in blocks, each of a batch of rows, with their bins at a byte or two
each: a block travels to Python as a few values, whatever its rows. For each level of a tree one job sums gradient and hessian by node, feature and bin, for the features that a node may still be split by;
tasks add up their own rows, Spark adds up the tasks, and the sums (nodes x features x bins, whatever the
number of rows) decide the splits. Monotone features
keep both sides of a split in order and pass their middle on as a bound; a path keeps to one group of
features that may meet. The sums of a tree's first level also tell the loss on rows held out, which stops
the boosting.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written
from .placing import placed

#: Trees whose margins are computed anew in each job before they are written with the rows.
PENDING = 8


@dataclass
class Settings:
    """rate: of each tree. l1, l2: on leaves. least_gain, least_hessian: of a split and of its sides. rows, columns: shares that a tree sees, drawn by hash and seed. patience: trees without a better loss on held-out rows before boosting stops."""

    trees: int = 200
    depth: int = 5
    rate: float = 0.05
    l1: float = 0.0
    l2: float = 1.0
    least_gain: float = 0.0
    least_hessian: float = 1.0
    bins: int = 64
    rows: float = 1.0
    columns: float = 1.0
    patience: int = 50
    seed: int = 42


@dataclass
class Tree:
    """Nodes in one list: feature (-1 in a leaf), the last bin that goes left, whether missing values do, children, and the value of a leaf."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, missing_left: bool, gain: float, values: tuple[float, float]) -> tuple[int, int]:
        left = len(self.feature)
        self.feature[node], self.cut[node], self.missing_left[node], self.gain[node], self.left[node], self.right[node] = feature, cut, missing_left, gain, left, left + 1
        for v in values:
            self.feature.append(-1), self.cut.append(0), self.missing_left.append(False), self.left.append(-1), self.right.append(-1), self.value.append(v), self.gain.append(0.0)
        return left, left + 1

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins; bin -1 is a missing value."""
        at, open_ = np.zeros(len(bins), np.intp), [(0, np.arange(len(bins)))]
        while open_:
            node, rows = open_.pop()
            f = self.feature[node]
            if f < 0 or not len(rows):
                at[rows] = node
                continue
            b = bins[:, f][rows]
            goes_left = b <= self.cut[node] if self.missing_left[node] else (b <= self.cut[node]) & (b >= 0)
            open_ += [(self.left[node], rows[goes_left]), (self.right[node], rows[~goes_left])]
        return at

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]


@dataclass
class Booster:
    """A fitted model; cuts are the upper edges of each feature's bins."""

    features: list[str]
    cuts: list[list[float]]
    base: float
    trees: list[Tree]
    held_losses: list[float]
    settings: Settings

    def binned(self, values: np.ndarray) -> np.ndarray:
        return _binned(list(values.T), self.cuts)

    def importance(self) -> list[tuple[str, float]]:
        """Each feature's gain over all splits, largest first, those without any (of gain 0) last."""
        gains = dict.fromkeys(self.features, 0.0)
        for tree in self.trees:
            for f, g in zip(tree.feature, tree.gain):
                if f >= 0:
                    gains[self.features[f]] += g
        return sorted(gains.items(), key=lambda x: (-x[1], x[0]))


def _kind(cuts: list[list[float]]) -> np.dtype:
    """The smallest type that holds a bin of any of the features."""
    return np.min_scalar_type(-1 - max((len(c) for c in cuts), default=0))


def _binned(columns: list[np.ndarray], cuts: list[list[float]]) -> np.ndarray:
    """Bins of rows (row, feature) from the values of each feature; each feature's bins lie together."""
    out = np.empty((len(columns[0]) if columns else 0, len(cuts)), _kind(cuts), order="F")
    for k, (column, edges) in enumerate(zip(columns, cuts)):
        out[:, k] = np.where(np.isnan(column), -1, np.searchsorted(np.array(edges), column, side="left"))
    return out


def _doubles(features: list[str]) -> Column:
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features])


def bin_cuts(train: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """For each feature at most bins - 1 distinct values, near its quantiles; nulls and NaN count for none."""
    shares = [k / bins for k in range(1, bins)]
    found = train.agg(*[F.percentile_approx(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), shares, 10_000).alias(f"c{k}") for k, c in enumerate(features)]).first()
    return [sorted(set(found[f"c{k}"] or [])) for k in range(len(features))]


def _weight(g: np.ndarray, h: np.ndarray, s: Settings) -> np.ndarray:
    return -np.sign(g) * np.maximum(np.abs(g) - s.l1, 0) / np.maximum(h + s.l2, 1e-12)


def _worth(g: np.ndarray, h: np.ndarray, w: np.ndarray, s: Settings) -> np.ndarray:
    """What a leaf of value w takes from the loss."""
    return -(g * w + 0.5 * (h + s.l2) * w * w + s.l1 * np.abs(w))


def best_split(sums: np.ndarray, allowed: list[int], monotone: list[int], low: float, high: float, s: Settings) -> tuple[float, int, int, bool, float, float] | None:
    """The best split of a node from sums (feature, bin + 1, [gradient, hessian]), bin 0 for missing values: gain, feature, last bin on the left, whether missing values go left, and both values.

    Values keep to low..high. Of splits of equal gain (to nine digits) the first feature, then the first bin,
    then missing values on the right.
    """
    best = None
    whole = sums[allowed[0]].sum(0) if allowed else None
    for f in allowed:
        own = np.clip(_weight(whole[0], whole[1], s), low, high)
        parent = _worth(whole[0], whole[1], own, s)
        along = sums[f, 1:].cumsum(0)
        for missing_left in (False, True):
            left = along + sums[f, 0] * missing_left
            right = whole - left
            w = [np.clip(_weight(x[:, 0], x[:, 1], s), low, high) for x in (left, right)]
            gain = np.round(_worth(left[:, 0], left[:, 1], w[0], s) + _worth(right[:, 0], right[:, 1], w[1], s) - parent, 9)
            fine = (left[:, 1] >= s.least_hessian) & (right[:, 1] >= s.least_hessian) & (monotone[f] * (w[1] - w[0]) >= 0) & (gain > s.least_gain)
            if fine.any():
                k = int(np.where(fine, gain, -np.inf).argmax())
                if best is None or gain[k] > best[0]:
                    best = (float(gain[k]), f, k, missing_left, float(w[0][k]), float(w[1][k]))
    return best


def fit_boosted(
    train: DataFrame, features: list[str], label: str, weight: str | None = None, held: str | None = None, settings: Settings | None = None, monotone: list[int] | None = None, groups: list[list[int]] | None = None,
) -> Booster:
    """Boosted trees for the log-loss of label (0 or 1; rows with another one or a weight that is not above 0 are left out).

    features are numbers; null and NaN are missing and go to the side that is better. held names a boolean
    column: its rows are not learned from but measured, and boosting stops when their loss has not
    fallen for `patience` trees; the trees after the best one are dropped. monotone: for each feature 1 or -1 if the
    chance may only rise or only fall with it, else 0. groups: lists of places of features that may meet on a path;
    None lets all meet; a feature of no list stands alone. Without rows to learn from the model has no tree.
    """
    s = settings or Settings()
    monotone = monotone or [0] * len(features)
    groups = [set(g) for g in groups] if groups is not None else [set(range(len(features)))]
    groups += [{k} for k in range(len(features)) if not any(k in g for g in groups)]
    given = train.where((F.col(label).cast("double") == 0) | (F.col(label).cast("double") == 1))
    given = given.select(*[F.col(c).cast("double").alias(f"f{k}") for k, c in enumerate(features)], F.col(label).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), F.coalesce(F.col(held), F.lit(False)).alias("held") if held else F.lit(False).alias("held"))
    names = [f"f{k}" for k in range(len(features))]
    given = given.where("w > 0 and not isnan(w)")
    learn = given.where("not held")
    cuts = bin_cuts(learn, names, s.bins)
    rate = learn.agg(F.sum(F.col("y") * F.col("w")) / F.sum("w")).first()[0]
    base = log(min(max(rate, 1e-6), 1 - 1e-6) / (1 - min(max(rate, 1e-6), 1 - 1e-6))) if rate is not None else 0.0
    model = Booster(list(features), cuts, base, [], [], s)
    if rate is None:
        return model
    drawn = F.pmod(F.xxhash64(F.lit(s.seed), *names, "y"), F.lit(1 << 30))
    rows = written(_margins(given.select(_doubles(names).alias("values"), "y", "w", "held", drawn.alias("drawn")), cuts, base))
    pending: list[Tree] = []
    rng = np.random.default_rng(s.seed)
    best = (float("inf"), 0)
    for step in range(s.trees + 1):
        chosen = sorted(rng.choice(len(features), max(1, round(s.columns * len(features))), replace=False).tolist())
        tree, open_ = Tree(), {0: (set(), -np.inf, np.inf)}
        for level in range(s.depth):
            may = {} if step == s.trees else {node: sorted({k for g in groups if used <= g for k in g} & set(chosen)) for node, (used, _, _) in open_.items()}
            sums, losses = _level(rows, pending, tree, may, cuts, s, step)
            if level == 0 and losses is not None:
                model.held_losses.append(losses)
                if losses < best[0] - 1e-12:
                    best = (losses, step)
            if level == 0 and (step == s.trees or losses is not None and step - best[1] >= s.patience):
                model.trees = model.trees[: best[1]] if losses is not None else model.trees
                return model
            following = {}
            for node, (used, low, high) in open_.items():
                found = best_split(sums[node], may[node], monotone, low, high, s) if node in sums and may[node] else None
                if found is None:
                    continue
                gain, f, cut, missing_left, v_left, v_right = found
                a, b = tree.split(node, f, cut, missing_left, gain, (v_left, v_right))
                middle, (low_a, high_a, low_b, high_b) = (v_left + v_right) / 2, (low, high, low, high)
                if monotone[f] > 0:
                    high_a, low_b = middle, middle
                elif monotone[f] < 0:
                    low_a, high_b = middle, middle
                following[a], following[b] = (used | {f}, low_a, high_a), (used | {f}, low_b, high_b)
            open_ = following
            if not open_:
                break
        tree.value = [v * s.rate for v in tree.value]
        model.trees.append(tree)
        pending.append(tree)
        if len(pending) == PENDING:
            rows, pending = written(_added(rows, pending, cuts)), []
    return model


@dataclass
class Block:
    """Rows that are stored and learned from together."""

    bins: np.ndarray
    y: np.ndarray
    w: np.ndarray
    held: np.ndarray
    drawn: np.ndarray
    margin: np.ndarray


_BLOCK = "bins binary, y binary, w binary, held binary, drawn binary, margin binary"


def _margins(rows: DataFrame, cuts: list[list[float]], base: float) -> DataFrame:
    """Rows of values, y, w, held and drawn in blocks, with their bins and the margin to start from."""
    size = len(cuts)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            bins = _binned(list(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size).T), cuts)
            y, w, held, drawn = (c.to_numpy(zero_copy_only=False) for c in batch.columns[1:])
            kept = (bins.T, y.astype(np.int8), w, held, drawn, np.full(len(bins), base))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in kept], ["bins", "y", "w", "held", "drawn", "margin"])

    return rows.mapInArrow(task, _BLOCK)


def _read(batches: Iterator[pa.RecordBatch], pending: list[Tree], cuts: list[list[float]]) -> Iterator[Block]:
    """The blocks of the batches, with the pending trees in their margins."""
    kinds = (_kind(cuts), np.int8, np.float64, np.bool_, np.int64, np.float64)
    for batch in batches:
        for row in zip(*batch.select(["bins", "y", "w", "held", "drawn", "margin"]).columns):
            bins, y, w, held, drawn, margin = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(row, kinds))
            block = Block(bins.reshape(len(cuts), -1).T, y, w, held, drawn, margin.copy())
            for tree in pending:
                block.margin += tree.values(block.bins)
            yield block


def _added(rows: DataFrame, pending: list[Tree], cuts: list[list[float]]) -> DataFrame:
    """The blocks with the pending trees in their margins."""
    shared = rows.sparkSession.sparkContext.broadcast(pending)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = pa.array([b.margin.tobytes() for b in _read(iter([batch]), shared.value, cuts)], pa.binary())
            yield batch.set_column(batch.schema.get_field_index("margin"), "margin", margins)

    return rows.mapInArrow(task, _BLOCK)


def _level(rows: DataFrame, pending: list[Tree], tree: Tree, may: dict[int, list[int]], cuts: list[list[float]], s: Settings, step: int) -> tuple[dict[int, np.ndarray], float | None]:
    """Sums of gradient and hessian by open node, feature and bin over the rows of all blocks that the tree sees, and, on a tree's first level, the mean loss of the rows held out.

    may: for each open node the features that may split it; features that split none have sums of 0.
    """
    shared = rows.sparkSession.sparkContext.broadcast((pending, tree))
    share, size, width = int(s.rows * (1 << 30)), len(cuts), max((len(c) for c in cuts), default=0) + 2
    nodes, measured = np.array(list(may), np.int64), len(tree.feature) == 1
    wanted = sorted({f for features in may.values() for f in features})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, tree = shared.value
        slot = np.full(len(tree.feature), -1)
        slot[nodes] = np.arange(len(nodes))
        sums = np.zeros((len(wanted), 2, len(nodes) * width))
        loss = np.zeros(2)
        for block in _read(batches, pending, cuts):
            y, w, p = block.y, block.w, 1 / (1 + np.exp(-block.margin))
            if measured:
                sure = np.clip(np.where(y > 0, p, 1 - p), 1e-15, 1)
                loss += [-(w * np.log(sure))[block.held].sum(), w[block.held].sum()]
            seen = ~block.held
            if s.rows < 1:
                seen &= (block.drawn * 2654435761 + step * 97003) % (1 << 30) < share
            at = slot[tree.nodes(block.bins)]
            mine = np.flatnonzero(seen & (at >= 0))
            first, g, h = at[mine] * width + 1, (w * (p - y))[mine], (w * p * (1 - p))[mine]
            for k, f in enumerate(wanted):
                cell = first + block.bins[:, f][mine]
                for part, x in zip(sums[k], (g, h)):
                    part += np.bincount(cell, x, len(part))
        for k, f in enumerate(wanted):
            at = np.flatnonzero(sums[k].any(0))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at // width].astype(np.int32)), pa.array((f * width + at % width).astype(np.int32)), pa.array(sums[k, 0, at]), pa.array(sums[k, 1, at])], ["node", "cell", "g", "h"])
        if measured:
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0], pa.int32()), pa.array(loss[:1]), pa.array(loss[1:])], ["node", "cell", "g", "h"])

    found = rows.mapInArrow(task, "node int, cell int, g double, h double").groupBy("node", "cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()
    sums: dict[int, np.ndarray] = {}
    for node, part in found[found["node"] >= 0].groupby("node"):
        held = sums[int(node)] = np.zeros((size * width, 2))
        held[part["cell"].to_numpy()] = part[["g", "h"]].to_numpy()
    told = found[found["node"] < 0]
    loss = float(told["g"].iloc[0] / told["h"].iloc[0]) if len(told) and told["h"].iloc[0] > 0 else None
    return {k: v.reshape(size, width, 2) for k, v in sums.items()}, loss


def boosted_scores(model: Booster, df: DataFrame, name: str = "score") -> DataFrame:
    """df with the chance of label 1; an old column of that name gives way."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def chance(values: pa.Array) -> pa.Array:
        m = shared.value
        bins = m.binned(values.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(m.features)))
        margin = np.full(len(bins), m.base)
        for tree in m.trees:
            margin += tree.values(bins)
        return pa.array(1 / (1 + np.exp(-margin)))

    return df.withColumn(name, chance(_doubles(model.features)))


def save_boosters(spark: SparkSession, models: dict[str, Booster], path: str, about: dict | None = None) -> None:
    """Each bucket's model with its settings as a row, and a manifest: which buckets there are, their features and trees, and `about` the training (such as z-statistics)."""
    spark.createDataFrame([(k, json.dumps(asdict(m))) for k, m in models.items()], "bucket string, model string").coalesce(1).write.mode("overwrite").json(f"{path}/models")
    manifest = {"buckets": {k: {"features": m.features, "trees": len(m.trees), "settings": asdict(m.settings)} for k, m in models.items()}, "about": about or {}}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_boosters(spark: SparkSession, path: str, buckets: list[str]) -> tuple[dict[str, Booster], dict]:
    """The models of those buckets that the manifest names, and the manifest; a bucket that it names without a model is an error."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    wanted = [b for b in buckets if b in manifest["buckets"]]
    found = {}
    for r in spark.read.schema("bucket string, model string").json(f"{path}/models").where(F.col("bucket").isin(wanted)).collect():
        m = json.loads(r["model"])
        found[r["bucket"]] = Booster(m["features"], m["cuts"], m["base"], [Tree(**t) for t in m["trees"]], m["held_losses"], Settings(**m["settings"]))
    if missing := set(wanted) - found.keys():
        raise ValueError(f"the manifest names models that are not there: {sorted(missing)}")
    return found, manifest


def importance_by_permutation(model: Booster, df: DataFrame, label: str, key: str, repeats: int = 10, low: float = 0.0005, seed: int = 42) -> DataFrame:
    """(feature, mean, std, is_low): how much worse the log-loss gets when a feature's values are dealt out anew among the rows, over the repeats.

    One order by hash for each repeat, all in one sort by ranges: a row takes the values of the row after it, the
    last those of the first. Every feature is then tried on the same pair of rows in the same task, so there
    is one sort and one join, whatever the number of features. Rows are told apart by key.
    """
    known = df.where((F.col(label).cast("double") == 0) | (F.col(label).cast("double") == 1))
    rows = known.select(F.col(key).alias("key"), F.col(label).cast("double").alias("y"), _doubles(model.features).alias("values"))
    dealt = placed(rows.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("_h", F.xxhash64(F.lit(seed), "turn", "key")), "turn", "_h", "key")
    dealt = written(dealt.select("turn", "place", "y", "values"))
    n = known.count()
    after = F.when(F.col("place") % n == 1 if n > 1 else F.lit(True), F.col("place") + n - 1).otherwise(F.col("place") - 1)
    pairs = dealt.join(dealt.select(after.alias("place"), F.col("values").alias("other")), "place").select("turn", "y", "values", "other")
    shared, size = df.sparkSession.sparkContext.broadcast(model), len(model.features)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, sums = shared.value, {}

        def losses(bins: np.ndarray, y: np.ndarray) -> np.ndarray:
            margin = m.base + sum((t.values(bins) for t in m.trees), np.zeros(len(bins)))
            p = 1 / (1 + np.exp(-margin))
            return -np.log(np.clip(np.where(y > 0, p, 1 - p), 1e-15, 1))

        for batch in batches:
            turn, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            own, other = (m.binned(batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)) for k in (2, 3))
            plain = losses(own, y)
            for f in range(size):
                mixed = own.copy()
                mixed[:, f] = other[:, f]
                worse = losses(mixed, y) - plain
                for t in np.unique(turn).tolist():
                    sums[f, t] = sums.get((f, t), 0.0) + worse[turn == t].sum()
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()), pa.array(list(sums.values()), pa.float64())], ["f", "turn", "worse"])

    found = pairs.mapInArrow(task, "f int, turn int, worse double").groupBy("f", "turn").agg((F.sum("worse") / max(n, 1)).alias("worse"))
    told = found.groupBy("f").agg(F.avg("worse").alias("mean"), F.stddev_pop("worse").alias("std"))
    names = F.array(*map(F.lit, model.features))
    return told.select(F.element_at(names, F.col("f") + 1).alias("feature"), "mean", "std", (F.col("mean") < low).alias("is_low"))


def pooled_by_bucket(models: dict[str, Booster], df: DataFrame, bucket: str, name: str = "score") -> DataFrame:
    """All rows with the score of their bucket's model, null where there is none, for metrics by bucket and over all."""
    rest = df.where(F.col(bucket).isNull() | ~F.col(bucket).isin(list(models))).withColumn(name, F.lit(None).cast("double"))
    for k, model in models.items():
        rest = rest.unionByName(boosted_scores(model, df.where(F.col(bucket) == k), name))
    return rest

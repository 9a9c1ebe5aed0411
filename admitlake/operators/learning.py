"""Boosted trees for each bucket, and the calibration of their scores."""

from __future__ import annotations

from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written
from .placing import placed

#: Buckets that may have a model each.
BUCKETS = 16


def fit_booster(train: DataFrame, features: list[str], label: str, weight: str | None = None, seed: int = 42, **params) -> PipelineModel:
    """Medians for missing features, then weighted boosted trees; label is 0.0 or 1.0, features are doubles."""
    filled = [f"{c}_filled" for c in features]
    booster = GBTClassifier(featuresCol="features", labelCol=label, seed=seed, **({"weightCol": weight} if weight else {}), **params)
    return Pipeline(stages=[Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features"), booster]).fit(train)


def scored(model: PipelineModel, df: DataFrame, name: str = "score") -> DataFrame:
    """df with the probability of label 1."""
    return model.transform(df).withColumn(name, vector_to_array("probability")[1]).select(*df.columns, name)


def fit_by_bucket(train: DataFrame, bucket: str, features: list[str], label: str, **params) -> dict[str, PipelineModel]:
    """One booster for each bucket that has both labels; buckets are a few fixed words, and more than BUCKETS of them are refused."""
    kinds = train.where(F.col(bucket).isNotNull()).groupBy(bucket).agg(F.countDistinct(label).alias("n")).where("n = 2").select(bucket).limit(BUCKETS + 1).toPandas()[bucket]
    if len(kinds) > BUCKETS:
        raise ValueError(f"more than {BUCKETS} buckets in {bucket}")
    return {k: fit_booster(train.where(F.col(bucket) == k), features, label, **params) for k in sorted(kinds)}


def scored_by_bucket(models: dict[str, PipelineModel], df: DataFrame, bucket: str, name: str = "score") -> DataFrame:
    """Each row scored by its bucket's model; rows whose bucket has none get a null score."""
    rest = df.where(F.col(bucket).isNull() | ~F.col(bucket).isin(list(models))).withColumn(name, F.lit(None).cast("double"))
    for k, model in models.items():
        rest = rest.unionByName(scored(model, df.where(F.col(bucket) == k), name))
    return rest


def permutation_importance(model: PipelineModel, df: DataFrame, features: list[str], label: str, key: str, repeats: int = 10, low: float = 0.0005) -> DataFrame:
    """(feature, mean, std, is_low): how much worse the log-loss is when one feature's values are dealt out anew among the rows, over the repeats.

    Rows are told apart by key; a shuffle joins each row with the value of the row at the same place in another order.
    """
    def loss(rows: DataFrame) -> float:
        p = F.greatest(F.least(F.col("score"), F.lit(1 - 1e-15)), F.lit(1e-15))
        return scored(model, rows).agg(F.avg(-(F.col(label) * F.log(p) + (1 - F.col(label)) * F.log(1 - p)))).first()[0]

    base, found = loss(df), []
    order = placed(df.select(key), key)
    for f in features:
        drops = []
        for k in range(repeats):
            other = placed(df.select(key, f).withColumn("_h", F.xxhash64(F.lit(k), F.col(key))), "_h", key).select("place", f)
            drops.append(loss(df.drop(f).join(order.join(other, "place").drop("place"), key)) - base)
        mean = sum(drops) / len(drops)
        found.append((f, mean, (sum((d - mean) ** 2 for d in drops) / len(drops)) ** 0.5, mean < low))
    return df.sparkSession.createDataFrame(found, "feature string, mean double, std double, is_low boolean")


def venn_abers(held: DataFrame, score: str, label: str, steps: int = 200) -> tuple[list[float], list[float], list[float]]:
    """Venn-ABERS calibration on a grid of scores: (grid, low, high).

    For each score of the grid two isotonic fits of the held-out rows and one more row at it, labelled 0 and
    labelled 1; their values there are low and high. Rows are counted by step of the grid before they come to the driver.
    """
    at = F.least(F.floor(F.col(score) * steps), F.lit(steps - 1)).cast("int")
    rows = held.where(F.col(score).isNotNull()).groupBy(at.alias("at")).agg(F.sum(F.col(label).cast("double")).alias("y"), F.count(F.lit(1)).alias("n")).collect()
    y, n = [0.0] * steps, [0.0] * steps
    for r in rows:
        y[r["at"]], n[r["at"]] = r["y"], float(r["n"])

    def fitted(k: int, extra: float) -> float:
        blocks: list[list[float]] = []
        for j in range(steps):
            weight, total = n[j] + (j == k), y[j] + extra * (j == k)
            if not weight:
                continue
            blocks.append([total, weight, j, j])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                b = blocks.pop()
                blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2], b[3]]
        return next(b[0] / b[1] for b in blocks if b[2] <= k <= b[3])

    grid = [(k + 0.5) / steps for k in range(steps)]
    return grid, [fitted(k, 0.0) for k in range(steps)], [fitted(k, 1.0) for k in range(steps)]


def venn_abers_calibrated(df: DataFrame, fit: tuple[list[float], list[float], list[float]], score: str) -> DataFrame:
    """df with the calibrated score, high / (1 - low + high), and its ends."""
    steps = len(fit[0])
    at = F.least(F.greatest(F.floor(F.col(score) * steps), F.lit(0)), F.lit(steps - 1)).cast("int") + 1
    low, high = (F.element_at(F.array(*map(F.lit, x)), at) for x in fit[1:])
    return df.withColumns({"low": low, "high": high}).withColumn("calibrated", F.col("high") / (1 - F.col("low") + F.col("high")))


def save_models(models: dict[str, PipelineModel], path: str) -> None:
    """Each bucket's model under its name."""
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/{name}")


def load_models(path: str, buckets: list[str]) -> dict[str, PipelineModel]:
    """The models that are there; a bucket without a folder is passed over, and one that cannot be read is an error."""
    found, spark = {}, SparkSession.getActiveSession()
    for name in buckets:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            found[name] = PipelineModel.load(f"{path}/{name}")
    return found


def _calibrations(rows: DataFrame) -> dict[str, object]:
    vector = VectorAssembler(inputCols=["x"], outputCol="v").transform(rows)
    return {"isotonic": IsotonicRegression(featuresCol="v", labelCol="y").fit(vector), "sigmoid": LogisticRegression(featuresCol="v", labelCol="y").fit(vector), "venn_abers": venn_abers(rows, "x", "y")}


def calibrate(held: DataFrame, score: str, label: str, seed: int = 42) -> tuple[str, object]:
    """Isotonic, logistic or Venn-ABERS calibration: its name and model.

    Half of the rows, by a hash of all their columns, is fitted on; the other half's Brier scores choose; the
    chosen one is fitted again on all. Scores lie in 0..1; rows without a score are left out. If a half has
    rows of one label only, the logistic one is taken.
    """
    every = held.where(F.col(score).isNotNull())
    rows = written(every.select(F.col(score).cast("double").alias("x"), F.col(label).cast("double").alias("y"), F.pmod(F.xxhash64(F.lit(seed), *every.columns), F.lit(2)).alias("half")))
    fit, rest = rows.where("half = 0").select("x", "y"), rows.where("half = 1").select("x", "y")
    kinds = {tuple(r) for r in rows.groupBy("half", "y").count().select("half", "y").collect()}
    if len(kinds) < 4:
        return "sigmoid", _calibrations(rows)["sigmoid"]
    losses = {k: calibrated(rest, k, m, "x").agg(F.avg((F.col("calibrated") - F.col("y")) ** 2)).first()[0] for k, m in _calibrations(fit).items()}
    best = min(losses, key=losses.__getitem__)
    return best, _calibrations(rows)[best]


def calibrated(df: DataFrame, kind: str, model, score: str) -> DataFrame:
    """df with the calibrated score."""
    if kind == "venn_abers":
        return venn_abers_calibrated(df, model, score).select(*df.columns, "calibrated")
    out = model.transform(VectorAssembler(inputCols=[score], outputCol="v").transform(df))
    p = F.col("prediction") if kind == "isotonic" else vector_to_array("probability")[1]
    return out.withColumn("calibrated", p).select(*df.columns, "calibrated")

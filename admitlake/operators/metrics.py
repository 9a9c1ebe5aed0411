"""Quality of predicted probabilities: calibration error, Brier score, log-loss, AUC, confusion, choices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .placing import exact_median

#: Ranges of probability in which ranks are counted on their own.
RANGES = 10_000


def calibration_bins(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Per half-open bin of probability: rows, mean probability, share of positives. A probability of 1 is in no bin."""
    rows = df.where((F.col(p) >= 0) & (F.col(p) < 1)).withColumn("bin", F.floor(F.col(p) * bins).cast("int"))
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("rate"))


def losses(df: DataFrame, p: str, y: str, *keys: str) -> DataFrame:
    """Rows, Brier score, its skill against the base rate, and log-loss, over all rows or by keys."""
    x = F.greatest(F.least(F.col(p), F.lit(1 - 1e-15)), F.lit(1e-15))
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col(p) - F.col(y), F.lit(2.0))).alias("brier"), F.avg(y).alias("base"),
        F.avg(-(F.col(y) * F.log(x) + (1 - F.col(y)) * F.log(1 - x))).alias("log_loss"),
    )
    return out.withColumn("brier_skill", 1 - F.try_divide("brier", F.col("base") * (1 - F.col("base"))))


def auc(df: DataFrame, p: str, y: str) -> DataFrame:
    """The area under the ROC curve by mid-ranks. Ranks run over distinct probabilities (0 to 1), already counted, range by range."""
    at = df.groupBy(p).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos"), F.count(F.lit(1)).alias("n"))
    at = at.withColumn("range", F.floor(F.col(p) * RANGES))
    sizes = at.groupBy("range").agg(F.sum("n").alias("size"))
    first = sizes.select("range", F.coalesce(F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    before = F.sum("n").over(Window.partitionBy("range").orderBy(p).rowsBetween(Window.unboundedPreceding, -1))
    ranked = at.join(F.broadcast(first), "range").select("pos", "n", (F.col("first") + F.coalesce(before, F.lit(0)) + (F.col("n") + 1) / 2).alias("rank"))
    sums = ranked.agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    return sums.select("n", F.col("pos").alias("positives"), F.try_divide(F.col("r") - F.col("pos") * (F.col("pos") + 1) / 2, F.col("pos") * (F.col("n") - F.col("pos"))).alias("auc"))


def confusion(df: DataFrame, p: str, y: str, threshold: float = 0.5) -> DataFrame:
    return df.groupBy(F.col(y).alias("actual"), (F.col(p) >= threshold).cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def pareto_pick(df: DataFrame, limit: str, value: str, key: str) -> DataFrame:
    """The key with the least value among rows whose limit is not above the median; of equals the smallest key."""
    return df.where(F.col(limit) <= exact_median(df, limit)).agg(F.min_by(key, F.struct(value, key)).alias(key), F.min(value).alias(value))


def class_report(df: DataFrame, p: str, y: str, threshold: float = 0.5) -> DataFrame:
    """(name, precision, recall, f1, support) of each class, '0' and '1', and their plain and weighted means, 'macro' and 'weighted'; a share of nothing is 0.

    Rows whose label is neither, or without a probability, count for none. Four counts come out of the rows; the rest follows from them.
    """
    said, is_one = F.col(p) >= threshold, F.col(y) == 1
    known = df.where(F.col(y).isin(0, 1) & F.col(p).isNotNull())
    n = known.agg(*[F.count_if(c).cast("double").alias(k) for k, c in (("tp", said & is_one), ("fp", said & ~is_one), ("fn", ~said & is_one), ("tn", ~said & ~is_one))])
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))

    def one(name: str, hit: str, wrong: str, missed: str):
        h, w, m = F.col(hit), F.col(wrong), F.col(missed)
        return F.struct(F.lit(name).alias("name"), share(h, h + w).alias("precision"), share(h, h + m).alias("recall"), share(2 * h, 2 * h + w + m).alias("f1"), (h + m).alias("support"))

    both = n.select(one("0", "tn", "fn", "fp").alias("a"), one("1", "tp", "fp", "fn").alias("b"))
    total = F.col("a.support") + F.col("b.support")
    mean = lambda name, wa, wb: F.struct(F.lit(name).alias("name"), *[share(wa * F.col(f"a.{k}") + wb * F.col(f"b.{k}"), wa + wb).alias(k) for k in ("precision", "recall", "f1")], total.alias("support"))
    rows = F.array("a", "b", mean("macro", F.lit(1.0), F.lit(1.0)), mean("weighted", F.col("a.support"), F.col("b.support")))
    return both.select(F.inline(rows)).withColumn("support", F.col("support").cast("long"))

"""From raw tables to the training set: joins, score normalisation, school means, features, encodings, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import catalogue
from ..functions.scores import capped_gpa, filled_scores
from .blocks import counted
from .placing import exact_median, placed


def joined_points(points: DataFrame, schools: DataFrame, grades: DataFrame) -> DataFrame:
    """Points with their school, and its grades where there are any; a tombstone (no_data) counts as none."""
    known = grades.where(F.coalesce(F.col("no_data"), F.lit(False)) == F.lit(False)).drop("no_data")
    return points.join(schools, "school_id").join(known, "school_id", "left")


def decided(points: DataFrame) -> DataFrame:
    return points.where(F.col("outcome").isin("accepted", "rejected"))


def with_scores(points: DataFrame) -> DataFrame:
    """SAT and ACT filled from each other; points with neither go."""
    sat, act = filled_scores(F.col("sat_score"), F.col("act_score"))
    return points.where(F.col("sat_score").isNotNull() | F.col("act_score").isNotNull()).withColumns({"sat_score": sat, "act_score": act})


def with_gpa(points: DataFrame) -> DataFrame:
    """gpa_original kept, is_weighted above 4, gpa held to 4; points outside 0 < gpa go."""
    gpa = F.col("gpa")
    return points.where(gpa > 0).withColumns({"gpa_original": gpa, "is_weighted": gpa > 4, "gpa": capped_gpa(gpa)})


def school_means(points: DataFrame) -> DataFrame:
    """The mean gpa of each school's accepted points."""
    return points.where("outcome = 'accepted'").groupBy("school_id").agg(F.avg("gpa").alias("school_gpa"))


def training_set(points: DataFrame, schools: DataFrame, grades: DataFrame) -> DataFrame:
    """Decided points with scores, school columns, school means and the whole feature catalogue."""
    base = with_gpa(with_scores(decided(points)))
    rows = joined_points(base, schools, grades).join(school_means(base), "school_id", "left")
    stats = base.join(schools.select("school_id"), "school_id", "left_semi").agg(*[f(x).alias(f"{x}_{n}") for x in ("gpa", "sat_score") for n, f in (("mean", F.avg), ("std", F.stddev_samp))])

    def one(name: str) -> Column:
        return stats.select(name).scalar()

    features = catalogue((one("gpa_mean"), one("gpa_std")), (one("sat_score_mean"), one("sat_score_std")))
    return rows.select("*", (F.col("outcome") == "accepted").cast("int").alias("admitted"), *[v.alias(k) for k, v in features.items()])


def smoothed_means(df: DataFrame, key: str, target: str, strength: float) -> DataFrame:
    """Per key (n * mean + strength * overall) / (n + strength), as `encoding`."""
    overall = df.agg(F.avg(target)).scalar()
    grouped = df.groupBy(key).agg(F.sum(target).alias("s"), F.count(target).alias("n"))
    return grouped.select(key, "n", ((F.col("s") + strength * overall) / (F.col("n") + strength)).alias("encoding"))


def out_of_fold(df: DataFrame, key: str, target: str, fold: Column, strength: float) -> DataFrame:
    """df with `encoding`: the smoothed mean of the key over the other folds; the other folds' mean for keys they lack."""
    folded = df.withColumn("fold", fold)
    cells = folded.groupBy(key, "fold").agg(F.sum(target).alias("s"), F.count(target).alias("n"))
    totals = cells.groupBy("fold").agg(F.sum("s").alias("fs"), F.sum("n").alias("fn"))
    everything = cells.agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    per_key = Window.partitionBy(key)
    others = cells.withColumns({"os": F.sum("s").over(per_key) - F.col("s"), "on": F.sum("n").over(per_key) - F.col("n")}).join(F.broadcast(totals), "fold")
    mean = (everything.select("s").scalar() - F.col("fs")) / (everything.select("n").scalar() - F.col("fn"))
    coded = others.select(key, "fold", F.when(F.col("on") > 0, (F.col("os") + strength * mean) / (F.col("on") + strength)).otherwise(mean).alias("encoding"))
    return folded.join(counted(coded), [key, "fold"])


def sample_weights(df: DataFrame, key: str) -> DataFrame:
    """df with `weight`: one over the square root of the key's frequency, scaled to mean 1."""
    counts = counted(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")))
    mean = counts.agg(F.sum(F.sqrt("n")) / F.sum("n")).scalar()
    return df.join(counts, key).withColumn("weight", 1 / F.sqrt("n") / mean).drop("n")


def stratified_split(df: DataFrame, key: str, label: Column, strata: int = 5) -> DataFrame:
    """df with `part` like grouped_split, but dealt out evenly within strata of the groups' share of positive labels.

    Within each stratum, groups in an order by hash go to the parts by turns of ten: 6, 2, 2.
    """
    groups = df.groupBy(key).agg(F.avg(label).alias("rate")).withColumn("stratum", F.least(F.floor(F.coalesce("rate", F.lit(0.0)) * strata), F.lit(strata - 1)))
    turn = F.pmod(F.col("place"), F.lit(10))
    dealt = placed(groups.withColumn("_h", F.xxhash64(key)), "stratum", "_h", key).select(key, F.when(turn < 6, "train").when(turn < 8, "calibrate").otherwise("test").alias("part"))
    return df.join(dealt, key)


def median_imputed(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with missing values of the columns filled by each column's exact median."""
    medians = {c: exact_median(df, c) for c in columns}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(m).cast("double")) for c, m in medians.items()})


def category_codes(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with a column's place among its distinct values in order, from 0; null gets -1."""
    kinds = placed(df.select(column).where(F.col(column).isNotNull()).distinct(), column, name=out).withColumn(out, F.col(out) - 1)
    return df.join(kinds, column, "left").withColumn(out, F.coalesce(out, F.lit(-1).cast("long")))


def grouped_split(df: DataFrame, key: str) -> DataFrame:
    """df with `part`: whole groups go to train (60 %), calibrate (20 %) or test (20 %), by the key's hash."""
    draw = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(10))
    return df.withColumn("part", F.when(draw < 6, "train").when(draw < 8, "calibrate").otherwise("test"))

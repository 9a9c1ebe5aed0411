"""Names matched to a dimension: exact after normalisation, else the most similar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalized_name
from .blocks import in_blocks
from .entities import alike_pairs


def similarity(a: Column, b: Column) -> Column:
    """100 for equal texts, less by the share of the longer one that must be edited."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 100.0).otherwise(100.0 * (1 - F.levenshtein(a, b) / longest))


def token_sorted(name: Column) -> Column:
    return F.array_join(F.array_sort(F.split(normalized_name(name), " ")), " ")


def token_sort_matches(names: DataFrame, schools: DataFrame, overrides: DataFrame | None = None, least: float = 80.0) -> DataFrame:
    """Each distinct name with the school it stands for and the score: by an override (name, school), else equal after normalisation, else the most like by its sorted words.

    Likeness is twice the letters common to both in order, by both lengths. Of equal scores the first school by name stays; names
    with no school of `least`, null and blank names are left out.
    """
    wanted = names.select("name").where(F.trim("name") != "").distinct()
    fixed = wanted.limit(0).withColumn("school", F.lit(None).cast("string")) if overrides is None else wanted.join(overrides.groupBy("name").agg(F.min("school").alias("school")), "name")
    keyed = wanted.join(fixed, "name", "left_anti").withColumn("key", token_sorted(F.col("name")))
    known = schools.select(F.col("name").alias("school")).where(F.trim("school") != "").distinct().withColumn("key", token_sorted(F.col("school")))
    exact = known.groupBy("key").agg(F.min("school").alias("school"))
    same = keyed.join(exact, "key").select("name", "school", F.lit(100.0).alias("score"))
    rest = keyed.join(exact, "key", "left_anti")
    alike = alike_pairs(rest.select(F.col("key").alias("run")), known.select("key"), least).join(exact, "key")
    best = alike.groupBy("run").agg(F.min_by(F.struct("school", "score"), F.struct((-F.col("score")).alias("s"), F.col("school"))).alias("b"))
    near = rest.join(best, F.col("key") == F.col("run")).select("name", "b.school", "b.score")
    return fixed.select("name", "school", F.lit(100.0).alias("score")).unionByName(same).unionByName(near)


def best_matches(names: DataFrame, schools: DataFrame, least: float = 80.0) -> DataFrame:
    """Each distinct name with the school (name) it stands for and the score; names with no school of `least` are left out.

    Names equal after normalisation score 100 and are joined, not compared. The rest meet the
    dimension in blocks of bounded size; names whose lengths alone rule the score out are not compared.
    Of equal scores the first school by name stays. Null and blank names match nothing.
    """
    wanted = names.select("name").where(F.trim("name") != "").distinct().withColumn("key", token_sorted(F.col("name")))
    known = schools.select(F.col("name").alias("school")).where(F.trim("school") != "").distinct().withColumn("school_key", token_sorted(F.col("school")))
    exact = known.groupBy(F.col("school_key").alias("key")).agg(F.min("school").alias("school"))
    same = wanted.join(exact, "key").select("name", "school", F.lit(100.0).alias("score"))
    rest = wanted.join(exact, "key", "left_anti")

    def compared(block: DataFrame) -> DataFrame:
        a, b = F.length("key"), F.length("school_key")
        near = F.least(a, b) * 100.0 >= F.greatest(a, b) * (least - 1e-9)
        pairs = rest.join(block, near).select("name", "school", similarity(F.col("key"), F.col("school_key")).alias("score"))
        place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), "school"))
        return pairs.where(F.col("score") >= least).withColumn("_place", place).where("_place = 1").drop("_place")

    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), "school"))
    return same.unionByName(in_blocks(known, "school", compared).withColumn("_place", place).where("_place = 1").drop("_place"))

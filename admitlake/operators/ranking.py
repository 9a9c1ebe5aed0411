"""Hits after a cross-encoder has scored them: boosts by school and page, the threshold, and the final order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import GRADE_POINTS, lookup
from .retrieval import page_type_boost, ranking_boost

# Page types that essays prefer.
ESSAY_PAGES = ("about", "academics", "campus_life", "diversity", "outcomes", "admissions", "safety_health", "research")


def flattened(hits: DataFrame, fields: list[str], entity: str = "entity", item: str = "item") -> DataFrame:
    """Hits with entity and item structs as flat rows: a field of the entity, else of the item; distance, else score, else 0."""
    have = {side: set(hits.schema[side].dataType.names) for side in (entity, item)}

    def one(name: str) -> Column:
        found = [F.col(side)[name] for side in (entity, item) if name in have[side]]
        return F.coalesce(*found) if found else F.lit(None)

    rest = [c for c in hits.columns if c not in (entity, item)]
    return hits.select(*rest, *[one(f).alias(f) for f in fields], F.coalesce(one("distance").cast("double"), one("score").cast("double"), F.lit(0.0)).alias("distance"))


def mean_grade(grades: Column, wanted: Column) -> Column:
    """The mean in grade points of a school's letters (a map by category) over the wanted categories; null without any."""
    points = F.array_compact(F.transform(F.filter(wanted, lambda w: w != "other"), lambda w: lookup(F.try_element_at(grades, w), GRADE_POINTS, "double")))
    return F.try_divide(F.aggregate(points, F.lit(0.0), lambda a, x: a + x), F.size(points))


def with_school_boost(hits: DataFrame, schools: DataFrame, wanted: Column) -> DataFrame:
    """Hits (query_id, id, college, score) of ranking questions, raised by what is known of their school.

    schools: name_key (lower-cased, one row each), rank, acceptance, grades (map). wanted: categories, an
    array; only "other" among them leaves rank and grades out. Hits of unknown schools stay as they are.
    """
    only_other = (F.size(wanted) == 1) & (wanted[0] == "other")
    grade = F.when(~only_other, mean_grade(F.col("_grades"), wanted))
    rank = F.when(~only_other & (F.col("_rank") != 0), F.col("_rank"))
    boost = ranking_boost(rank, F.col("_acceptance"), F.array_contains(wanted, "academics"), grade)
    known = schools.select("name_key", F.col("rank").alias("_rank"), F.col("acceptance").alias("_acceptance"), F.col("grades").alias("_grades"))
    joined = hits.withColumn("name_key", F.lower("college")).join(known, "name_key", "left")
    raised = F.coalesce("score", F.lit(0.0)) + F.greatest(boost, F.lit(0.0))
    return joined.withColumn("score", F.when(F.col("_grades").isNotNull() & (boost > 0), raised).otherwise(F.col("score"))).drop("name_key", "_rank", "_acceptance", "_grades")


def reranked(hits: DataFrame, top_k: int, schools: DataFrame | None = None, wanted: Column | None = None, preferred: tuple[str, ...] = (), least: float = 0.1) -> DataFrame:
    """The hits (query_id, id, college, kind, score, rank) of each query after reranking, with `place`.

    The top_k by score, of equals by rank, are raised by their school (if schools are given) and their
    page type, and those below `least` go; a missing score is 0. A query's only hit stays untouched.
    """
    per = Window.partitionBy("query_id")
    score = F.coalesce("score", F.lit(0.0))
    first = hits.withColumn("_n", F.count(F.lit(1)).over(per)).withColumn("_at", F.row_number().over(per.orderBy(F.desc(score), "rank")))
    alone = first.where("_n <= 1")
    chosen = first.where((F.col("_n") > 1) & (F.col("_at") <= top_k))
    if schools is not None:
        chosen = with_school_boost(chosen, schools, wanted)
    if preferred:
        chosen = chosen.withColumn("score", page_type_boost(F.col("score"), F.col("kind"), list(preferred)))
    chosen = chosen.where(score >= least)
    out = chosen.unionByName(alone)
    return out.withColumn("place", F.row_number().over(per.orderBy(F.desc(score), "_at"))).drop("_n", "_at")


def unranked(hits: DataFrame, top_k: int, preferred: tuple[str, ...] = ()) -> DataFrame:
    """The first top_k hits of each query without a cross-encoder: in their order, raised by page type if types are preferred, no threshold."""
    per = Window.partitionBy("query_id")
    if preferred:
        hits = hits.withColumn("score", page_type_boost(F.col("score"), F.col("kind"), list(preferred)))
    order = (F.desc(F.coalesce("score", F.lit(0.0))), "rank") if preferred else ("rank",)
    return hits.withColumn("place", F.row_number().over(per.orderBy(*order))).where(F.col("place") <= top_k)


def health(hits: DataFrame) -> DataFrame:
    """Of each query's candidates: how many, the whole mean length of their contents, and how many name no school."""
    size = F.sum(F.length(F.coalesce("content", F.lit("")))).cast("long")
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), size.alias("_size"), F.sum((F.coalesce("college", F.lit("")) == "").cast("long")).alias("empty_names")).select("query_id", "n", F.expr("_size div n").alias("mean_length"), "empty_names")

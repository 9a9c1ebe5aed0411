"""From a model's scores to what an applicant is told: chance, interval, class, factors, error rows, order, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import single_catalogue
from ..functions.scores import chance_class, clamp, filled_scores, major_tier, wilson
from ..functions.text import is_chance_question, stats_in
from .placing import placed

# Which way a feature may move the chance, and which features may meet in a tree.
MONOTONE = {
    "gpa": 1, "sat_score": 1, "identity_acceptance_rate": 1, "sat_percentile_at_school": 1, "gpa_vs_expected": 1, "sat_zscore_at_school": 1, "gpa_zscore_at_school": 1, "academic_composite_z": 1,
    "gpa_x_acceptance": 1, "sat_ratio": 1, "sat_above_75th": 1, "sat_below_25th": -1, "academic_fit": 1, "test_optional_x_sat_z": 1, "test_optional_x_gpa_zscore": 1, "test_required_x_sat_below_25th": -1,
}
INTERACTIONS = {
    "applicant_academic": (
        "gpa", "sat_score", "academic_composite_z", "sat_percentile_at_school", "gpa_vs_expected", "sat_zscore_at_school", "gpa_zscore_at_school", "sat_percentile_sq", "sat_excess", "gpa_excess", "sat_ratio", "academic_fit",
    ),
    "school_stats": ("identity_acceptance_rate", "student_size", "student_faculty_ratio", "competitiveness_index", "holistic_signal", "sat_range"),
    "fit_interactions": (
        "gpa_x_acceptance", "selectivity_x_sat", "gpa_x_competitiveness", "sat_x_competitiveness", "instate_x_public", "residency_x_acceptance", "stem_competitive_x_acceptance", "is_yield_protector",
        "is_test_optional", "test_optional_x_sat_z", "test_required_x_sat_below_25th", "test_optional_x_gpa_zscore",
    ),
}
# What stands around a prediction.
GUIDANCE = (
    "Note: This prediction is based on self-reported data and should be treated as a rough estimate, not a guarantee.\nGuidance for incorporating this prediction:\n"
    "- Frame the probability relative to the school's overall acceptance rate.\n- Classify the school as: SAFETY (>70%), MATCH (30-70%), or REACH (<30%) based on the predicted probability.\n"
    "- If REACH, suggest specific actions that could improve candidacy (strong essays, demonstrated interest if the school tracks it, ED if financial aid is not a constraint).\n"
    "- Never present the probability as deterministic — admissions involves holistic review factors not captured by the model."
)


def monotone_vector(features: list[str]) -> list[int]:
    """For each feature 1, -1, or 0 where it may move the chance either way."""
    return [MONOTONE.get(f, 0) for f in features]


def interaction_groups(features: list[str]) -> list[list[int]]:
    """Places of the features that may meet in a tree, group by group; a feature of no group is one of its own."""
    at = {f: k for k, f in enumerate(features)}
    groups = [[at[f] for f in group if f in at] for group in INTERACTIONS.values()]
    grouped = {f for group in INTERACTIONS.values() for f in group}
    return [g for g in groups if g] + [[k] for f, k in at.items() if f not in grouped]


def requests_joined(requests: DataFrame, schools: DataFrame, school_means: DataFrame) -> DataFrame:
    """Requests (gpa, sat_score, act_score, school_id, residency, major) with their school's columns; gpa held to 4, scores filled, `error` where a prediction is impossible."""
    sat, act = filled_scores(F.col("sat_score"), F.col("act_score"))
    known = schools.withColumn("_known", F.lit(True))
    rows = requests.join(known, "school_id", "left").join(school_means, "school_id", "left").withColumns({"sat_score": sat, "act_score": act, "given_gpa": F.col("gpa")})
    error = F.when(F.col("_known").isNull(), "school not found").when(F.col("sat_score").isNull(), "no test score").when(F.col("gpa").isNull(), "no gpa")
    return rows.withColumns({"error": error, "gpa": F.when(F.col("gpa").isNotNull(), F.least(F.col("gpa"), F.lit(4.0))), "major_tier": major_tier(F.col("major"))}).drop("_known")


def with_features(rows: DataFrame, z_stats: tuple[Column, Column, Column, Column]) -> DataFrame:
    return rows.select("*", *[v.alias(k) for k, v in single_catalogue(z_stats).items()])


def factors(percentile: Column, gpa: Column, sat: Column) -> Column:
    """What speaks for and against, as structs impact and detail: scores against the school's, and the gpa."""
    def one(impact: str, detail: Column) -> Column:
        return F.struct(F.lit(impact).alias("impact"), detail.alias("detail"))

    score = F.concat(F.lit("SAT "), sat.cast("int").cast("string"))
    by_score = F.when(percentile > 0.75, one("positive", F.concat(score, F.lit(" is above the 75th percentile")))).when(percentile < 0.25, one("negative", F.concat(score, F.lit(" is below the 25th percentile"))))
    mark = F.format_string("GPA %.2f", gpa)
    by_gpa = F.when(gpa >= 3.8, one("positive", F.concat(mark, F.lit(" is strong")))).when(gpa < 3.0, one("negative", F.concat(mark, F.lit(" is below typical admits"))))
    return F.array_compact(F.array(by_score, by_gpa))


def predictions(scored: DataFrame, score: str = "score") -> DataFrame:
    """Scored rows (with features, given_gpa, error) with probability, low, high, class and factors; rows in error, or without a score (no model of their bucket), have an error and nothing else."""
    p = clamp(F.col(score), 0.01, 0.99)
    low, high = wilson(p)
    error = F.coalesce("error", F.when(F.col(score).isNull(), "no model"))
    made = {"probability": F.bround(p, 4), "low": F.bround(low, 4), "high": F.bround(high, 4), "class": F.when(p.isNotNull(), chance_class(p)), "factors": factors(F.col("sat_percentile_at_school"), F.col("given_gpa"), F.col("sat_score"))}
    return scored.withColumn("error", error).withColumns({k: F.when(F.col("error").isNull(), v) for k, v in made.items()})


def compared(predicted: DataFrame, *ties: str) -> DataFrame:
    """All predictions by falling probability with their `place`; rows in error count as 0."""
    return placed(predicted.withColumn("_p", F.coalesce("probability", F.lit(0.0))), F.desc("_p"), *ties).drop("_p")


def asked_stats(question: Column, gpa: Column, test: Column, score: Column) -> dict[str, Column]:
    """gpa, sat and act of a question about chances: as the question says, else as the profile does; null in other questions."""
    said, kind = stats_in(question), F.upper(F.coalesce(test, F.lit("")))
    bare = said["sat"].isNull() & said["act"].isNull()
    asked = is_chance_question(question)
    return {
        "gpa": F.when(asked, F.coalesce(said["gpa"], F.nullif(gpa, F.lit(0.0)))), "sat": F.when(asked, F.coalesce(said["sat"], F.when(bare & (kind == "SAT") & score.between(400, 1600), score))),
        "act": F.when(asked, F.coalesce(said["act"], F.when(bare & (kind == "ACT") & score.between(1, 36), score))),
    }


def prediction_text(probability: Column, low: Column, high: Column, kind: Column, acceptance: Column, found: Column) -> Column:
    """A prediction as the text that a model reads; null without one."""
    listed = F.transform(found, lambda f: F.concat(F.lit("  ["), F.when(f["impact"] == "positive", "+").otherwise("-"), F.lit("] "), f["detail"]))
    lines = F.array(
        F.lit("\n[ML MODEL PREDICTION] Based on our admissions probability model:"),
        F.format_string("- Estimated admission probability: %.0f%% (95%% CI: %.0f%%-%.0f%%)", probability * 100, low * 100, high * 100),
        F.concat(F.lit("- Classification: "), F.upper(kind), F.lit(" school for this student")), F.format_string("- School acceptance rate: %.1f%%", F.coalesce(acceptance, F.lit(0.0)) * 100),
    )
    more = F.when(F.size(found) > 0, F.concat(F.array(F.lit("- Key factors:")), listed)).otherwise(F.array().cast("array<string>"))
    return F.when(probability.isNotNull(), F.array_join(F.concat(lines, more, F.array(F.lit(GUIDANCE))), "\n"))

"""Score conversions, buckets, intervals and losses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# SAT for each ACT composite from 36 down to 9.
ACT_TO_SAT = {
    36: 1590, 35: 1540, 34: 1500, 33: 1460, 32: 1430, 31: 1400, 30: 1370, 29: 1340, 28: 1310, 27: 1280, 26: 1240, 25: 1210, 24: 1180, 23: 1140,
    22: 1110, 21: 1080, 20: 1040, 19: 1010, 18: 970, 17: 930, 16: 890, 15: 850, 14: 800, 13: 760, 12: 710, 11: 670, 10: 630, 9: 590,
}
# Letter grades as ordinals and as grade points.
GRADE_ORDINALS = {"A+": 12, "A": 11, "A-": 10, "B+": 9, "B": 8, "B-": 7, "C+": 6, "C": 5, "C-": 4, "D+": 3, "D": 2, "D-": 1, "F": 0}
GRADE_POINTS = {"A+": 4.3, "A": 4.0, "A-": 3.7, "B+": 3.3, "B": 3.0, "B-": 2.7, "C+": 2.3, "C": 2.0, "C-": 1.7, "D+": 1.3, "D": 1.0, "D-": 0.7, "F": 0.0}
# The tier of each field of study.
MAJOR_TIERS = {
    "Computer Science": "stem_competitive", "Engineering": "stem_competitive", "Nursing": "stem_competitive", "Data Science": "stem_competitive", "Biology": "stem_standard",
    "Chemistry": "stem_standard", "Physics": "stem_standard", "Mathematics": "stem_standard", "Environmental Science": "stem_standard", "Neuroscience": "stem_standard",
    "Biochemistry": "stem_standard", "Statistics": "stem_standard", "Astronomy": "stem_standard", "Health Professions": "health", "Public Health": "health",
    "Kinesiology and Physical Therapy": "health", "Pharmacy": "health", "Business and Management": "business", "Finance and Accounting": "business", "Economics": "business",
    "Marketing": "business", "Hospitality": "business", "Real Estate": "business", "English": "arts_humanities", "History": "arts_humanities", "Philosophy": "arts_humanities",
    "Art": "arts_humanities", "Music": "arts_humanities", "Theater": "arts_humanities", "Film and Photography": "arts_humanities", "Foreign Languages": "arts_humanities",
    "Religious Studies": "arts_humanities", "Liberal Arts": "arts_humanities", "Performing Arts": "arts_humanities", "Communications": "arts_humanities", "Journalism": "arts_humanities",
    "Architecture": "arts_humanities", "Psychology": "social_science", "Political Science": "social_science", "Sociology": "social_science", "Anthropology": "social_science",
    "Social Work": "social_science", "International Relations": "social_science", "Gender Studies": "social_science", "Public Policy": "social_science", "Education": "education",
    "Criminal Justice": "applied", "Agriculture": "applied", "Culinary Arts": "applied", "Information Technology": "applied", "Aviation": "applied",
}


def lookup(key: Column, table: dict, kind: str) -> Column:
    """A small fixed dictionary as an expression; null for keys it lacks."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key).cast(kind)


def clamp(x: Column, low: float, high: float) -> Column:
    """x within bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def act_ranges(spark: SparkSession) -> DataFrame:
    """(low, high, act): the half-open range of SAT scores, in tens, that stands for each ACT."""
    steps = sorted((s, a) for a, s in ACT_TO_SAT.items())
    edges = [(float(s), float(t), a) for (s, a), (t, _) in zip(steps, steps[1:])]
    return spark.createDataFrame([*edges, (float(steps[-1][0]), 1600.0, 36), (1600.0, 1e9, 36)], "low double, high double, act int")


def act_to_sat(act: Column) -> Column:
    """Rounded half to even, held to 9..36, looked up."""
    return lookup(clamp(F.bround(act), 9.0, 36.0).cast("int"), ACT_TO_SAT, "double")


def sat_to_act(sat: Column) -> Column:
    """Rounded half to even to tens, held to 590..1600, then the highest ACT whose SAT is not above it."""
    x = clamp(F.bround(sat / 10) * 10, 590.0, 1600.0)
    steps = [36.0 if s == 1600 else float(max(a for a, floor in ACT_TO_SAT.items() if s >= floor)) for s in range(590, 1601, 10)]
    return F.element_at(F.array(*map(F.lit, steps)), ((x - 590) / 10 + 1).cast("int"))


def filled_scores(sat: Column, act: Column) -> tuple[Column, Column]:
    """SAT filled from ACT, and ACT from SAT; both null only where both were."""
    return F.coalesce(sat, act_to_sat(act)), F.coalesce(act, sat_to_act(sat))


def capped_gpa(gpa: Column) -> Column:
    return F.when(gpa.isNotNull(), F.least(gpa, F.lit(4.0)))


def selectivity(rate: Column) -> Column:
    return F.when(rate.isNull(), "unknown").when(rate < 0.15, "reach").when(rate < 0.40, "competitive").when(rate < 0.70, "match").otherwise("safety")


def grade_ordinal(grade: Column) -> Column:
    return lookup(F.trim(grade), GRADE_ORDINALS, "double")


def major_tier(major: Column) -> Column:
    """The tier of a field: "other" for unknown ones, null for null or blank."""
    return F.when(F.trim(major) != "", F.coalesce(lookup(major, MAJOR_TIERS, "string"), F.lit("other")))


def wilson(p: Column, n: float = 100.0, z: float = 1.96) -> tuple[Column, Column]:
    """The interval's ends, held to 0.01..0.99."""
    centre, spread = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return clamp(centre - spread, 0.01, 0.99), clamp(centre + spread, 0.01, 0.99)


def chance_class(p: Column) -> Column:
    return F.when(p >= 0.6, "safety").when(p >= 0.3, "match").otherwise("reach")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def focal_terms(raw: Column, label: Column, gamma: float = 2.0, alpha: float = 0.25) -> tuple[Column, Column]:
    """Focal loss and its gradient by the raw score, probabilities clipped by 1e-7."""
    p = clamp(sigmoid(raw), 1e-7, 1 - 1e-7)
    pt, weight, sign = F.when(label == 1, p).otherwise(1 - p), F.when(label == 1, alpha).otherwise(1 - alpha), F.when(label == 1, 1.0).otherwise(-1.0)
    loss = -weight * F.pow(1 - pt, F.lit(gamma)) * F.log(pt)
    gradient = sign * weight * F.pow(1 - pt, F.lit(gamma)) * (gamma * pt * F.log(pt) - (1 - pt))
    return loss, gradient


def focal_objective(raw: Column, label: Column, gamma: float = 2.0, alpha: float = 0.25) -> tuple[Column, Column]:
    """Gradient and hessian as boosters are handed them: the focal weight before the slope of the weighted cross-entropy, and an approximation held above 1e-7."""
    p = clamp(sigmoid(raw), 1e-7, 1 - 1e-7)
    pt, sign = F.when(label == 1, p).otherwise(1 - p), F.when(label == 1, 1.0).otherwise(-1.0)
    focus = F.pow(1 - pt, F.lit(gamma))
    weight = F.when(label == 1, alpha).otherwise(1 - alpha) * focus
    gradient = weight * (gamma * F.pow(1 - pt, F.lit(gamma - 1)) * pt * F.log(pt) * sign + focus * (p - label))
    return gradient, F.greatest(weight * focus * p * (1 - p), F.lit(1e-7))


def proxy_score(successes: Column, attempts: Column, latency: Column) -> Column:
    """Share of successes (0.5 without attempts) less latency (500 if unknown) over 5000."""
    return F.coalesce(F.try_divide(successes, attempts), F.lit(0.5)) - F.coalesce(latency, F.lit(500.0)) / 5000

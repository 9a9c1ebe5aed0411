"""The engineered features of an applicant at a school, as column expressions over a joined row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import clamp, major_tier, selectivity

# Schools known to turn down applicants who are likely to go elsewhere.
YIELD_PROTECTORS = (
    "tufts university", "northeastern university", "tulane university", "university of chicago", "emory university", "case western reserve university",
    "boston university", "brandeis university", "washington university in st. louis", "lehigh university", "rensselaer polytechnic institute",
    "university of rochester", "college of william and mary", "american university", "george washington university",
)


def catalogue(gpa_stats: tuple[Column, Column], sat_stats: tuple[Column, Column]) -> dict[str, Column]:
    """All thirty features by name, in order.

    The row has gpa, sat_score, residency, major, name, acceptance, sat_avg, sat25, sat75,
    graduation, ownership, test_requirements and school_gpa (mean of the school's admitted). The
    arguments are mean and sample deviation over the whole table.
    """
    c = F.col
    gpa, sat, s25, s75 = c("gpa"), c("sat_score"), c("sat25"), c("sat75")
    width, middle = s75 - s25, F.coalesce(c("sat_avg"), (s25 + s75) / 2)
    rate, expected = F.coalesce(c("acceptance"), F.lit(0.5)), F.coalesce(c("school_gpa"), 3 - clamp(F.coalesce(c("acceptance"), F.lit(0.5)), 0.0, 1.0))
    position = clamp(F.try_divide(sat - s25, width), -1.0, 2.0)
    sat_z = F.coalesce(F.try_divide(sat - middle, width / 1.35), F.lit(0.0))
    gpa_z = F.coalesce((gpa - expected) / 0.5, F.lit(0.0))

    def standard(x: Column, stats: tuple[Column, Column]) -> Column:
        return (x - stats[0]) / F.when(stats[1] > 0, stats[1]).otherwise(1.0)

    index = 0.4 * (1 - rate) + 0.35 * (F.coalesce(middle, F.lit(1000.0)) - 800) / 800 + 0.25 * F.coalesce(c("graduation"), F.lit(0.5))
    home = F.when(c("residency").isNotNull(), (c("residency") == "inState").cast("double"))
    public = F.coalesce((c("ownership") == 1).cast("double"), F.lit(0.0))
    over_sat = F.coalesce(F.when((sat - s75).isNotNull(), F.greatest(sat - s75, F.lit(0.0))), F.lit(0.0))
    gap = gpa - F.coalesce(c("school_gpa"), F.lit(4.0))
    over_gpa = F.when(gap.isNotNull(), F.greatest(gap, F.lit(0.0)))
    tier = major_tier(c("major"))
    below = F.coalesce((sat < s25).cast("double"), F.lit(0.0))
    optional = F.when(c("test_requirements").isin(3, 5), 1.0).when(c("test_requirements").isin(1, 2), 0.0)
    return {
        "sat_percentile_at_school": position,
        "gpa_vs_expected": gpa - expected,
        "selectivity_bucket": selectivity(c("acceptance")),
        "sat_zscore_at_school": sat_z,
        "gpa_zscore_at_school": gpa_z,
        "gpa_x_acceptance": gpa * rate,
        "sat_percentile_sq": position * position,
        "selectivity_x_sat": (1 - rate) * position,
        "academic_composite_z": (standard(gpa, gpa_stats) + standard(sat, sat_stats)) / 2,
        "competitiveness_index": index,
        "gpa_x_competitiveness": gpa * index,
        "sat_x_competitiveness": sat_z * index,
        "instate_x_public": home * public,
        "residency_x_acceptance": home * rate,
        "sat_excess": over_sat,
        "gpa_excess": over_gpa,
        "sat_ratio": F.coalesce(F.try_divide(sat, middle), F.lit(1.0)),
        "is_yield_protector": F.coalesce(F.lower(F.trim(c("name"))).isin(*YIELD_PROTECTORS).cast("double"), F.lit(0.0)),
        "major_tier": tier,
        "stem_competitive_x_acceptance": F.when(tier.isNotNull(), (tier == "stem_competitive").cast("double")) * rate,
        "sat_above_75th": F.coalesce((sat > s75).cast("double"), F.lit(0.0)),
        "sat_below_25th": below,
        "overqualification_index": over_sat / 100 + over_gpa,
        "academic_fit": 0.5 * clamp(sat_z, -3.0, 3.0) / 3 + 0.5 * clamp(gpa_z, -3.0, 3.0) / 3,
        "holistic_signal": F.when(width > 0, F.try_divide(width, middle)),
        "sat_range": F.when(width > 0, width),
        "is_test_optional": optional,
        "test_optional_x_sat_z": optional * sat_z,
        "test_required_x_sat_below_25th": (1 - optional) * below,
        "test_optional_x_gpa_zscore": optional * gpa_z,
    }


def single_catalogue(z_stats: tuple[Column, Column, Column, Column]) -> dict[str, Column]:
    """The features of one applicant at one school as they are computed for a prediction, which differs from the training form.

    The row is that of catalogue; z_stats: mean and deviation of gpa and of SAT scores that the model was trained with (null: no
    statistics). Missing quartiles count as 0, a range that is not above 0 gives a percentile of 0.5 and a z-score of 0, and a
    school without a mean of its admitted has a gpa z-score of 0. Squares and products take the percentile before it is held to -1..2.
    """
    c, zero = F.col, F.lit(0.0)
    gpa, sat, rate, mean = c("gpa"), c("sat_score"), F.coalesce(c("acceptance"), F.lit(0.5)), c("school_gpa")
    s25, s75 = F.coalesce(c("sat25"), zero), F.coalesce(c("sat75"), zero)
    width = s75 - s25
    wide = width > 0
    share = F.when(wide, F.try_divide(sat - s25, width)).otherwise(0.5)
    middle = F.nullif(F.coalesce(c("sat_avg"), F.when(wide, (s25 + s75) / 2)), zero)
    sat_z = F.when(wide & middle.isNotNull(), F.try_divide(sat - middle, width / 1.35)).otherwise(0.0)
    gpa_z = F.when(mean > 0, (gpa - mean) / 0.5).otherwise(0.0)
    gpa_mean, gpa_std, sat_mean, sat_std = z_stats
    composite = (F.when(gpa_std > 0, (gpa - gpa_mean) / gpa_std).otherwise(0.0) + F.when(sat_std > 0, (sat - sat_mean) / sat_std).otherwise(0.0)) / 2
    index = 0.4 * (1 - rate) + 0.35 * (F.coalesce(middle, F.lit(1000.0)) - 800) / 800 + 0.25 * F.coalesce(c("graduation"), F.lit(0.5))
    home = F.when(c("residency").isNotNull(), (c("residency") == "inState").cast("double"))
    over_sat = F.when(s75 > 0, F.greatest(sat - s75, zero)).otherwise(0.0)
    over_gpa = F.greatest(gpa - F.coalesce(F.nullif(mean, zero), F.lit(4.0)), zero)
    below = F.when(s25 > 0, (sat < s25).cast("double")).otherwise(0.0)
    optional = F.when(c("test_requirements").isin(3, 5), 1.0).when(c("test_requirements").isin(1, 2), 0.0)
    return {
        "sat_percentile_at_school": clamp(share, -1.0, 2.0),
        "gpa_vs_expected": gpa - F.coalesce(mean, 3.0 - rate),
        "selectivity_bucket": selectivity(rate),
        "sat_zscore_at_school": sat_z,
        "gpa_zscore_at_school": gpa_z,
        "gpa_x_acceptance": gpa * rate,
        "sat_percentile_sq": share * share,
        "selectivity_x_sat": (1 - rate) * share,
        "academic_composite_z": F.coalesce(composite, zero),
        "competitiveness_index": index,
        "gpa_x_competitiveness": gpa * index,
        "sat_x_competitiveness": sat_z * index,
        "instate_x_public": home * F.coalesce((c("ownership") == 1).cast("double"), zero),
        "residency_x_acceptance": home * rate,
        "sat_excess": over_sat,
        "gpa_excess": over_gpa,
        "sat_ratio": F.when(middle > 0, sat / middle).otherwise(1.0),
        "is_yield_protector": F.coalesce(F.lower(F.trim(c("name"))).isin(*YIELD_PROTECTORS).cast("double"), zero),
        "sat_above_75th": F.when(s75 > 0, (sat > s75).cast("double")).otherwise(0.0),
        "sat_below_25th": below,
        "overqualification_index": over_sat / 100 + over_gpa,
        "academic_fit": 0.5 * clamp(sat_z, -3.0, 3.0) / 3 + 0.5 * clamp(gpa_z, -3.0, 3.0) / 3,
        "holistic_signal": F.when(wide & (middle > 0), width / middle),
        "sat_range": F.when(wide, width),
        "is_test_optional": optional,
        "test_optional_x_sat_z": optional * sat_z,
        "test_required_x_sat_below_25th": (1 - optional) * below,
        "test_optional_x_gpa_zscore": optional * gpa_z,
    }

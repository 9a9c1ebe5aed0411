"""Queries of predictions: features as a prediction computes them, what applicants are told, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boosting, predicting, training
from ..storage import written
from .fixtures import CTES, grades, points, schools
from .registry import query, table
from .training import _fine

_STATS = (3.28, 0.701, 950.3, 315.0)
_S = f"""{CTES}, q as (select order_id, line_no, gpa as given_gpa, least(gpa, 4) as gpa, sat_score, act_score, school_id * 2 as school_id, residency, major from points),
    f as (select q.* exclude (sat_score), coalesce(q.sat_score, a.sat::double) as sat_score from q left join act_table a on q.act_score is not null and a.act = greatest(9, least(36, round_even(q.act_score, 0)))),
    r0 as (select f.*, s.* exclude (school_id), s.school_id is not null as known, m.school_gpa, coalesce(acceptance, 0.5) as rate, coalesce(sat25, 0) as s25, coalesce(sat75, 0) as s75 from f left join schools s using (school_id) left join means m using (school_id)),
    r1 as (select *, s75 - s25 as width, nullif(coalesce(sat_avg, case when s75 > s25 then (s25 + s75) / 2 end), 0) as middle from r0),
    r2 as (select *, case when width > 0 then (sat_score - s25) / width else 0.5 end as share, case when width > 0 and middle is not null then (sat_score - middle) / (width / 1.35) else 0 end as sat_z, case when school_gpa > 0 then (gpa - school_gpa) / 0.5 else 0 end as gpa_z,
        0.4 * (1 - rate) + 0.35 * (coalesce(middle, 1000) - 800) / 800 + 0.25 * coalesce(graduation, 0.5) as idx, case when test_requirements in (3, 5) then 1.0 when test_requirements in (1, 2) then 0.0 end::double as optional,
        case when s75 > 0 then greatest(sat_score - s75, 0) else 0 end as over_sat, greatest(gpa - coalesce(nullif(school_gpa, 0), 4), 0) as over_gpa, case when s25 > 0 then (sat_score < s25)::int::double else 0 end as below from r1 where known and sat_score is not null and gpa is not null)"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points as requests for predictions, at every other school; half of these schools are not known."""
    base = training.with_gpa(training.with_scores(training.decided(points(spark, sf_dir))))
    rows = points(spark, sf_dir).withColumn("school_id", F.col("school_id") * 2).drop("outcome")
    joined = predicting.requests_joined(rows, schools(spark, sf_dir), training.school_means(base))
    return predicting.with_features(joined, tuple(F.lit(x) for x in _STATS))


def _f(e: str, name: str) -> str:
    return f"floor(({e}) * 1e6::double + 0.5001) / 1e6::double as {name}"


@query("features_single", f"""with {_S} select order_id, line_no, {_f('greatest(-1, least(2, share))', 'sat_percentile_at_school')}, {_f('gpa - coalesce(school_gpa, 3 - rate)', 'gpa_vs_expected')}, {_f('sat_z', 'sat_zscore_at_school')}, {_f('gpa_z', 'gpa_zscore_at_school')},
    {_f('share * share', 'sat_percentile_sq')}, {_f('(1 - rate) * share', 'selectivity_x_sat')}, {_f('((gpa - 3.28) / 0.701 + (sat_score - 950.3) / 315) / 2', 'academic_composite_z')}, {_f('idx', 'competitiveness_index')}, {_f('sat_z * idx', 'sat_x_competitiveness')},
    {_f('over_sat / 100 + over_gpa', 'overqualification_index')}, {_f('coalesce(sat_score / middle, 1)', 'sat_ratio')}, {_f('case when width > 0 then width / middle end', 'holistic_signal')}, {_f('optional * sat_z', 'test_optional_x_sat_z')}, (1 - optional) * below as test_required_x_sat_below_25th
    from r2""")
def features_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = (
        "sat_percentile_at_school", "gpa_vs_expected", "sat_zscore_at_school", "gpa_zscore_at_school", "sat_percentile_sq", "selectivity_x_sat", "academic_composite_z", "competitiveness_index",
        "sat_x_competitiveness", "overqualification_index", "sat_ratio", "holistic_signal", "test_optional_x_sat_z",
    )
    return _fine(_requests(spark, sf_dir).where("error is null").select("order_id", "line_no", "test_required_x_sat_below_25th", *names), *names)


_SCORE = "1 / (1 + exp(-(0.8 * gpa_z + 0.6 * sat_z + 4 * (rate - 0.5))))"


@query("predictions", f"""with {_S}, p as (select order_id, line_no, greatest(0.01, least(0.99, {_SCORE})) as p, greatest(-1, least(2, share)) as spot, given_gpa, sat_score from r2),
    e as (select order_id, line_no, case when not known then 'school not found' when sat_score is null then 'no test score' end as error from r0)
    select order_id, line_no, error, null::double as probability, null as class, null as factors from e where error is not null union all
    select order_id, line_no, null, round(p, 3), case when p >= 0.6 then 'safety' when p >= 0.3 then 'match' else 'reach' end,
        concat_ws('; ', case when spot > 0.75 then 'SAT ' || sat_score::int || ' is above the 75th percentile' when spot < 0.25 then 'SAT ' || sat_score::int || ' is below the 25th percentile' end,
            case when given_gpa >= 3.8 then 'GPA ' || printf('%.1f', floor(given_gpa * 10) / 10) || ' is strong' when floor(given_gpa * 10) / 10 < 3.0 then 'GPA ' || printf('%.1f', floor(given_gpa * 10) / 10) || ' is below typical admits' end) from p""")
def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear model's scores as predictions; marks cut to tenths, so that both sides print them alike."""
    rows = _requests(spark, sf_dir)
    score = 1 / (1 + F.exp(-(0.8 * F.col("gpa_zscore_at_school") + 0.6 * F.col("sat_zscore_at_school") + 4 * (F.coalesce("acceptance", F.lit(0.5)) - 0.5))))
    out = predicting.predictions(rows.withColumn("score", score).withColumn("given_gpa", F.floor(F.col("given_gpa") * 10) / 10))
    said = F.array_join(F.transform("factors", lambda f: F.regexp_replace(f["detail"], r"(GPA \d\.\d)0", "$1")), "; ")
    return out.select("order_id", "line_no", "error", F.round(F.when(F.col("error").isNull(), F.least(F.greatest("score", F.lit(0.01)), F.lit(0.99))), 3).alias("probability"), "class", said.alias("factors"))


@query("chance_stats", rf"""with t as (select conv_id, turn, case turn % 4 when 0 then 'What are my chances with SAT 1420?' when 1 then 'can i get into it with gpa of 3.5?' when 2 then 'Can I get into it?' else text end as q, case when conv_id % 2 = 0 then 3.1::double end as pg, case conv_id % 3 when 0 then 'sat' when 1 then 'ACT' end as test, case when conv_id % 5 <> 0 then (conv_id % 3 * -900 + 1000)::double end as score from conversations),
    x as (select *, regexp_matches(lower(q), 'what are my chances|can i get into') as asked, try_cast(nullif(regexp_extract(q, '(?i)(?:gpa|grade point average)\s*(?:of|is|:)?\s*(\d+\.?\d*)', 1), '') as double) as g, try_cast(nullif(regexp_extract(q, '(?i)(?:sat|sat score)\s*(?:of|is|:)?\s*(\d{{3,4}})', 1), '') as double) as s from t)
    select conv_id, turn, case when asked then coalesce(g, pg) end as gpa, case when asked then coalesce(s, case when test = 'sat' and score between 400 and 1600 then score end) end as sat, case when asked and s is null and test = 'ACT' and score between 1 and 36 then score end as act from x""")
def chance_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.expr("case turn % 4 when 0 then 'What are my chances with SAT 1420?' when 1 then 'can i get into it with gpa of 3.5?' when 2 then 'Can I get into it?' else text end")
    gpa, test = F.expr("case when conv_id % 2 = 0 then 3.1d end"), F.expr("case conv_id % 3 when 0 then 'sat' when 1 then 'ACT' end")
    score = F.expr("case when conv_id % 5 <> 0 then double(conv_id % 3 * -900 + 1000) end")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *[c.alias(n) for n, c in predicting.asked_stats(q, gpa, test, score).items()])


@query("prediction_context", """with p as (select p_partkey, p_size / 100.0::double as p, p_size % 3 as k from part)
    select p_partkey, sha256(chr(10) || '[ML MODEL PREDICTION] Based on our admissions probability model:' || chr(10) || printf('- Estimated admission probability: %.0f%% (95%% CI: %.0f%%-%.0f%%)', round(p * 100), 1.0::double, 99.0::double) || chr(10)
        || '- Classification: ' || case when p >= 0.6 then 'SAFETY' when p >= 0.3 then 'MATCH' else 'REACH' end || ' school for this student' || chr(10) || printf('- School acceptance rate: %.1f%%', round(p * 100)) || chr(10)
        || case when k > 0 then '- Key factors:' || chr(10) || '  [' || case when k = 1 then '+' else '-' end || '] GPA' || chr(10) else '' end || '""" + predicting.GUIDANCE.replace("'", "''") + """') as digest from p""")
def prediction_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_size") / 100
    found = F.expr("case p_size % 3 when 1 then array(struct('positive' as impact, 'GPA' as detail)) when 2 then array(struct('negative' as impact, 'GPA' as detail)) else array() end")
    kind = F.when(p >= 0.6, "safety").when(p >= 0.3, "match").otherwise("reach")
    said = predicting.prediction_text(p, F.lit(0.01), F.lit(0.99), kind, p, found)
    return table(spark, sf_dir, "part").select("p_partkey", F.sha2(said, 256).alias("digest"))


#: What the boosted model of `boosted_chances` reads.
FEATURES = (
    "gpa", "sat_score", "sat_percentile_at_school", "gpa_vs_expected", "sat_zscore_at_school", "gpa_zscore_at_school", "gpa_x_acceptance", "selectivity_x_sat", "competitiveness_index", "gpa_x_competitiveness",
    "sat_x_competitiveness", "academic_composite_z", "holistic_signal", "sat_ratio", "school_encoding",
)


@query("boosted_chances")
def boosted_chances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request's chance by boosted trees fitted on the decided points, requests in error among them, with its place among all.

    The trees keep to the directions and groups of features that are fixed; the school's encoding is out of fold in
    training and over all points in predictions; a fifth of the schools, by hash, says when to stop.
    """
    fold = F.pmod(F.xxhash64("order_id", "line_no"), F.lit(5)).cast("int")
    names = list(FEATURES)
    known = written(training.training_set(points(spark, sf_dir), schools(spark, sf_dir), grades(spark, sf_dir)).select("order_id", "line_no", "school_id", "admitted", *names[:-1]))
    held = F.pmod(F.xxhash64("school_id"), F.lit(5)) == 0
    coded = written(training.out_of_fold(known, "school_id", "admitted", fold, 300.0).select(*names[:-1], F.col("encoding").alias("school_encoding"), "admitted", held.alias("held")))
    settings = boosting.Settings(trees=12, depth=4, rate=0.2, bins=32, patience=4)
    model = boosting.fit_boosted(coded, names, "admitted", held="held", settings=settings, monotone=predicting.monotone_vector(names), groups=predicting.interaction_groups(names))
    means = training.smoothed_means(known, "school_id", "admitted", 300.0).select("school_id", F.col("encoding").alias("school_encoding"))
    requests = _requests(spark, sf_dir).join(means, "school_id", "left")
    asked = requests.select("order_id", "line_no", "error", "given_gpa", *names)
    told = predicting.predictions(boosting.boosted_scores(model, asked)).select("order_id", "line_no", "error", "probability", "low", "high", "class")
    return predicting.compared(written(told), "order_id", "line_no")

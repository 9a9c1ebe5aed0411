"""Queries of the relational and feature pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import metrics, sampling, search, training
from ..operators.placing import placed
from ..storage import written
from .fixtures import CTES, grades, points, schools
from .registry import query, table


def _set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.training_set(points(spark, sf_dir), schools(spark, sf_dir), grades(spark, sf_dir))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _fine(df: DataFrame, *names: str) -> DataFrame:
    """Six digits by the same arithmetic as in the SQL: features of round numbers often end in a five at the seventh, which goes up."""
    return df.withColumns({n: F.floor(F.col(n) * 1e6 + 0.5001) / 1e6 for n in names})


@query("training_join", f"""with {CTES}
    select order_id, line_no, p.school_id, name, acceptance, overall_grade, niche_rank
    from points p join schools s using (school_id) left join grades g on g.school_id = p.school_id and not coalesce(no_data, false)""")
def training_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training.joined_points(points(spark, sf_dir), schools(spark, sf_dir), grades(spark, sf_dir))
    return rows.select("order_id", "line_no", "school_id", "name", "acceptance", "overall_grade", "niche_rank")


@query("outcome_filter_scores", f"with {CTES} select order_id, line_no, outcome, sat_score, act_score from scored")
def outcome_filter_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.with_scores(training.decided(points(spark, sf_dir))).select("order_id", "line_no", "outcome", "sat_score", "act_score")


@query("act_range_join", f"with {CTES} select order_id, line_no, act_score from scored where line_no not in (3, 6, 7)")
def act_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ACT of points with a SAT alone, by a join with the ranges of SAT scores."""
    rows = training.decided(points(spark, sf_dir)).where("sat_score is not null and act_score is null")
    sat = F.greatest(F.least(F.bround(F.col("sat_score") / 10) * 10, F.lit(1600.0)), F.lit(590.0))
    ranges = F.broadcast(scores.act_ranges(spark))
    found = rows.withColumn("x", sat).join(ranges, (F.col("x") >= F.col("low")) & (F.col("x") < F.col("high")))
    return found.select("order_id", "line_no", F.col("act").cast("double").alias("act_score"))


@query("gpa_normalize", f"with {CTES} select order_id, line_no, round(gpa, 6) as gpa, round(gpa_original, 6) as gpa_original, is_weighted from base")
def gpa_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training.with_gpa(training.with_scores(training.decided(points(spark, sf_dir))))
    return _rounded(rows.select("order_id", "line_no", "gpa", "gpa_original", "is_weighted"), "gpa", "gpa_original")


@query("school_mean_gpa", f"with {CTES} select school_id, round(school_gpa, 6) as school_gpa from means")
def school_mean_gpa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(training.school_means(training.with_gpa(training.with_scores(training.decided(points(spark, sf_dir))))), "school_gpa")


_ROWS = f"""with {CTES},
    stats as (select avg(gpa) as gm, stddev_samp(gpa) as gs, avg(sat_score) as sm, stddev_samp(sat_score) as ss from base where school_id in (select school_id from schools)),
    r0 as (select b.*, s.* exclude (school_id), m.school_gpa, sat75 - sat25 as width, coalesce(sat_avg, (sat25 + sat75) / 2) as middle, coalesce(acceptance, 0.5) as rate
        from base b join schools s using (school_id) left join means m using (school_id)),
    r1 as (select *, coalesce(school_gpa, 3 - least(greatest(rate, 0), 1)) as expected, case when sat_score is null or width = 0 then null else greatest(-1, least(2, (sat_score - sat25) / width)) end as position,
        case when width = 0 then 0 else coalesce((sat_score - middle) / (width / 1.35), 0) end as sat_z from r0),
    r2 as (select *, coalesce((gpa - expected) / 0.5, 0) as gpa_z, 0.4 * (1 - rate) + 0.35 * (coalesce(middle, 1000) - 800) / 800 + 0.25 * coalesce(graduation, 0.5) as idx,
        coalesce(greatest(sat_score - sat75, 0), 0) as over_sat, greatest(gpa - coalesce(school_gpa, 4), 0) as over_gpa,
        coalesce((sat_score < sat25)::int::double, 0) as below, case when test_requirements in (3, 5) then 1.0 when test_requirements in (1, 2) then 0.0 end::double as optional,
        case major when 'Computer Science' then 'stem_competitive' when 'Biology' then 'stem_standard' when 'Economics' then 'business' when 'History' then 'arts_humanities'
            when 'Basket Weaving' then 'other' end as tier from r1)"""


@query("features_fit", f"""{_ROWS}
    select order_id, line_no, floor((position) * 1e6::double + 0.5001) / 1e6::double as sat_percentile_at_school, floor((gpa - expected) * 1e6::double + 0.5001) / 1e6::double as gpa_vs_expected,
        case when acceptance is null then 'unknown' when acceptance < 0.15 then 'reach' when acceptance < 0.4 then 'competitive' when acceptance < 0.7 then 'match' else 'safety' end as selectivity_bucket,
        floor((sat_z) * 1e6::double + 0.5001) / 1e6::double as sat_zscore_at_school, floor((gpa_z) * 1e6::double + 0.5001) / 1e6::double as gpa_zscore_at_school, floor((over_sat / 100 + over_gpa) * 1e6::double + 0.5001) / 1e6::double as overqualification_index,
        floor((0.5 * greatest(-3, least(3, sat_z)) / 3 + 0.5 * greatest(-3, least(3, gpa_z)) / 3) * 1e6::double + 0.5001) / 1e6::double as academic_fit,
        floor((case when width > 0 then width / nullif(middle, 0) end) * 1e6::double + 0.5001) / 1e6::double as holistic_signal, case when width > 0 then width end as sat_range
    from r2""")
def features_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("sat_percentile_at_school", "gpa_vs_expected", "sat_zscore_at_school", "gpa_zscore_at_school", "overqualification_index", "academic_fit", "holistic_signal")
    return _fine(_set(spark, sf_dir).select("order_id", "line_no", "selectivity_bucket", "sat_range", *names), *names)


@query("features_interactions", f"""{_ROWS}
    select order_id, line_no, floor((gpa * rate) * 1e6::double + 0.5001) / 1e6::double as gpa_x_acceptance, floor((position * position) * 1e6::double + 0.5001) / 1e6::double as sat_percentile_sq, floor(((1 - rate) * position) * 1e6::double + 0.5001) / 1e6::double as selectivity_x_sat,
        floor((idx) * 1e6::double + 0.5001) / 1e6::double as competitiveness_index, floor((gpa * idx) * 1e6::double + 0.5001) / 1e6::double as gpa_x_competitiveness, floor((sat_z * idx) * 1e6::double + 0.5001) / 1e6::double as sat_x_competitiveness,
        (residency = 'inState')::int::double * coalesce((ownership = 1)::int::double, 0) as instate_x_public, floor(((residency = 'inState')::int::double * rate) * 1e6::double + 0.5001) / 1e6::double as residency_x_acceptance,
        over_sat as sat_excess, floor((over_gpa) * 1e6::double + 0.5001) / 1e6::double as gpa_excess, floor((coalesce(sat_score / nullif(middle, 0), 1)) * 1e6::double + 0.5001) / 1e6::double as sat_ratio, floor(((tier = 'stem_competitive')::int::double * rate) * 1e6::double + 0.5001) / 1e6::double as stem_competitive_x_acceptance
    from r2""")
def features_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = (
        "gpa_x_acceptance", "sat_percentile_sq", "selectivity_x_sat", "competitiveness_index", "gpa_x_competitiveness", "sat_x_competitiveness",
        "residency_x_acceptance", "gpa_excess", "sat_ratio", "stem_competitive_x_acceptance",
    )
    return _fine(_set(spark, sf_dir).select("order_id", "line_no", "instate_x_public", "sat_excess", *names), *names)


@query("features_policy", f"""{_ROWS}
    select order_id, line_no, 0::double as is_yield_protector, tier as major_tier, coalesce((sat_score > sat75)::int::double, 0) as sat_above_75th, below as sat_below_25th, optional as is_test_optional,
        floor((optional * sat_z) * 1e6::double + 0.5001) / 1e6::double as test_optional_x_sat_z, (1 - optional) * below as test_required_x_sat_below_25th, floor((optional * gpa_z) * 1e6::double + 0.5001) / 1e6::double as test_optional_x_gpa_zscore
    from r2""")
def features_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("test_optional_x_sat_z", "test_optional_x_gpa_zscore")
    plain = ("is_yield_protector", "major_tier", "sat_above_75th", "sat_below_25th", "is_test_optional", "test_required_x_sat_below_25th")
    return _fine(_set(spark, sf_dir).select("order_id", "line_no", *plain, *names), *names)


@query("z_composite", f"""{_ROWS} select order_id, line_no, round(((gpa - gm) / case when gs > 0 then gs else 1 end + (sat_score - sm) / case when ss > 0 then ss else 1 end) / 2, 6) as academic_composite_z from r2, stats""")
def z_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_set(spark, sf_dir).select("order_id", "line_no", "academic_composite_z"), "academic_composite_z")


@query("selectivity_buckets", f"""with {CTES} select case when acceptance is null then 'unknown' when acceptance < 0.15 then 'reach' when acceptance < 0.4 then 'competitive'
    when acceptance < 0.7 then 'match' else 'safety' end as bucket, count(*) as n from schools group by 1""")
def selectivity_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schools(spark, sf_dir).groupBy(scores.selectivity(F.col("acceptance")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("stats_by_source", "select o_orderpriority as source, o_orderstatus as outcome, count(*) as n from orders group by all")
def stats_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("top10_groups", "select p_name as name, p_partkey as school_id, count(*) as n from lineitem join part on p_partkey = l_partkey group by all order by n desc, name, school_id limit 10")
def top10_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = points(spark, sf_dir).groupBy("school_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(schools(spark, sf_dir).select("school_id", "name"), "school_id").orderBy(F.desc("n"), "name", "school_id").limit(10)


@query("coverage_rates", f"""with {CTES} select count(distinct p.school_id) as schools, round(avg((overall_grade is not null)::int), 6) as graded, round(avg((sat_score is not null)::int), 6) as with_sat,
    round(avg((act_score is not null)::int), 6) as with_act from points p left join grades g on g.school_id = p.school_id and not no_data""")
def coverage_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training.joined_points(points(spark, sf_dir), schools(spark, sf_dir), grades(spark, sf_dir))
    share = {"graded": "overall_grade", "with_sat": "sat_score", "with_act": "act_score"}
    return rows.agg(F.countDistinct("school_id").alias("schools"), *[F.round(F.avg(F.col(c).isNotNull().cast("int")), 6).alias(n) for n, c in share.items()])


@query("target_encoding_full", f"""with {CTES}, g as (select avg((outcome = 'accepted')::int) as m from base)
    select school_id, count(*) as n, round((sum((outcome = 'accepted')::int) + 300 * (select m from g)) / (count(*) + 300), 6) as encoding from base group by school_id""")
def target_encoding_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training.with_gpa(training.with_scores(training.decided(points(spark, sf_dir)))).withColumn("admitted", (F.col("outcome") == "accepted").cast("int"))
    return _rounded(training.smoothed_means(rows, "school_id", "admitted", 300.0), "encoding")


@query("target_encoding_oof", f"""with {CTES}, t as (select order_id, line_no, coalesce(major, '') as major, order_id % 5 as fold, (outcome = 'accepted')::int as y from base),
    c as (select major, fold, sum(y) as s, count(*) as n from t group by all), f as (select fold, sum(s) as s, sum(n) as n from c group by fold),
    m as (select fold, ((select sum(s) from c) - s) / ((select sum(n) from c) - n) as m from f),
    e as (select c.major, c.fold, sum(c.s) over (partition by c.major) - c.s as os, sum(c.n) over (partition by c.major) - c.n as os_n, m.m from c join m using (fold))
    select order_id, line_no, t.fold, round(case when os_n > 0 then (os + 100 * m) / (os_n + 100) else m end, 6) as encoding from t join e using (major, fold)""")
def target_encoding_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training.with_gpa(training.with_scores(training.decided(points(spark, sf_dir))))
    rows = rows.select("order_id", "line_no", F.coalesce("major", F.lit("")).alias("major"), (F.col("outcome") == "accepted").cast("int").alias("y"))
    out = training.out_of_fold(rows, "major", "y", F.col("order_id") % 5, 100.0)
    return _rounded(out.select("order_id", "line_no", "fold", "encoding"), "encoding")


@query("median_impute", f"""with {CTES} select order_id, line_no, coalesce(sat_score, (select median(sat_score) from points)) as sat_score, coalesce(act_score, (select median(act_score) from points)) as act_score from points""")
def median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir)
    return training.median_imputed(rows, ["sat_score", "act_score"]).select("order_id", "line_no", "sat_score", "act_score")


@query("category_codes", "select p_partkey as school_id, (select count(distinct p_type) from part q where q.p_type < p.p_type) as code from part p")
def category_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = schools(spark, sf_dir).select("school_id", "kind")
    return training.category_codes(rows, "kind", "code").select("school_id", "code")


@query("sample_weights", f"""with {CTES}, n as (select school_id, count(*) as n from base group by school_id), w as (select sum(sqrt(n)) / sum(n) as m from n)
    select order_id, line_no, round(1 / sqrt(n) / (select m from w), 6) as weight from base join n using (school_id)""")
def sample_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training.with_gpa(training.with_scores(training.decided(points(spark, sf_dir))))
    return _rounded(training.sample_weights(rows, "school_id").select("order_id", "line_no", "weight"), "weight")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a probability that follows from the document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", "lang", F.col("quality").alias("y"), (((F.col("n_chars") * 7 + F.col("doc_id")) % 1000) / 1000).alias("p"))


_SCORED = "scored as (select doc_id, lang, quality as y, ((n_chars * 7 + doc_id) % 1000) / 1000.0::double as p from labels join documents using (doc_id))"


@query("ece_bins", f"with {_SCORED} select floor(p * 10)::int as bin, count(*) as n, round(avg(p), 6) as mean_p, round(avg(y), 6) as rate from scored where p < 1 group by 1")
def ece_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.calibration_bins(_scored(spark, sf_dir), "p", "y"), "mean_p", "rate")


_LOSSES = """count(*) as n, round(avg((p - y) * (p - y)), 6) as brier, round(avg(y), 6) as base, round(avg(-(y * ln(greatest(least(p, 1 - 1e-15), 1e-15)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-15), 1e-15)))), 6) as log_loss,
    round(1 - avg((p - y) * (p - y)) / nullif(avg(y) * (1 - avg(y)), 0), 6) as brier_skill from scored"""


@query("brier_logloss", f"with {_SCORED} select {_LOSSES}")
def brier_logloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.losses(_scored(spark, sf_dir), "p", "y"), "brier", "base", "log_loss", "brier_skill")


@query("metrics_by_bucket", f"with {_SCORED} select lang, {_LOSSES} group by lang")
def metrics_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.losses(_scored(spark, sf_dir), "p", "y", "lang"), "brier", "base", "log_loss", "brier_skill")


@query("auc_rank", f"""with {_SCORED}, r as (select y, (rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0)::double as r from scored)
    select count(*) as n, sum(y)::bigint as positives, round((sum(r) filter (where y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y)))::double, 6) as auc from r""")
def auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.auc(_scored(spark, sf_dir), "p", "y"), "auc")


@query("confusion", f"with {_SCORED} select y as actual, (p >= 0.5)::int as predicted, count(*) as n from scored group by all")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_scored(spark, sf_dir), "p", "y")


@query("pareto_pick", "select min_by(p_partkey, (p_size, p_partkey)) as p_partkey, min(p_size) as p_size from part where p_retailprice <= (select median(p_retailprice) from part)")
def pareto_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pareto_pick(table(spark, sf_dir, "part"), "p_retailprice", "p_size", "p_partkey")


@query("wilson_ci", """with q as (select doc_id, ((n_chars * 7 + doc_id) % 1000) / 1000.0::double as p from documents),
    w as (select *, (p + 3.8416 / 200) / (1 + 3.8416 / 100) as c, 1.96 * sqrt(p * (1 - p) / 100 + 3.8416 / 40000) / (1 + 3.8416 / 100) as s from q)
    select doc_id, round(greatest(0.01, least(0.99, c - s)), 6) as low, round(greatest(0.01, least(0.99, c + s)), 6) as high, case when p >= 0.6 then 'safety' when p >= 0.3 then 'match' else 'reach' end as class from w""")
def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ((F.col("n_chars") * 7 + F.col("doc_id")) % 1000) / 1000
    low, high = scores.wilson(p)
    return table(spark, sf_dir, "documents").select("doc_id", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), scores.chance_class(p).alias("class"))


@query("focal_grad", """with q as (select doc_id, toxic as y, (doc_id % 41 - 20) / 5.0::double as x from labels), s as (select *, greatest(1e-7, least(1 - 1e-7, 1 / (1 + exp(-x)))) as p from q),
    t as (select *, case when y = 1 then p else 1 - p end as pt, case when y = 1 then 0.25 else 0.75 end::double as w, case when y = 1 then 1 else -1 end as sg from s)
    select doc_id, round(-w * (1 - pt) ** 2 * ln(pt), 6) as loss, round(sg * w * (1 - pt) ** 2 * (2 * pt * ln(pt) - (1 - pt)), 6) as gradient from t""")
def focal_grad(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss, gradient = scores.focal_terms((F.col("doc_id") % 41 - 20) / 5, F.col("toxic"))
    return table(spark, sf_dir, "labels").select("doc_id", F.round(loss, 6).alias("loss"), F.round(gradient, 6).alias("gradient"))


@query("focal_objective", """with q as (select doc_id, toxic as y, (doc_id % 41 - 20) / 5.0::double as x from labels), s as (select *, greatest(1e-7, least(1 - 1e-7, 1 / (1 + exp(-x)))) as p from q),
    t as (select *, case when y = 1 then p else 1 - p end as pt, case when y = 1 then 1 else -1 end as sg from s), u as (select *, (1 - pt) ** 2 as f, case when y = 1 then 0.25 else 0.75 end::double * (1 - pt) ** 2 as w from t)
    select doc_id, round(w * (2 * (1 - pt) * pt * ln(pt) * sg + f * (p - y)), 6) as gradient, round(greatest(w * f * p * (1 - p), 1e-7), 6) as hessian from u""")
def focal_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    gradient, hessian = scores.focal_objective((F.col("doc_id") % 41 - 20) / 5, F.col("toxic"))
    return table(spark, sf_dir, "labels").select("doc_id", F.round(gradient, 6).alias("gradient"), F.round(hessian, 6).alias("hessian"))


@query("compare_schools", f"""with {CTES}, x as (select school_id, name, acceptance, sat25, sat75, greatest(0.01, least(0.99, coalesce(acceptance, 0.5) * 0.8 + 0.1)) as p from schools)
    select school_id, name, round(p, 4) as probability, case when p >= 0.6 then 'safety' when p >= 0.3 then 'match' else 'reach' end as class, row_number() over (order by p desc, school_id) as place,
        case when sat75 > sat25 and (1250 - sat25) / (sat75 - sat25) > 0.75 then 'sat above most admitted' when sat75 > sat25 and (1250 - sat25) / (sat75 - sat25) < 0.25 then 'sat below most admitted' end as factor from x""")
def compare_schools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One applicant (SAT 1250) against all schools, by chance."""
    p = scores.clamp(F.coalesce("acceptance", F.lit(0.5)) * 0.8 + 0.1, 0.01, 0.99)
    at = F.try_divide(1250 - F.col("sat25"), F.col("sat75") - F.col("sat25"))
    rows = placed(schools(spark, sf_dir).withColumn("p", p), F.desc("p"), "school_id")
    factor = F.when(at > 0.75, "sat above most admitted").when(at < 0.25, "sat below most admitted")
    return rows.select("school_id", "name", F.round("p", 4).alias("probability"), scores.chance_class(F.col("p")).alias("class"), "place", factor.alias("factor"))


@query("leakage_check", f"with {CTES} select count(distinct school_id) as schools, count(*) as points, 0::bigint as shared, true as strata_even from points")
def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the grouped, stratified split: schools, points, schools in two parts, and whether each part's share of accepted points is within a tenth of the whole's."""
    split = training.stratified_split(points(spark, sf_dir), "school_id", (F.col("outcome") == "accepted").cast("int"))
    sides = split.groupBy("school_id").agg(F.countDistinct("part").alias("parts"), F.count(F.lit(1)).alias("n"))
    parts = split.groupBy("part").agg(F.avg((F.col("outcome") == "accepted").cast("int")).alias("rate"), F.count(F.lit(1)).alias("n"))
    even = parts.agg(F.max(F.col("rate")) - F.min(F.col("rate")) < 0.1)
    return sides.agg(F.count(F.lit(1)).alias("schools"), F.sum("n").alias("points"), F.sum((F.col("parts") > 1).cast("long")).alias("shared")).withColumn("strata_even", even.scalar())


@query("price_front", """with x as (select l_extendedprice as a, -l_quantity as b, l_orderkey, l_linenumber from lineitem),
    d as (select a, min(b) as b from x group by a), f as (select a, b from (select a, b, min(b) over (order by a rows between unbounded preceding and 1 preceding) as before from d) where before is null or b < before),
    c as (select a, b, lag(a) over w as a0, lag(b) over w as b0, lead(a) over w as a1, lead(b) over w as b1, max(a) over () - min(a) over () as wide, max(b) over () - min(b) over () as high from f window w as (order by a))
    select l_orderkey, l_linenumber, a as price, -b as quantity, case when a0 is null or a1 is null then -1 else round((a1 - a0) / wide + (b0 - b1) / high, 6) end as crowding from x join c using (a, b)""")
def price_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that no other line beats in both price and quantity, with how far apart each one's neighbours on the front are; -1 at both ends."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"), (-F.col("l_quantity")).alias("less"))
    best = written(search.front(rows, "price", "less"))
    joined = best.join(search.crowding(best, "price", "less"), ["price", "less"])
    return joined.select("l_orderkey", "l_linenumber", "price", (-F.col("less")).alias("quantity"), F.when(F.col("crowding") == float("inf"), -1.0).otherwise(F.round("crowding", 6)).alias("crowding"))


@query("sample_by_group", "select l_suppkey, l_orderkey, l_linenumber, row_number() over (partition by l_suppkey order by md5('42:' || l_orderkey || ':' || l_linenumber), l_orderkey, l_linenumber) as turn from lineitem qualify turn <= 5")
def sample_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five lines of every supplier, drawn by seed."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    return sampling.sampled_by(rows, "l_suppkey", 5, "l_orderkey", "l_linenumber")


@query("shuffled_orders", "select o_orderkey, row_number() over (order by md5('42:' || o_orderkey), o_orderkey) as place from orders")
def shuffled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders in a seeded order."""
    return sampling.shuffled(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")

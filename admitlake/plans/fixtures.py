"""The tables at hand as schools, grades and applicant points; CTES says the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import spread, table

_MAJORS = ("Computer Science", "Biology", "Economics", "History", "Basket Weaving", "", None)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applicant points out of lineitem."""
    t = spread(table(spark, sf_dir, "lineitem"), "l_orderkey")
    c = F.col
    major = F.when(c("l_suppkey") % 7 == 0, _MAJORS[0])
    for k, m in enumerate(_MAJORS[1:-1], 1):
        major = major.when(c("l_suppkey") % 7 == k, m)
    return t.select(
        c("l_orderkey").alias("order_id"), c("l_linenumber").alias("line_no"), c("l_partkey").alias("school_id"), (c("l_quantity") / 11).alias("gpa"),
        F.when(~c("l_linenumber").isin(6, 7), (400 + F.floor(c("l_extendedprice") / 100) % 1201).cast("double")).alias("sat_score"),
        F.when(c("l_linenumber").isin(3, 6), (9 + c("l_suppkey") % 28).cast("double")).alias("act_score"),
        F.when(c("l_returnflag") == "A", "accepted").when(c("l_returnflag") == "R", "rejected").otherwise("waitlisted").alias("outcome"),
        F.when(c("l_linestatus") == "O", "inState").otherwise("outOfState").alias("residency"), major.alias("major"),
    )


def schools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schools out of part."""
    t = table(spark, sf_dir, "part")
    c = F.col
    low = (800 + 8 * c("p_size")).cast("double")
    high = low + (c("p_partkey") % 5) * 60
    return t.select(
        c("p_partkey").alias("school_id"), c("p_name").alias("name"), c("p_type").alias("kind"), F.when(c("p_partkey") % 13 != 0, c("p_size") / 50).alias("acceptance"),
        low.alias("sat25"), high.alias("sat75"), F.when(c("p_partkey") % 7 != 0, (low + high) / 2 + (c("p_partkey") % 3) * 10).alias("sat_avg"),
        F.when(c("p_partkey") % 11 != 0, 0.3 + (c("p_partkey") % 7) / 10).alias("graduation"), (1 + c("p_partkey") % 3).alias("ownership"),
        F.when(c("p_partkey") % 6 != 0, c("p_partkey") % 6).alias("test_requirements"), c("p_retailprice").alias("size"),
    )


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades out of supplier: few schools have any, and some only a tombstone."""
    t = table(spark, sf_dir, "supplier")
    letters = F.array(*map(F.lit, ("A+", "A", "A-", "B+", "B", "B-", "C+", "C", "C-", "D+", "D", "D-", "F")))
    return t.select(F.col("s_suppkey").alias("school_id"), F.element_at(letters, (F.col("s_nationkey") % 13 + 1).cast("int")).alias("overall_grade"), F.col("s_suppkey").alias("niche_rank"), (F.col("s_acctbal") < 0).alias("no_data"))


CTES = """
    points as (
        select l_orderkey as order_id, l_linenumber as line_no, l_partkey as school_id, l_quantity / 11 as gpa,
            case when l_linenumber not in (6, 7) then (400 + floor(l_extendedprice / 100)::bigint % 1201)::double end as sat_score,
            case when l_linenumber in (3, 6) then (9 + l_suppkey % 28)::double end as act_score,
            case l_returnflag when 'A' then 'accepted' when 'R' then 'rejected' else 'waitlisted' end as outcome,
            case when l_linestatus = 'O' then 'inState' else 'outOfState' end as residency,
            case l_suppkey % 7 when 0 then 'Computer Science' when 1 then 'Biology' when 2 then 'Economics' when 3 then 'History' when 4 then 'Basket Weaving' when 5 then '' end as major
        from lineitem),
    schools as (
        select *, case when school_id % 7 <> 0 then (sat25 + sat75) / 2 + (school_id % 3) * 10 end as sat_avg
        from (select p_partkey as school_id, p_name as name, p_type as kind, case when p_partkey % 13 <> 0 then p_size / 50.0::double end as acceptance,
            (800 + 8 * p_size)::double as sat25, (800 + 8 * p_size + (p_partkey % 5) * 60)::double as sat75,
            case when p_partkey % 11 <> 0 then 0.3::double + (p_partkey % 7) / 10.0::double end as graduation, 1 + p_partkey % 3 as ownership,
            case when p_partkey % 6 <> 0 then p_partkey % 6 end as test_requirements, p_retailprice as size from part)),
    grades as (
        select s_suppkey as school_id, (['A+', 'A', 'A-', 'B+', 'B', 'B-', 'C+', 'C', 'C-', 'D+', 'D', 'D-', 'F'])[s_nationkey % 13 + 1] as overall_grade,
            s_suppkey as niche_rank, s_acctbal < 0 as no_data from supplier),
    act_table as (select unnest(range(36, 8, -1)) as act, unnest([1590, 1540, 1500, 1460, 1430, 1400, 1370, 1340, 1310, 1280, 1240, 1210, 1180, 1140,
        1110, 1080, 1040, 1010, 970, 930, 890, 850, 800, 760, 710, 670, 630, 590]) as sat),
    scored as (
        select p.* exclude (sat_score, act_score), coalesce(p.sat_score, a.sat::double) as sat_score,
            coalesce(p.act_score, case when p.sat_score is not null then
                case when greatest(590, least(1600, round_even(p.sat_score / 10, 0) * 10)) = 1600 then 36
                else (select max(act) from act_table t where t.sat <= greatest(590, least(1600, round_even(p.sat_score / 10, 0) * 10))) end end)::double as act_score
        from points p left join act_table a on a.act = greatest(9, least(36, round_even(p.act_score, 0)))
        where p.outcome in ('accepted', 'rejected') and (p.sat_score is not null or p.act_score is not null)),
    base as (select * exclude (gpa), least(gpa, 4) as gpa, gpa as gpa_original, gpa > 4 as is_weighted from scored where gpa > 0),
    means as (select school_id, avg(gpa) as school_gpa from base where outcome = 'accepted' group by school_id)"""

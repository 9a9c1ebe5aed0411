"""Queries of corpus upkeep, of lists and dimensions, and of what profile pages say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import routing, text, urls
from ..functions.scores import GRADE_POINTS, grade_ordinal, lookup, proxy_score
from ..operators import entities, maintenance, metrics, upkeep
from ..sources import grades, nested
from ..storage import tasks_for
from .corpus import _HOST, _KEY
from .registry import query, spread, table


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as records of a store: college, url (some blank), digest, time, id."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('college ', l_suppkey) as college", "case when l_partkey % 17 <> 0 then concat('u', l_partkey) end as url", "string(l_linenumber % 3) as digest", "l_shipdate as crawled_at", "l_orderkey * 10 + l_linenumber as id"
    )


_RECORDS = "records as (select 'college ' || l_suppkey as college, case when l_partkey % 17 <> 0 then 'u' || l_partkey end as url, (l_linenumber % 3)::varchar as digest, l_shipdate as crawled_at, l_orderkey * 10 + l_linenumber as id from lineitem)"


@query("duplicate_report", f"""with {_RECORDS}, e as (select college, coalesce(url, '') as url, digest, count(*) as n from records group by all), u as (select college, url, sum(n) as n, sum(n - 1) as extra from e group by all)
    select college, sum(n)::bigint as total, count(*) filter (where extra > 0) as urls_with_duplicates, sum(extra)::bigint as duplicates, count(*) as unique_urls from u group by college""")
def duplicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.duplicate_report(_records(spark, sf_dir), "college", "url", "digest")


@query("duplicates_listed", f"with {_RECORDS}, e as (select url, digest, count(*) as n from records where url is not null group by all) select url, sum(n - 1)::bigint as duplicates from e group by url having sum(n - 1) > 0")
def duplicates_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All addresses with repeated rows."""
    return upkeep.duplicates_by_url(_records(spark, sf_dir).where("url is not null"), "url", "digest")


@query("delete_duplicates", f"""with {_RECORDS}, d as (select distinct on (college, url, digest) id from records order by college, url, digest, crawled_at desc, id desc), k as (select * from records where id in (select id from d)),
    e as (select college, coalesce(url, '') as url, digest, count(*) as n from k group by all) select college, sum(n)::bigint as final_count, count(distinct url) as unique_urls, (sum(n - 1) > 10000)::boolean as too_many from e group by college""")
def delete_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store holds after its duplicates are deleted, the newest of each kept. (Ids repeat in this fixture, so a kept id may stand more than once.)"""
    rows, keys = _records(spark, sf_dir), ["college", "url", "digest"]
    tasks = tasks_for(rows)
    newest = maintenance.kept_best(rows.repartition(tasks, *keys), keys, ["crawled_at", "id"])
    kept = rows.repartition(tasks, "id").join(newest.select("id").repartition(tasks, "id"), "id", "left_semi")
    report = upkeep.duplicate_report(kept, "college", "url", "digest")
    return report.select("college", F.col("total").alias("final_count"), "unique_urls", (F.col("duplicates") > 10000).alias("too_many"))


@query("delete_url", "select l_orderkey, l_linenumber from lineitem where l_partkey not in (select p_partkey from part where p_size = 7)")
def delete_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of some addresses go as a unit."""
    gone = table(spark, sf_dir, "part").where("p_size = 7").select(F.col("p_partkey").alias("l_partkey"))
    return upkeep.without_groups(table(spark, sf_dir, "lineitem"), "l_partkey", gone).select("l_orderkey", "l_linenumber")


@query("delete_foreign", f"select page_id from (select page_id, case when page_id % 10 <> 0 then {_HOST} end as h from pages) where h is not null and not h like '%.org'")
def delete_foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to delete: on hosts that do not end as wanted; every tenth address is blank here and stays."""
    host = F.when(F.col("page_id") % 10 != 0, urls.host(F.col("url")))
    return upkeep.foreign_rows(table(spark, sf_dir, "pages"), host, ".org").select("page_id")


@query("rename_values", "with m as (select n_name as old, min(n_name || ' X') as new from nation where n_nationkey % 3 = 0 group by 1) select c_custkey, coalesce(new, n_name) as name from customer join nation on n_nationkey = c_nationkey left join m on old = n_name")
def rename_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    pairs = nation.where("n_nationkey % 3 = 0").selectExpr("n_name as old", "concat(n_name, ' X') as new").union(nation.selectExpr("n_name", "n_name")).union(nation.selectExpr("n_name", "' '"))
    rows = table(spark, sf_dir, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).selectExpr("c_custkey", "n_name as name")
    return upkeep.renamed_values(rows, "name", pairs)


@query("name_index", "select k as key, max(p_partkey) as p_partkey from (select lower(p_type) as k, p_partkey from part) group by k")
def name_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised names with the id that is written last, the highest."""
    return upkeep.last_by_key(table(spark, sf_dir, "part"), text.normalized_name(F.col("p_type")), "p_partkey", F.col("p_partkey"))


@query("slug_index", "select replace(lower(p_name), ' ', '-') as key, arg_min(p_partkey, (p_size, p_partkey)) as p_partkey from part group by 1")
def slug_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs with their smallest school: written in the order of size, the largest first, the last one stays."""
    return upkeep.last_by_key(table(spark, sf_dir, "part"), text.slug(F.col("p_name")), "p_partkey", F.desc("p_size"), F.desc("p_partkey"))


@query("stripped_index", "select trim(regexp_replace(regexp_replace(p_brand || '/' || p_type, '[^a-zA-Z0-9 ]+', ' ', 'g'), ' {2,}', ' ', 'g')) as key, min(p_brand || '/' || p_type) as name from part group by 1")
def stripped_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("name")).distinct()
    return names.groupBy(entities.without_punctuation(F.col("name")).alias("key")).agg(F.min("name").alias("name"))


@query("batch_fetch", "select p_name as name, p_partkey, p_size from part join (select lower(p_name) as k, min(p_partkey) as id from part group by 1) on k = lower(p_name) and id = p_partkey union select upper(p_name), p_partkey, p_size from part where p_partkey in (select min(p_partkey) from part group by lower(p_name))")
def batch_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in two spellings resolved to one id, whose facts come back under both."""
    part = table(spark, sf_dir, "part")
    first = part.groupBy(F.lower("p_name").alias("k")).agg(F.min("p_partkey").alias("p_partkey"))
    wanted = part.select(F.col("p_name").alias("name")).union(part.select(F.upper("p_name"))).distinct()
    index = wanted.withColumn("k", F.lower("name")).join(first, "k").select("name", "p_partkey")
    return upkeep.fanned_out(wanted, index, part.select("p_partkey", "p_size"), "p_partkey").select("name", "p_partkey", "p_size")


@query("alias_merge", """with l as (select * from part where p_partkey % 5 <> 0 order by p_size desc, p_name || ' ' || p_partkey limit 1000), d as (select lower(trim(alias)) as alias, name, s from (select p_name || ' ' || p_partkey as name, p_size as s, unnest(string_split(p_name || ', ' || p_brand, ',')) as alias from l)),
    db as (select alias, arg_min(name, (-s, name)) as name from d group by alias), f as (select lower(n_name) as alias, 'flag ' || n_nationkey as name from nation union all select lower(p_brand), 'brand' from part where p_size = 3)
    select alias, min(name) as name from (select * from f union all select * from db where alias not in (select alias from f)) group by alias""")
def alias_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed aliases before those of the thousand largest schools."""
    part, nation = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation")
    schools = part.where("p_partkey % 5 <> 0").selectExpr("concat(p_name, ' ', p_partkey) as name", "concat(p_name, ', ', p_brand) as aliases", "double(p_size) as size")
    fixed = nation.selectExpr("n_name as alias", "concat('flag ', n_nationkey) as name").union(part.where("p_size = 3").selectExpr("p_brand", "'brand'"))
    return entities.merged_aliases(fixed, entities.listed_aliases(schools))


@query("majority_value", "select source, arg_min(lang, (-n, lang)) as lang, max(n) as n from (select source, lang, count(*) as n from documents where lang is not null group by all) group by source")
def majority_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.majority(table(spark, sf_dir, "documents"), "source", "lang")


@query("schema_migrate", "select c_custkey as school_id, c_name as name, null::double as net_price, null::varchar as alias from customer")
def schema_migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    def step(df: DataFrame) -> DataFrame:
        return upkeep.migrated(df, {"c_custkey": "school_id", "c_name": "name"}, {"net_price": "double", "alias": "string"}, ("c_nationkey", "c_acctbal", "c_mktsegment"))

    return step(step(table(spark, sf_dir, "customer")))


@query("frontier_links", "select distinct 'n' || (o_orderkey % 997) as url from orders where o_orderkey % 997 not in (select c_custkey % 997 from customer where c_custkey % 2 = 0) and o_orderkey % 997 not in (select s_suppkey from supplier) and o_orderkey % 997 not in (select p_partkey from part where p_size = 1)")
def frontier_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that are neither stored nor crawled nor discovered."""
    def named(name: str, key: str, where: str = "true") -> DataFrame:
        return table(spark, sf_dir, name).where(where).selectExpr(f"concat('n', {key}) as url")

    return upkeep.new_links(named("orders", "o_orderkey % 997"), named("customer", "c_custkey % 997", "c_custkey % 2 = 0"), named("supplier", "s_suppkey"), named("part", "p_partkey", "p_size = 1"))


@query("crawl_counters", "select count(*) filter (where event_type = 'view') as viewed, count(*) filter (where event_type = 'error') as errors, count(*) filter (where value > 100) as large, count(*) filter (where event_type = 'error' and value > 100) as large_errors from events")
def crawl_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    return upkeep.tallied(table(spark, sf_dir, "events"), viewed=kind == "view", errors=kind == "error", large=value > 100, large_errors=(kind == "error") & (value > 100))


@query("evaluation_rates", "select count(*) as n, round(avg((quality = toxic)::int), 6) as agreement, round(avg(case when doc_id % 3 <> 0 then (quality = 1)::int end), 6) as good from labels")
def evaluation_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = upkeep.accuracies(table(spark, sf_dir, "labels"), agreement=F.col("quality") == F.col("toxic"), good=F.when(F.col("doc_id") % 3 != 0, F.col("quality") == 1))
    return found.withColumns({c: F.round(c, 6) for c in ("agreement", "good")})


@query("seed_list", "select p_name || ' ' || p_partkey as name, p_brand as url from part where p_partkey % 6 <> 0 and trim(p_brand) <> '' order by p_retailprice desc, p_partkey limit 1000")
def seed_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thousand largest schools that have an address."""
    rows = table(spark, sf_dir, "part").where("p_partkey % 6 <> 0 and trim(p_brand) <> ''")
    return upkeep.newest_first(rows, [F.desc_nulls_last("p_retailprice"), F.col("p_partkey")], 1000).selectExpr("concat(p_name, ' ', p_partkey) as name", "p_brand as url")


@query("option_search", "select distinct p_name || ' ' || p_size as name from part where contains(lower(p_name || ' ' || p_size), 'idge') and p_name || ' ' || p_size not in (select p_name || ' ' || p_size from part where p_partkey < 5) order by lower(name), name limit 100")
def option_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").selectExpr("concat(p_name, ' ', p_size) as name", "p_partkey")
    return upkeep.options(names, "IDGE", names.where("p_partkey < 5"))


@query("rechunk_sets", "select p_partkey from part where p_size % 2 = 0 except select p_partkey from part where p_size % 3 = 0")
def rechunk_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that are stored and need no new chunks."""
    part = table(spark, sf_dir, "part")
    return part.where("p_size % 2 = 0").select("p_partkey").exceptAll(part.where("p_size % 3 = 0").select("p_partkey")).distinct()


@query("proxy_pool", """with s as (select user_id, event_type, count(*) filter (where value > 50) as good, count(*) as n, avg(value) as latency from events group by all), p as (select *, round(coalesce(good / nullif(n, 0)::double, 0.5) - coalesce(latency, 500) / 5000, 9) as score from s)
    select user_id, event_type, score from (select *, row_number() over (partition by user_id order by score desc, event_type) as r from p) where r <= 3""")
def proxy_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user the three kinds with the best score, as proxies are chosen."""
    stats = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.sum((F.col("value") > 50).cast("long")).alias("good"), F.count(F.lit(1)).alias("n"), F.avg("value").alias("latency"))
    scored = stats.select("user_id", "event_type", F.round(proxy_score(F.col("good"), F.col("n"), F.col("latency")), 9).alias("score"))
    place = F.row_number().over(upkeep.Window.partitionBy("user_id").orderBy(F.desc("score"), "event_type"))
    return scored.withColumn("r", place).where("r <= 3").drop("r")


@query("rate_limit", """with e as (select event_id, user_id, floor(epoch(ts))::bigint as t from events), k as (select *, row_number() over (partition by user_id order by t, event_id) - 1 as k from e)
    select event_id, max(t - k * 900.0::double) over (partition by user_id order by t, event_id rows unbounded preceding) + k * 900.0::double as start from k""")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each event may start if a user's events start at least 900 seconds apart."""
    log = table(spark, sf_dir, "events").select("event_id", "user_id", F.floor(F.col("ts").cast("timestamp").cast("double")).alias("at"))
    return upkeep.paced(log, "user_id", "at", "event_id", 900.0).select("event_id", "start")


@query("conversation_store", "select conv_id, last, turns from (select conv_id, max(turn) as last, least(count(*), 4) as turns from conversations group by conv_id) order by last desc, conv_id limit 50")
def conversation_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty conversations that went on longest, each with its last four messages counted (the store's stated sizes)."""
    kept = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last"), F.least(F.count(F.lit(1)), F.lit(4)).alias("turns"))
    return upkeep.newest_first(kept, [F.desc("last"), F.col("conv_id")], 50)


@query("backoff_waits", "select event_id, 2.0::double ** a as page, 0.5::double * 2.0::double ** a as database, least(300.0::double, 30.0::double * a) as host, least(300.0::double, 20.0::double * a) as render from (select event_id, event_id % 12 as a from events)")
def backoff_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempt = (F.col("event_id") % 12).cast("double")
    return table(spark, sf_dir, "events").select("event_id", *[routing.backoff(k, attempt).alias(k) for k in ("page", "database", "host", "render")])


@query("content_types", "select event_type, count(*) as n, count(*) filter (where event_id % 3 = 0) as pages from events group by 1")
def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("case event_id % 3 when 0 then ' Text/HTML; charset=utf-8' when 1 then 'application/pdf' end")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(routing.is_page(kind), F.lit(False))).alias("pages"))


@query("grade_scales", "select p_partkey, g as grade, case g " + " ".join(f"when '{g}' then {12 - k}" for k, g in enumerate(GRADE_POINTS)) + " end::double as ordinal, case g " + " ".join(f"when '{g}' then {p}" for g, p in GRADE_POINTS.items())
    + " end::double as points, regexp_full_match(g, '[A-F][+-]?') as letter, case when p_size % 4 <> 0 then 600 + p_size end as composite from (select p_partkey, p_size, (['A+', 'A', 'A-', 'B+', 'B', 'B-', 'C+', 'C', 'C-', 'D+', 'D', 'D-', 'F', 'E', 'a'])[p_partkey % 15 + 1] as g from part)")
def grade_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter = F.element_at(F.array(*[F.lit(g) for g in (*GRADE_POINTS, "E", "a")]), (F.col("p_partkey") % 15 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", letter.alias("grade"), "p_size")
    g = F.col("grade")
    return rows.select("p_partkey", "grade", grade_ordinal(g).alias("ordinal"), lookup(g, GRADE_POINTS, "double").alias("points"), routing.is_letter_grade(g).alias("letter"), routing.composite_sat(F.when(F.col("p_size") % 4 != 0, F.lit(600)), F.col("p_size")).alias("composite"))


_PROFILE_PAGE = """'<p>Acceptance Rate <b>' || page_id % 90 || '.5%</b> <!-- 99% -->Graduation<!-- --> Rate: ' || page_id % 80 || '.0 %. The average national rate is around 68%' || repeat('.', 210) || 'Student-Faculty Ratio ' || (page_id % 30 + 1) || '.5:1 '
    || case when page_id % 2 = 0 then 'Average Annual Cost: $' || page_id * 7 || ',001/yr' else 'Net Price $' || page_id || '' end || '<h2>Campus Food: ' || (['A+', 'B', 'C-'])[page_id % 3 + 1] || '</h2> Safety: d ' || '</p>' || html"""


@query("page_numbers", rf"""with p as (select page_id, {_PROFILE_PAGE} as h from pages), c as (select page_id, regexp_replace(regexp_replace(h, '<!--.*?-->', '', 'g'), '{grades.REMARKS}', '', 'g') as c from p),
    r as (select page_id, nullif(regexp_extract(c, '{grades.NUMBER_PATTERNS[0][0]}', 1), '') as a, nullif(regexp_extract(c, '{grades.NUMBER_PATTERNS[1][0]}', 1), '') as g, nullif(regexp_extract(c, '{grades.NUMBER_PATTERNS[2][0]}', 1), '') as f,
        coalesce(nullif(regexp_extract(c, '{grades.NUMBER_PATTERNS[3][0]}', 1), ''), '') as k, coalesce(nullif(regexp_extract(c, '{grades.NUMBER_PATTERNS[4][0]}', 1), ''), '') as n from c),
    v as (select *, try_cast(replace(a, ',', '') as double) as av, try_cast(replace(g, ',', '') as double) as gv, try_cast(replace(k, ',', '') as double) as kv, try_cast(replace(n, ',', '') as double) as nv from r)
    select page_id, case when av > 1 then av / 100 else av end as acceptance_rate_niche, case when gv > 1 then gv / 100 else gv end as graduation_rate_niche, try_cast(f as double) as student_faculty_ratio_niche,
        coalesce(case when kv >= 100 then kv end, case when nv >= 100 then nv end) as avg_annual_cost from v""")
def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.expr(_PROFILE_PAGE.replace("(['A+', 'B', 'C-'])[page_id % 3 + 1]", "element_at(array('A+', 'B', 'C-'), int(page_id % 3 + 1))"))
    rows = table(spark, sf_dir, "pages").select("page_id", page.alias("page"))
    return rows.select("page_id", *[c.alias(n) for n, c in grades.numbers_in(F.col("page")).items()])


def _grade_sql(label: str, field: str) -> str:
    return f"case when regexp_matches(page, '(?i){label}[^A-Za-z0-9]{{1,50}}[A-F][+-]?([^A-Za-z0-9]|$)') then '{field}=' || upper(regexp_extract(page, '(?i){label}[^A-Za-z0-9]{{1,50}}([A-F][+-]?)(?:[^A-Za-z0-9]|$)', 1)) end"


@query("page_grades", f"with p as (select page_id, {_PROFILE_PAGE} as page from pages) select page_id, array_to_string(list_sort(list_filter([{', '.join(_grade_sql(k, v) for k, v in grades.GRADE_FIELDS.items())}], lambda g: g is not null)), ',') as grades from p")
def page_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of all pages by category."""
    page = F.expr(_PROFILE_PAGE.replace("(['A+', 'B', 'C-'])[page_id % 3 + 1]", "element_at(array('A+', 'B', 'C-'), int(page_id % 3 + 1))"))
    found = table(spark, sf_dir, "pages").select("page_id", grades.grades_in(page).alias("g"))
    return found.select("page_id", F.array_join(F.array_sort(F.transform(F.map_entries("g"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("grades"))


@query("nested_profiles", """select page_id, 'dorms=' || (['A', 'B-', 'C+'])[page_id % 3 + 1] as grades, page_id % 50 + 1 as rank, case when page_id % 2 = 0 then (page_id % 90 + 2) / 100.0::double end as acceptance, case when page_id % 5 <> 0 then round((page_id % 4 + 1) / 4.0::double * 4, 2) end as gpa from pages""")
def nested_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its facts in embedded JSON, at depths up to fourteen, read back."""
    c = F.col("page_id")
    facts = F.concat(
        F.lit('{"rank":'), (c % 50 + 1).cast("string"), F.lit(',"items":[{"label":" Dorms","grade":"'), F.element_at(F.array(*map(F.lit, ("A", "B-", "C+"))), (c % 3 + 1).cast("int")),
        F.lit('"},{"rank":99,"name":"Acceptance Rate","value":"'), F.when(c % 2 == 0, F.concat((c % 90 + 2).cast("string"), F.lit("%"))).otherwise("n/a"),
        F.lit('"}],"blocks":[{"template":"BlockScatterplot","buckets":{"0":{"contents":[{"scatterplot":{"plot":{"units":["GPA","SAT"],"attributes":["Decision"],"attributeValues":[["Accepted"]],"points":['),
        F.when(c % 5 != 0, F.concat(F.lit('{"values":['), ((c % 4 + 1) / 4).cast("string"), F.lit(',0.5],"attributes":[0]}'))).otherwise(""), F.lit("]}}}]}}}]}"),
    )
    deep = (c % 7).cast("int")
    state = F.concat(F.lit('{"a":1,"state":'), F.repeat(F.lit('{"x":['), deep), facts, F.repeat(F.lit("]}"), deep), F.lit("}"))
    pages = spread(table(spark, sf_dir, "pages"), "page_id").select("page_id", F.concat("html", F.lit('<script id="__NEXT_DATA__">'), state, F.lit("</script>")).alias("html"))
    found = nested.profiles(pages, "page_id", "html")
    told = F.array_join(F.transform(F.map_entries("grades"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return found.select("page_id", told.alias("grades"), F.col("numbers")["niche_rank"].cast("long").alias("rank"), F.try_element_at("numbers", F.lit("acceptance_rate_niche")).alias("acceptance"), F.get("points", F.lit(0))["gpa"].alias("gpa"))


@query("scatter_points", """with g as (select l_orderkey, l_linenumber, round_even(l_discount * 4, 2) as gpa, round_even(l_tax * 10 * 1600, 0) as sat, case l_returnflag when 'A' then 'accepted' when 'R' then 'rejected' end as outcome,
        case l_linenumber % 3 when 0 then 'Biology' when 1 then 'History' end as major, case when l_linestatus = 'O' then 'inState' else 'outOfState' end as residency from lineitem)
    select l_orderkey, l_linenumber, gpa, sat as sat_score, outcome, major, residency from g where outcome is not null and gpa > 0 and gpa <= 4 and sat > 0""")
def scatter_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as plots of one point each, as JSON, read back."""
    c = F.col
    value = F.to_json(F.array(c("l_tax") * 10, c("l_discount")))
    kinds = F.expr("to_json(array(case when l_linestatus = 'O' then 1 else 0 end, case l_returnflag when 'A' then 1 when 'R' then 2 else 0 end, l_linenumber % 3))")
    plot = F.concat(
        F.lit('{"units":["SAT/ACT","GPA"],"attributes":["In-State Status","Decision","Major"],"attributeValues":[["Out of State","In-State"],["Considering","Accepted","Rejected"],["Biology","History"]],"points":[{"values":'),
        value, F.lit(',"attributes":'), kinds, F.lit('},{"values":[0.5]},{"values":[null,0.5]}]}'),
    )
    found = spread(table(spark, sf_dir, "lineitem"), "l_orderkey").select("l_orderkey", "l_linenumber", F.inline(grades.plotted_points(F.from_json(plot, grades.PLOT))))
    return found.select("l_orderkey", "l_linenumber", "gpa", "sat_score", "outcome", "major", "residency")


@query("drawn_points", "select page_id, (page_id % 40 / 10.0)::double as gpa, (400 + page_id % 1200)::double as sat_score, case page_id % 3 when 0 then 'accepted' when 1 then 'rejected' end as outcome from pages where page_id % 3 < 2")
def drawn_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.expr("concat('<svg><circle data-gpa=\"', format_string('%.1f', page_id % 40 / 10), '\" data-score=\"', 400 + page_id % 1200, '\" fill=\"', case page_id % 3 when 0 then '#4CAF50' when 1 then 'darkred' else 'blue' end, '\"/><circle r=\"3\"/></svg>', html)")
    return table(spark, sf_dir, "pages").select("page_id", F.inline(grades.drawn_points(page)))


@query("labelled_numbers", """select event_id, case event_id % 4 when 0 then 'acceptance_rate_niche' when 1 then 'avg_annual_cost' when 2 then 'setting' end as field,
    case event_id % 4 when 0 then case when event_id % 50 > 1 then event_id % 50 / 100.0::double else (event_id % 50)::double end when 1 then case when event_id >= 100 then event_id::double end end as number, case when event_id % 4 = 2 then 'Urban' end as label from events""")
def labelled_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("case event_id % 4 when 0 then ' Acceptance Rate' when 1 then 'Net Price' when 2 then 'Campus Setting' else 'Mascot' end")
    raw = F.expr("case event_id % 4 when 0 then concat(event_id % 50, '%') when 1 then concat('$', event_id, '/yr') else ' Urban ' end")
    found = table(spark, sf_dir, "events").select("event_id", grades.number_of(label, raw).alias("f"))
    return found.select("event_id", "f.field", "f.number", F.col("f.text").alias("label"))


@query("renamed_by_url", rf"""with a as (select 'Page ' || page_id as name, {_KEY} as key from pages), o as (select case when page_id % 3 = 0 then 'PAGE ' || page_id else 'page no ' || page_id end as name, {_KEY} as key, page_id as place from pages
        union all select 'later', {_KEY}, page_id + 100000 from pages), f as (select key, arg_min(name, place) as other_name from o where key <> '' group by key)
    select name, other_name, key from a join f using (key) where lower(name) <> lower(other_name)""")
def renamed_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose address another list has under another name."""
    rows = table(spark, sf_dir, "pages")
    name = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("PAGE "), "page_id")).otherwise(F.concat(F.lit("page no "), "page_id"))
    other = rows.select(name.alias("name"), "url", F.col("page_id").alias("place")).unionByName(rows.select(F.lit("later").alias("name"), F.concat(F.regexp_replace("url", "^http:", "https:"), F.lit("#again")).alias("url"), (F.col("page_id") + 100000).alias("place")))
    return upkeep.renamed_by_url(rows.select(F.concat(F.lit("Page "), "page_id").alias("name"), "url"), other)


@query("option_list", "select distinct 'all' as list, trim(p_type) as option from part where trim(p_type) <> '' union all select 'none', unnest(['First College', 'Second College'])")
def option_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of parts as options; and of a list whose values are all blank, what is offered instead."""
    rows, spare = table(spark, sf_dir, "part"), ("First College", "Second College")
    full = upkeep.option_list(rows, "p_type", spare).select(F.lit("all").alias("list"), "option")
    return full.unionByName(upkeep.option_list(rows.select(F.repeat(F.lit(" "), F.col("p_size")).alias("blank")), "blank", spare).select(F.lit("none").alias("list"), "option"))


@query("skipped_first", "select c_custkey, row_number() over (order by case when c_custkey % 10 <> 0 then c_acctbal end asc nulls first, c_custkey) as place from customer where c_custkey in (select o_custkey from orders)")
def skipped_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose orders are there already, by rising balance."""
    work = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal")).alias("size"))
    done = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return upkeep.skipped_first(work, done, "c_custkey", "size").select("c_custkey", "place")


@query("class_report", """with q as (select (doc_id * 7919 % 101) / 100.0::double as p, toxic as y from labels), n as (select count(*) filter (where p >= 0.5 and y = 1)::double as tp, count(*) filter (where p >= 0.5 and y = 0)::double as fp, count(*) filter (where p < 0.5 and y = 1)::double as fn, count(*) filter (where p < 0.5 and y = 0)::double as tn from q),
    c as (select '0' as name, tn / (tn + fn) as precision, tn / (tn + fp) as recall, 2 * tn / (2 * tn + fn + fp) as f1, tn + fp as support from n union all select '1', coalesce(tp / nullif(tp + fp, 0), 0), coalesce(tp / nullif(tp + fn, 0), 0), coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), tp + fn from n),
    r as (select * from c union all select 'macro', avg(precision), avg(recall), avg(f1), sum(support) from c union all select 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) from c)
    select name, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support::bigint as support from r""")
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a score by rule tells toxic documents, class by class."""
    rows = table(spark, sf_dir, "labels").select((F.col("doc_id") * 7919 % 101 / 100).alias("p"), F.col("toxic").alias("y"))
    found = metrics.class_report(rows, "p", "y")
    return found.select("name", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")

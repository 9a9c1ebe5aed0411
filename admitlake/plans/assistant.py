"""Queries of the question side: labels, checks, rules, ranking of hits, and the texts that a model reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import profiles, routing, text
from ..functions.scores import GRADE_POINTS
from ..operators import entities, ranking
from .fixtures import CTES, points
from .registry import query, spread, table


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def _words(values: tuple[str, ...]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_ANSWER = """case (conv_id + turn) % 7
    when 0 then '```json' || chr(10) || '{"query_type": "ranking", "complexity": "simple", "categories": ["cost", "bogus", "aid", "cost"], "niche_categories": ["food", "nope"]}' || chr(10) || '```'
    when 1 then '{"query_type": "ranking", "niche_categories": []}' when 2 then ' {"query_type": "poem", "complexity": "odd", "categories": ["student"], "niche_categories": ["food"]} '
    when 3 then text when 4 then '{"query_type": "comparison", "categories": null}' when 5 then '{"query_type": "essay_ideas", "complexity": "simple", "niche_categories": null}' else '[1, 2]' end"""


@query("intent_validate", rf"""with a as (select conv_id, turn, trim({_ANSWER}) as raw from conversations),
    b as (select *, case when raw like '```%' then trim(regexp_replace(regexp_replace(raw, '^[^\n]*\n', ''), '\n```$', '')) else raw end as body from a),
    j as (select conv_id, turn, case when body like '{{%' and json_valid(body) then body::json end as j from b),
    k as (select *, case when (j ->> '$.query_type') in ({_words(routing.QUERY_TYPES)}) then j ->> '$.query_type' else 'qa' end as kind,
        j is not null and coalesce(json_type(j, '$.categories') <> 'NULL', true) as sound, list_filter(coalesce(json_extract_string(j, '$.categories[*]'), []), lambda c: c in ({_words(routing.DATA_CATEGORIES)})) as cats,
        list_filter(coalesce(json_extract_string(j, '$.niche_categories[*]'), []), lambda c: c in ({_words(routing.GRADE_CATEGORIES)})) as niche from j)
    select conv_id, turn, case when sound then kind else 'qa' end as query_type, case when sound and (j ->> '$.complexity') = 'simple' then 'simple' else 'complex' end as complexity,
        case when sound then array_to_string(cats, ',') else '' end as categories, case when sound and kind = 'ranking' then case when len(niche) > 0 then array_to_string(niche, ',') else 'academics' end else '' end as niche_categories from k""")
def intent_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _turns(spark, sf_dir).select("conv_id", "turn", routing.intent(F.expr(_ANSWER)).alias("i"))
    return found.select("conv_id", "turn", "i.query_type", "i.complexity", F.array_join("i.categories", ",").alias("categories"), F.array_join("i.niche_categories", ",").alias("niche_categories"))


@query("request_check", f"""with {CTES} select school_id, count(*) as n, count(*) filter (where gpa * 1.2 > 5 or gpa * 1.2 < 0) as bad_gpa, count(*) filter (where sat_score < 400 or sat_score > 1600) as bad_sat,
    count(*) filter (where act_score < 1 or act_score > 36) as bad_act, count(*) filter (where line_no * 4 > 20 or line_no * 4 < 1) as bad_top_k from points group by school_id""")
def request_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per school, requests that fail each check."""
    rows = points(spark, sf_dir)
    wrong = routing.out_of_range(gpa=F.col("gpa") * 1.2, sat=F.col("sat_score"), act=F.col("act_score"), top_k=F.col("line_no") * 4)
    checked = rows.select("school_id", wrong.alias("wrong"))
    return checked.groupBy("school_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.array_contains("wrong", c).cast("long")).alias(f"bad_{c}") for c in ("gpa", "sat", "act", "top_k")])


_FAILURE = "text || case turn % 4 when 0 then ' Stream EXPIRED' when 1 then ' BLOCKED, please upgrade' when 2 then ' blocked' else '' end"


@query("failure_kinds", f"""select conv_id, turn, regexp_matches(lower({_FAILURE}), '{"|".join(routing.LOST_CONNECTION)}') as lost, contains(lower({_FAILURE}), 'blocked') and contains(lower({_FAILURE}), 'upgrade') as blocked from conversations""")
def failure_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.expr(_FAILURE)
    return _turns(spark, sf_dir).select("conv_id", "turn", routing.is_lost_connection(message).alias("lost"), routing.is_blocked(message).alias("blocked"))


_GREET = "|".join(f"(?:{p})" for p in text.GREETING).replace("'", "''")


@query("routing_rules", rf"""with t as (select conv_id, turn, text as q, case when turn % 5 = 0 then text when turn % 5 = 1 then ' ' end as essay, case when turn % 3 = 0 then text end as prompt from conversations),
    r as (select conv_id, turn, case when coalesce(trim(essay), '') <> '' then 'essay_review' when coalesce(trim(prompt), '') <> '' then 'essay_ideas'
        when len(list_filter(regexp_split_to_array(trim(q), '\s+'), lambda w: w <> '')) <= 8 and regexp_matches(lower(trim(q)), '{_GREET}') then 'greeting' end as kind from t)
    select conv_id, turn, kind, case when coalesce(kind, 'qa') = 'qa' and turn % 2 = 0 then 'simple' else 'standard' end as tier, '' as instructions from r""")
def routing_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules alone say of each turn, and the model and instructions that follow."""
    rows = _turns(spark, sf_dir).select("conv_id", "turn", routing.ruled_type(F.col("text"), F.expr("case when turn % 5 = 0 then text when turn % 5 = 1 then ' ' end"), F.expr("case when turn % 3 = 0 then text end")).alias("kind"))
    kind = F.coalesce("kind", F.lit("qa"))
    return rows.select("conv_id", "turn", "kind", routing.model_tier(kind, F.when(F.col("turn") % 2 == 0, "simple").otherwise("complex")).alias("tier"), routing.instructed_type(kind).alias("instructions"))


@query("search_fanout", """with q as (select item_id, text, case item_id % 4 when 0 then 'essay_ideas' when 1 then 'admission_prediction' when 2 then 'ranking' else 'essay_review' end as kind, list_filter(string_split(text, ' '), lambda w: length(w) > 6) as s from benchmark),
    e as (select item_id, [text] || case when kind like 'essay%' then flatten(list_transform(s[1:2], lambda x: [x || ' mission values what we look for in students', x || ' unique programs culture community']))
        when kind = 'admission_prediction' then flatten(list_transform(s[1:2], lambda x: [x || ' admissions statistics acceptance rate class profile', x || ' application requirements deadlines'])) else [] end as l from q)
    select item_id, k, l[k + 1] as query from (select item_id, l, unnest(range(0, len(l))) as k from e)""")
def search_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("case item_id % 4 when 0 then 'essay_ideas' when 1 then 'admission_prediction' when 2 then 'ranking' else 'essay_review' end")
    schools = F.filter(F.split("text", " "), lambda w: F.length(w) > 6)
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(routing.searches(F.col("text"), kind, schools)).alias("k", "query")).withColumn("k", F.col("k").cast("long"))


_RULED = "case item_id % 6 when 0 then 'How do I apply for merit aid? ' when 1 then 'Is ED binding ' when 2 then 'Campus tour or fafsa deadline ' when 3 then 'Who writes a rec letter ' else '' end || text"
_RULES = " || ".join("case when " + " or ".join(f"contains(q, '{w}')" for w in words) + " then '" + rule.replace("'", "''") + "' else '' end" for words, rule in routing.EXTRA_RULES)


@query("extra_rules", f"select item_id, sha256(r) as digest, length(r) as size from (select item_id, {_RULES} as r from (select item_id, lower({_RULED}) as q from benchmark))")
def extra_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = table(spark, sf_dir, "benchmark").select("item_id", routing.extra_rules(F.expr(_RULED)).alias("r"))
    return rules.select("item_id", F.sha2("r", 256).alias("digest"), F.length("r").cast("long").alias("size"))


@query("residency_status", """with c as (select c_custkey, case c_nationkey % 4 when 0 then 'FR' when 1 then null else 'US' end as country, case when c_custkey % 7 <> 0 then lower(left(c_mktsegment, 2)) end as state, left(p_type, 2) as school_state from customer left join part on p_partkey = c_custkey)
    select c_custkey, case when country is null then null when country <> 'US' then 'international' when state is null or school_state is null then null when upper(state) = upper(school_state) then 'in-state' else 'out-of-state' end as residency from c""")
def residency_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    country = F.when(F.col("c_nationkey") % 4 == 0, "FR").when(F.col("c_nationkey") % 4 != 1, "US")
    state = F.when(F.col("c_custkey") % 7 != 0, F.lower(F.substring("c_mktsegment", 1, 2)))
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("c_custkey"), F.substring("p_type", 1, 2).alias("s")), "c_custkey", "left")
    return rows.select("c_custkey", routing.residency_at(country, state, F.col("s")).alias("residency"))


_PROFILE = """case when c_custkey % 5 <> 0 then (c_custkey % 40 / 10.0)::varchar end as gpa, case when c_custkey % 3 = 0 then 'sat' when c_custkey % 3 = 1 then '' end as test, case when c_custkey % 4 <> 0 then (400 + c_custkey % 1200)::varchar end as score,
    case when c_custkey % 6 = 0 then 'in-state' end as residency, case c_nationkey % 3 when 0 then 'US' when 1 then 'FR' end as country, case when c_nationkey % 2 = 0 then c_mktsegment end as state"""


@query("profile_context", f"""with c as (select c_custkey, {_PROFILE} from customer), p as (select c_custkey, concat_ws(', ', 'GPA ' || gpa, case when test <> '' then upper(test) else 'Test Score' end || ' ' || score, 'Residency: ' || residency,
        case when country <> 'US' then 'Country: France' when country = 'US' then 'State: ' || state end, case when c_custkey % 2 = 0 then 'Preferred majors (ranked): #1 Biology, #2 History' end, case when c_custkey % 9 = 0 then 'Preferred schools (ranked): #1 ' || c_custkey end) as parts from c)
    select c_custkey, case when parts = '' then '' else 'Profile: ' || parts || chr(10) || case when c_custkey % 2 = 0 or c_custkey % 9 = 0 then '{profiles.RANKINGS_NOTE.strip()}' || chr(10) else '' end || chr(10) end as profile from p""")
def profile_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", *[
        "case when c_custkey % 5 <> 0 then format_string('%.1f', c_custkey % 40 / 10) end as gpa", "case when c_custkey % 3 = 0 then 'sat' when c_custkey % 3 = 1 then '' end as test", "case when c_custkey % 4 <> 0 then string(400 + c_custkey % 1200) end as score",
        "case when c_custkey % 6 = 0 then 'in-state' end as residency", "case c_nationkey % 3 when 0 then 'US' when 1 then 'FR' end as country", "case when c_nationkey % 2 = 0 then c_mktsegment end as state",
        "case when c_custkey % 2 = 0 then array('Biology', 'History') end as majors", "case when c_custkey % 9 = 0 then array(string(c_custkey)) end as wishes"])
    c = F.col
    return rows.select("c_custkey", profiles.profile_block(c("gpa"), c("test"), c("score"), c("residency"), c("country"), F.lit("France"), c("state"), c("majors"), c("wishes")).alias("profile"))


@query("experience_context", """select o_custkey, 'Experiences and activities:' || chr(10) || string_agg('- **' || o_orderpriority || '**' || case when o_orderstatus <> 'P' then ' at ' || o_orderstatus else '' end || case when o_orderkey % 3 = 0 then ' (club)' else '' end
    || case when o_orderkey % 2 = 0 then ' [' || strftime(o_orderdate, '%Y-%m-%d') || case when o_orderkey % 4 = 0 then ' – now' else '' end || ']' else '' end || case when o_orderkey % 5 = 0 then chr(10) || '  ' || o_orderkey else '' end, chr(10) order by o_orderkey) || chr(10) || chr(10) as experiences
    from orders group by o_custkey""")
def experience_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as experiences (the fixture has about ten each)."""
    k = F.col("o_orderkey")
    line = profiles.experience_line(
        F.col("o_orderpriority"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")), F.when(k % 3 == 0, "club"), F.when(k % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")), F.when(k % 4 == 0, "now"), F.when(k % 5 == 0, k.cast("string"))
    )
    lines = table(spark, sf_dir, "orders").select("o_custkey", F.struct("o_orderkey", line.alias("line")).alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"])
    return lines.groupBy("o_custkey").agg(profiles.experiences_block(ordered).alias("experiences"))


@query("essay_prompt_context", f"select conv_id, turn, case when turn % 2 = 0 and trim(text) <> '' then 'Essay prompt being responded to: **' || trim(text) || '**' || chr(10) || chr(10) else '{profiles.NO_PROMPT.strip()}' || chr(10) || chr(10) end as block from conversations")
def essay_prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", profiles.prompt_block(F.when(F.col("turn") % 2 == 0, F.col("text"))).alias("block"))


_SCHOOL = {
    "name": "p_name", "city": "case when p_partkey % 4 <> 0 then p_brand end", "state": "case when p_partkey % 9 <> 0 then left(p_type, 2) end", "ownership": "p_partkey % 5", "url": "case when p_partkey % 2 = 0 then p_brand else '' end",
    "acceptance_rate": "case when p_partkey % 13 <> 0 then p_size / cast(50 as double) end", "sat_avg": "case when p_partkey % 7 <> 0 then 800 + p_size * 10 end", "sat_25": "800 + p_size", "sat_75": "case when p_partkey % 6 <> 0 then 1000 + p_size * 10 end",
    "act_25": "p_size % 3 * 9", "act_75": "25", "test_requirements": "p_partkey % 7", "enrollment": "p_partkey * 137 % 50000", "student_faculty_ratio": "cast(case when p_partkey % 3 = 0 then p_size end as double)",
    "retention_rate": "p_size / cast(100 as double)", "pct_men": "cast(0.5 as double)", "pct_women": "case when p_partkey % 2 = 0 then cast(0.5 as double) end", "pct_asian": "p_size / cast(200 as double)",
    "tuition_in_state": "case when p_partkey % 3 <> 0 then 10000 + p_partkey end", "tuition_out_of_state": "case when p_partkey % 4 <> 0 then 10000 + p_partkey + p_partkey % 2 * 5000 end", "avg_net_price": "case when p_size > 20 then p_size * 1000 end",
    "net_price_0_30k": "case when p_size > 30 then p_size * 100 end", "pell_grant_rate": "p_size / cast(50 as double)", "cumulative_debt_25th": "5000", "cumulative_debt_75th": "case when p_size < 25 then 20000 end",
    "graduation_rate": "case when p_size > 5 then p_size / cast(50 as double) end", "endowment": "case p_partkey % 4 when 0 then 3000000000 + p_size * cast(100000000 as bigint) when 1 then 5000000 when 2 then 70000 end", "faculty_salary": "case when p_size > 10 then 9000 end",
}


def _pct(c: str) -> str:
    return f"printf('%.1f%%', {c} * 100)"


def _usd(c: str) -> str:
    return f"'$' || format('{{:,}}', {c}::bigint)"


@query("school_block", f"""with s as (select p_partkey, {', '.join(f'{v.replace("cast(", "cast(")} as {k}' for k, v in _SCHOOL.items())} from part),
    t as (select *, {_usd('tuition_in_state')} as tin, {_usd('tuition_out_of_state')} as tout from s),
    l as (select p_partkey, ['[SCHOOL DATA] ' || name,
        nullif(concat_ws(' | ', coalesce('Location: ' || city || ', ' || state, 'State: ' || state), case ownership when 1 then 'Type: Public' when 2 then 'Type: Private nonprofit' when 3 then 'Type: For-profit' end), ''),
        nullif(concat_ws(' | ', 'Acceptance Rate: ' || {_pct('acceptance_rate')}, 'Website: ' || nullif(url, '')), ''),
        'Test Scores: ' || nullif(concat_ws(' | ', 'SAT Avg: ' || sat_avg, 'SAT Range: ' || sat_25 || '-' || sat_75, case when act_25 <> 0 then 'ACT Range: ' || act_25 || '-' || act_75 end,
            'Test Policy: ' || case test_requirements when 1 then 'Required' when 2 then 'Recommended' when 3 then 'Neither required nor recommended' when 4 then 'Unknown' when 5 then 'Test-flexible (considered but not required)' end), ''),
        'Enrollment: ' || nullif(concat_ws(' | ', case when enrollment <> 0 then 'Enrollment: ' || format('{{:,}}', enrollment) end, 'Student-Faculty Ratio: ' || printf('%.0f:1', student_faculty_ratio), 'Retention Rate: ' || {_pct('retention_rate')}, 'Male/Female: ' || {_pct('pct_men')} || '/' || {_pct('pct_women')}), ''),
        'Demographics: ' || 'Asian ' || {_pct('pct_asian')},
        'Cost: ' || nullif(concat_ws(' | ', case when tin <> tout then 'In-State Tuition: ' || tin end, case when tin <> tout then 'Out-of-State Tuition: ' || tout end, case when not coalesce(tin <> tout, false) then 'Tuition: ' || coalesce(tin, tout) end, 'Avg Net Price: ' || {_usd('avg_net_price')}), ''),
        'Net Price by Income: $0-30k: ' || {_usd('net_price_0_30k')}, 'Financial Aid: ' || concat_ws(' | ', 'Pell Grant Rate: ' || {_pct('pell_grant_rate')}, 'Debt Range (25th-75th): ' || {_usd('cumulative_debt_25th')} || '-' || {_usd('cumulative_debt_75th')}),
        'Outcomes: Graduation Rate: ' || {_pct('graduation_rate')},
        'Resources: ' || nullif(concat_ws(' | ', 'Endowment: ' || case when endowment >= 1000000000 then printf('$%.1fB', endowment / 1e9::double) when endowment >= 1000000 then printf('$%.0fM', endowment / 1e6::double) else {_usd('endowment')} end, 'Avg Faculty Salary: ' || {_usd('faculty_salary')} || '/mo'), '')] as l from t)
    select p_partkey, array_to_string(list_filter(l, lambda x: x is not null), chr(10)) || chr(10) || chr(10) as block from l""")
def school_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.array(*[F.lit(c) for c in ("identity", "admissions", "student", "cost", "aid", "outcome", "institution")])
    return spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", profiles.school_block({k: F.expr(v) for k, v in _SCHOOL.items()}, wanted).alias("block"))


_LETTER = "(['A+', 'A', 'A-', 'B+', 'B', 'B-', 'C+', 'C', 'C-', 'D+', 'D', 'D-', 'F'])[{} % 13 + 1]"
_GRADED = {"academics": "p_partkey", "food": "p_partkey + 5", "safety": "p_size"}


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as schools with a few grades, some missing."""
    letters = F.array(*[F.lit(g) for g in GRADE_POINTS])
    grades = {k: F.when(F.col("p_partkey") % 8 != 0, F.element_at(letters, (F.expr(v) % 13 + 1).cast("int"))) for k, v in _GRADED.items()}
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("school "), F.col("p_partkey").cast("string")).alias("name_key"), "p_partkey", F.when(F.col("p_partkey") % 10 != 0, F.col("p_size")).alias("rank"), (F.col("p_size") / 50).alias("acceptance"),
        F.create_map(*[x for k, g in grades.items() for x in (F.lit(k), g)]).alias("grades"),
    )


@query("grade_block", f"""with g as (select p_partkey, concat_ws(', ', {', '.join(f"'{k.title()} ' || case when p_partkey % 8 <> 0 then {_LETTER.format('(' + v + ')')} end" for k, v in _GRADED.items())}) as parts, case when p_partkey % 10 <> 0 and p_size <> 0 then ' (#' || p_size || ')' else '' end as r from part)
    select p_partkey % 20 as hits, '{profiles.GRADES_HEAD}' || chr(10) || string_agg('school ' || p_partkey || r || ': ' || parts, chr(10) order by p_partkey) || chr(10) || chr(10) as block from g where parts <> '' group by 1""")
def grade_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty lists of hits, each school in one of them, with its grades."""
    wanted = F.array(*[F.lit(k) for k in (*_GRADED, "other")])
    line = profiles.grade_line(F.col("name_key"), F.col("rank"), {k: F.col("grades")[k] for k in _GRADED}, wanted)
    lines = _graded(spark, sf_dir).select((F.col("p_partkey") % 20).alias("hits"), F.struct("p_partkey", line.alias("line")).alias("x")).where("x.line is not null")
    ordered = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"])
    return lines.groupBy("hits").agg(profiles.grades_block(ordered).alias("block"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as hits of their customer's question, scored by a rule."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_custkey as query_id", "o_orderkey as id", "concat('School ', o_orderkey % 250) as college", "case o_orderkey % 4 when 0 then 'about' when 1 then 'research' when 2 then 'other' end as kind",
        "case when o_orderkey % 11 <> 0 then o_orderkey * 37 % 101 / 100 end as score", "o_orderkey as rank", "case when o_orderkey % 3 = 0 then o_orderpriority end as content",
    )


_HITS = """hits as (select o_custkey as query_id, o_orderkey as id, 'School ' || o_orderkey % 250 as college, case o_orderkey % 4 when 0 then 'about' when 1 then 'research' when 2 then 'other' end as kind,
    case when o_orderkey % 11 <> 0 then o_orderkey * 37 % 101 / 100.0::double end as score, o_orderkey as rank, case when o_orderkey % 3 = 0 then o_orderpriority end as content from orders)"""
_POINT = "(case {} " + " ".join(f"when '{g}' then {p}" for g, p in GRADE_POINTS.items()) + " end)::double"
_BOOST = f"""boosts as (select 'school ' || p_partkey as name_key, case when p_partkey % 10 <> 0 and p_size <> 0 then greatest(0, 1 - (p_size - 1) / 500.0::double) * 0.15 else 0 end + case when p_size between 1 and 50 then (1 - p_size / 50.0::double) * 0.05 else 0 end
    + case when p_partkey % 8 <> 0 then ({_POINT.format(_LETTER.format('p_partkey'))} + {_POINT.format(_LETTER.format('(p_partkey + 5)'))}) / 2 / 4.3::double * 0.1 else 0 end as boost from part)"""


@query("rerank_pipeline", f"""with {_HITS}, {_BOOST}, f as (select *, count(*) over (partition by query_id) as n, row_number() over (partition by query_id order by coalesce(score, 0) desc, rank) as pos from hits),
    b as (select f.*, case when boost > 0 then coalesce(score, 0) + boost else score end as s1 from f left join boosts on name_key = lower(college) where n > 1 and pos <= 8),
    p as (select *, case when kind in ({_words(ranking.ESSAY_PAGES)}) then coalesce(s1, 0) + 0.1 else s1 end as s2 from b)
    select query_id, id, round(s2, 9) as score, row_number() over (partition by query_id order by coalesce(s2, 0) desc, pos) as place from p where coalesce(s2, 0) >= 0.1 union all select query_id, id, round(score, 9), 1 from f where n = 1""")
def rerank_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.array(F.lit("academics"), F.lit("food"), F.lit("other"))
    out = ranking.reranked(_hits(spark, sf_dir), 8, _graded(spark, sf_dir), wanted, ranking.ESSAY_PAGES)
    return out.select("query_id", "id", F.round("score", 9).alias("score"), F.col("place").cast("long").alias("place"))


@query("rerank_absent", f"""with {_HITS}, p as (select *, case when kind in ('about', 'research') then coalesce(score, 0) + 0.1 else score end as s from hits)
    select * from (select query_id, id, round(s, 9) as score, row_number() over (partition by query_id order by coalesce(s, 0) desc, rank) as place from p) where place <= 5""")
def rerank_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.unranked(_hits(spark, sf_dir), 5, ("about", "research"))
    return out.select("query_id", "id", F.round("score", 9).alias("score"), F.col("place").cast("long").alias("place"))


@query("hits_flatten", f"with {_HITS} select query_id, coalesce(case when id % 2 = 0 then id end, id + 1) as id, coalesce(case when id % 3 = 0 then college end, kind) as title, coalesce(case when id % 5 = 0 then score end, score, 0) as distance from hits")
def hits_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    entity = F.struct(F.when(c("id") % 2 == 0, c("id")).alias("id"), F.when(c("id") % 3 == 0, c("college")).alias("title"), F.when(c("id") % 5 == 0, c("score")).alias("distance"))
    nested = _hits(spark, sf_dir).select("query_id", entity.alias("entity"), F.struct((c("id") + 1).alias("id"), c("kind").alias("title"), c("score").alias("score")).alias("item"))
    return ranking.flattened(nested, ["id", "title"]).select("query_id", "id", "title", "distance")


@query("retrieval_health", f"with {_HITS} select query_id, count(*) as n, sum(length(coalesce(content, '')))::bigint // count(*) as mean_length, 0::bigint as empty_names from hits group by query_id")
def retrieval_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.health(_hits(spark, sf_dir))


@query("model_inputs", f"""with {_HITS} select id, 'College: ' || college || ' | Page: ' || coalesce(kind, '') || chr(10) || coalesce(content || chr(10), '') || coalesce(kind, '') as rerank, case when content is not null then content || chr(10) || chr(10) || college else college end as embed,
    case when length(college || content) > 12 then left(college || content, 12) || '...' else college || content end as title from hits""")
def model_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that a cross-encoder and an embedder read of each hit, and a short title."""
    c = F.col
    return _hits(spark, sf_dir).select(
        "id", routing.rerank_text(c("college"), c("kind"), c("content"), c("kind")).alias("rerank"), routing.embed_input(c("content"), c("college")).alias("embed"), routing.short_title(F.concat("college", "content"), 12).alias("title")
    )


_CITED = "text || case item_id % 5 when 0 then ' [1] and [9].' when 1 then ' [N] [sd].' when 2 then ' [SCHOOL DATA] x' when 3 then ' [0][2][01]' else '' end"
_PLAIN = rf"regexp_replace(regexp_replace(regexp_replace({_CITED}, '\s*\[SCHOOL DATA\][^\n]*', '', 'g'), '\[(?i:sd)\]', '[SD]', 'g'), '\s*\[N\]', '', 'g')"


@query("citations_verify", rf"""with a as (select item_id, item_id % 3 as k, {_PLAIN} as t from benchmark),
    r as (select item_id, k, t, case when k = 1 then regexp_replace(t, '\[(0+|0*[2-9]|0*[1-9][0-9]+)\]', '', 'g') when k = 2 then regexp_replace(t, '\[(0+|0*[3-9]|0*[1-9][0-9]+)\]', '', 'g') else t end as u from a)
    select item_id, case when k = 0 then t when regexp_matches(u, '\[[0-9]+\]') then u else u || chr(10) || chr(10) || '> **Note:** This response may not be fully grounded in the provided sources. Please verify with the college''s official website.' end as answer from r""")
def citations_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", text.verified_citations(F.expr(_CITED), (F.col("item_id") % 3).cast("int")).alias("answer"))


@query("sources_listed", "select o_custkey, string_agg('[' || k || '] ' || o_orderstatus || ' — ' || o_orderpriority || chr(10) || '    ' || o_orderkey, chr(10) order by k) as listing from (select *, row_number() over (partition by o_custkey order by o_orderkey) as k from orders) group by o_custkey")
def sources_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority"))).alias("x"))
    return rows.select("o_custkey", profiles.sources_text(F.col("x.o_orderstatus"), F.col("x.o_orderpriority"), F.col("x.o_orderkey").cast("array<string>")).alias("listing"))


@query("shorthand_expand")
def shorthand_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches share spaces, which SQL's replacements cannot say; tests hold it against a loop."""
    asked = F.concat(F.expr("case turn % 5 when 0 then 'U mich or ariz state ' when 1 then 'univ of CA in TX nc ' when 2 then 'is penn mass ok ' else '' end"), F.col("text"))
    return _turns(spark, sf_dir).select("conv_id", "turn", entities.expanded(entities.without_punctuation(asked)).alias("text"))


@query("schools_in_questions")
def schools_in_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of parts as schools, named in benchmark items: whole, by alias, misspelt; tests hold it against a loop."""
    kinds = table(spark, sf_dir, "part").select(F.concat(F.initcap("p_type"), F.lit(" "), F.col("p_brand"), F.lit(" University")).alias("name")).distinct()
    listed = kinds.select(F.lower(F.regexp_replace("name", "[^A-Za-z]*([0-9]+) University$", " $1")).alias("alias"), "name")
    asked = F.expr("case item_id % 4 when 0 then 'Is standard brand 3 or Economy Brand#13 University good? ' when 1 then 'promo brnd 5 univ ' when 2 then 'u of nothing ' else '' end")
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.concat(asked, F.col("text")).alias("text"))
    found = entities.extracted(questions, entities.merged_aliases(listed), kinds)
    return found.withColumn("place", F.col("place").cast("long"))

from __future__ import annotations

import time

from conftest import SF
from pyspark.sql import functions as F

from admitlake.functions import scores, text, urls
from admitlake.operators import maintenance, metrics, retrieval
from admitlake.plans import QUERIES


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_score_conversions_round_half_to_even(spark):
    assert one(spark, scores.act_to_sat(F.lit(26.5)), scores.act_to_sat(F.lit(40.0)), scores.act_to_sat(F.lit(None).cast("double"))) == (1240.0, 1590.0, None)
    assert one(spark, scores.sat_to_act(F.lit(1600.0)), scores.sat_to_act(F.lit(1205.0)), scores.sat_to_act(F.lit(100.0))) == (36.0, 24.0, 9.0)


def test_buckets_and_tiers(spark):
    assert one(spark, *[scores.selectivity(F.lit(x).cast("double")) for x in (None, 0.1, 0.15, 0.5, 0.7)]) == ("unknown", "reach", "competitive", "match", "safety")
    assert one(spark, *[scores.major_tier(F.lit(x).cast("string")) for x in ("Nursing", "Falconry", " ", None)]) == ("stem_competitive", "other", None, None)


def test_clean_text(spark):
    raw = "<p>Call&nbsp;555-123-4567 &amp; go!!!</p><script>x()</script> é@b……"
    assert one(spark, text.clean_text(F.lit(raw)), text.clean_text(F.lit(None).cast("string"))) == ("Call go! é b", "")
    assert one(spark, text.clean_text(F.lit("alpha beta gamma"), 12)) == ("alpha beta...",)


def test_citations(spark):
    found = one(spark, *[text.verified_citations(F.lit(a), F.lit(2)) for a in ("a [1] b [3] [N]", "x [sd]", "y [SCHOOL DATA] z\nw [2]")])
    assert found[0] == "a [1] b " and found[1].startswith("x [SD]\n\n> **Note:**") and found[2] == "y\nw [2]"
    assert one(spark, text.verified_citations(F.lit("a [7]"), F.lit(0))) == ("a [7]",)


def test_sentences_windows_names(spark):
    assert one(spark, text.unique_sentences(F.lit("One two three. one  two THREE! Short. Another long one?"))) == ("One two three. Another long one.",)
    sizes = F.transform(text.token_windows(F.transform(F.sequence(F.lit(1), F.lit(600)), lambda x: x.cast("string"))), lambda w: F.size(w))
    assert one(spark, sizes) == ([512, 138],)
    assert one(spark, text.normalized_name(F.lit("The O'Hara University - Main Campus"))) == ("o hara university",)


def test_urls(spark):
    url = F.lit("HTTP://WWW.A.edu:80//x/y/?b=2&utm_source=q&a=1#frag")
    assert one(spark, urls.normalized(url), urls.canonical_key(url), urls.host(url)) == ("http://www.a.edu/x/y?a=1&b=2", "a.edu//x/y?b=2&utm_source=q&a=1", "a.edu")
    assert one(spark, *[urls.page_type(F.lit(f"https://x.edu/{p}")) for p in ("apply", "study-abroad/", "diversity/programs", "nothing")]) == ("admissions", "international", "diversity", "other")
    base = F.lit("https://www.x.edu/")
    assert one(spark, *[urls.is_internal(F.lit(u), base) for u in ("/a.pdf", "https://lib.x.edu/a", "https://x.edu/a.pdf", "https://y.edu/a", "https://x.edu/login")]) == (True, True, False, False, False)


def test_parsing(spark):
    assert one(spark, text.parse_percent(F.lit("4%")), text.parse_cost(F.lit("$18,000/yr")), text.parse_cost(F.lit("$50")), text.parse_ratio(F.lit("5:1")), text.parse_ratio(F.lit("x"))) == (0.04, 18000, None, 5.0, None)


def test_capped_hits_keep_blank_keys(spark):
    hits = spark.createDataFrame([("u", 1), ("u", 2), ("u", 3), ("", 4), (None, 5), ("v", 6)], "url string, rank int")
    assert sorted(r["rank"] for r in retrieval.capped_by_key(hits, "url", "rank").collect()) == [1, 2, 4, 5, 6]


def test_auc_and_empty_tables(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "p double, y int")
    assert metrics.auc(rows, "p", "y").first()["auc"] == 0.75
    assert metrics.auc(rows.limit(0), "p", "y").first()["auc"] is None
    assert metrics.calibration_bins(rows.union(spark.createDataFrame([(1.0, 1)], "p double, y int")), "p", "y").agg(F.sum("n")).first()[0] == 4


def test_frontier_and_delta(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src int, dst int")
    found = {r["node"]: r["depth"] for r in maintenance.frontier(edges, spark.createDataFrame([(1,)], "node int")).collect()}
    assert found == {1: 0, 2: 1, 3: 2}
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, h string"), spark.createDataFrame([(1, "a"), (3, "c")], "k int, h string")
    assert {tuple(r) for r in maintenance.delta(old, new, "k", "h").collect()} == {(1, "unchanged"), (2, "gone"), (3, "new")}


def test_sentences_of_a_long_text_take_no_square_of_their_number(spark):
    n = 20_000
    long = ". ".join(f"Sentence number {k % (n // 2)}" for k in range(n)) + "."
    start = time.monotonic()
    (got,) = spark.createDataFrame([(long,)], "t string").select(text.unique_sentences(F.col("t"))).first()
    assert got == ". ".join(f"Sentence number {k}" for k in range(n // 2)) + "."
    assert time.monotonic() - start < 60


def test_counted_words(spark):
    words = F.array(*map(F.lit, ["b", "a", "b", "c", "a", "b"]))
    (got, none, null) = one(spark, text.counted(words), text.counted(F.array().cast("array<string>")), text.counted(F.lit(None).cast("array<string>")))
    assert [tuple(r) for r in got] == [("a", 2, 1), ("b", 3, 0), ("c", 1, 3)]
    assert (none, null) == ([], None)


def test_keywords_by_document_hold_no_more_than_a_document(spark):
    plan = QUERIES["keywords_by_document"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Window" not in plan


def test_small_tables_are_dealt_to_all_cores_and_texts_cleaned_once(spark):
    plan = lambda name: QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    for name in ("school_block", "scatter_points"):
        assert "RepartitionByExpression" in plan(name)
    assert plan("scatter_points").count("from_json") == 1
    assert plan("valid_content").count("<script.*?</script>") == 1


def test_tasks_grow_with_the_input(spark, monkeypatch):
    from admitlake import storage

    rows = spark.read.parquet(f"{SF}/lineitem.parquet")
    assert storage.tasks_for(rows) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(storage, "HELD", 1 << 10)
    for name in ("duplicate_report", "delete_duplicates"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan()
        assert "RepartitionByExpression" in plan.toString() and "Window" not in plan.toString()
    assert storage.tasks_for(rows) > 100

"""Functions that no query's SQL holds: links, likeness of names, calibration, importance, constraints, delays, storage."""

from __future__ import annotations

import html
import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F
from test_entities import like

from admitlake.functions import profiles, routing, scores, text, urls
from admitlake.operators import learning, matching, placing, predicting, upkeep
from admitlake.sources import files, grades, paged


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_entities_are_those_of_the_standard_library(spark):
    texts = ["a &amp; b &lt;p&gt; &eacute;&copy &copycat &ampamp; &unknown; & &; &#65;&#x41 &#x80; &#150; &#xD800; &#99999999999; &#0; &notit; &NotEqualTilde; &nbsp;x", "plain", "", "&", "&&amp;&lt", "&#;", "&#x;&#xzz;", "a&b=c&d"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.unescaped(F.col("t")).alias("x")).collect()
    assert {r["t"]: r["x"] for r in got} == {t: html.unescape(t) for t in texts}


def test_links_are_resolved(spark):
    base = "https://www.a.edu/x/y/z.html?q=1"
    links = ["b.html", "/c", "../d", "../../../e", "?r=2", "//h.edu/f", "http://o.edu/g", "./", "..", "k/./l/../m", "https://A.edu", "n#frag"]
    for link in links:
        assert one(spark, urls.resolved(F.lit(link), F.lit(base))) == urljoin(base, link).split("#")[0], link
    page = "<a href='b/'>1</a><A HREF=\"/c?utm_source=x&b=2&a=1\">2</A><a href=d.pdf><a href=/e><a href='#f'><a href='mailto:x@y'><link rel=\"next\" href='?page=2'><a href='https://other.edu/'><a href='https://sub.a.edu/g'><link rel=stylesheet href=s.css>"
    got = one(spark, urls.page_links(F.lit(page), F.lit(base)))
    assert got == ["https://www.a.edu/x/y/b", "https://www.a.edu/c?a=1&b=2", "https://www.a.edu/e", "https://sub.a.edu/g", "https://www.a.edu/x/y/z.html?page=2"]


def test_names_are_matched_by_sorted_words(spark):
    schools = ["University of Texas - Austin", "Texas State University", "Duke University", "Boston College", "College of Boston Arts", "Rice University"]
    names = ["Duke Univrsity", "University Duke", "texas univ. of austin", "Bostn Colege", "Nowhere", "", None, "Rice Universty", "Texas University State", "special"]
    df = [spark.createDataFrame([(n,) for n in x], "name string") for x in (names, schools)]
    over = spark.createDataFrame([("special", "Rice University")], "name string, school string")
    keys = {r["name"]: r["k"] for r in df[0].union(df[1]).where("name is not null").select("name", matching.token_sorted(F.col("name")).alias("k")).collect()}
    want = {"special": ("Rice University", 100.0)}
    for n in names:
        if n and n.strip() and n != "special":
            best = max((like(keys[n], keys[s]), s) for s in schools)
            if best[0] >= 80:
                want[n] = (best[1], pytest.approx(best[0]))
    assert {r["name"]: (r["school"], r["score"]) for r in matching.token_sort_matches(*df, over).collect()} == want
    assert matching.token_sort_matches(df[0].limit(0), df[1]).count() == 0 and matching.token_sort_matches(df[0], df[1].limit(0)).count() == 0


def test_calibration_between_two_fits(spark):
    draw = random.Random(3)
    rows = [(p, int(draw.random() < p)) for p in (draw.random() for _ in range(3000))]
    df = spark.createDataFrame(rows, "p double, y int")
    fit = learning.venn_abers(df, "p", "y", 20)
    assert all(a <= b for a, b in zip(fit[1], fit[2])) and all(fit[1][k] <= fit[1][k + 1] + 1e-9 for k in range(19))
    out = learning.venn_abers_calibrated(df, fit, "p").collect()
    assert all(abs(r["calibrated"] - r["p"]) < 0.15 and r["low"] <= r["calibrated"] <= r["high"] for r in out)
    learning.venn_abers(df.limit(0), "p", "y", 5)


def test_importance_and_constraints(spark, tmp_path):
    df = spark.createDataFrame([(k, float(k % 10), float(k * 7 % 11), float(k % 10 > 4)) for k in range(200)], "id long, a double, b double, y double")
    model = learning.fit_booster(df, ["a", "b"], "y", maxIter=3, maxDepth=2)
    found = {r["feature"]: r for r in learning.permutation_importance(model, df, ["a", "b"], "y", "id", repeats=2).collect()}
    assert found["a"]["mean"] > 0.1 and not found["a"]["is_low"] and found["b"]["is_low"]
    learning.save_models({"reach": model}, str(tmp_path / "m"))
    assert list(learning.load_models(str(tmp_path / "m"), ["reach", "match"])) == ["reach"]
    assert predicting.monotone_vector(["gpa", "x", "sat_below_25th"]) == [1, 0, -1]
    assert predicting.interaction_groups(["x", "gpa", "sat_range", "sat_score"]) == [[1, 3], [2], [0]]


def test_places_and_medians(spark):
    df = spark.createDataFrame([(k * 7 % 50, float(k % 3)) for k in range(50)], "id long, v double").repartition(5)
    assert [r["id"] for r in placing.placed(df, F.desc("v"), "id").orderBy("place").collect()] == [r["id"] for r in df.orderBy(F.desc("v"), "id").collect()]
    assert placing.exact_median(df, "v") == 1.0 and placing.exact_median(df.limit(0), "v") is None
    assert placing.placed(df.limit(0), "id").count() == 0


def test_median_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(placing, "HELD", 3)
    monkeypatch.setattr(placing, "RANGES", 4)
    for values in ([1.0, 5.0, 2.0, 9.0, 7.5, 100.0], [3.0] * 7 + [4.0, 1e9], [float(k * k) for k in range(101)]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
        ordered = sorted(values)
        n = len(ordered)
        assert placing.exact_median(df, "v") == (ordered[(n - 1) // 2] + ordered[n // 2]) / 2


def test_pages_that_fail_are_named(spark):
    def fetch(page, size):
        return (200, 0.0, [{"id": page}]) if page != 1 else (500, 0.0, [])

    spark.dataSource.register(paged.paged_source("failing_pages", fetch, 25, 10))
    rows = spark.read.format("failing_pages").load().collect()
    assert sorted((r["page"], r["record"] is None) for r in rows) == [(0, False), (1, True), (2, False)]


def test_small_texts(spark):
    assert one(spark, grades.merged_profile(F.create_map(F.lit("a"), F.lit("A+"), F.lit("b"), F.lit("B")), F.create_map(F.lit("b"), F.lit("0.5")))) == {"a": "A+", "b": "0.5"}
    empty = F.array().cast("array<int>")
    assert one(spark, grades.first_source(empty, F.array(F.lit(2)), F.array(F.lit(3)))) == [2] and one(spark, grades.first_source(empty)) is None
    assert one(spark, profiles.ranked(F.array(F.lit("x"), F.lit("y")))) == "#1 x, #2 y"
    assert one(spark, routing.without_campus(F.lit("X University - Main Campus"))) == "X University"
    delays = [r["x"] for r in spark.range(200).select(routing.human_delay(0.5, 0.4, 1.0, 3.0, 1).alias("x")).collect()]
    assert min(delays) >= 1.0 and max(delays) <= 3.0 and len(set(delays)) > 50
    assert all(2.0 <= r["x"] < 3.0 for r in spark.range(50).select(routing.jittered(2.0, 3.0, 1).alias("x")).collect())
    same = upkeep.renamed_values(spark.createDataFrame([("a",), (None,)], "n string"), "n", spark.createDataFrame([], "old string, new string"))
    assert sorted(str(r["n"]) for r in same.collect()) == ["None", "a"]


def test_files_that_are_missing_and_copies(spark, tmp_path):
    first = files.seeds_or_sample(spark, str(tmp_path / "seeds"))
    assert first.count() == 3 and files.seeds_or_sample(spark, str(tmp_path / "seeds")).count() == 3
    rows = spark.createDataFrame([("a", 1), ("", 2), (None, 3)], "id string, n int")
    assert [tuple(r) for r in files.copied(rows, str(tmp_path / "copy")).collect()] == [("a", 1)]
    assert files.read_overrides(spark, str(tmp_path / "none")).count() == 0
    files.write_overrides(spark.createDataFrame([("x", "A"), ("x", "B"), ("y", "C")], "name string, school string"), str(tmp_path / "over"))
    assert sorted(map(tuple, files.read_overrides(spark, str(tmp_path / "over")).collect())) == [("x", "B"), ("y", "C")]
    (tmp_path / "gold.json").write_text('[{"q": "a", "n": 1}, {"q": "b"}]')
    assert [tuple(r) for r in files.golden_set(spark, str(tmp_path / "gold.json"), "q string, n int").collect()] == [("a", 1), ("b", None)]
    assert one(spark, files.origins(F.lit("http://x, http://y"), ("http://y", "http://z"))) == ["http://x", "http://y", "http://z"]
    assert one(spark, text.truncated(F.array(*map(F.lit, range(5))), 3)) == [0, 1, 2] and one(spark, urls.is_junk(F.lit("http://a/calendar"), ("calendar",))) and not one(spark, urls.is_junk(F.lit("x")))

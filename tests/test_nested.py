"""JSON of unknown depth against plain recursion."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from admitlake.functions import text
from admitlake.sources import files, grades, nested


def made(draw, depth=0):
    """A value with the keys that matter at any depth, and noise."""
    if depth > 6 or draw.random() < 0.15:
        return draw.choice([None, True, 0, 3, 4.5, "", "A-", "b", '{"rank": 9}', "45%", "$21,500", "12:1", "Rural"])
    if draw.random() < 0.3:
        return [made(draw, depth + 1) for _ in range(draw.randint(0, 4))]
    names = ["overallGrade", "rank", "rankValue", "rating", "stars", "reviewCount", "label", "name", "value", "grade", "setting", "acceptanceRate", "netPriceAvg", "greekLife", "zeta", "alpha", "ké y", "a.b", "graduationRate"]
    chosen = draw.sample(names, draw.randint(1, 6))
    out = {}
    for n in chosen:
        out[n] = draw.choice(["Academics", " dorms ", "Setting", "Net Price", "graduation rate", "other", made(draw, depth + 1)]) if n in ("label", "name") else made(draw, depth + 1)
    return out


def said(obj, *names):
    for n in names:
        v = obj.get(n)
        if isinstance(v, str) and v or isinstance(v, (int, float)) and not isinstance(v, bool) and v:
            return str(v)
    return None


def percent(s):
    try:
        v = float(s.strip().replace("%", "").replace(",", "").replace("+", ""))
        return v / 100 if v > 1 else v
    except ValueError:
        return None


def cost(s):
    try:
        v = int(float(s.strip().replace("$", "").replace(",", "").replace("+", "").split("/")[0]))
        return v if v >= 100 else None
    except ValueError:
        return None


def looked_for(value):
    """Stats and grades by recursion in the order of the text."""
    stats, letters = {}, {}

    def label_said(label, raw):
        field = grades.NUMBER_FIELDS.get((label or "").lower().strip())
        if field is None or field in stats or raw is None:
            return
        if field in ("setting", "religious_affiliation"):
            v = raw.strip() or None
        else:
            v = cost(raw) if field == "avg_annual_cost" else float(raw.split(":")[0].replace(",", "")) if field == "student_faculty_ratio_niche" else percent(raw)
        if v is not None:
            stats[field] = v

    def walk(v):
        if isinstance(v, list):
            for x in v:
                walk(x)
        if not isinstance(v, dict):
            return
        g = said(v, "overallGrade", "overall_grade")
        if g and re.match(r"^[A-F][+-]?$", g.strip()):
            stats.setdefault("overall_grade", g.strip().upper())
        for names, field, fine in ((nested.RANKS, "niche_rank", lambda x: x > 0), (nested.RATINGS, "avg_rating", lambda x: 1 <= x <= 5), (nested.REVIEWS, "review_count", lambda x: x > 0)):
            for n in names:
                x = v.get(n)
                if isinstance(x, (int, float)) and not isinstance(x, bool) and fine(x):
                    stats.setdefault(field, float(x) if field == "avg_rating" else int(x))
                    break
        label_said(said(v, "label", "name", "title"), said(v, "value", "displayValue", "formattedValue"))
        for k in sorted(v):
            x, low = v[k], k.lower()
            if isinstance(x, (dict, list)) or x is None:
                continue
            raw = json.dumps(x) if not isinstance(x, str) else x
            label = "acceptance rate" if "acceptancerate" in low else "net price" if "netprice" in low else "graduation rate" if "graduationrate" in low else "setting" if low == "setting" and isinstance(x, str) else "greek life" if "greek" in low else None
            if label:
                label_said(label, raw)
        field, letter = grades.GRADE_FIELDS.get((said(v, "label", "name", "title", "category") or "").lower().strip()), said(v, "grade", "letterGrade", "overallGrade", "value")
        if field and letter and re.match(r"^[A-F][+-]?$", letter.strip()):
            letters[field] = letter.strip().upper()
        for x in v.values():
            walk(x)

    walk(value)
    return stats, letters


def test_found_at_any_depth(spark):
    draw = random.Random(3)
    values = [made(draw) for _ in range(400)]
    deep = {"rank": 7}
    for k in range(18):
        deep = {"x": deep} if k % 2 else [deep]
    values += [deep, {"a": [{"b": [deep]}]}, [], {}, {"rank": "5", "b": {"rank": 2}}]
    rows = [(i, json.dumps(v, ensure_ascii=bool(i % 2))) for i, v in enumerate(values)] + [(9000, None), (9001, "{broken"), (9002, '{"a":1,"a":{"rank":3}}'), (9003, "")]
    walk = nested.walked(spark.createDataFrame(rows, "id int, t string").repartition(3), "id", "t")
    walk.persist()
    stats, letters = {}, {}
    for r in nested.stats_found(walk, "id").collect():
        stats.setdefault(r["id"], {})[r["field"]] = r["text"] if r["number"] is None else r["number"]
    for r in nested.grades_found(walk, "id").collect():
        letters.setdefault(r["id"], {})[r["field"]] = r["grade"]
    for i, v in enumerate(values):
        want = looked_for(v) if i != len(values) - 4 else ({}, {})  # one lies deeper than the search goes
        assert (stats.get(i, {}), letters.get(i, {})) == (pytest.approx(want[0]) if all(not isinstance(x, str) for x in want[0].values()) else want[0], want[1]), (i, json.dumps(v))
    assert stats[400] == {"niche_rank": 7} and not {9000, 9001, 9003} & stats.keys()
    walk.unpersist()


PLOT = {"units": ["GPA", "SAT/ACT"], "attributes": ["Decision"], "attributeValues": [["Accepted", "Rejected"]], "points": [{"values": [0.9, 0.8], "attributes": [0]}, {"values": [0.5, 0.7], "attributes": [1]}]}
EMPTY = PLOT | {"points": []}


def test_plots_in_blocks(spark):
    block = lambda plot: {"template": nested.PLOT_BLOCK, "buckets": {"0": {"contents": [{"scatterplot": {"plot": plot}}]}}}
    rows = [
        (1, {"z": {"profile": {"blocks": [{"template": "Other"}, block(PLOT), block(EMPTY)]}}}), (2, {"blocks": [block(EMPTY)], "more": [[block(PLOT)]]}), (3, {"blocks": [{"template": "Other", "plot": PLOT}]}), (4, {"plot": PLOT}),
        (5, [{"template": nested.PLOT_BLOCK, "plot": PLOT | {"points": [{"values": [0.25, 0.5], "attributes": [1]}]}}, block(PLOT)]),
    ]
    walk = nested.walked(spark.createDataFrame([(i, json.dumps(v)) for i, v in rows], "id int, t string"), "id", "t")
    found = {}
    for r in nested.points_found(walk, "id").collect():
        found.setdefault(r["id"], set()).add((r["gpa"], r["sat_score"], r["outcome"]))
    both = {(3.6, 1280.0, "accepted"), (2.0, 1120.0, "rejected")}
    assert found == {1: both, 2: both, 5: {(1.0, 800.0, "rejected")}}


def test_pages_by_json_and_else_by_text(spark):
    state = {"props": {"pageProps": {"blocks": [{"items": [{"label": "Academics", "grade": "A-"}, {"label": "Net Price", "value": "$18,000"}]}], "rank": 12}}}
    pages = [
        (1, f'<html><script id="__NEXT_DATA__" type="application/json">{json.dumps(state)}</script><p>Dorms: B</p></html>'), (2, "<p>Dorms: B</p> Acceptance Rate 45%"), (3, None), (4, "<p>nothing</p>"),
    ]
    found = {r["id"]: r for r in nested.profiles(spark.createDataFrame(pages, "id int, html string"), "id", "html").collect()}
    assert found[1]["grades"] == {"academics": "A-"} and found[1]["numbers"] == {"avg_annual_cost": 18000.0, "niche_rank": 12.0}
    assert found[2]["grades"] == {"dorms": "B"} and found[2]["numbers"] == {"acceptance_rate_niche": 0.45}
    assert found.keys() == {1, 2, 3, 4} and not found[4]["grades"] and not found[4]["numbers"] and not found[4]["points"]


def test_labels_and_embedded_text_are_made_once(spark):
    assert str(grades.number_of(F.col("lbl"), F.col("raw"))).count("lbl") == 1
    assert str(nested._by_key(F.col("lbl"), F.col("v"))).count("lbl") == 1
    assert str(files.embedded_state(F.col("page"))).count("page") == 2
    texts = [(1, ' \n{"a": {"rank": 3}}'), (2, '"[1]"'), (3, "7"), (4, '{"a": "{}", "b": "[]"}'), (5, "{broken")]
    walk = nested.walked(spark.createDataFrame(texts, "id int, t string"), "id", "t").select("id", "path", "is_list").collect()
    assert sorted((r["id"], r["path"], r["is_list"]) for r in walk) == [(1, [], False), (1, [0], False), (4, [], False)]

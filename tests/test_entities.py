"""Schools in questions against plain loops over every alias, name and run of words."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from admitlake.operators import entities

NAMES = [
    "University of Michigan - Ann Arbor", "Michigan State University", "Duke University", "Stanford University", "Texas A&M University", "University of California - Berkeley", "Ohio State University",
    "Lewis University", "Rice University", "University of Texas - Austin", "Boston College", "Boston University", "Arizona State University", "Penn",
]
ALIASES = {"mit": "Massachusetts Institute of Technology", "u of m": "University of Michigan - Ann Arbor", "duke": "Duke University", "a&m": "Texas A and M University", "bu": "Boston University", "university of michigan": "University of Michigan - Ann Arbor"}
QUESTIONS = [
    "MIT vs duke, or Stanford University?", "tell me about univ of mich", "Stanfrod University admit rate", "summit hike, bu", None, "", "   ", "texas a m university please", "ohio state or mit or MIT",
    "university of california berkeley", "ariz state and U mich and penn mass ok", "boston colege vs bostn university vs rice universty", "Duke University DUKE duke", "I live in CA TX or nc, state u",
    "mit duke bu stanford university rice university lewis university ohio state university", "a&m", "Universities of Lewis", "état u of m é",
]


def swapped(text, table, spaced):
    keys = sorted(table, key=len, reverse=True)
    out, at = "", 0
    while at < len(text):
        for key in keys:
            whole = f" {key} " if spaced else key
            piece = text[at : at + len(whole)]
            same = piece.lower() == whole if spaced else piece == whole and text[at - 1 : at] == " " and text[at + len(whole) : at + len(whole) + 1] == " "
            if same:
                out += f" {table[key]} " if spaced else table[key]
                at += len(whole)
                break
        else:
            out += text[at]
            at += 1
    return out


def expanded(text):
    out = swapped(swapped(f" {text} ", entities.STATE_WORDS, True), entities.STRUCTURE, True)
    return swapped(swapped(out, entities.STATES, False), {k.lower(): v for k, v in entities.STATES.items() if k.lower() not in entities.COMMON_WORDS}, False).strip(" ")


def bare(text):
    return re.sub(" {2,}", " ", re.sub("[^a-zA-Z0-9 ]+", " ", text)).strip(" ")


def like(a, b):
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for k, y in enumerate(b):
            row.append(last[k] + 1 if x == y else max(last[k + 1], row[k]))
    return 200 * row[-1] / (len(a) + len(b)) if a and b else 0


def matched(text, pairs):
    low, found, spans = text.lower(), [], []

    def free(a, b):
        return all(b <= s or a >= e for s, e in spans)

    def put(name, a, b):
        if name.lower() not in [n.lower() for n in found]:
            found.append(name)
        spans.append((a, b))

    at = 0
    while at < len(low):
        for alias in sorted(ALIASES, key=lambda k: (-len(k), k)):
            if low.startswith(alias, at) and not re.match("[a-z]", low[at - 1 : at] if at else "") and not re.match("[a-z]", low[at + len(alias) :]):
                put(ALIASES[alias], at, at + len(alias))
                at += len(alias) - 1
                break
        at += 1
    for key, name in sorted(pairs.items(), key=lambda p: (-len(p[0]), p[1])):
        k = low.find(key.lower())
        if k >= 0 and free(k, k + len(key)):
            put(name, k, k + len(key))
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", low)]
    for n in range(min(7, len(words)), 0, -1):
        for i in range(len(words) - n + 1):
            a, b = words[i][0], words[i + n - 1][1]
            if free(a, b):
                run = " ".join(low[s:e] for s, e in words[i : i + n])
                best = max(((like(run, key.lower()), [-ord(c) for c in name], name) for key, name in pairs.items()), default=(0, [], None))
                if best[0] >= 85 and best[2].lower() not in [x.lower() for x in found]:
                    put(best[2], a, b)
    return found


def extracted(text):
    found = matched(text, {n: n for n in NAMES})
    again = expanded(bare(text))
    if again != text:
        found += [n for n in matched(again, {bare(n): n for n in reversed(sorted(NAMES))}) if n.lower() not in [f.lower() for f in found]]
    return found[:5]


def test_schools_in_questions(spark):
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    aliases = spark.createDataFrame(list(ALIASES.items()), "alias string, name string")
    questions = spark.createDataFrame(list(enumerate(QUESTIONS)), "question_id long, text string").repartition(3)
    found: dict[int, list[str]] = {}
    for r in entities.extracted(questions, aliases, names).orderBy("question_id", "place").collect():
        found.setdefault(r["question_id"], []).append(r["name"])
    assert found == {k: x for k, q in enumerate(QUESTIONS) if q and (x := extracted(q))}
    assert entities.extracted(questions.limit(0), aliases, names).count() == 0
    assert entities.extracted(questions, aliases.limit(0), names.limit(0)).count() == 0


def test_shorthand(spark):
    texts = ["U mich", "ariz state", "CA TX CA", "u of ca berkeley", "penn mass penn", "or in me OR IN", "uni univ u", "STATE", "", "state state", "va VA Va"]
    got = [r["x"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(entities.expanded(F.col("t")).alias("x")).collect()]
    assert sorted(got) == sorted(expanded(t) for t in texts)


def test_aliases(spark):
    one = spark.createDataFrame([(" MIT ", "A"), ("x", "B"), ("", "C")], "alias string, name string")
    two = spark.createDataFrame([("mit", "D"), ("y", "E"), (None, "F")], "alias string, name string")
    assert sorted(map(tuple, entities.merged_aliases(one, two).collect())) == [("mit", "A"), ("x", "B"), ("y", "E")]
    schools = spark.createDataFrame([("A", "a, b ,", 10.0), ("B", "b,c", 20.0), ("C", None, 5.0), ("D", "d", None)], "name string, aliases string, size double")
    assert sorted(map(tuple, entities.listed_aliases(schools).collect())) == [("a", "A"), ("b", "B"), ("c", "B"), ("d", "D")]
    assert sorted(map(tuple, entities.listed_aliases(schools, 2).collect())) == [("a", "A"), ("b", "B"), ("c", "B")]

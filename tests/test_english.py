"""Stems against the published algorithm written as plain steps over letters."""

from __future__ import annotations

import re

import pytest
from conftest import LARGER
from pyspark.sql import functions as F

from admitlake.functions import english

#: Pairs from the description of the algorithm.
KNOWN = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat",
    "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat",
    "conditional": "condit", "rational": "ration", "valenci": "valenc", "digitizer": "digit", "conformabli": "conform", "radicalli": "radic", "differentli": "differ", "vileli": "vile", "analogousli": "analog",
    "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit",
    "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "formalize": "formal", "electriciti": "electr", "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow",
    "inference": "infer", "airliner": "airlin", "gyroscopic": "gyroscop", "adjustable": "adjust", "defensible": "defens", "irritant": "irrit", "replacement": "replac", "adjustment": "adjust", "dependent": "depend",
    "adoption": "adopt", "homologou": "homolog", "communism": "commun", "activate": "activ", "angulariti": "angular", "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate",
    "cease": "ceas", "controll": "control", "roll": "roll", "universities": "univers", "studying": "studi", "yes": "ye", "yoyoing": "yoyo", "is": "is", "ms": "ms", "a1ing": "a1ing", "": "",
}


def plain(word: str) -> str:
    if not re.fullmatch("[a-z]{3,}", word):
        return word

    def consonant(w: str, i: int) -> bool:
        return w[i] not in "aeiou" and (w[i] != "y" or i == 0 or not consonant(w, i - 1))

    def measure(w: str) -> int:
        kinds = "".join("c" if consonant(w, i) else "v" for i in range(len(w)))
        return len(re.findall("v+c+", kinds))

    def vowel(w: str) -> bool:
        return any(not consonant(w, i) for i in range(len(w)))

    def double(w: str) -> bool:
        return len(w) > 1 and w[-1] == w[-2] and consonant(w, len(w) - 1)

    def short(w: str) -> bool:
        n = len(w)
        return n > 2 and consonant(w, n - 1) and not consonant(w, n - 2) and consonant(w, n - 3) and w[-1] not in "wxy"

    def longest(w: str, endings) -> str | None:
        return max((e for e in endings if w.endswith(e) and len(w) > len(e)), key=len, default=None)

    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    elif (e := longest(w, ("ed", "ing"))) and vowel(w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif measure(w) == 1 and short(w):
            w += "e"
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (english.STEP_2, english.STEP_3):
        if (e := longest(w, rules)) and measure(w[: -len(e)]) > 0:
            w = w[: -len(e)] + rules[e]
    e = longest(w, (*english.STEP_4, "ion"))
    if e and measure(w[: -len(e)]) > 1 and (e != "ion" or w[-4] in "st"):
        w = w[: -len(e)]
    if w.endswith("e") and (measure(w[:-1]) > 1 or measure(w[:-1]) == 1 and not short(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and measure(w) > 1:
        w = w[:-1]
    return w


def stems(spark, found):
    table = spark.createDataFrame([(w,) for w in found], "w string").repartition(4)
    return dict(map(tuple, table.select("w", english.stem(F.col("w")).alias("s")).collect()))


def test_known_words(spark):
    assert stems(spark, KNOWN) == KNOWN and {w: plain(w) for w in KNOWN} == KNOWN
    assert spark.range(1).select(english.stem(F.lit(None).cast("string"))).first()[0] is None


def test_words_of_the_tables_and_made_up_ones(spark):
    rows = spark.read.parquet(f"{LARGER}/documents.parquet").select(F.explode(english.words(F.col("text"))).alias("w")).distinct().collect()
    parts = ["y", "s", "b", "t", "oo", "ay", "e", "ll", "x", "str", "i", "yy"]
    ends = ["", "s", "ed", "ing", "eed", "y", "e", "ll", "ion", *english.STEP_2, *english.STEP_3, *english.STEP_4]
    made = {a + b + c + e for a in parts for b in parts for c in parts for e in ends}
    words = {r["w"] for r in rows} | made
    found = stems(spark, words)
    assert found == {w: plain(w) for w in words}


@pytest.mark.parametrize("text", ["The CATS, and the dogs' 2nd", None, "", "the of"])
def test_words_without_stop_words(spark, text):
    want = [w for w in re.split("[^a-z0-9]+", (text or "").lower()) if w and w not in english.STOP_WORDS]
    assert spark.createDataFrame([(text,)], "t string").select(english.words(F.col("t"))).first()[0] == want

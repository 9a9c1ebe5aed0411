"""Schools named in questions: aliases, whole names, and names nearly spelt, found by equi-joins on pieces of the text.

Aliases are looked up by joining every piece of a question that starts and ends at a letter's border;
names by joining on their first letters and comparing the rest. Of a question's matches, few and
bounded by its length, a small fold keeps those that do not overlap, in the order that decides.
"""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..storage import written

#: Schools that a question may name; letters that names are joined by; words of a nearly spelt name, and its least likeness.
MOST, HEAD, WORDS, LEAST = 5, 6, 7, 85.0
#: Pairs of letters, the most frequent in names, that are put last in the order; it only saves comparisons.
OFTEN = 100

# Words that stand for a state's name, and for parts of a university's name.
STATE_WORDS = {
    "ariz": "arizona", "cal": "california", "cali": "california", "colo": "colorado", "col": "colorado", "conn": "connecticut", "del": "delaware", "mass": "massachusetts",
    "mich": "michigan", "minn": "minnesota", "neb": "nebraska", "okla": "oklahoma", "penn": "pennsylvania", "tenn": "tennessee", "tex": "texas", "wisc": "wisconsin",
}
STRUCTURE = {"u of": "university of", "u": "university of", "uni": "university", "univ": "university", "state": "state university"}
# Codes of states. In lower case, those that are common words do not count.
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware", "FL": "Florida", "GA": "Georgia",
    "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland",
    "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire",
    "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania",
    "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington",
    "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
}
COMMON_WORDS = ("or", "in", "me", "hi", "ok", "id", "la")


def _swapped(text: Column, table: dict[str, str], spaced: bool, any_case: bool) -> Column:
    """text with each key between spaces replaced, in one pass from the left; with `spaced`, a match takes its spaces with it."""
    keys = "|".join(sorted(table, key=len, reverse=True))
    mode = "(?i)" if any_case else ""
    found = F.regexp_extract_all(text, F.lit(f"{mode} (?:{keys}) " if spaced else f"{mode}(?<= )(?:{keys})(?= )"), F.lit(0))
    between = F.split(text, f"{mode} (?:{keys}) " if spaced else f"{mode}(?<= )(?:{keys})(?= )")
    words = F.create_map(*[F.lit(x) for item in table.items() for x in item])

    def put(m: Column) -> Column:
        word = F.trim(F.lower(m) if any_case else m)
        new = F.try_element_at(words, word)
        return F.concat(F.lit(" "), new, F.lit(" ")) if spaced else new

    return F.array_join(F.zip_with(between, F.transform(found, put), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def expanded(text: Column) -> Column:
    """text with shorthand written out: states' words, then parts of universities' names, then codes of states."""
    out = F.concat(F.lit(" "), text, F.lit(" "))
    out = _swapped(_swapped(out, STATE_WORDS, True, True), STRUCTURE, True, True)
    lower = {k.lower(): v for k, v in STATES.items() if k.lower() not in COMMON_WORDS}
    return F.trim(_swapped(_swapped(out, STATES, False, False), lower, False, False))


def without_punctuation(text: Column) -> Column:
    """Letters, digits and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[^a-zA-Z0-9 ]+", " "), " {2,}", " "))


def merged_aliases(*sources: DataFrame) -> DataFrame:
    """(alias, name) of several sources of aliases: of an alias in more than one, the first source's."""
    every = reduce(DataFrame.unionByName, [s.select(F.lower(F.trim("alias")).alias("alias"), "name").withColumn("_source", F.lit(k)) for k, s in enumerate(sources)])
    return every.where("alias <> ''").groupBy("alias").agg(F.min_by("name", F.struct("_source", "name")).alias("name"))


def listed_aliases(schools: DataFrame, most: int = 1000) -> DataFrame:
    """(alias, name) of the `most` largest schools (name, aliases: comma-separated, size): of an alias of several, the largest school's."""
    first = schools.where("aliases is not null and aliases <> ''").orderBy(F.desc_nulls_last("size"), "name").limit(most)
    rows = first.select("name", "size", F.explode(F.split("aliases", ",")).alias("alias")).select("name", "size", F.lower(F.trim("alias")).alias("alias"))
    return rows.where("alias <> ''").groupBy("alias").agg(F.min_by("name", F.struct((-F.coalesce("size", F.lit(-1.0))).alias("size"), F.col("name"))).alias("name"))


def alias_matches(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """(question_id, start, end, name): aliases in a question's text, with no letter a-z at either side, the longest from the left."""
    longest = aliases.agg(F.max(F.length("alias"))).first()[0] or 0
    low = questions.select("question_id", F.lower("text").alias("low")).where("low is not null")
    every = F.sequence(F.lit(1), F.length("low"))
    starts = F.filter(every, lambda k: ~(F.substring(F.col("low"), F.greatest(k - 1, F.lit(1)), F.lit(1)).rlike("[a-z]") & (k > 1)))
    begun = low.where(F.length("low") > 0).select("question_id", "low", F.explode(starts).alias("start"))
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.length("low") - F.col("start") + 1))
    ends = F.filter(sizes, lambda n: ~F.substring(F.col("low"), F.col("start") + n, F.lit(1)).rlike("^[a-z]"))
    pieces = begun.select("question_id", "start", F.explode(F.transform(ends, lambda n: F.substring(F.col("low"), F.col("start"), n))).alias("alias"))
    found = pieces.join(F.broadcast(aliases) if aliases.count() <= 100_000 else aliases, "alias")
    found = found.select("question_id", (F.col("start") - 1).alias("start"), (F.col("start") - 1 + F.length("alias")).alias("end"), "name")
    return _apart(found, F.struct("start", (-F.col("end")).alias("e"), "end", "name"))


def name_matches(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(question_id, start, end, name) of names (key, name) that stand in a question, each at its first place.

    A name is looked for by the run of HEAD letters in it that the fewest names have, so that common words of
    names bring no question together with all of them; a shorter name by the whole of it.
    """
    low = questions.select("question_id", F.lower("text").alias("low")).where("low <> ''")
    known = written(names.select(F.lower("key").alias("key"), "name").where("key <> ''").distinct())
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("key") - HEAD + 1, F.lit(1))), lambda k: F.substring(F.col("key"), k, F.lit(HEAD))))
    every = known.select("key").distinct().select("key", F.explode(runs).alias("head"))
    often = every.groupBy("head").agg(F.count(F.lit(1)).alias("n"))
    rarest = every.join(often, "head").groupBy("key").agg(F.min(F.struct("n", "head"))["head"].alias("head"))
    heads = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("low")), lambda k: F.transform(F.sequence(F.lit(1), F.lit(HEAD)), lambda n: F.substring(F.col("low"), k, n)))))
    found = low.select("question_id", "low", F.explode(heads).alias("head")).join(rarest.join(known, "key"), "head")
    start = F.instr("low", F.col("key")) - 1
    return found.where(start >= 0).select("question_id", start.alias("start"), (start + F.length("key")).alias("end"), "name")


def _apart(found: DataFrame, order: Column, taken: DataFrame | None = None, once: bool = False) -> DataFrame:
    """Of each question's matches those that overlap none before them in the order, and no span already taken.

    once: a name that is already among them is passed over, and its span stays free.
    """
    kind = "array<struct<start:int,end:int,name:string,at:int>>"
    rows = found.groupBy("question_id").agg(F.array_sort(F.collect_set(order)).alias("m"))
    before = F.array().cast(kind)
    if taken is not None:
        spans = taken.groupBy("question_id").agg(F.collect_list(F.struct("start", "end", "name", "at")).cast(kind).alias("t"))
        rows = rows.join(spans, "question_id", "left")
        before = F.coalesce(F.col("t"), before)

    def clear(m: Column, spans: Column) -> Column:
        other = ~F.exists(spans, lambda s: ~((m["end"] <= s["start"]) | (m["start"] >= s["end"])))
        return other & ~F.exists(spans, lambda s: F.lower(s["name"]) == F.lower(m["name"])) if once else other

    def keep(state: Column, m: Column) -> Column:
        new = F.struct(m["start"].cast("int").alias("start"), m["end"].cast("int").alias("end"), m["name"].alias("name"), F.size(state).alias("at"))
        return F.when(clear(m, state) & clear(m, before), F.concat(state, F.array(new))).otherwise(state)

    kept = F.aggregate("m", F.array().cast(kind), keep)
    return rows.select("question_id", F.inline(kept))


def _like(a: str, b: str) -> float:
    """100 for texts whose sorted words are equal, less by the share of letters that are not common to both in order."""
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    if not a or not b:
        return 0.0
    at: dict[str, int] = {}
    for k, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << k
    row = full = (1 << len(a)) - 1
    for y in b:
        both = row & at.get(y, 0)
        row = (row + both | row - both) & full
    return 200.0 * (full & ~row).bit_count() / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Of each pair of texts, by the longest common subsequence of their sorted words."""
    return pd.Series([_like(x, y) for x, y in zip(a, b)], dtype="float64")


def alike_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(run, key, score): texts of left (run) and right (key), both of sorted words, whose likeness is `least` or more.

    Texts that are alike enough differ by few letters, and each letter that is left out spoils two pairs of
    neighbours, each put in one. So of the distinct pairs, the rarest on the right first, one more than may be spoilt
    hold one that both texts have: the sides are joined on these, and only what meets is compared.
    """
    share = least / 200.0
    shorter = share / (1 - share)
    spoilt = 2 - 3 * share + max(0.0, 1 - 3 * share) / shorter + min(0.0, 1 - 3 * share) * shorter

    def pairs_of(text: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda k: F.substring(text, k, F.lit(2))))

    often = right.select(F.explode(pairs_of(F.col("key"))).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p").limit(OFTEN).collect()
    places = F.from_json(F.lit(json.dumps({r["p"]: len(often) - k for k, r in enumerate(often)})), "map<string,int>")

    def pieces(text: Column) -> Column:
        placed = F.transform(pairs_of(text), lambda p: F.struct(F.coalesce(F.try_element_at(places, p), F.lit(0)).alias("often"), p.alias("p")))
        lost = F.floor(spoilt * F.length(text) + 1e-9).cast("int")
        return F.concat(F.array(F.concat(F.lit("="), text)), F.transform(F.slice(F.sort_array(placed), 1, lost + 1), lambda s: s["p"]))

    sizes = right.agg(F.min(F.length("key")).alias("low"), F.max(F.length("key")).alias("high")).first()
    within = (F.length("run") >= shorter * (sizes["low"] or 0) - 1e-9) & (F.length("run") <= (sizes["high"] or 0) / shorter + 1e-9)
    a = left.select("run").where(within).distinct().select("run", F.explode(pieces(F.col("run"))).alias("piece"))
    b = right.select("key").distinct().select("key", F.explode(pieces(F.col("key"))).alias("piece"))
    la, lb = F.length("run"), F.length("key")
    pairs = a.join(b, "piece").where(F.least(la, lb) >= (share - 1e-9) * (la + lb)).select("run", "key").distinct()
    return pairs.withColumn("score", likeness("run", "key")).where(F.col("score") >= least)


def near_matches(questions: DataFrame, names: DataFrame, least: float = LEAST) -> DataFrame:
    """(question_id, start, end, words, place, name): runs of one to WORDS words that are nearly a name, with the most like name, of equals the first."""
    low = questions.select("question_id", F.lower("text").alias("low")).where("low is not null")
    low = low.withColumn("words", F.regexp_extract_all("low", F.lit(r"\S+"), F.lit(0)))
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("at"))

    def step(s: Column, w: Column) -> Column:
        at = F.call_function("locate", w, F.col("low"), s["next"])
        return F.struct((at + F.length(w)).alias("next"), F.concat(s["at"], F.array(at - 1)).alias("at"))

    low = low.withColumn("at", F.aggregate("words", start, step)["at"])
    n_words = F.size("words")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.least(n_words, F.lit(WORDS))), lambda n: F.transform(F.sequence(F.lit(0), n_words - n), lambda i: F.struct(i.alias("i"), n.alias("n")))))
    runs = low.where(n_words > 0).select("question_id", "words", "at", F.explode(runs).alias("r"))
    last = F.col("r.i") + F.col("r.n") - 1
    said = F.slice("words", F.col("r.i") + 1, F.col("r.n"))
    runs = runs.select(
        "question_id", F.get("at", F.col("r.i")).alias("start"), (F.get("at", last) + F.length(F.get("words", last))).alias("end"), F.col("r.n").alias("words"), F.col("r.i").alias("place"),
        F.array_join(F.array_sort(said), " ").alias("run"),
    )
    known = names.select(F.array_join(F.array_sort(F.split(F.lower(F.trim("key")), " +")), " ").alias("key"), "name").where("key <> ''").distinct()

    known = written(known)
    alike = alike_pairs(runs.select("run"), known.select("key"), least)
    best = alike.join(known, "key").groupBy("run").agg(F.min_by("name", F.struct((-F.col("score")).alias("s"), F.col("name"))).alias("name"))
    return runs.join(best, "run").select("question_id", "start", "end", "words", "place", "name")


def _matched(questions: DataFrame, aliases: DataFrame, names: DataFrame) -> DataFrame:
    """(question_id, stage, at, name) of one pass: aliases, then names, longest first, then names nearly spelt, the longest run first."""
    first = written(alias_matches(questions, aliases))
    order = F.struct((F.col("start") - F.col("end")).alias("longest"), "name", "start", "end")
    second = written(_apart(name_matches(questions, names), order, first))
    taken = first.unionByName(second)
    order = F.struct((-F.col("words")).alias("longest"), "place", "start", "end", "name")
    third = _apart(near_matches(questions, names), order, taken, once=True)
    return reduce(DataFrame.unionByName, [d.select("question_id", F.lit(k).alias("stage"), "at", "name") for k, d in enumerate((first, second, third))])


def extracted(questions: DataFrame, aliases: DataFrame, names: DataFrame, most: int = MOST) -> DataFrame:
    """(question_id, place, name): the schools that each question (question_id, text) names, each once, `most` of them.

    aliases: (alias, name); names: (name). Two passes: over the text as it is, then over the text without
    punctuation and with shorthand written out, against names without punctuation; what the first
    finds comes first. Null and empty questions name none.
    """
    plain = names.select(F.col("name").alias("key"), "name").where("trim(name) <> ''").distinct()
    bare = plain.groupBy(without_punctuation(F.col("name")).alias("key")).agg(F.min("name").alias("name"))
    again = questions.select("question_id", expanded(without_punctuation(F.col("text"))).alias("text"), F.col("text").alias("_old")).where(F.col("text") != F.col("_old")).drop("_old")
    every = _matched(questions, aliases, plain).withColumn("pass", F.lit(1)).unionByName(_matched(again, aliases, bare).withColumn("pass", F.lit(2)))
    once = every.groupBy("question_id", F.lower("name").alias("_key")).agg(F.min(F.struct("pass", "stage", "at", "name")).alias("f"))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("f"))
    return once.withColumn("place", place).where(F.col("place") <= most).select("question_id", "place", F.col("f.name").alias("name"))

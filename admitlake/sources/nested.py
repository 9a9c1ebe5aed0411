"""Search of JSON whose shape nobody knows: its objects and lists as rows, level by level, and what profile pages hide in them."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import held
from ..storage import shared_dir, written
from .files import embedded_state
from .grades import GRADE_FIELDS, PLOT, grades_in, number_of, numbers_in, plotted_points

#: How deep a value is searched; how deep lists of blocks may lie.
DEPTH, BLOCK_DEPTH = 20, 15
# Keys that hold a rank, a rating, a count of reviews; the block of a plot; which key stands for which number.
RANKS = ("nationalRank", "national_rank", "rank", "rankValue")
RATINGS = ("rating", "averageRating", "overallRating", "stars", "starRating")
REVIEWS = ("reviewCount", "review_count", "totalReviews", "numReviews")
PLOT_BLOCK = "BlockScatterplot"
KEY_PARTS = (
    (("acceptancerate", "admissionsrate"), "acceptance rate"), (("netprice", "annualcost", "avgcost"), "average annual cost"), (("graduationrate",), "graduation rate"), (("studentfaculty", "facultyratio"), "student faculty ratio"),
)
MORE_KEY_PARTS = ((("oncampus", "livingoncampus"), "students on campus"), (("greek",), "greek life"))
_LETTER = r"^[A-F][+-]?$"


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_container(v: Column) -> Column:
    return F.coalesce(_kind(v).rlike("^(OBJECT|ARRAY)<"), F.lit(False))


def walked(docs: DataFrame, key: str, json: str, depth: int = DEPTH) -> DataFrame:
    """(key, path, is_list, node, block): every object and list in the JSON texts, down to `depth` steps below the whole.

    path holds the places on the way, in the order of the text, so sorting by it is the order in which a reader
    meets them. node is the value as a VARIANT. block is the path of the outermost list around it (itself among
    them) that holds an object whose template is PLOT_BLOCK. Null, malformed and bare values, and objects
    that repeat a key, give no rows. Each level is written in the shared folder, and the last empty one ends it.
    """
    own_block = F.exists(F.col("node").try_cast("array<variant>"), lambda v: F.coalesce(F.try_variant_get(v, "$.template", "string") == PLOT_BLOCK, F.lit(False)))

    def marked(df: DataFrame) -> DataFrame:
        df = df.withColumns({"node": F.try_parse_json("text"), "is_list": F.col("text").startswith("[")})
        here = F.when(F.col("is_list") & (F.size("path") <= BLOCK_DEPTH), F.when(own_block, F.col("path")))
        return df.withColumn("block", F.coalesce(F.col("block"), here)) if "block" in df.columns else df.withColumn("block", here)

    spark = docs.sparkSession
    base = f"{shared_dir(spark)}/walk-{uuid.uuid4().hex}"

    def kept(df: DataFrame, at: int) -> DataFrame:
        df.write.parquet(f"{base}/level={at}")
        return spark.read.schema(df.schema).parquet(f"{base}/level={at}")

    # Explode keeps the text from being made again for the filter and each column; below the whole, what is a container by its value needs no filter.
    whole = docs.select(key, F.explode(F.array(F.col(json))).alias("text")).select(key, F.inline(F.array(F.struct("text", F.try_parse_json("text").alias("sound")))))
    level = kept(marked(whole.where("sound is not null").where(F.col("text").rlike(r"^\s*[\[{]")).select(key, F.array().cast("array<int>").alias("path"), F.regexp_replace("text", r"^\s+", "").alias("text"))), 0)
    schema = level.schema
    members = F.from_json("text", "map<string,string>")
    inner = F.map_keys(F.map_filter(F.col("node").try_cast("map<string,variant>"), lambda _, v: _is_container(v)))
    in_object = F.filter(F.transform(F.map_entries(members), lambda e, i: F.struct(i.alias("at"), e["key"].alias("name"), e["value"].alias("text"))), lambda s: F.array_contains(F.col("inner"), s["name"]))
    in_list = F.filter(F.transform(F.from_json("text", "array<string>"), lambda t, i: F.struct(i.alias("at"), F.lit("").alias("name"), t.alias("text"))), lambda s: F.get(F.col("sound"), s["at"]))
    sound = F.transform(F.col("node").try_cast("array<variant>"), _is_container)
    for at in range(1, depth + 1):
        objects = level.where("not is_list").withColumn("inner", inner).select(key, "path", "block", F.explode(in_object).alias("c"))
        lists = level.where("is_list").withColumn("sound", sound).select(key, "path", "block", F.explode(in_list).alias("c"))
        below = objects.unionByName(lists).select(key, F.concat("path", F.array(F.col("c.at").cast("int"))).alias("path"), F.col("c.text").alias("text"), "block")
        level = kept(marked(below), at)
        if level.isEmpty():
            break
    return spark.read.schema(schema).parquet(base).select(key, "path", "is_list", "node", "block")


def _number(node: Column, name: str) -> Column:
    """A member that is a number, and not a text of one."""
    at = F.try_variant_get(node, f"$['{name}']", "variant")
    return F.when(_kind(at).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(node, f"$['{name}']", "double"))


def _said(node: Column, *names: str) -> Column:
    """The first of the members that is a text which is not empty or a number other than 0, as text."""

    def one(at: Column) -> Column:
        text, zero = F.try_variant_get(at, "$", "string"), F.coalesce(F.try_variant_get(at, "$", "double") == 0, F.lit(False))
        return F.when(at.isNotNull(), held(_kind(at), lambda kind: F.when((kind == "STRING") | kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & ~zero, F.nullif(text, F.lit("")))))

    return F.coalesce(*[held(F.try_variant_get(node, f"$['{name}']", "variant"), one) for name in names])


def _first_number(node: Column, names: tuple[str, ...], fine) -> Column:
    return F.coalesce(*[F.when(fine(_number(node, n)), _number(node, n)) for n in names])


def _by_key(name: Column, value: Column) -> Column:
    """What a member of its own says by its name, as number_of gives it."""

    def label(low: Column) -> Column:
        fits = lambda words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
        says = F.when(F.lit(False), "")
        for words, said in KEY_PARTS:
            says = says.when(fits(words), said)
        is_text = _kind(value) == "STRING"
        says = says.when((low == "setting") & is_text, "setting").when(low.contains("religious") & is_text, "religious affiliation")
        for words, said in MORE_KEY_PARTS:
            says = says.when(fits(words), said)
        return says

    return held(held(F.lower(name), label), lambda says: F.when(says.isNotNull() & ~_is_container(value), number_of(says, F.try_variant_get(value, "$", "string"))))


def stats_found(walk: DataFrame, key: str) -> DataFrame:
    """(key, field, number, text): grade, rank, rating, count of reviews and labelled numbers, wherever the objects of a walk hold them; of several the first."""
    node, none = F.col("node"), F.lit(None)
    one = lambda field, number, text: F.struct(F.lit(field).alias("field"), number.cast("double").alias("number"), text.cast("string").alias("text"))
    grade = F.upper(F.trim(F.when(F.trim(_said(node, "overallGrade", "overall_grade")).rlike(_LETTER), _said(node, "overallGrade", "overall_grade"))))
    whole = [
        one("overall_grade", none, grade), one("niche_rank", F.floor(_first_number(node, RANKS, lambda v: v > 0)), none), one("avg_rating", _first_number(node, RATINGS, lambda v: v.between(1, 5)), none),
        one("review_count", F.floor(_first_number(node, REVIEWS, lambda v: v > 0)), none), number_of(_said(node, "label", "name", "title"), _said(node, "value", "displayValue", "formattedValue")),
    ]
    keys = F.map_entries(node.try_cast("map<string,variant>"))
    found = F.concat(F.array(*whole), F.transform(keys, lambda e: _by_key(e["key"], e["value"])))
    rows = walk.where("not is_list").select(key, "path", F.posexplode(found).alias("at", "s")).where("s is not null and (s.number is not null or s.text <> '')")
    return rows.groupBy(key, F.col("s.field").alias("field")).agg(F.min_by("s", F.struct("path", "at")).alias("s")).select(key, "field", "s.number", "s.text")


def grades_found(walk: DataFrame, key: str) -> DataFrame:
    """(key, field, grade): letter grades beside a category's label, wherever they lie; of several the last."""
    node = F.col("node")
    field = F.try_element_at(F.create_map(*[F.lit(x) for pair in GRADE_FIELDS.items() for x in pair]), F.lower(F.trim(_said(node, "label", "name", "title", "category"))))
    grade = F.trim(_said(node, "grade", "letterGrade", "overallGrade", "value"))
    rows = walk.where("not is_list").select(key, "path", field.alias("field"), grade.alias("grade")).where(F.col("field").isNotNull() & F.col("grade").rlike(_LETTER))
    return rows.groupBy(key, "field").agg(F.upper(F.max_by("grade", "path")).alias("grade"))


def points_found(walk: DataFrame, key: str) -> DataFrame:
    """(key, gpa, sat_score, outcome, major, residency): the points of the first block list that has any; of a list the first plot counts."""
    node = F.col("node")
    here = [F.try_variant_get(node, f"{at}", "variant") for at in ("$.plot", "$.scatterplot.plot")]
    has = [F.try_variant_get(node, f"{at}", "variant").isNotNull() for at in ("$.plot.points", "$.plot.units", "$.scatterplot.plot.points")]
    plot = F.when(has[0] & has[1], here[0]).when(has[2], here[1])
    rows = walk.where("not is_list and block is not null").select(key, "path", "block", F.to_json(plot).alias("plot")).where("plot is not null")
    first = rows.groupBy(key, "block").agg(F.min_by("plot", "path").alias("plot"))
    points = first.select(key, "block", plotted_points(F.from_json("plot", PLOT)).alias("points")).where(F.size("points") > 0)
    return points.groupBy(key).agg(F.min_by("points", "block").alias("points")).select(key, F.inline("points"))


def profiles(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, grades, numbers, texts, points): what each page says, as maps by field and an array of points.

    The page's embedded JSON is asked first; a page whose JSON names no grade is read for grades as text, one whose JSON
    names no number likewise. Every page has a row; what it does not say is empty.
    """
    state = pages.select(key, embedded_state(F.col(html)).alias("state"))
    walk = walked(state, key, "state")
    by_field = lambda df, value, name: df.where(F.col(value).isNotNull()).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", value)))).alias(name))
    stats = written(stats_found(walk, key))
    found = pages.select(key, html).join(by_field(grades_found(walk, key), "grade", "grades"), key, "left")
    found = found.join(by_field(stats, "number", "numbers"), key, "left").join(by_field(stats, "text", "texts"), key, "left")
    points = points_found(walk, key)
    found = found.join(points.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[c for c in points.columns if c != key]))).alias("points")), key, "left")
    told = F.map_filter(F.create_map(*[x for field, v in numbers_in(F.col(html)).items() for x in (F.lit(field), v)]), lambda _, v: v.isNotNull())
    nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return found.select(key, F.coalesce("grades", grades_in(F.col(html))).alias("grades"), F.coalesce("numbers", told).alias("numbers"), F.coalesce("texts", nothing).alias("texts"), F.coalesce("points", F.array().cast(found.schema["points"].dataType)).alias("points"))

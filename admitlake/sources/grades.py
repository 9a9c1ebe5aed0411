"""What a school's profile page says: letter grades, numbers, and applicant points, out of its HTML and JSON, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import held, outcome, parse_cost, parse_percent, parse_ratio, residency

# What the page calls each grade and each number, and the names of their fields.
GRADE_FIELDS = {
    "academics": "academics", "value": "value", "diversity": "diversity", "campus": "campus", "athletics": "athletics", "party scene": "party_scene", "professors": "professors",
    "location": "location", "dorms": "dorms", "campus food": "food", "student life": "student_life", "safety": "safety",
}
NUMBER_FIELDS = {
    "acceptance rate": "acceptance_rate_niche", "admissions rate": "acceptance_rate_niche", "average annual cost": "avg_annual_cost", "avg annual cost": "avg_annual_cost", "net price": "avg_annual_cost",
    "average net price": "avg_annual_cost", "graduation rate": "graduation_rate_niche", "4-year graduation rate": "graduation_rate_niche", "student faculty ratio": "student_faculty_ratio_niche",
    "student-faculty ratio": "student_faculty_ratio_niche", "setting": "setting", "campus setting": "setting", "religious affiliation": "religious_affiliation",
    "students on campus": "pct_students_on_campus", "percent of students on campus": "pct_students_on_campus", "students in fraternities": "pct_greek_life", "students in sororities": "pct_greek_life",
    "greek life": "pct_greek_life",
}
# How the page's own text gives each number, after its comments and remarks on national averages are out.
NUMBER_PATTERNS = (
    (r"[Aa]cceptance [Rr]ate[^0-9]{0,20}(\d[\d,.]+)\s*%", "acceptance_rate_niche", "percent"), (r"[Gg]raduation [Rr]ate[^0-9]{0,20}(\d[\d,.]+)\s*%", "graduation_rate_niche", "percent"),
    (r"[Ss]tudent[- ][Ff]aculty [Rr]atio[^0-9]{0,20}(\d[\d.]+)\s*:?\s*1", "student_faculty_ratio_niche", "ratio"), (r"[Aa]verage [Aa]nnual [Cc]ost[^$0-9]{0,10}\$?([\d,]+)", "avg_annual_cost", "cost"),
    (r"[Nn]et [Pp]rice[^$0-9]{0,10}\$?([\d,]+)", "avg_annual_cost", "cost"),
)
REMARKS = r"(?is)(national|average\s+(?:for|is)|around\s+\d|data.?source).{0,200}"

PLOT = "struct<units:array<string>,attributes:array<string>,attributeValues:array<array<string>>,points:array<struct<values:array<double>,attributes:array<int>>>>"


def numbers_in(html: Column) -> dict[str, Column]:
    """Numbers by field from a page's raw text; null where it has none. Of several patterns of a field the first counts."""
    clean = F.regexp_replace(F.regexp_replace(html, r"<!--.*?-->", ""), REMARKS, "")
    parse = {"percent": parse_percent, "ratio": parse_ratio, "cost": lambda c: parse_cost(c).cast("double")}
    out: dict[str, Column] = {}
    for pattern, field, kind in NUMBER_PATTERNS:
        value = parse[kind](F.nullif(F.regexp_extract(clean, pattern, 1), F.lit("")))
        out[field] = F.coalesce(out[field], value) if field in out else value
    return out


def grades_in(html: Column) -> Column:
    """A map from field to letter grade, from a page's raw text."""
    pairs = []
    for label, field in GRADE_FIELDS.items():
        letter = F.upper(F.regexp_extract(html, rf"(?i){label}[^A-Za-z0-9]{{0,50}}(?<![A-Za-z])([A-F][+-]?)(?![A-Za-z0-9])", 1))
        pairs.append(F.struct(F.lit(field).alias("field"), F.nullif(letter, F.lit("")).alias("grade")))
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["grade"].isNotNull()))


def number_of(label: Column, raw: Column) -> Column:
    """The struct field, number, text of a label and value on the page; null for other labels. Settings and affiliations stay text, numbers that do not parse are null."""
    field = F.try_element_at(F.create_map(*[F.lit(x) for item in NUMBER_FIELDS.items() for x in item]), F.lower(F.trim(label)))

    def told(field: Column) -> Column:
        is_text = field.isin("setting", "religious_affiliation")
        number = F.when(field == "avg_annual_cost", parse_cost(raw).cast("double")).when(field == "student_faculty_ratio_niche", parse_ratio(raw)).when(~is_text, parse_percent(raw))
        return F.when(field.isNotNull(), F.struct(field.alias("field"), number.alias("number"), F.when(is_text, F.trim(raw)).alias("text")))

    return held(field, told)


def merged_profile(grades: Column, numbers: Column) -> Column:
    """Maps of grades and of numbers as one, numbers going before grades of the same name."""
    left = F.map_filter(grades, lambda k, _: ~F.map_contains_key(numbers, k))
    return F.map_concat(left, numbers)


def first_source(*found: Column) -> Column:
    """The first array that is not empty: preloaded state, next-data, answers of the page's interface, elements of the page."""
    return F.coalesce(*[F.when(F.size(c) > 0, c) for c in found])


def _axis(names: Column, default: int, *words: str, without: tuple[str, ...] = ()) -> Column:
    """The last place, from 0, of a name that holds one of the words and none of the others; else the default (null below 0)."""
    low = F.transform(names, lambda n, i: F.struct(F.lower(n).alias("n"), i.alias("i")))

    def hit(s: Column) -> Column:
        has = F.lit(False)
        for w in words:
            has = has | s["n"].contains(w)
        for w in without:
            has = has & ~s["n"].contains(w)
        return has

    found = F.array_max(F.transform(F.filter(low, hit), lambda s: s["i"]))
    return F.coalesce(found, F.lit(default) if default >= 0 else F.lit(None).cast("int"))


def plotted_points(plot: Column) -> Column:
    """The points of a scatter plot (a struct of type PLOT) as structs gpa, sat_score, outcome, major, residency.

    Values are shares of 4.0 and of 1600; attributes are places in the lists of labels. Points without an
    outcome, or whose gpa is not in (0, 4] or whose score is not above 0, go.
    """
    def axes(p: Column) -> Column:
        units, names = p["units"], F.coalesce(p["attributes"], F.array().cast("array<string>"))
        return F.struct(
            _axis(units, 0, "gpa").alias("gpa"), _axis(units, 1, "sat", "act", "score", without=("gpa",)).alias("score"), _axis(names, 0, "decision", without=("type", "plan", "round")).alias("decision"),
            _axis(names, -1, "major", "field", without=("decision",)).alias("major"), _axis(names, -1, "state", "residency", without=("major", "field", "decision")).alias("home"),
        )

    def read(plot: Column, at: Column) -> Column:
        def label(point: Column, place: Column) -> Column:
            return F.trim(F.get(F.get(plot["attributeValues"], place), F.get(point["attributes"], place)))

        def made(p: Column) -> Column:
            return F.struct(
                F.bround(F.get(p["values"], at["gpa"]) * 4, 2).alias("gpa"), F.bround(F.get(p["values"], at["score"]) * 1600, 0).alias("sat_score"), held(label(p, at["decision"]), outcome).alias("outcome"),
                label(p, at["major"]).alias("major"), held(label(p, at["home"]), lambda home: F.when(home.isNotNull(), residency(home))).alias("residency"),
            )

        return F.filter(F.transform(F.filter(plot["points"], lambda p: F.size(p["values"]) >= 2), made), is_point)

    return held(plot, lambda p: held(axes(p), lambda at: read(p, at)))


def is_point(p: Column) -> Column:
    """Whether a point has a known outcome and numbers in range."""
    return F.coalesce(p["outcome"].isNotNull() & (p["gpa"] > 0) & (p["gpa"] <= 4) & (p["sat_score"] > 0), F.lit(False))


def drawn_points(html: Column) -> Column:
    """Points out of the circles of a drawn plot: data-gpa and data-score (or data-y and data-x), the outcome by the fill's colour."""
    circles = F.regexp_extract_all(html, F.lit(r"(?i)(<circle\b[^>]*>)"), F.lit(1))

    def attribute(tag: Column, name: str) -> Column:
        return F.nullif(F.regexp_extract(tag, rf'(?i)\b{name}\s*=\s*"([^"]*)"', 1), F.lit(""))

    def made(tag: Column) -> Column:
        colour = F.lower(F.coalesce(attribute(tag, "fill"), attribute(tag, "data-color"), F.lit("")))
        kind = F.when(colour.contains("green") | colour.contains("#4caf50"), "accepted").when(colour.contains("red") | colour.contains("#f44336"), "rejected").when(colour.rlike("yellow|orange"), "waitlisted")
        gpa, score = (F.coalesce(attribute(tag, a), attribute(tag, b)).try_cast("double") for a, b in (("data-gpa", "data-y"), ("data-score", "data-x")))
        return F.struct(gpa.alias("gpa"), score.alias("sat_score"), kind.alias("outcome"))

    return F.filter(F.transform(circles, made), lambda p: p["gpa"].isNotNull() & p["sat_score"].isNotNull() & p["outcome"].isNotNull())

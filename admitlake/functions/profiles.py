"""Schools, grades, applicants and experiences as the text that a model reads, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .routing import said
from .text import as_money, as_percent, as_ratio

# What codes of ownership and of test policies are called.
OWNERSHIP = {1: "Public", 2: "Private nonprofit", 3: "For-profit"}
TEST_POLICIES = {1: "Required", 2: "Recommended", 3: "Neither required nor recommended", 4: "Unknown", 5: "Test-flexible (considered but not required)"}
# The names of grade categories.
GRADE_LABELS = {
    "academics": "Academics", "value": "Value", "diversity": "Diversity", "campus": "Campus", "athletics": "Athletics", "party_scene": "Party Scene", "professors": "Professors",
    "location": "Location", "dorms": "Dorms", "food": "Food", "student_life": "Student Life", "safety": "Safety",
}
# Head and ends of the blocks, and the notes in them.
GRADES_HEAD = "[NICHE GRADES — for internal ranking only, NEVER mention in response]"
RANKINGS_NOTE = "Note: This person is still going through the application process. Their rankings for majors and schools are subject to change.\n"
NO_PROMPT = "No particular essay prompt has been specified. Provide general essay advice and strategies that apply broadly across common college application essay prompts.\n\n"


def _named(code: Column, names: dict) -> Column:
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def _there(x: Column) -> Column:
    """Whether a number is there and not 0."""
    return F.coalesce(x != 0, F.lit(False))


def _part(label: str, text: Column, end: str = "") -> Column:
    return F.when(text.isNotNull(), F.concat(F.lit(label), text, F.lit(end)))


def _line(head: str, *parts: Column, between: str = " | ") -> Column:
    """Parts that are not null after a head; null if there are none."""
    kept = F.array_compact(F.array(*parts))
    return F.when(F.size(kept) > 0, F.concat(F.lit(head), F.array_join(kept, between)))


def _between(low: Column, high: Column) -> Column:
    return F.when(_there(low) & _there(high), F.concat(low.cast("int").cast("string"), F.lit("-"), high.cast("int").cast("string")))


def school_block(school: dict[str, Column], wanted: Column) -> Column:
    """A school's data as lines under its name: where and what it is, then the families of columns in `wanted` (an array of names).

    school: columns by the names used here; a column that is not given is missing in every row.
    A line is there if one of its parts is.
    """

    def c(name: str) -> Column:
        return school.get(name, F.lit(None).cast("double"))

    def text(name: str) -> Column:
        return F.nullif(school.get(name, F.lit(None).cast("string")), F.lit(""))

    def family(name: str, line: Column) -> Column:
        return F.when(F.array_contains(wanted, name), line)

    place = F.coalesce(F.concat(F.lit("Location: "), text("city"), F.lit(", "), text("state")), F.concat(F.lit("State: "), text("state")))
    inside, outside = as_money(c("tuition_in_state")), as_money(c("tuition_out_of_state"))
    two = inside.isNotNull() & outside.isNotNull() & (inside != outside)
    fund = c("endowment")
    endowment = F.when(fund >= 1e9, F.format_string("$%.1fB", fund / 1e9)).when(fund >= 1e6, F.format_string("$%.0fM", fund / 1e6)).otherwise(as_money(fund))
    men, women = as_percent(c("pct_men")), as_percent(c("pct_women"))
    lines = [
        F.concat(F.lit("[SCHOOL DATA] "), text("name")),
        _line("", place, _part("Type: ", _named(c("ownership"), OWNERSHIP))),
        family("identity", _line("", _part("Acceptance Rate: ", as_percent(c("acceptance_rate"))), _part("Website: ", text("url")))),
        family("admissions", _line(
            "Test Scores: ", F.when(_there(c("sat_avg")), F.concat(F.lit("SAT Avg: "), c("sat_avg").cast("int").cast("string"))), _part("SAT Range: ", _between(c("sat_25"), c("sat_75"))),
            _part("ACT Range: ", _between(c("act_25"), c("act_75"))), _part("Test Policy: ", _named(c("test_requirements"), TEST_POLICIES)))),
        family("student", _line(
            "Enrollment: ", F.when(_there(c("enrollment")), F.concat(F.lit("Enrollment: "), F.format_number(c("enrollment").cast("long"), 0))), _part("Student-Faculty Ratio: ", as_ratio(c("student_faculty_ratio"))),
            _part("Retention Rate: ", as_percent(c("retention_rate"))), F.when(_there(c("avg_age_entry")), F.concat(F.lit("Avg Age at Entry: "), c("avg_age_entry").cast("string"))),
            F.concat(F.lit("Male/Female: "), men, F.lit("/"), women), _part("Part-Time: ", as_percent(c("part_time_share"))))),
        family("student", _line("Demographics: ", *[
            _part(f"{label} ", as_percent(c(name))) for name, label in (("pct_white", "White"), ("pct_black", "Black"), ("pct_hispanic", "Hispanic"), ("pct_asian", "Asian"), ("pct_first_gen", "First-Gen"))], between=", ")),
        family("cost", _line(
            "Cost: ", F.when(two, F.concat(F.lit("In-State Tuition: "), inside)), F.when(two, F.concat(F.lit("Out-of-State Tuition: "), outside)), F.when(~F.coalesce(two, F.lit(False)), _part("Tuition: ", F.coalesce(inside, outside))),
            _part("Total Cost of Attendance: ", as_money(c("cost_attendance"))), _part("Avg Net Price: ", as_money(c("avg_net_price"))), _part("Books & Supplies: ", as_money(c("booksupply"))))),
        family("cost", _line("Net Price by Income: ", *[
            _part(f"{label}: ", as_money(c(f"net_price_{name}"))) for name, label in (("0_30k", "$0-30k"), ("30_48k", "$30-48k"), ("48_75k", "$48-75k"), ("75_110k", "$75-110k"), ("110k_plus", "$110k+"))])),
        family("aid", _line(
            "Financial Aid: ", _part("Pell Grant Rate: ", as_percent(c("pell_grant_rate"))), _part("Federal Loan Rate: ", as_percent(c("federal_loan_rate"))), _part("Median Debt at Graduation: ", as_money(c("median_debt"))),
            F.concat(F.lit("Debt Range (25th-75th): "), as_money(c("cumulative_debt_25th")), F.lit("-"), as_money(c("cumulative_debt_75th"))))),
        family("outcome", _line("Outcomes: ", _part("Graduation Rate: ", as_percent(c("graduation_rate"))), _part("Median Earnings (10yr post-entry): ", as_money(c("median_earnings_10yr"))))),
        family("institution", _line(
            "Resources: ", F.when(_there(fund), F.concat(F.lit("Endowment: "), endowment)), _part("Avg Faculty Salary: ", as_money(c("faculty_salary")), "/mo"), _part("Full-Time Faculty: ", as_percent(c("ft_faculty_rate"))),
            _part("Instructional Spend/Student: ", as_money(c("instructional_spend_per_fte"))))),
    ]
    return F.concat(F.array_join(F.array_compact(F.array(*lines)), "\n"), F.lit("\n\n"))


def grade_line(name: Column, rank: Column, grades: dict[str, Column], wanted: Column) -> Column:
    """A school's grades in the wanted categories, in their order, behind its name and rank; null without any."""
    table = F.create_map(*[x for k, c in grades.items() for x in (F.lit(k), F.nullif(c, F.lit("")))])
    labels = F.create_map(*[F.lit(x) for item in GRADE_LABELS.items() for x in item])
    parts = F.array_compact(F.transform(F.filter(wanted, lambda w: w != "other"), lambda w: F.concat(F.try_element_at(labels, w), F.lit(" "), F.try_element_at(table, w))))
    place = F.when(_there(rank), F.concat(F.lit(" (#"), rank.cast("string"), F.lit(")"))).otherwise("")
    return F.when(F.size(parts) > 0, F.concat(name, place, F.lit(": "), F.array_join(parts, ", ")))


def grades_block(lines: Column) -> Column:
    """The block of grade lines (an array in order); empty without any."""
    kept = F.array_compact(lines)
    return F.when(F.size(kept) > 0, F.concat(F.lit(GRADES_HEAD + "\n"), F.array_join(kept, "\n"), F.lit("\n\n"))).otherwise("")


def ranked(names: Column) -> Column:
    """#1 first, #2 second: the names in order, numbered."""
    return F.array_join(F.transform(names, lambda n, i: F.concat(F.lit("#"), (i + 1).cast("string"), F.lit(" "), n)), ", ")


def profile_block(gpa: Column, test: Column, score: Column, residency: Column, country: Column, country_label: Column, state: Column, majors: Column, schools: Column) -> Column:
    """An applicant's numbers, residency and ranked wishes as one line, with a note behind wishes; empty if nothing is known. Texts and arrays of texts."""
    listed = {n: F.coalesce(a, F.array().cast("array<string>")) for n, a in (("majors", majors), ("schools", schools))}
    has = {n: F.size(a) > 0 for n, a in listed.items()}
    abroad = said(country) & (country != "US")
    parts = F.array_compact(F.array(
        F.when(said(gpa), F.concat(F.lit("GPA "), gpa)), F.when(said(score), F.concat(F.when(said(test), F.upper(test)).otherwise("Test Score"), F.lit(" "), score)), _part("Residency: ", residency),
        F.when(abroad, F.concat(F.lit("Country: "), F.coalesce(country_label, country))).when((country == "US") & said(state), F.concat(F.lit("State: "), state)),
        F.when(has["majors"], F.concat(F.lit("Preferred majors (ranked): "), ranked(listed["majors"]))), F.when(has["schools"], F.concat(F.lit("Preferred schools (ranked): "), ranked(listed["schools"]))),
    ))
    note = F.when(has["majors"] | has["schools"], RANKINGS_NOTE).otherwise("")
    return F.when(F.size(parts) > 0, F.concat(F.lit("Profile: "), F.array_join(parts, ", "), F.lit("\n"), note, F.lit("\n"))).otherwise("")


def prompt_block(prompt: Column) -> Column:
    return F.when(said(prompt), F.concat(F.lit("Essay prompt being responded to: **"), F.trim(prompt), F.lit("**\n\n"))).otherwise(NO_PROMPT)


def experience_line(title: Column, place: Column, kind: Column, start: Column, end: Column, what: Column) -> Column:
    """One experience: its head, and what it was on a line below."""
    dates = F.concat(F.lit(" ["), start, F.when(said(end), F.concat(F.lit(" – "), end)).otherwise(""), F.lit("]"))
    head = F.concat(
        F.lit("- **"), F.coalesce(title, F.lit("")), F.lit("**"), F.when(said(place), F.concat(F.lit(" at "), place)).otherwise(""), F.when(said(kind), F.concat(F.lit(" ("), kind, F.lit(")"))).otherwise(""),
        F.when(said(start), dates).otherwise(""),
    )
    return F.concat(head, F.when(said(what), F.concat(F.lit("\n  "), what)).otherwise(""))


def experiences_block(lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.concat(F.lit("Experiences and activities:\n"), F.array_join(lines, "\n"), F.lit("\n\n"))).otherwise("")


def sources_text(colleges: Column, titles: Column, urls: Column) -> Column:
    """The sources of an answer (arrays), numbered, each with its address on a line below."""
    rows = F.arrays_zip(colleges.alias("c"), titles.alias("t"), urls.alias("u"))
    return F.array_join(F.transform(rows, lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(s["c"], F.lit("")), F.lit(" — "), F.coalesce(s["t"], F.lit("")), F.lit("\n    "), F.coalesce(s["u"], F.lit("")))), "\n")

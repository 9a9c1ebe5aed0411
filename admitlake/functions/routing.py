"""What a question asks for and how it is to be answered: labels, request checks, rules, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_greeting

# Labels that a classifier may give.
QUERY_TYPES = ("qa", "essay_ideas", "essay_review", "admission_prediction", "ranking", "comparison")
COMPLEXITIES = ("simple", "complex")
DATA_CATEGORIES = ("admissions", "student", "cost", "aid", "outcome", "institution")
GRADE_CATEGORIES = ("academics", "value", "diversity", "campus", "athletics", "party_scene", "professors", "location", "dorms", "food", "student_life", "safety", "other")
# Ranges of a request's numbers, both ends allowed.
RANGES = {"gpa": (0.0, 5.0), "sat": (400.0, 1600.0), "act": (1.0, 36.0), "top_k": (1.0, 20.0)}
# What the text of a lost connection says.
LOST_CONNECTION = ("stream not found", "stream expired", "hrana", "websocket")
# What an auxiliary search of a school adds, by the type of the question.
AUXILIARY = {
    "essay": ("mission values what we look for in students", "unique programs culture community"),
    "admission_prediction": ("admissions statistics acceptance rate class profile", "application requirements deadlines"),
}
# Words of a question, and what they add to the rules of its answer.
EXTRA_RULES = (
    (("how do i", "how to", "apply", "application", "steps", "deadline", "require", "submit"),
     "- End with a ## Next Steps section using bullet points for undergraduate applicants.\n"),
    (("financial aid", "net price", "sticker price", "merit aid", "need-based", "afford", "aid package", "cost of attendance", "tuition", "scholarship"),
     "- Distinguish between sticker price (published cost of attendance) and net price (what families actually pay after aid). Most people pay less than sticker price.\n"
     "- Distinguish between need-based aid (determined by FAFSA/CSS Profile) and merit aid (determined by academic credentials).\n"
     "- If the sources contain net price or average aid data, prioritize those over sticker price.\n"
     "- If residency status is known, use it to specify whether in-state or out-of-state tuition applies. Do not present both unless asked to compare.\n"),
    (("demonstrated interest", "visit campus", "show interest", "info session", "campus tour", "alumni interview"),
     "- Note that demonstrated interest policies vary significantly by school. Many highly selective schools (Ivies, Stanford, MIT, Caltech) explicitly do NOT consider it. "
     "Check the sources for this school's specific policy before advising.\n"),
    (("early decision", "early action", " ed ", " ea ", " rd ", "binding", "restrictive early action", "when should i apply"),
     "- ED (Early Decision) is binding — the applicant must attend if accepted. It often carries a statistical advantage but eliminates the ability to compare financial aid offers.\n"
     "- EA (Early Action) is non-binding and generally has higher acceptance rates than RD.\n"
     "- REA (Restrictive Early Action) limits other early applications — policies vary by school.\n"
     "- Encourage weighing the financial implications of ED, not just the statistical advantage.\n"),
    (("recommendation", "rec letter", "letter of recommendation", "who should i ask", "recommender"),
     "- End with a ## Next Steps section suggesting who to ask and when (junior year spring or early senior fall is ideal).\n"),
    (("fafsa deadline", "css profile", "when to file", "fafsa open", "priority deadline"),
     "- FAFSA opens October 1. Many schools have priority filing deadlines (often February 1-15). Filing early maximizes aid eligibility.\n"
     "- Note whether the school requires CSS Profile in addition to FAFSA (most private schools do).\n"),
)


def unfenced(answer: Column) -> Column:
    """A model's answer without the code fence around it, if it has one."""
    raw = F.regexp_replace(answer, r"^\s+|\s+$", "")
    inner = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"^[^\n]*\n", ""), "```$", ""), r"^\s+|\s+$", "")
    return F.when(raw.startswith("```"), inner).otherwise(raw)


def intent(answer: Column) -> Column:
    """The struct query_type, complexity, categories, niche_categories of a classifier's JSON answer.

    Unknown labels give way to qa and complex; lists keep known labels in order, repeats too. Grade
    categories count for rankings only, academics if none is left. What is no JSON object, or has null
    for a list that counts, is qa, complex, without categories.
    """
    body = unfenced(answer)
    parsed = F.try_parse_json(F.when(body.startswith("{"), body))

    def has_null(name: str) -> Column:
        return F.coalesce(F.is_variant_null(F.try_variant_get(parsed, f"$.{name}", "variant")), F.lit(False))

    def one(name: str, allowed: tuple[str, ...], default: str) -> Column:
        found = F.try_variant_get(parsed, f"$.{name}", "string")
        return F.when(found.isin(*allowed), found).otherwise(default)

    def many(name: str, allowed: tuple[str, ...]) -> Column:
        found = F.coalesce(F.try_variant_get(parsed, f"$.{name}", "array<string>"), F.array().cast("array<string>"))
        return F.filter(found, lambda c: c.isin(*allowed))

    none = F.array().cast("array<string>")
    kind = one("query_type", QUERY_TYPES, "qa")
    grades = many("niche_categories", GRADE_CATEGORIES)
    sound = parsed.isNotNull() & ~has_null("categories") & ~((kind == "ranking") & has_null("niche_categories"))
    return F.struct(
        F.when(sound, kind).otherwise("qa").alias("query_type"), F.when(sound, one("complexity", COMPLEXITIES, "complex")).otherwise("complex").alias("complexity"),
        F.when(sound, many("categories", DATA_CATEGORIES)).otherwise(none).alias("categories"),
        F.when(sound & (kind == "ranking"), F.when(F.size(grades) > 0, grades).otherwise(F.array(F.lit("academics")))).otherwise(none).alias("niche_categories"),
    )


def out_of_range(**fields: Column) -> Column:
    """The names of a request's numbers that are outside their range; a missing number is in it."""
    wrong = [F.when((c < RANGES[n][0]) | (c > RANGES[n][1]), n) for n, c in fields.items()]
    return F.array_compact(F.array(*wrong))


def is_lost_connection(message: Column) -> Column:
    low = F.lower(message)
    found = F.lit(False)
    for words in LOST_CONNECTION:
        found = found | low.contains(words)
    return found


def is_blocked(message: Column) -> Column:
    """A plan's quota is used up: trying again will not help."""
    low = F.lower(message)
    return low.contains("blocked") & low.contains("upgrade")


def said(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) != ""


def ruled_type(question: Column, essay: Column, prompt: Column) -> Column:
    """The type that a question has by rule: an essay is reviewed, a prompt gets ideas, a greeting is one; null leaves it to the classifier."""
    return F.when(said(essay), "essay_review").when(said(prompt), "essay_ideas").when(is_greeting(question), "greeting")


def model_tier(kind: Column, complexity: Column) -> Column:
    return F.when((kind == "qa") & (complexity == "simple"), "simple").otherwise("standard")


def instructed_type(kind: Column) -> Column:
    """Types whose answers have instructions of their own."""
    return F.when(kind.isin("ranking", "comparison"), kind).otherwise("")


def _with_ends(ends: tuple[str, ...]) -> Callable[[Column], Column]:
    return lambda school: F.array(*[F.concat(school, F.lit(" "), F.lit(e)) for e in ends])


def searches(question: Column, kind: Column, schools: Column) -> Column:
    """The searches of a question: itself, and for essays and chances two more for each of its first two schools."""
    key = F.when(kind.isin("essay_ideas", "essay_review"), "essay").otherwise(kind)
    more = F.array().cast("array<string>")
    for name, ends in AUXILIARY.items():
        made = F.flatten(F.transform(F.slice(schools, 1, 2), _with_ends(ends)))
        more = F.when(key == name, made).otherwise(more)
    return F.concat(F.array(question), more)


def extra_rules(question: Column) -> Column:
    low = F.lower(question)

    def says(words: tuple[str, ...]) -> Column:
        found = F.lit(False)
        for w in words:
            found = found | low.contains(w)
        return found

    return F.concat(*[F.when(says(words), rule).otherwise("") for words, rule in EXTRA_RULES])


def residency_at(country: Column, state: Column, school_state: Column) -> Column:
    """in-state, out-of-state or international, as far as is known."""
    home = F.when(said(state) & said(school_state), F.when(F.upper(state) == F.upper(school_state), "in-state").otherwise("out-of-state"))
    return F.when(said(country), F.when(country != "US", "international").otherwise(home))


def backoff(kind: str, attempt: Column) -> Column:
    """Seconds to wait before the next attempt, by what failed: page, database, host, or render."""
    return {
        "page": F.pow(F.lit(2.0), attempt), "database": 0.5 * F.pow(F.lit(2.0), attempt), "host": F.least(F.lit(300.0), 30.0 * attempt), "render": F.least(F.lit(300.0), 20.0 * attempt),
    }[kind]


def jittered(low: float, high: float, seed: int) -> Column:
    """A delay drawn evenly from a range, for each row."""
    return F.rand(seed) * (high - low) + low


def human_delay(mean: float, deviation: float, low: float, high: float, seed: int) -> Column:
    """A log-normal delay, held to a range, for each row."""
    return F.least(F.greatest(F.exp(F.randn(seed) * deviation + mean), F.lit(low)), F.lit(high))


def is_page(content_type: Column) -> Column:
    """Whether a response's type is one that is meant to be parsed."""
    return F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1)))).isin("text/html", "application/xhtml+xml")


def is_letter_grade(text: Column) -> Column:
    return F.coalesce(text.rlike("^[A-F][+-]?$"), F.lit(False))


def composite_sat(reading: Column, mathematics: Column) -> Column:
    """The sum of both parts, if both are there and not 0."""
    return F.when((reading != 0) & (mathematics != 0), reading + mathematics)


def short_title(text: Column, most: int = 60) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def without_campus(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"(?i)\s*[-–]\s*(main campus|campus)$", ""))


def embed_input(title: Column, chunk: Column, prefix: Column | None = None) -> Column:
    """What is embedded of a chunk: a prefix or else the title before it, if there is one."""
    head = F.coalesce(F.nullif(F.trim(prefix), F.lit("")), title) if prefix is not None else title
    return F.when(said(head), F.concat(head, F.lit("\n\n"), chunk)).otherwise(chunk)


def rerank_text(college: Column, kind: Column, title: Column, content: Column, most: int = 8000) -> Column:
    """What a cross-encoder reads of a hit."""
    c, t = F.coalesce(college, F.lit("")), F.coalesce(title, F.lit(""))
    head = F.when(c != "", F.concat(F.lit("College: "), c, F.lit(" | Page: "), F.coalesce(kind, F.lit("")), F.lit("\n"))).otherwise("")
    return F.concat(head, F.when(t != "", F.concat(t, F.lit("\n"))).otherwise(""), F.substring(F.coalesce(content, F.lit("")), 1, most))

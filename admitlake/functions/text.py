"""Text cleaning, keywords, chunks, labels and budgets as column expressions."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no keywords.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "up", "about", "into", "through", "during", "before", "after", "above", "below", "between",
    "among", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "can", "this", "that", "these",
    "those",
)
# What a question about one's own chances says, and what a greeting does.
CHANCE = (
    r"what are my chances", r"can i get into", r"will i get into", r"do i have a chance", r"chances of getting in", r"admission probability", r"how likely am i", r"likelihood of acceptance",
    r"chance of admission", r"get accepted", r"admitted to", r"acceptance rate.*gpa|gpa.*acceptance rate", r"sat.*chance|chance.*sat", r"gpa.*\d+\.\d+.*chance|chance.*gpa.*\d+\.\d+",
)
GREETING = (
    r"^(hi|hello|hey|howdy|yo|sup)\b", r"^good (morning|afternoon|evening|night)\b", r"^(thanks|thank you|thx|ty)\b", r"^(bye|goodbye|see you|later)\b", r"^how are you",
    r"^what'?s up\b", r"^nice to meet you",
)
#: Names of HTML entities that count without a semicolon too, longest first, as a pattern.
_OPEN_NAMES = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
#: Numbers that stand for other characters than their own: those of Windows-1252, and 0.
_NUMBERS = {n: bytes([n]).decode("cp1252", "replace").replace("\ufffd", chr(n)) for n in range(0x80, 0xA0)} | {0: "\ufffd", 0x0D: "\r"}


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often `use` names it, inside of lambdas too."""
    return F.transform(F.array(value), use)[0]


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def unescaped(text: Column, closed: bool = False) -> Column:
    """text with its HTML entities as characters: each ampersand's reference on its own, by number or by name, unknown names kept.

    A name without its semicolon counts if it is one of the old ones, by its longest known beginning.
    Numbers beyond Unicode, and surrogates, become U+FFFD. closed: only references that end with a semicolon count.
    """
    end = ";" if closed else ";?"
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    numbers = F.from_json(F.lit(json.dumps({str(k): v for k, v in _NUMBERS.items()})), "map<string,string>")

    def reference(part: Column) -> Column:
        name = F.regexp_extract(part, rf"^[^\t\n\f <&#;]{{1,32}}{end}", 0)
        start = F.regexp_extract(part, f"^(?:{_OPEN_NAMES})", 0)
        known = F.try_element_at(names, name)
        by_name = F.when(known.isNotNull(), F.concat(known, F.substring(part, F.length(name) + 1, F.length(part))))
        by_name = by_name.when((start != "") & F.lit(not closed), F.concat(F.try_element_at(names, start), F.substring(part, F.length(start) + 1, F.length(part)))).otherwise(F.concat(F.lit("&"), part))
        sign = F.regexp_extract(part, f"^#(?:[xX][0-9a-fA-F]+|[0-9]+){end}", 0)
        digits = F.regexp_replace(sign, "^#[xX]?0*|;", "")
        value = F.when(F.length(digits) > 8, F.lit(1 << 24)).when(sign.rlike("^#[xX]"), F.conv(digits, 16, 10).cast("int")).otherwise(digits.try_cast("int"))
        value = F.coalesce(value, F.lit(0))
        wide = F.decode(F.unhex(F.lpad(F.hex(value), 8, "0")), "UTF-32")
        char = F.coalesce(F.try_element_at(numbers, value.cast("string")), F.when((value > 0x10FFFF) | value.between(0xD800, 0xDFFF), "\ufffd").otherwise(wide))
        by_number = F.concat(char, F.substring(part, F.length(sign) + 1, F.length(part)))
        return F.when(sign != "", by_number).otherwise(by_name)

    parts = F.split(text, "&")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), reference)
    return F.when(text.contains("&"), F.concat(parts[0], F.array_join(rest, ""))).otherwise(text)


def clean_text(text: Column, most: int | None = None, closed: bool = False) -> Column:
    """Entities, scripts, styles, tags and odd characters out; phones out; runs of punctuation and white space collapsed.

    Null gives an empty text. most: cut to so many characters at a word's end, with "..." behind. closed: as for unescaped.
    """
    out = unescaped(F.coalesce(text, F.lit("")), closed)
    marked = out
    for pattern in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"<[^>]+>"):
        marked = F.regexp_replace(marked, pattern, "")
    out = F.when(out.contains("<"), marked).otherwise(out)
    for pattern, put in (
        (r"(?:[\s ]|[^\p{L}\p{N}_\s.,!?;:()\[\]\"'-])+", " "), (r"(?<![\p{L}\p{N}_])\d{3}[-.]?\d{3}[-.]?\d{4}(?![\p{L}\p{N}_])", ""),
        (r"[.]{3,}", "..."), (r"([!?])\1+", "$1"), (r"\s+", " "),
    ):
        out = F.regexp_replace(out, pattern, put)
    out = F.trim(out)
    if most is None:
        return out
    head = F.regexp_replace(F.substring(out, 1, most), r" [^ ]*$", "")
    return F.when(F.length(out) > most, F.when(head != "", F.concat(head, F.lit("..."))).otherwise("")).otherwise(out)


def ascii_words(text: Column) -> Column:
    """Words of three or more ASCII letters and nothing else; a word is a run of letters, digits and underscores."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.rlike("^[a-zA-Z]{3,}$"))


def counted(words: Column) -> Column:
    """Each distinct word of an array as a struct word, n, first (its first place from 0), sorted by word; places by sorting, so nothing grows with the square."""
    keyed = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("first"))))

    def starts(ks: Column) -> Column:
        runs = F.transform(ks, lambda k, i: F.struct(k.alias("k"), i.alias("at"), F.coalesce(F.get(ks, i - 1)["word"] != k["word"], F.lit(True)).alias("new")))
        return held(F.filter(runs, lambda r: r["new"]), lambda rs: F.transform(rs, lambda r, j: F.struct(r["k"]["word"].alias("word"), (F.coalesce(F.get(rs, j + 1)["at"], F.size(ks)) - r["at"]).cast("long").alias("n"), r["k"]["first"].alias("first"))))

    return held(keyed, starts)


def is_valid_content(text: Column, least: int = 50) -> Column:
    """Clean text of `least` characters with five words of three ASCII letters."""
    return is_valid_clean(clean_text(text), least)


def is_valid_clean(clean: Column, least: int = 50) -> Column:
    """is_valid_content of a text that is clean already; as a column of its own it is cleaned once and not at each mention."""
    return (F.length(clean) >= least) & (F.size(ascii_words(clean)) >= 5)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def is_insufficient(text: Column, characters: int = 100, words: int = 50) -> Column:
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    return (F.length(trimmed) < characters) | (word_count(trimmed) < words)


def unique_sentences(text: Column) -> Column:
    """Sentences longer than ten characters, each once by its lower-cased form, put together again. Equal ones are found by sorting, so long texts take little more than their length."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[.!?]+"), lambda s: F.trim(s)), lambda s: F.length(s) > 10)
    keyed = F.sort_array(F.transform(parts, lambda s, i: F.struct(F.lower(F.regexp_replace(s, r"\s+", " ")).alias("key"), i.alias("i"), s.alias("s"))))
    first = held(keyed, lambda ks: F.filter(ks, lambda k, i: (i == 0) | (F.get(ks, i - 1)["key"] != k["key"])))
    kept = F.transform(F.sort_array(F.transform(first, lambda k: F.struct(k["i"].alias("i"), k["s"].alias("s")))), lambda k: k["s"])
    return held(kept, lambda said: F.when(F.size(said) > 0, F.concat(F.array_join(said, ". "), F.lit("."))).otherwise(""))


def content_hash(text: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256 of the lower-cased, squeezed text."""
    return F.substring(F.sha2(F.regexp_replace(F.lower(text), r"\s+", " "), 256), 1, 16)


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.lower(text).rlike("|".join(f"(?:{p})" for p in patterns))


def is_chance_question(text: Column) -> Column:
    return any_of(text, CHANCE)


def is_greeting(text: Column) -> Column:
    trimmed = F.trim(text)
    return (word_count(trimmed) <= 8) & any_of(trimmed, GREETING)


def stats_in(text: Column) -> dict[str, Column]:
    """gpa in (0, 5], sat in 400..1600, act in 1..36, each from its first mention; else null."""
    # How each is mentioned, and its range.
    found = {
        "gpa": (r"(?i)(?:gpa|grade point average)\s*(?:of|is|:)?\s*(\d+\.?\d*)", 0.0, 5.0),
        "sat": (r"(?i)(?:sat|sat score)\s*(?:of|is|:)?\s*(\d{3,4})", 400.0, 1600.0),
        "act": (r"(?i)(?:act|act score)\s*(?:of|is|:)?\s*(\d{1,2})", 1.0, 36.0),
    }
    out = {}
    for name, (pattern, low, high) in found.items():
        x = F.regexp_extract(text, pattern, 1).try_cast("double")
        out[name] = F.when((x > low if name == "gpa" else x >= low) & (x <= high), x)
    return out


def verified_citations(answer: Column, sources: Column) -> Column:
    """Leaked tags and placeholders out, [sd] as [SD], numbers outside 1..sources out, a note if none are left."""
    # Fixed value: the note behind an answer without citations.
    note = "\n\n> **Note:** This response may not be fully grounded in the provided sources. Please verify with the college's official website."
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(answer, r"\s*\[SCHOOL DATA\][^\n]*", ""), r"\[(?i:sd)\]", "[SD]"), r"\s*\[N\]", "")
    numbers = F.array_distinct(F.regexp_extract_all(out, F.lit(r"\[(\d+)\]"), F.lit(1)))
    wrong = F.filter(numbers, lambda n: (n.cast("decimal(38,0)") < 1) | (n.cast("decimal(38,0)") > sources))
    kept = F.aggregate(wrong, out, lambda text, n: F.replace(text, F.concat(F.lit("["), n, F.lit("]")), F.lit("")))
    kept = F.when(kept.rlike(r"\[\d+\]"), kept).otherwise(F.concat(kept, F.lit(note)))
    return F.when(sources == 0, out).otherwise(kept)


def length_budget(question: Column, wanted: Column) -> Column:
    q = F.lower(question)

    def says(*words: str) -> Column:
        return q.rlike("|".join(words))

    # The budgets, and the words that decide.
    return (
        F.when(wanted == "XS", "50-100 words (brief, direct answer)")
        .when(wanted == "S", "100-200 words (concise answer)")
        .when(wanted == "L", "400-600 words (thorough, detailed answer)")
        .when(wanted == "XL", "600-900 words (comprehensive, in-depth answer)")
        .when(says("compare", "versus", "vs", "difference between"), "400-600 words (comparative answer)")
        .when(says("how do i", "how to", "application process", "steps to", "apply", "process for"), "300-450 words with numbered steps")
        .when(says("what is", "tell me about", "overview", "what are"), "150-250 words (concise factual answer)")
        .otherwise("200-350 words")
    )


def parse_percent(text: Column) -> Column:
    x = F.regexp_replace(F.trim(text), "[%,+]", "").try_cast("double")
    return F.when(x > 1, x / 100).otherwise(x)


def parse_cost(text: Column) -> Column:
    x = F.split_part(F.regexp_replace(F.trim(text), "[$,+]", ""), F.lit("/"), F.lit(1)).try_cast("double").cast("long")
    return F.when(x >= 100, x)


def parse_ratio(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t.contains(":"), F.split_part(t, F.lit(":"), F.lit(1)).try_cast("double")).otherwise(F.replace(t, F.lit(","), F.lit("")).try_cast("double"))


def token_windows(tokens: Column, size: int = 512, overlap: int = 50) -> Column:
    """Windows of tokens, each `overlap` tokens into the one before; the last is the first that reaches the end."""
    step = size - overlap
    last = F.greatest(F.ceil((F.size(tokens) - size) / step), F.lit(0)).cast("int")
    return F.when(F.size(tokens) > 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(tokens, k * step + 1, size))).otherwise(F.array().cast("array<array<string>>"))


def truncated(tokens: Column, most: int = 8191) -> Column:
    """The first tokens of a text, as many as an embedder takes."""
    return F.slice(tokens, 1, most)


def normalized_name(name: Column) -> Column:
    """A school's name without campus suffix, lower-cased, articles and punctuation out, squeezed."""
    out = F.lower(F.regexp_replace(name, r"(?i)\s*[-–]\s*(main campus|campus)$", ""))
    for literal in ("the ", " at ", " - ", ",", ".", "'"):
        out = F.replace(out, F.lit(literal), F.lit(" "))
    return squeezed(out)


def sentences(text: Column) -> Column:
    """Sentences: cut at white space behind a full stop, an exclamation or a question mark."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def sentence_chunks(text: Column, size: int = 512, carried: int = 1) -> Column:
    """Chunks of whole sentences of up to `size` words, each starting with the last `carried` sentences of the one before.

    A sentence longer than `size` closes the chunk before it, is cut into token windows, and carries nothing
    over. Carried and next sentence together may exceed `size`. The fold keeps places only; null and blank texts have no chunks.
    """
    kept = sentences(text)
    with_sizes = F.transform(kept, lambda s: F.struct(s.alias("s"), F.size(words(s)).alias("n")))
    start = F.struct(F.array().cast("array<struct<a:int,b:int>>").alias("cuts"), F.lit(0).alias("first"), F.lit(0).alias("held"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("last"))

    def put(state: Column, sentence: Column) -> Column:
        n, i, first = sentence["n"], state["i"], state["first"]
        last = F.concat(F.filter(state["last"], lambda _, k: k + carried > F.size(state["last"])), F.array(n))
        closed = F.when(first < i, F.concat(state["cuts"], F.array(F.struct(first.alias("a"), (i - 1).alias("b"))))).otherwise(state["cuts"])
        own = F.array(F.struct(i.alias("a"), i.alias("b")))
        again = F.greatest(i - carried, first)
        held_again = F.aggregate(F.slice(state["last"], F.greatest(F.size(state["last"]) - (i - again) + 1, F.lit(1)), i - again), F.lit(0), lambda a, x: a + x)

        def made(cuts: Column, first_: Column, held: Column) -> Column:
            return F.struct(cuts.alias("cuts"), first_.alias("first"), held.alias("held"), (i + 1).alias("i"), last.alias("last"))

        full = (state["held"] + n > size) & (first < i)
        return F.when(n > size, made(F.concat(closed, own), i + 1, F.lit(0))).when(full, made(closed, again, held_again + n)).otherwise(made(state["cuts"], first, state["held"] + n))

    def finish(state: Column) -> Column:
        return F.when(state["first"] < state["i"], F.concat(state["cuts"], F.array(F.struct(state["first"].alias("a"), (state["i"] - 1).alias("b"))))).otherwise(state["cuts"])

    cuts = F.aggregate(with_sizes, start, put, finish)

    def said(cut: Column) -> Column:
        first = F.get(kept, cut["a"])
        windows = F.transform(token_windows(words(first), size), lambda w: F.array_join(w, " "))
        return F.when((cut["a"] == cut["b"]) & (F.size(words(first)) > size), windows).otherwise(F.array(F.array_join(F.slice(kept, cut["a"] + 1, cut["b"] - cut["a"] + 1), " ")))

    return F.flatten(F.transform(cuts, said))


def plain_words(text: Column) -> Column:
    """Punctuation to spaces, squeezed."""
    return squeezed(F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", " "))


def slug(name: Column) -> Column:
    out = F.trim(F.lower(F.regexp_replace(name, r"(?i)\s*[-–]\s*(main campus|campus)$", "")))
    out = F.translate(out, "',.()&/", "")
    for literal, put in ((" - ", "-"), ("  ", " "), (" ", "-")):
        out = F.replace(out, F.lit(literal), F.lit(put))
    return out


def as_percent(x: Column) -> Column:
    return F.when(x.isNotNull(), F.format_string("%.1f%%", x * 100))


def as_money(x: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(x.cast("long"), 0))


def as_ratio(x: Column) -> Column:
    return F.concat(F.bround(x, 0).cast("long").cast("string"), F.lit(":1"))


def outcome(label: Column) -> Column:
    """accepted, rejected or waitlisted by what a point's label or colour says; else null."""
    # The words of each outcome.
    low = F.lower(label)
    return F.when(low.rlike("accept|admit|green"), "accepted").when(low.rlike("deny|denied|reject|red"), "rejected").when(low.rlike("wait|defer|yellow"), "waitlisted")


def residency(label: Column) -> Column:
    low = F.lower(label)
    return F.when(low.contains("in") & low.contains("state") & ~low.contains("out"), "inState").when(low.rlike("international|foreign"), "international").otherwise("outOfState")


def listed(names: Column) -> Column:
    """"a, b and **c**" of an array of names; nothing of none."""
    n = F.size(names)
    bold = F.concat(F.lit("**"), F.element_at(names, -1), F.lit("**"))
    return F.when(n == 0, "").when(n == 1, bold).otherwise(F.concat(F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), bold))


def retrieval_key(question: Column, names: Column) -> Column:
    """What equal retrievals share: the question in lower case and the schools' names, lower-cased and sorted."""
    return F.concat(F.lower(question), F.lit("|"), F.array_join(F.array_sort(F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda s: F.lower(s))), ","))

"""The English analyser as column expressions: words, stop words, and stems by the suffix rules published by M. F. Porter in 1980."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning for a search; fixed values, the usual short list for English.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this",
    "to", "was", "will", "with",
)
#: The published rules: what becomes of an ending if the rest has measure above 0; fixed values.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate",
    "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
#: Endings that go if the rest has measure above 1; "ion" goes only after s or t.
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

# y is a consonant (written Y here) at the start and after a vowel; elsewhere a vowel. Measures count runs of vowels that consonants follow.
VOWEL, MEASURE_0, MEASURE_1 = "[aeiouy]", "[aeiouy][^aeiouy]", "[aeiouy][^aeiouy]+[aeiouy]+[^aeiouy]"
MEASURE_IS_1 = "^[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]*$"
SHORT, SHORT_1 = "[^aeiouy][aeiouy][^aeiouywxY]$", "^[^aeiouy]+[aeiouy][^aeiouywxY]$"
WORD = "^[a-z]{3,}$"


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once however often f names it."""
    return F.transform(F.array(value), f)[0]


def _ending(endings: dict[str, str] | tuple[str, ...]) -> str:
    """A word as its rest and the longest of the endings."""
    return f"^(.+?)({'|'.join(endings)})$"


def _mapped(word: Column, rules: dict[str, str], measure: str) -> Column:
    pattern, to = _ending(rules), F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])
    rest = F.regexp_extract(word, pattern, 1)
    return F.when(rest.rlike(measure), F.concat(rest, F.element_at(to, F.regexp_extract(word, pattern, 2)))).otherwise(word)


def _plural(word: Column) -> Column:
    return F.when(word.rlike("(ss|i)es$"), F.regexp_replace(word, "es$", "")).when(word.rlike("[^s]s$"), F.regexp_replace(word, "s$", "")).otherwise(word)


def _past(word: Column) -> Column:
    rest = F.regexp_extract(word, "^(.+?)(ed|ing)$", 1)
    agreed = F.when(F.regexp_extract(word, "^(.+?)eed$", 1).rlike(MEASURE_0), F.regexp_replace(word, "d$", "")).otherwise(word)
    return F.when(word.rlike("eed$"), agreed).when(rest.rlike(VOWEL), _bound(rest, _repaired)).otherwise(word)


def _repaired(rest: Column) -> Column:
    double = (F.lower(F.right(rest, F.lit(1))) == F.lower(F.substring(rest, -2, 1))) & (F.char_length(rest) > 1) & rest.rlike("[^aeiouylsz]$")
    return F.when(rest.rlike("(at|bl|iz)$") | rest.rlike(SHORT_1) & ~double, F.concat(rest, F.lit("e"))).when(double, F.regexp_replace(rest, ".$", "")).otherwise(rest)


def _last_y(word: Column) -> Column:
    return F.when(F.regexp_extract(word, "^(.+)[yY]$", 1).rlike(VOWEL), F.regexp_replace(word, "[yY]$", "i")).otherwise(word)


def _cut(word: Column) -> Column:
    rest, ion = F.regexp_extract(word, _ending(STEP_4), 1), F.regexp_extract(word, "^(.*[st])ion$", 1)
    return F.when(rest.rlike(MEASURE_1), rest).when(ion.rlike(MEASURE_1), ion).otherwise(word)


def _last_e(word: Column) -> Column:
    rest = F.regexp_extract(word, "^(.+)e$", 1)
    return F.when(rest.rlike(MEASURE_1) | rest.rlike(MEASURE_IS_1) & ~rest.rlike(SHORT), rest).otherwise(word)


def _last_l(word: Column) -> Column:
    return F.when(word.rlike("ll$") & word.rlike(MEASURE_1), F.regexp_replace(word, "l$", "")).otherwise(word)


def stem(word: Column) -> Column:
    """The stem of a lower-case word of three letters a-z or more; anything else, null too, as it is."""
    steps = (_plural, _past, _last_y, lambda w: _mapped(w, STEP_2, MEASURE_0), lambda w: _mapped(w, STEP_3, MEASURE_0), _cut, _last_e, _last_l)
    found = F.regexp_replace(F.regexp_replace(word, "(^|[aeiou])y", "$1Y"), "yy", "yY")
    for step in steps:
        found = _bound(found, step)
    return F.when(word.rlike(WORD), F.lower(found)).otherwise(word)


def words(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9 without the stop words; of a null text none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+"), lambda t: (t != "") & ~t.isin(*STOP_WORDS))

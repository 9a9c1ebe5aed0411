"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, quoted, with_columns
from .spans import SPANS, Covered, span_array

#: Kinds in the order that breaks ties at one start; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "local_phone")
BASE = 4
#: Characters on either side that are searched for context words, and the least score of a span that is not base.
AROUND, ENOUGH = 40, 0.6
#: Kind: score without context, what a context word adds, the words.
SCORES = {
    "email": (0.80, 0.15, "mail|email|e-mail|contact|write|adresse|correo|courriel"),
    "ip": (0.55, 0.30, "ip|address|host|server|client|adresse|login"),
    "card": (0.80, 0.15, "card|credit|visa|mastercard|payment|carte|karte|tarjeta"),
    "phone": (0.70, 0.20, "phone|tel|call|mobile|fax|telefon|téléphone|teléfono"),
    "iban": (0.90, 0.08, "iban|bank|account|konto|compte|cuenta"),
    "ssn": (0.30, 0.50, "ssn|social|security|taxpayer"),
    "local_phone": (0.30, 0.40, "phone|tel|call|mobile|fax|telefon|téléphone|teléfono"),
}

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTS = re.compile(r"\.[0-9]++\.[0-9]++\.[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){13,}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"[0-9]{3}\)?[ -][0-9]{3}-[0-9]{4}(?![0-9-])")
_CONTEXT = {k: re.compile(rf"(?<![^\W\d_])(?:{words})(?![^\W\d_])", re.IGNORECASE) for k, (_, _, words) in SCORES.items()}
_NOT_DIGITS = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    """The check of card numbers: every second digit from the right doubled, digit sums added, a multiple of 10."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of account numbers: the first four characters moved to the end, letters as 10 to 35, remainder 1."""
    plain = iban.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    out, free = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            free = m.end()
    return out


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Spans that their pattern and checks confirm, base kinds first. Each pattern takes time linear in the text."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if _DOTS.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGITS.sub("", m[0])
        if len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGITS.sub("", m[0])) <= 15]
    out += [("iban", *m.span()) for m in _IBAN.finditer(text) if mod97(m[0]) and not text[m.start() - 1 : m.start()].isalnum()]
    if "-" in text:
        out += [("ssn", *m.span()) for m in _SSN.finditer(text) if text[m.start() - 1 : m.start()] not in tuple("0123456789-")]
        out += [("local_phone", *m.span()) for m in _LOCAL_PHONE.finditer(text) if text[m.start() - 1 : m.start()] not in tuple("0123456789-+")]
    return out


def scan(text: str) -> list[tuple[str, int, int, float, bool]]:
    """All spans of a text by start, then kind: base ones, and others that score enough and overlap no span before them."""
    out: list[tuple[str, int, int, float, bool]] = []
    taken = Covered()
    for kind, start, end in proposals(text):
        plain, more, _ = SCORES[kind]
        near = text[max(0, start - AROUND) : start] + "\n" + text[end : end + AROUND]
        score = round(plain + (more if _CONTEXT[kind].search(near) else 0.0), 4)
        base = KINDS.index(kind) < BASE
        if base or score >= ENOUGH and not taken.meets(start, end):
            out.append((kind, start, end, score, base))
            taken.add(start, end)
    out.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return out


def find_personal_data(df: DataFrame, text: str = "text", spans: str = "personal_data") -> DataFrame:
    """df with the personal data found in each whole text: kind, start, end, score, base.

    A null or empty text has no spans. Rows stay as they are, repeated ones included; an old
    column named like the new one gives way. One pass without a shuffle.
    """
    bounded_batches(df.sparkSession)

    @F.arrow_udf(SPANS)
    def run(texts: pa.Array) -> pa.Array:
        found = [scan(t) if t else [] for t in texts.to_pylist()]
        return span_array([s for one in found for s in one], [len(one) for one in found])

    return with_columns(df, {spans: run(F.col(quoted(text)).cast("string"))})

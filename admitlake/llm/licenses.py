"""License notices: ordered signature rules behind a keyword prefilter, overlaps resolved by priority and containment."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, quoted, utf8_parts, with_columns
from .spans import Outermost

#: The base: phrases of consecutive words and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label: (identifier in tags, name as written in prose); a space stands for any white space. Names that are
#: everyday words or syllables end in "license" or the like, so that prose alone does not match them.
LICENSES: dict[str, tuple[str, str]] = {
    "apache-2.0": (r"apache-2\.0", r"apache (?:software )?licen[cs]e,? (?:version |v\.? ?)?2(?:\.0)?"),
    "apache-1.1": (r"apache-1\.1", r"apache (?:software )?licen[cs]e,? (?:version |v\.? ?)?1\.1"),
    "apache-1.0": (r"apache-1\.0", r"apache (?:software )?licen[cs]e,? (?:version |v\.? ?)?1\.0"),
    "mit": (r"mit", r"mit (?:expat )?licen[cs]e"),
    "mit-0": (r"mit-0", r"mit no attribution licen[cs]e"),
    "x11": (r"x11", r"x11 licen[cs]e"),
    "isc": (r"isc", r"isc licen[cs]e"),
    "0bsd": (r"0bsd", r"(?:zero-clause|0-clause) bsd licen[cs]e"),
    "bsd-2-clause": (r"bsd-2-clause", r"(?:simplified|2-clause|two-clause|freebsd) bsd licen[cs]e|bsd 2-clause"),
    "bsd-3-clause": (r"bsd-3-clause", r"(?:new|modified|revised|3-clause|three-clause) bsd licen[cs]e|bsd 3-clause"),
    "bsd-4-clause": (r"bsd-4-clause", r"(?:original|4-clause|four-clause) bsd licen[cs]e|bsd 4-clause"),
    "bsd": (r"bsd", r"bsd(?:-style)? licen[cs]e"),
    "gpl-1.0": (r"gpl-1\.0(?:-only|-or-later|\+)?", r"(?:gnu )?(?:general public licen[cs]e|gpl),? (?:version |v\.? ?)1(?:\.0)?"),
    "gpl-2.0": (r"gpl-2\.0(?:-only|-or-later|\+)?", r"(?:gnu )?(?:general public licen[cs]e|gpl),? (?:version |v\.? ?)2(?:\.0)?"),
    "gpl-3.0": (r"gpl-3\.0(?:-only|-or-later|\+)?", r"(?:gnu )?(?:general public licen[cs]e|gpl),? (?:version |v\.? ?)3(?:\.0)?"),
    "lgpl-2.0": (r"lgpl-2\.0(?:-only|-or-later|\+)?", r"(?:gnu )?(?:library general public licen[cs]e|lgpl),? (?:version |v\.? ?)2(?:\.0)?"),
    "lgpl-2.1": (r"lgpl-2\.1(?:-only|-or-later|\+)?", r"(?:gnu )?(?:lesser general public licen[cs]e|lgpl),? (?:version |v\.? ?)2\.1"),
    "lgpl-3.0": (r"lgpl-3\.0(?:-only|-or-later|\+)?", r"(?:gnu )?(?:lesser general public licen[cs]e|lgpl),? (?:version |v\.? ?)3(?:\.0)?"),
    "agpl-3.0": (r"agpl-3\.0(?:-only|-or-later|\+)?", r"(?:gnu )?(?:affero general public licen[cs]e|agpl),? (?:version |v\.? ?)3(?:\.0)?"),
    "lgpl": (r"lgpl", r"gnu (?:lesser|library) general public licen[cs]e|gnu lgpl"),
    "agpl": (r"agpl", r"(?:gnu )?affero general public licen[cs]e|gnu agpl"),
    "gfdl": (r"gfdl-1\.[123](?:-only|-or-later)?", r"gnu free documentation licen[cs]e|gfdl licen[cs]e"),
    "mpl-1.0": (r"mpl-1\.0", r"mozilla public licen[cs]e,? (?:version |v\.? ?)1\.0"),
    "mpl-1.1": (r"mpl-1\.1", r"mozilla public licen[cs]e,? (?:version |v\.? ?)1\.1"),
    "mpl-2.0": (r"mpl-2\.0", r"mozilla public licen[cs]e,? (?:version |v\.? ?)2(?:\.0)?"),
    "epl-1.0": (r"epl-1\.0", r"eclipse public licen[cs]e,? (?:version |v\.? ?|- v ?)1(?:\.0)?"),
    "epl-2.0": (r"epl-2\.0", r"eclipse public licen[cs]e,? (?:version |v\.? ?|- v ?)2(?:\.0)?"),
    "eupl-1.1": (r"eupl-1\.1", r"european union public licen[cs]e,? (?:version |v\.? ?)1\.1"),
    "eupl-1.2": (r"eupl-1\.2", r"european union public licen[cs]e,? (?:version |v\.? ?)1\.2"),
    "cddl-1.0": (r"cddl-1\.0", r"common development and distribution licen[cs]e,? (?:version |v\.? ?)1\.0"),
    "cddl-1.1": (r"cddl-1\.1", r"common development and distribution licen[cs]e,? (?:version |v\.? ?)1\.1"),
    "cpl-1.0": (r"cpl-1\.0", r"common public licen[cs]e,? (?:version |v\.? ?)1\.0"),
    "artistic-1.0": (r"artistic-1\.0(?:-perl)?", r"(?:perl )?artistic licen[cs]e,? (?:version |v\.? ?)?1(?:\.0)?"),
    "artistic-2.0": (r"artistic-2\.0", r"artistic licen[cs]e,? (?:version |v\.? ?)?2(?:\.0)?"),
    "bsl-1.0": (r"bsl-1\.0", r"boost software licen[cs]e"),
    "zlib": (r"zlib", r"zlib(?:/libpng)? licen[cs]e"),
    "unlicense": (r"unlicense", r"the unlicense"),
    "wtfpl": (r"wtfpl", r"do what the f\S+ you want to public licen[cs]e"),
    "cc0-1.0": (r"cc0-1\.0", r"cc0(?: 1\.0)?(?: universal)?|creative commons zero"),
    "cc-by-1.0": (r"cc-by-1\.0", r"creative commons attribution 1\.0"),
    "cc-by-2.0": (r"cc-by-2\.0", r"creative commons attribution 2\.0"),
    "cc-by-2.5": (r"cc-by-2\.5", r"creative commons attribution 2\.5"),
    "cc-by-3.0": (r"cc-by-3\.0", r"creative commons attribution 3\.0|cc[ -]by[ -]3\.0"),
    "cc-by-4.0": (r"cc-by-4\.0", r"creative commons attribution 4\.0|cc[ -]by[ -]4\.0"),
    "cc-by-sa-2.5": (r"cc-by-sa-2\.5", r"creative commons attribution[- ]share ?alike 2\.5|cc[ -]by[ -]sa[ -]2\.5"),
    "cc-by-sa-3.0": (r"cc-by-sa-3\.0", r"creative commons attribution[- ]share ?alike 3\.0|cc[ -]by[ -]sa[ -]3\.0"),
    "cc-by-sa-4.0": (r"cc-by-sa-4\.0", r"creative commons attribution[- ]share ?alike 4\.0|cc[ -]by[ -]sa[ -]4\.0"),
    "cc-by-nc-3.0": (r"cc-by-nc-3\.0", r"creative commons attribution[- ]non ?commercial 3\.0|cc[ -]by[ -]nc[ -]3\.0"),
    "cc-by-nc-4.0": (r"cc-by-nc-4\.0", r"creative commons attribution[- ]non ?commercial 4\.0|cc[ -]by[ -]nc[ -]4\.0"),
    "cc-by-nd-4.0": (r"cc-by-nd-4\.0", r"creative commons attribution[- ]no ?deriv\w* 4\.0|cc[ -]by[ -]nd[ -]4\.0"),
    "cc-by-nc-sa-4.0": (r"cc-by-nc-sa-4\.0", r"cc[ -]by[ -]nc[ -]sa[ -]4\.0"),
    "cc-by-nc-nd-4.0": (r"cc-by-nc-nd-4\.0", r"cc[ -]by[ -]nc[ -]nd[ -]4\.0"),
    "odbl-1.0": (r"odbl-1\.0", r"open (?:data commons open )?database licen[cs]e"),
    "ofl-1.1": (r"ofl-1\.1", r"sil open font licen[cs]e"),
    "python-2.0": (r"python-2\.0", r"python software foundation licen[cs]e|psf licen[cs]e"),
    "postgresql": (r"postgresql", r"postgresql licen[cs]e"),
    "ncsa": (r"ncsa", r"university of illinois/ncsa open source licen[cs]e"),
    "w3c": (r"w3c", r"w3c (?:software )?(?:notice and )?licen[cs]e"),
    "unicode": (r"unicode-(?:dfs-201[56]|3\.0)", r"unicode licen[cs]e"),
    "php-3.01": (r"php-3\.01", r"php licen[cs]e,? (?:version |v\.? ?)?3\.01"),
    "ruby": (r"ruby", r"ruby licen[cs]e"),
    "openssl": (r"openssl", r"openssl licen[cs]e"),
    "afl-3.0": (r"afl-3\.0", r"academic free licen[cs]e,? (?:version |v\.? ?)?3(?:\.0)?"),
    "osl-3.0": (r"osl-3\.0", r"open software licen[cs]e,? (?:version |v\.? ?)?3(?:\.0)?"),
    "ms-pl": (r"ms-pl", r"microsoft public licen[cs]e"),
    "ms-rl": (r"ms-rl", r"microsoft reciprocal licen[cs]e"),
    "sspl-1.0": (r"sspl-1\.0", r"server side public licen[cs]e"),
    "busl-1.1": (r"busl-1\.1", r"business source licen[cs]e"),
    "elastic-2.0": (r"elastic-2\.0", r"elastic licen[cs]e,? (?:version |v\.? ?)?2(?:\.0)?"),
    "mulanpsl-2.0": (r"mulanpsl-2\.0", r"mulan permissive software licen[cs]e"),
    "blueoak-1.0.0": (r"blueoak-1\.0\.0", r"blue oak model licen[cs]e"),
    "public-domain": (r"licenseref-public-domain", r"(?:released|dedicated|placed) (?:in|on)?to the public domain|in the public domain"),
    "proprietary": (r"licenseref-proprietary", r"proprietary and confidential|unauthori[sz]ed copying of this"),
}

#: Phrases of licence bodies, with the label of the body: they need no name nearby.
BODIES: dict[str, tuple[str, ...]] = {
    "mit": (r"permission is hereby granted, free of charge, to any person obtaining a copy", r"the above copyright notice and this permission notice shall be included in all"),
    "isc": (r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee",),
    "bsd": (r"redistribution and use in source and binary forms, with or without modification, are permitted", r"neither the name of .{3,80} nor the names of its contributors"),
    "apache-2.0": (r"you may not use this file except in compliance with the licen[cs]e", r"apache\.org/licenses/license-2\.0"),
    "gpl": (r"you can redistribute it and/or modify it under the terms of the gnu general public licen[cs]e", r"gnu\.org/licenses/gpl", r"you should have received a copy of the gnu general public licen[cs]e"),
    "lgpl": (r"gnu\.org/licenses/lgpl", r"you should have received a copy of the gnu lesser general public licen[cs]e"),
    "agpl": (r"gnu\.org/licenses/agpl", r"you should have received a copy of the gnu affero general public licen[cs]e"),
    "mpl-2.0": (r"this source code form is subject to the terms of the mozilla public licen[cs]e", r"mozilla\.org/mpl/2\.0"),
    "zlib": (r"this software is provided 'as-is', without any express or implied warranty",),
    "unlicense": (r"this is free and unencumbered software released into the public domain", r"unlicense\.org"),
    "bsl-1.0": (r"boost\.org/license_1_0",),
    "cc-by-4.0": (r"creativecommons\.org/licenses/by/4\.0",),
    "cc-by-sa-4.0": (r"creativecommons\.org/licenses/by-sa/4\.0",),
    "cc-by-sa-3.0": (r"creativecommons\.org/licenses/by-sa/3\.0",),
    "cc-by-nc-4.0": (r"creativecommons\.org/licenses/by-nc/4\.0",),
    "cc-by-nd-4.0": (r"creativecommons\.org/licenses/by-nd/4\.0",),
    "cc0-1.0": (r"creativecommons\.org/publicdomain/zero/1\.0",),
    "copyright": (r"(?:copyright|\(c\)|©) (?:\(c\) |© )?(?:19|20)\d\d", r"copyright (?:notice|holders?|owner)"),
}

@dataclass(frozen=True)
class Rule:
    """A signature: the smaller priority wins; one of the keywords must stand in the text before the pattern is tried."""

    label: str
    priority: int
    confidence: float
    keywords: tuple[str, ...]
    pattern: re.Pattern[str]


def spaced(body: str) -> str:
    """A rule's body with its spaces as any white space: one or more, or any number where the space is optional."""
    return re.sub(r"\[[^\]]*\]| \?| ", lambda m: m[0].replace(" ", r"\s") if m[0][0] == "[" else r"\s*" if m[0] == " ?" else r"\s+", body)


def keywords(pattern: str) -> tuple[str, ...]:
    """Strings of which every match of a pattern holds one: of those that can be had, the set whose weakest string is longest."""

    def weight(found: set[str]) -> tuple[float, int]:
        return min(sum(1.0 if c.isalpha() else 0.5 for c in w) + 1.5 * (not w.isascii()) for w in found), -len(found)

    def needed(items) -> set[str]:
        sets: list[set[str]] = []
        run = ""
        for kind, value in items:
            name = str(kind)
            if name == "LITERAL":
                run += chr(value)
                continue
            if run:
                sets.append({run})
                run = ""
            if name == "SUBPATTERN":
                sets.append(needed(value[3]))
            elif name == "BRANCH":
                parts = [needed(part) for part in value[1]]
                sets.append(set().union(*parts) if all(parts) else set())
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
                sets.append(needed(value[2]))
        if run:
            sets.append({run})
        return max(filter(None, sets), key=weight, default=set())

    return tuple(sorted(needed(_parser.parse(pattern))))


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules in order: tags, bodies, grants, references by name, each license's in the order listed."""

    def made(label: str, priority: int, confidence: float, body: str) -> Rule:
        pattern = spaced(body)
        return Rule(label, priority, confidence, keywords(pattern), re.compile(rf"(?<![a-z0-9])(?:{pattern})(?![a-z0-9])"))

    under = r"(?:licen[cs]ed|released|distributed|available|published|provided|covered|governed)(?: [a-z]+){0,3} (?:under|by)(?: the)?(?: terms of)?(?: the)?"
    out: list[Rule] = []
    for label, (identifier, _) in LICENSES.items():
        out.append(made(label, 1, 0.99, rf"spdx-license-identifier: ?(?:[a-z0-9.+-]+ (?:or|and) ){{0,4}}{identifier}"))
    for label, bodies in BODIES.items():
        out += [made(label, 2 if label != "copyright" else 9, 0.95 if label != "copyright" else 0.4, b) for b in bodies]
    for label, (_, name) in LICENSES.items():
        out.append(made(label, 3, 0.9, rf"{under} (?:{name})"))
    for label, (_, name) in LICENSES.items():
        out.append(made(label, 4, 0.7, rf"(?:{name})"))
    for label, (identifier, _) in LICENSES.items():
        out.append(made(label, 5, 0.6, rf"licen[cs]e ?[:=] ?[\"']?{identifier}"))
    return tuple(out)


_SEPARATORS = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PHRASES = [(label, re.compile(rb"(?<![0-9a-z\x80-\xff])" + _SEPARATORS.join(p.encode().split()) + rb"(?![0-9a-z\x80-\xff])")) for p, label in PHRASES.items()]
_WORD_BYTE = np.array([48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90 or b >= 128 for b in range(256)])
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@lru_cache(maxsize=1)
def gates() -> tuple[bytes, ...]:
    """A text without any of these holds none of the rules' notices: all keywords that hold no other one."""
    every = {w for rule in rules() for w in rule.keywords}
    return tuple(sorted((w.encode() for w in every if not any(v != w and v in w for v in every)), key=lambda w: (len(w), w)))


def detections(low: str) -> list[tuple[int, int, Rule]]:
    """Spans of a lower-cased text that rules match and no better-placed span contains, by start."""
    held = {w for w in {w for rule in rules() for w in rule.keywords} if w in low}
    found = [(m.start(), m.end(), k, rule) for k, rule in enumerate(rules()) if not held.isdisjoint(rule.keywords) for m in rule.pattern.finditer(low)]
    found.sort(key=lambda d: (d[3].priority, d[0] - d[1], d[0], d[2]))
    kept: list[tuple[int, int, Rule]] = []
    outermost = Outermost()
    for start, end, _, rule in found:
        if not outermost.holds(start, end):
            kept.append((start, end, rule))
            outermost.add(start, end)
    return sorted(kept, key=lambda d: (d[0], d[1]))


def scan(raw: bytes) -> tuple[int, int | None, int | None, list[str], list[str], float]:
    """Base places, first and last word, base labels, all labels, score of a text's UTF-8 bytes."""
    low = raw.lower()
    gated = any(g in low for g in gates())
    if not gated and not (b"cc" in low and b"by" in low) and b"public" not in low and b"reserved" not in low:
        return 0, None, None, [], [], 0.0
    places, base = [], []
    for label, pattern in _PHRASES:
        starts = [m.start() for m in pattern.finditer(low)]
        places += starts
        base += [label] * bool(starts)
    labels, doubt = set(base), 1.0
    for label in base:
        doubt *= 0.5 if label == "reserved" else 0.2
    if gated:
        kept = detections(low.decode("utf-8"))
        for label, confidence in {r.label: r.confidence for _, _, r in sorted(kept, key=lambda d: d[2].confidence)}.items():
            labels.add(label)
            doubt *= 1 - confidence
    first = last = None
    if places:
        first, last = (len(_WORD.findall(low[:at])) for at in (min(places), max(places)))
    return len(places), first, last, sorted(base), sorted(labels), round(1 - doubt, 6)


def word_counts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many words each text has."""
    inside = _WORD_BYTE[raw]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < at[1:]]
    starts[heads] = inside[heads]
    return np.diff(np.searchsorted(np.flatnonzero(starts), at))


def find_licenses(df: DataFrame, text: str = "text", found: str = "licenses") -> DataFrame:
    """df with a struct about the license notices of each whole text.

    n_words; n_base, first_word and last_word: places of the base phrases and the smallest and
    largest word at which one starts (null if none); base_labels and labels: sorted arrays without
    repeats, the second with the rules' own; score: how sure the notices make it that the text
    states a license, 0 without any. A null or empty text has no words and no labels. Rows stay as
    they are; an old column named like the new one gives way. One pass without a shuffle.
    """
    bounded_batches(df.sparkSession)

    @F.arrow_udf("struct<n_words:long,n_base:long,first_word:long,last_word:long,base_labels:array<string>,labels:array<string>,score:double>")
    def run(texts: pa.Array) -> pa.Array:
        raw, at = utf8_parts(texts)
        whole, ends = raw.tobytes(), at.tolist()
        rows = list(zip(*[scan(whole[a:b]) for a, b in zip(ends, ends[1:])])) or [[]] * 6
        words = pa.array(word_counts(raw, at), pa.int64()) if len(at) > 1 else pa.array([], pa.int64())
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.float64())
        names = ("n_base", "first_word", "last_word", "base_labels", "labels", "score")
        return pa.StructArray.from_arrays([words, *[pa.array(list(r), k) for r, k in zip(rows, kinds)]], ["n_words", *names])

    return with_columns(df, {found: run(F.col(quoted(text)).cast("string"))})

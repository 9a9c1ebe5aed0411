"""A page's elements by nesting: parts are cut at their own end, and content is found by tag, role, class and id, as column expressions.

Tags are read into a list and folded over a stack of open elements; the fold keeps no more than the stack and
the places of the elements that are looked for. An end tag closes the last open element of its name and
all inside it; one without such an element counts for nothing; what is open at the end ends there. A tag ends at its first >.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import unescaped

#: Comments, declarations, scripts and styles with what is in them, tags, text.
TOKENS = r"(?is)(<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<[!?][^>]*>|</?[a-z][^>]*>|[^<]+|<)"
# Elements without an end; parts that are no content; where content is, first come first served; words of a class or an id that tell the same.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
FRAME = ("nav", "footer", "header")
SELECTORS = ("main", "article", '[role="main"]', ".main-content", ".content", "#content", ".post-content", ".entry-content")
FRAME_WORDS = ("nav", "menu", "sidebar", "header", "footer", "breadcrumb", "social", "share", "comment", "advertisement", "ad")
CONTENT_WORDS = {"div": ("main", "content", "body", "article"), "section": ("main", "content", "body")}

_CUT = 1 << 30
_STATE = "struct<stack:array<struct<name:string,at:int,what:int>>,done:array<struct<what:int,start:int,end:int>>>"


def attribute(tag: Column, name: str) -> Column:
    """A tag's attribute in double, single or no quotes; empty without one."""
    value = rf"""(?is)^<[^>]*?\s{name}\s*=\s*(?:"([^">]*)"|'([^'>]*)'|([^\s"'>]+))"""
    return F.concat(*[F.regexp_extract(tag, value, k) for k in (1, 2, 3)])


def _has_class(tag: Column, name: str) -> Column:
    return F.array_contains(F.split(attribute(tag, "class"), r"\s+"), name)


def selected(name: Column, tag: Column, selector: str) -> Column:
    """Whether a tag is meant by a selector: a name, .class, #id or [attribute="value"]."""
    if selector.startswith("."):
        return _has_class(tag, selector[1:])
    if selector.startswith("#"):
        return attribute(tag, "id") == selector[1:]
    if selector.startswith("["):
        key, value = selector[1:-1].split("=")
        return attribute(tag, key) == value.strip('"')
    return name == selector


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _elements(tokens: Column, what) -> Column:
    """The places (what, start, end) of the elements for which what(name, tag) is not 0: from the place of their tag to that of their end."""
    name = lambda t: F.lower(F.regexp_extract(t, "^</?([a-zA-Z][a-zA-Z0-9:-]*)", 1))
    tags = F.transform(tokens, lambda t, i: F.struct(name(t).alias("name"), t.startswith("</").alias("ends"), i.alias("at"), F.when(name(t).isin("", "script", "style", *VOID) | t.rlike(r"/>\z"), F.lit(None).cast("int")).when(t.startswith("</"), 0).otherwise(what(name(t), t)).alias("what")))
    tags = F.filter(tags, lambda s: s["what"].isNotNull())

    def closed(held: Column, at: Column) -> Column:
        return F.transform(F.filter(held, lambda s: s["what"] != 0), lambda s: F.struct(s["what"].alias("what"), s["at"].alias("start"), at.cast("int").alias("end")))

    def step(state: Column, tag: Column) -> Column:
        stack, n = state["stack"], F.size(state["stack"])
        last = n - F.array_position(F.reverse(F.transform(stack, lambda s: s["name"])), tag["name"]).cast("int") + 1
        opened = F.struct(F.concat(stack, F.array(F.struct(tag["name"].alias("name"), tag["at"].cast("int").alias("at"), tag["what"].alias("what")))).alias("stack"), state["done"].alias("done"))
        ended = F.struct(F.slice(stack, F.lit(1), last - 1).alias("stack"), F.concat(state["done"], closed(F.slice(stack, last, n - last + 1), tag["at"])).alias("done"))
        return F.when(~tag["ends"], opened).when(last <= n, ended).otherwise(state)

    nothing = F.from_json(F.lit('{"stack":[],"done":[]}'), _STATE)
    return F.aggregate(tags, nothing, step, lambda s: F.concat(s["done"], closed(s["stack"], F.size(tokens))))


def _words(tokens: Column, cuts: Column, start: Column, end: Column, closed: bool) -> Column:
    """The text between two places outside the cuts: its pieces trimmed, blank ones left out, joined by spaces."""
    pieces = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    inside = F.filter(pieces, lambda p: (p["i"] >= start) & (p["i"] < end) & ((p["t"] == "<") | ~p["t"].startswith("<")) & ~F.exists(cuts, lambda c: (p["i"] >= c["start"]) & (p["i"] < c["end"])))
    told = F.transform(inside, lambda p: F.trim(F.regexp_replace(unescaped(p["t"], closed), r"(?U)^\s+|\s+$", "")))
    return F.array_join(F.filter(told, lambda t: t != ""), " ")


def _content(html: Column, cut, choices: list, whole: bool, closed: bool = False) -> Column:
    """The words of the first element of the first choice that has one and, if `whole`, else of the page."""
    def what(name: Column, tag: Column) -> Column:
        bits = sum((F.when(choice(name, tag), 1 << k).otherwise(0) for k, choice in enumerate(choices)), F.lit(0))
        return F.when(cut(name, tag), _CUT).otherwise(bits).cast("int")

    tokens = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TOKENS), F.lit(1))

    def read(held: Column) -> Column:
        tokens, found = held["tokens"], held["found"]
        cuts = F.filter(found, lambda e: e["what"] == _CUT)
        outside = F.filter(found, lambda e: (e["what"] != _CUT) & ~F.exists(cuts, lambda c: (e["start"] >= c["start"]) & (e["start"] < c["end"])))

        def first(k: int) -> Column:
            mine = F.transform(F.filter(outside, lambda e: e["what"].bitwiseAND(1 << k) != 0), lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end")))
            return F.array_min(mine)

        listed = [first(k) for k in range(len(choices))]
        *most, body = listed if not whole else [*listed, F.struct(F.lit(0).alias("start"), F.size(tokens).alias("end"))]
        chosen = F.coalesce(*most) if most else F.lit(None)
        words = F.transform(F.array(chosen, body), lambda e: F.when(e.isNotNull(), _words(tokens, cuts, e["start"], e["end"], closed)))
        return F.transform(F.array(words), lambda w: F.coalesce(F.nullif(w[0], F.lit("")), w[1], F.lit("")))[0]

    elements = lambda t: F.struct(t.alias("tokens"), _elements(t, what).alias("found"))
    return F.transform(F.transform(F.array(tokens), elements), read)[0]


def main_by_selectors(html: Column, closed: bool = False) -> Column:
    """The words of the first element that a selector of SELECTORS means, the selectors in order; if there is none or it is blank, those of the body, else nothing.

    Scripts, styles and the parts in FRAME are out, each to its own end. Null gives an empty text. closed: an entity
    without its semicolon is text; else it counts as a browser has it.
    """
    choices = [lambda n, t, s=s: selected(n, t, s) for s in (*SELECTORS, "body")]
    return _content(html, lambda n, _: n.isin(*FRAME), choices, whole=False, closed=closed)


def main_by_names(html: Column) -> Column:
    """The words of the first main, article, or division or section whose class or id speaks of content; else of the whole page.

    Out are scripts, styles, FRAME, aside, and every element whose class or id holds one of FRAME_WORDS.
    """
    named = lambda tag, words: (attribute(tag, "class").rlike("(?i)" + "|".join(words))) | (attribute(tag, "id").rlike("(?i)" + "|".join(words)))
    choices = [lambda n, _: n == "main", lambda n, _: n == "article", *[lambda n, t, k=k, w=w: (n == k) & named(t, w) for k, w in CONTENT_WORDS.items()]]
    return _content(html, lambda n, t: n.isin(*FRAME, "aside") | named(t, FRAME_WORDS) & ~n.isin("main", "article", "body", "html"), choices, whole=True)

"""A fetched page as the row that a corpus stores, and whether it must be rendered first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pages import main_by_selectors
from ..functions.routing import is_page
from ..functions.text import clean_text, content_hash, is_insufficient, word_count
from ..functions.urls import is_js_heavy, page_links, page_type, title

#: Least characters and words of a page; longest title; parts of addresses that tell of pages made by scripts.
CHARACTERS, WORDS, TITLE = 100, 50, 200
DYNAMIC = ("/app/", "/dashboard/", "/portal/", "/admin/")


def page_title(html: Column, closed: bool = False) -> Column:
    """The title, else the first heading, cleaned and cut to TITLE characters; empty without either."""
    return F.coalesce(F.substring(clean_text(title(html), closed=closed), 1, TITLE), F.lit(""))


def render_reason(mime: Column, main: Column, content: Column, heading: Column, js_heavy: Column, n_links: Column, url: Column, aggressive: bool = False) -> Column:
    """Why a page should be rendered before it is read, by the first rule that holds; null if as it is it will do.

    mime: of another kind than pages (null is not); main: the words found before cleaning; content: after it.
    """
    short, words = is_insufficient(content, CHARACTERS, WORDS), word_count(content)
    rules = [
        (F.coalesce(~is_page(mime), F.lit(False)), "content type"), (F.coalesce(main, F.lit("")) == "", "no content"), (short & js_heavy, "scripts"),
        (short & ((words < 10) | (F.char_length(F.trim(content)) < 50)), "very little content"), (short & (F.trim(heading) == ""), "no title"), (short & (words < WORDS // 2), "little content"), (short & F.lit(aggressive), "short content"),
        ((n_links == 0) & js_heavy, "scripts and no links"), ((n_links == 0) & short, "short content and no links"), ((n_links == 0) & F.lower(url).rlike("|".join(DYNAMIC)), "no links at a dynamic address"),
    ]
    out = F.when(F.lit(False), "")
    for holds, name in rules:
        out = out.when(holds, name)
    return out


def page_rows(pages: DataFrame, aggressive: bool = False, closed: bool = False) -> DataFrame:
    """pages (url, html, mime and others) with title, content, links, word_count, content_hash, page_type, render and insufficient.

    Null html is an empty page. Old columns of these names give way. One pass without a shuffle.
    closed: an entity without its semicolon is text.
    """
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    read = pages.withColumns({"title": page_title(html, closed), "_main": main_by_selectors(html, closed), "links": F.coalesce(page_links(html, url), F.array().cast("array<string>")), "_heavy": is_js_heavy(html, url), "page_type": page_type(url)})
    read = read.withColumn("content", F.coalesce(clean_text(F.col("_main"), closed=closed), F.lit("")))
    told = read.withColumns({
        "word_count": word_count(F.col("content")), "content_hash": content_hash(F.col("content")), "insufficient": is_insufficient(F.col("content"), CHARACTERS, WORDS),
        "render": render_reason(F.col("mime"), F.col("_main"), F.col("content"), F.col("title"), F.col("_heavy"), F.size("links"), url, aggressive),
    })
    return told.drop("_main", "_heavy")

"""Elements by nesting against a plain stack over the standard library's reader of tags."""

from __future__ import annotations

import random
import re
from html.parser import HTMLParser

import pytest
from conftest import LARGER
from pyspark.sql import functions as F

from admitlake.functions import pages


class Tree(HTMLParser):
    """Elements as lists [name, attributes, children]; an end tag closes the last open element of its name."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.root = ["", {}, []]
        self.open, self.joins = [self.root], False
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.joins = False
        node = [tag, {k: v or "" for k, v in attrs}, []]
        self.open[-1][2].append(node)
        if tag not in pages.VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.joins = False
        self.open[-1][2].append([tag, dict(attrs), []])

    def handle_endtag(self, tag):
        self.joins = False
        at = max((k for k, n in enumerate(self.open) if k and n[0] == tag), default=None)
        if at is not None:
            del self.open[at:]

    def handle_comment(self, data):
        self.joins = False

    def handle_data(self, data):
        """Text that no tag, end or comment parts is one piece."""
        inside = self.open[-1][2]
        if self.joins:
            inside[-1] += data
        else:
            inside.append(data)
        self.joins = True


def all_of(node):
    for c in node[2]:
        if isinstance(c, list):
            yield c
            yield from all_of(c)


def words(node):
    """Pieces of text, trimmed."""
    return " ".join(x for c in node[2] if (x := c.strip() if isinstance(c, str) else words(c)))


def without(node, gone):
    node[2] = [c for c in node[2] if isinstance(c, str) or not gone(c)]
    for c in node[2]:
        if isinstance(c, list):
            without(c, gone)
    return node


def meant(n, s):
    if s[0] == ".":
        return s[1:] in n[1].get("class", "").split()
    return n[1].get("id", "") == s[1:] if s[0] == "#" else n[1].get("role", "") == "main" if s[0] == "[" else n[0] == s


def plain_selectors(html):
    root = without(Tree(html).root, lambda n: n[0] in (*pages.FRAME, "script", "style"))
    for s in pages.SELECTORS:
        if found := next((n for n in all_of(root) if meant(n, s)), None):
            if w := words(found):
                return w
            break
    body = next((n for n in all_of(root) if n[0] == "body"), None)
    return words(body) if body else ""


def says(n, names):
    return any(re.search("|".join(names), n[1].get(k, ""), re.I) for k in ("class", "id"))


def plain_names(html):
    gone = lambda n: n[0] in (*pages.FRAME, "aside", "script", "style") or says(n, pages.FRAME_WORDS) and n[0] not in ("main", "article", "body", "html")
    root = without(Tree(html).root, gone)
    tests = [lambda n: n[0] == "main", lambda n: n[0] == "article", *[lambda n, k=k, w=w: n[0] == k and says(n, w) for k, w in pages.CONTENT_WORDS.items()]]
    found = next((n for t in tests for n in all_of(root) if t(n)), None)
    return (words(found) if found else "") or words(root)


def made(draw, depth=0):
    if depth > 5 or draw.random() < 0.3:
        return draw.choice(["some words", " &amp; more ", "", "x<br>y", "<img src='a.png'/>", "<!-- <nav> -->", "<script>var a = '<main>';</script>", "<style>p {}</style>", "&copy; tail", "</div>", "</p>"])
    name = draw.choice(["div", "div", "nav", "section", "main", "article", "p", "footer", "span", "aside", "DIV", "header"])
    attrs = draw.choice(["", "", ' class="content wide"', " class='main-content'", ' id="content"', ' role="main"', ' class="top-menu"', ' id=sidebar', ' class="post-content"', ' class="article-body"', ' data-class="content"'])
    inside = "".join(made(draw, depth + 1) for _ in range(draw.randint(0, 4)))
    return f"<{name}{attrs}>{inside}" + (f"</{name}>" if draw.random() < 0.93 else "")


@pytest.fixture(scope="module")
def html(spark):
    draw = random.Random(8)
    found = [f"<html><head><title>t</title></head><body>{''.join(made(draw) for _ in range(draw.randint(1, 5)))}</body></html>" for _ in range(500)]
    found += [made(draw) for _ in range(100)] + ["", "plain", "<div class=content><div>a</div>b</div>c", "<nav><nav>x</nav>y</nav>z<body>k</body>", "<body><main> </main>rest</body>"]
    found += [r["html"] for r in spark.read.parquet(f"{LARGER}/pages.parquet").limit(60).collect()]
    return found


def squeezed(text):
    return re.sub(r"\s+", " ", text)


@pytest.mark.parametrize(("native", "plain"), [(pages.main_by_selectors, plain_selectors), (pages.main_by_names, plain_names)])
def test_same_as_the_tree(spark, html, native, plain):
    table = spark.createDataFrame(list(enumerate(html)) + [(-1, None)], "id int, html string").repartition(4)
    found = {r["id"]: r["text"] for r in table.select("id", native(F.col("html")).alias("text")).collect()}
    assert found[-1] == ""
    for i, h in enumerate(html):
        assert squeezed(found[i]) == squeezed(plain(h)), h


def test_long_page(spark):
    page = "<body>" + "<div class='content'><p>word</p>" * 300 + "<nav>" + "<ul><li>x</li></ul>" * 2000 + "</nav>" + "</div>" * 300
    got = spark.createDataFrame([(page,)], "html string").select(pages.main_by_selectors(F.col("html"))).first()[0]
    assert got == " ".join(["word"] * 300)


@pytest.mark.parametrize("name", ["html_nested", "page_rows"])
def test_entities_without_a_semicolon_are_text_as_in_the_sql(name, spark, tmp_path):
    import duckdb

    from admitlake.plans import QUERIES, SQL

    html = "<html><head><title>One &amp two</title></head><body><article><h1>Three &amp</h1><p>four &ampfive &amp;&amp six &copy seven &copy; eight</p></article></body></html>"
    at = f"{tmp_path}/pages.parquet"
    duckdb.sql(f"copy (select page_id::bigint as page_id, 'https://a.org/' || page_id as url, '{html}' as html from range(1, 13) t(page_id)) to '{at}' (format parquet)")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{at}'")
    got = QUERIES[name](spark, str(tmp_path)).toPandas()
    columns = sorted(got.columns)
    told = lambda frame: sorted(tuple(str(v) for v in r) for r in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False))
    assert told(got) == told(con.sql(SQL[name]).df())

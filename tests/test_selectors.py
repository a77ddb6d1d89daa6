"""Selectors over nodes, and the pages of an archive of pictures."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideglass.functions import pictures, selectors
from tideglass.functions.html import parse

PAGE = """<div id=a class="x y"><p>one <b>two</b></p><p class="x">three<br>four</p><ul><li><a href="/1">L1</a><li class="y z"><a href="/2" rel="next up" data-n="5">L2</a></ul></div><p title="a, b">out</p><script>if (a<b) {}</script>"""


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(PAGE,)], "h string").select(selectors.page_nodes("h").alias("n")).cache()


def found(nodes, selector):
    return nodes.select(F.transform(selectors.select(F.col("n"), selector), lambda n: F.coalesce(selectors.text(F.col("n"), n), F.lit("-"))).alias("v")).first().v


@pytest.mark.parametrize(
    ("selector", "want"),
    [
        ("p", ["one two", "three four", "out"]), ("div > p", ["one two", "three four"]), ("#a .x", ["three four"]), ("div.x.y > ul a", ["L1", "L2"]), ("div.y.x p.x", ["three four"]), ("li.z > a, p.x", ["three four", "L2"]), ("[href^='/']", ["L1", "L2"]),
        ('a[rel~="up"][data-n]', ["L2"]), ("a[href$=2]", ["L2"]), ("a[href*=zz]", []), ("div > a", []), ("ul>li>a", ["L1", "L2"]), ("div div", []), ("[title='a, b']", ["out"]), ("P , B", ["one two", "two", "three four", "out"]), ("div li, li", ["L1", "L2"]), (".x > .x", ["three four"]), ("script", ["if (a<b) {}"]),
        ("[rel=next]", []), ("[href^='']", []), ("*.z", ["L2"]),
    ],
)
def test_selectors(nodes, selector, want):
    assert found(nodes, selector) == want


@pytest.mark.parametrize("selector", ["", "a,", "> a", "a >", "li:first", "a + b", "[", "a[=x]", "#"])
def test_what_is_no_selector(selector):
    with pytest.raises(selectors.SelectorError):
        selectors.compiled(selector)


def test_nodes_and_markup(spark, nodes):
    n = F.col("n")
    row = nodes.select(
        selectors.markup(n, selectors.first(n, "div")).alias("m"), selectors.text(n, selectors.following(n, selectors.first(n, "p"))).alias("next"), selectors.first(n, "nothing", "b").alias("b"), selectors.first(n, "nothing").alias("none"), selectors.following(n, selectors.first(n, "script")).alias("end"),
        F.size(selectors.select(n, "a", selectors.first(n, "li.z"))).alias("within"), F.size(selectors.select(n, "a", selectors.first(n, "nothing"))).alias("whole"),
    ).first()
    assert row.m == '<div id="a" class="x y"><p>one <b>two</b></p><p class="x">three<br>four</p><ul><li><a href="/1">L1</a></li><li class="y z"><a href="/2" rel="next up" data-n="5">L2</a></li></ul></div>'
    assert (row.next, row.b.tag, row.none, row.end, row.within, row.whole) == ("three four", "b", None, None, 1, 2)
    empty = spark.createDataFrame([(None,), ("",), ("just text",)], "h string").select(selectors.page_nodes("h").alias("n"))
    assert [r[0] for r in empty.select(F.size(selectors.select(F.col("n"), "*"))).collect()] == [0, 0, 0]
    assert [r[0] for r in empty.select(F.size("n")).collect()] == [0, 0, 1]


def test_deep_pages(spark):
    """A page of many levels, and one of many elements beside one another."""
    pages = ["<div>" * 3000 + "<a href=x>in</a>" + "</div>" * 3000, "<ul>" + "<li><a href=x>y</a></li>" * 2000 + "</ul>"]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, h string").select("i", selectors.page_nodes("h").alias("n"))
    assert [r[0] for r in df.orderBy("i").select(F.size(selectors.select(F.col("n"), "ul > li > a, div[id], div > a"))).collect()] == [1, 2000]


# -- pictures

CATEGORY = """<div><a href="/wiki/File:Elsewhere.jpg">guide</a></div><div id="mw-category-media"><ul><li><a href="/wiki/File:A.jpg?x=1">A</a><a href="/wiki/File:A.jpg">A again</a></li>
<li><a href="/wiki/%E3%83%95%E3%82%A1%E3%82%A4%E3%83%AB:B.png">B</a></li><li><a href="/wiki/Help:C">no file</a></li></ul></div>"""
LINKS = '<a href="//commons.wikimedia.org/wiki/Category:Temple_1?uselang=ja">a</a><a href="https://commons.wikimedia.org/wiki/Category:Temple_1">b</a><a href=" https://commons.wikimedia.org/wiki/%E3%82%AB%E3%83%86%E3%82%B4%E3%83%AA:X ">c</a><a href="https://ja.wikipedia.org/wiki/Category:Y">d</a>'
BY = '<table class="licensetpl"><tr><td>licensed under the <a href="https://creativecommons.org/licenses/by/4.0/">Creative Commons Attribution 4.0</a></td></tr></table>'
SA = '<table class="licensetpl"><tr><td><a href="https://creativecommons.org/licenses/by-sa/4.0/">Creative Commons Attribution-ShareAlike 4.0</a></td></tr></table>'
GFDL = '<div class="fileinfotpl-license">GNU Free Documentation License</div>'
FILE = '<div class="fullImageLink" id="file"><a href="//upload.wikimedia.org/wikipedia/commons/a/ab/T.jpg?utm=1"><img></a></div><table><tr><td id="fileinfotpl_aut">Author</td><td><a href="/u">山田 <b>太郎</b></a></td></tr></table>'


def of(spark, page, what):
    return spark.createDataFrame([(page,)], "h string").select(selectors.page_nodes("h").alias("n")).select(what(F.col("n")).alias("v")).first().v


def test_files_of_a_category(spark):
    assert of(spark, CATEGORY, pictures.category_files) == ["https://commons.wikimedia.org/wiki/File:A.jpg", "https://commons.wikimedia.org/wiki/%E3%83%95%E3%82%A1%E3%82%A4%E3%83%AB:B.png"]
    assert of(spark, CATEGORY, lambda n: pictures.category_files(n, limit=1)) == ["https://commons.wikimedia.org/wiki/File:A.jpg"]
    # an old layout without a list of files
    assert of(spark, '<a href="/wiki/File:Old.jpg">x</a>', pictures.category_files) == ["https://commons.wikimedia.org/wiki/File:Old.jpg"]
    gallery = '<a href="/wiki/File:No.jpg">x</a><div id="mw-category-generated"><ul class="gallery big"><li><a href="/wiki/File:Yes.jpg">y</a></ul></div>'
    assert of(spark, gallery, pictures.category_files) == ["https://commons.wikimedia.org/wiki/File:Yes.jpg"]
    assert of(spark, "", pictures.category_files) == []


def test_links_to_categories(spark):
    assert of(spark, LINKS, pictures.category_links) == ["https://commons.wikimedia.org/wiki/Category:Temple_1", "https://commons.wikimedia.org/wiki/%E3%82%AB%E3%83%86%E3%82%B4%E3%83%AA:X"]
    assert of(spark, LINKS, lambda n: pictures.category_links(n, 1)) == ["https://commons.wikimedia.org/wiki/Category:Temple_1"]


URL = "https://commons.wikimedia.org/wiki/File:My_%E5%AF%BA.jpg"


def page(spark, html):
    return of(spark, html, lambda n: pictures.file_page(n, F.lit(URL)))


def test_page_of_a_file(spark):
    got = page(spark, FILE + BY)
    assert (got.title, got.picture, got.author) == ("My 寺.jpg", "https://upload.wikimedia.org/wikipedia/commons/a/ab/T.jpg", "山田 太郎")
    assert got.licence and got.reason is None and got.found == [got.licence]


def test_boxes_are_judged_one_by_one(spark):
    alone, both = page(spark, FILE + BY), page(spark, FILE + GFDL + SA + BY)
    assert both.licence == alone.licence and len(both.found) == 3 and "GFDL" in both.found
    none = page(spark, FILE)
    assert (none.licence, none.reason, none.found) == (None, "no_licence", [])
    denied = page(spark, FILE + GFDL + GFDL)
    assert denied.licence is None and denied.reason == "not_allowed: GFDL" and denied.found == ["GFDL"]


def test_authors(spark):
    by = lambda html: of(spark, html, pictures.author)
    assert by('<table><tr id="fileinfotpl_aut"><td>Author</td><td>Hana</td></tr></table>') == "Hana"
    assert by('<table><tr><td class="fileinfotpl_aut">Author</td><td></td></tr><tr><td id="fileinfotpl_src">Source</td><td>own work</td></tr></table>') == "own work"
    assert by("<p>none</p>") is None
    assert of(spark, '<div id="file"><a class="internal" href="https://evil.example/x.jpg">x</a></div>', pictures.picture_url) is None


def flat(html):
    return [(n["tag"], n["parent"], n["last"], None if n["attrs"] is None else dict(n["attrs"]), n["text"]) for n in selectors._flat(parse(html))] if html else []


def read(htmls):
    """The nodes of pages in one batch, and how many characters of pages each part that is given back has."""
    parts = list(selectors.page_nodes.func(iter([pa.array(htmls, pa.string())])))
    ends = [sum(len(p) for p in parts[: i + 1]) for i in range(len(parts))]
    sizes = [sum(len(h or "") for h in htmls[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
    nodes = [[(n["tag"], n["parent"], n["last"], None if n["attrs"] is None else dict(n["attrs"]), n["text"]) for n in page] for part in parts for page in part.to_pylist()]
    return nodes, sizes


def test_a_batch_of_large_pages_is_read_in_parts():
    item = '<li><a href="/wiki/File:Part_{0}.jpg">x</a><a href="/wiki/File:Part_{0}.jpg?again">{1}</a></li>'
    pages = [f'<p>a</p><div id="m"><ul class="g w">{"".join(item.format(i * k, "&amp;" if k % 9 == 0 else "y") for i in range(50 * (k % 7)))}</ul></div>' for k in range(300)] + [None, ""]
    nodes, sizes = read(pages)
    assert nodes == [flat(h) for h in pages]
    assert max(sizes) <= selectors.PART + max(len(h or "") for h in pages) and sum(sizes) > 8 * selectors.PART


def test_plain_pages_are_read_as_by_the_tree():
    rng = random.Random(2)
    plain = ["<p>", "</p>", "<li>", "</li>", "<ul>", "</ul>", '<div id="a b">', "</div>", "<tr>", '<td x="1" x="2">', '<td x="1" y="" x="3">', "</td>", "</tr>", "<th>", "text", "a > b", " \n", "<br>", '<img src="x">', "</br>", "<dt>", "<dd>", "<option>", "<h1>", "</h1>", "é日"]
    other = [*plain, "<br/>", "<P>", "<a href=x>", "</a >", "&amp;", "&", "<", '"', "<!-- c -->", "<!doctype html>", "<script>", "</script>", "<title>", "</title>", "<textarea>", '<a\thref="x">', "<x-y>", '<a b="1"c="2">', "</", "\x00", "<option selected>"]
    pages = ["".join(rng.choice(other if k % 3 == 0 else plain) for _ in range(rng.randrange(14))) for k in range(6000)]
    assert read(pages)[0] == [flat(h) for h in pages]

"""Queries by selectors: parts of stored pages, and pages of pictures composed of the rows of a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.functions import pictures, selectors
from tideglass.session import table


def page_selectors(spark: SparkSession, folder: str) -> DataFrame:
    """Of each stored page: its heading, how many links its navigation has and the first of them, paragraphs of its article, and its blocks of advertising."""
    n = F.col("n")
    pages = table(spark, folder, "pages").select("page_id", selectors.page_nodes("html").alias("n"))
    links = selectors.select(n, "nav > ul > li > a[href^='/']")
    return pages.select(
        "page_id", selectors.text(n, selectors.first(n, "article > h1", "h1")).alias("heading"), F.size(links).alias("links"), selectors.attribute(F.get(links, F.lit(0)), "href").alias("first_link"), F.size(selectors.select(n, "article p, article li")).alias("parts"), F.size(selectors.select(n, "div.ad")).alias("ads")
    )


def _file_page(k: Column) -> Column:
    """The page of a picture: where it is kept, who made it, and one to three licence boxes."""
    box = lambda part: F.concat(F.lit('<table class="licensetpl x"><tr><td><a href="https://creativecommons.org/licenses/'), F.lit(part), F.lit('/">terms</a></td></tr></table>'))
    free = F.lit('<div class="fileinfotpl-license">GNU Free Documentation License</div>')
    boxes = F.when(k % 5 == 0, F.lit("")).when(k % 5 == 1, free).when(k % 5 == 2, F.concat(free, box("by-sa/4.0"))).when(k % 5 == 3, F.concat(box("by-sa/4.0"), free, box("by/4.0"))).otherwise(box("by-nc/4.0"))
    row = F.when(k % 2 == 0, F.concat(F.lit('<tr id="fileinfotpl_aut"><td>Author</td><td>'), "p_name", F.lit("</td></tr>"))).otherwise(F.concat(F.lit('<tr><td id="fileinfotpl_aut">Author</td><td><a href="/u">'), "p_name", F.lit("</a> &amp; <i>"), "p_brand", F.lit("</i></td></tr>")))
    return F.concat(F.lit('<html><body><div class="fullImageLink" id="file"><a href="//upload.wikimedia.org/wikipedia/commons/a/ab/P'), k, F.lit('.jpg?utm=1"><img src="t"></a></div><table>'), row, F.lit("</table>"), boxes, F.lit("</body></html>"))


def picture_pages(spark: SparkSession, folder: str) -> DataFrame:
    """What the page of each part's picture says: title, picture, author, licence, the boxes found, and why it may not be used."""
    k = F.col("p_partkey")
    pages = table(spark, folder, "part").select(k.alias("id"), F.concat(F.lit("https://commons.wikimedia.org/wiki/File:Part_"), k, F.lit(".jpg")).alias("url"), selectors.page_nodes(_file_page(k)).alias("n"))
    page = pages.select("id", pictures.file_page(F.col("n"), F.col("url")).alias("p"))
    return page.select("id", "p.title", "p.picture", "p.author", "p.licence", F.array_join("p.found", ";").alias("found"), "p.reason")


def picture_categories(spark: SparkSession, folder: str) -> DataFrame:
    """The files of each supplier's category: those in its own list, not those that a guide above it links to."""
    parts = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("id"), "l_partkey").distinct().groupBy("id").agg(F.array_sort(F.collect_list("l_partkey")).alias("parts"))
    link = lambda p: F.concat(F.lit('<li><a href="/wiki/File:Part_'), p.cast("string"), F.lit('.jpg">x</a><a href="/wiki/File:Part_'), p.cast("string"), F.lit('.jpg?again">y</a></li>'))
    listed = F.array_join(F.transform("parts", link), "")
    html = F.concat(F.lit('<p><a href="/wiki/File:Guide.jpg">guide</a></p>'), F.when(F.col("id") % 3 == 0, F.lit('<div id="mw-category-media"><ul>')).otherwise(F.lit('<div id="mw-category-generated"><ul class="gallery wide">')), listed, F.lit('<li><a href="/wiki/Help:Files">help</a></li></ul></div>'))
    nodes = parts.select("id", selectors.page_nodes(html).alias("n"))
    files = nodes.select("id", F.posexplode(pictures.category_files(F.col("n"))).alias("place", "url"))
    return files.select("id", "place", "url")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"page_selectors": page_selectors, "picture_pages": picture_pages, "picture_categories": picture_categories}
ORACLES = {
    "page_selectors": r"""WITH p AS (SELECT page_id, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS art, html FROM pages),
h AS (SELECT *, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h1, regexp_extract_all(nav, '<a href="(/[^"]*)"', 1) AS ls FROM p)
SELECT page_id, trim(regexp_replace(replace(replace(replace(regexp_replace(h1, '&amp;?', '&', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '\s+', ' ', 'g')) AS heading, CAST(len(ls) AS INTEGER) AS links, ls[1] AS first_link,
CAST(len(regexp_extract_all(art, '<(p|li)>')) AS INTEGER) AS parts, CAST(len(regexp_extract_all(html, '<div class="ad">')) AS INTEGER) AS ads FROM h""",
    "picture_pages": """SELECT p_partkey AS id, concat('Part ', p_partkey, '.jpg') AS title, concat('https://upload.wikimedia.org/wikipedia/commons/a/ab/P', p_partkey, '.jpg') AS picture, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ' & ' || p_brand END AS author,
CASE p_partkey % 5 WHEN 2 THEN 'CC-BY-SA-4.0' WHEN 3 THEN 'CC-BY-4.0' END AS licence, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'GFDL' WHEN 2 THEN 'CC-BY-SA-4.0;GFDL' WHEN 3 THEN 'CC-BY-SA-4.0;CC-BY-4.0;GFDL' ELSE 'CC BY-NC（非営利）' END AS found,
CASE p_partkey % 5 WHEN 0 THEN 'no_licence' WHEN 1 THEN 'not_allowed: GFDL' WHEN 4 THEN 'not_allowed: CC BY-NC（非営利）' END AS reason FROM part""",
    "picture_categories": """WITH d AS (SELECT DISTINCT l_suppkey AS id, l_partkey AS p FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p) - 1 AS place FROM d)
SELECT id, CAST(place AS INTEGER) AS place, concat('https://commons.wikimedia.org/wiki/File:Part_', p, '.jpg') AS url FROM n WHERE place < 40""",
}

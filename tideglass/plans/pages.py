"""Queries over raw pages: text, links and fingerprints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.functions import web
from tideglass.functions.html import page_signals
from tideglass.session import table


def _signals(spark: SparkSession, folder: str, *fields: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", "url", page_signals(fields=fields)(F.col("html"), F.col("url")).alias("s"))


def page_text(spark: SparkSession, folder: str) -> DataFrame:
    s = _signals(spark, folder, "title", "text", "n_links", "n_scripts")
    return s.select("page_id", F.col("s.title").alias("title"), F.length("s.text").alias("n_chars"), web.content_hash(web.squash(F.col("s.text"))).alias("hash"), F.col("s.n_links").alias("n_links"), F.col("s.n_scripts").alias("n_scripts"))


def page_links(spark: SparkSession, folder: str) -> DataFrame:
    links = _signals(spark, folder, "links").select("page_id", F.posexplode("s.links").alias("place", "l"))
    return links.select("page_id", "place", F.col("l.url").alias("url"), F.array_join("l.labels", " / ").alias("labels"), web.host_of(F.col("l.url")).alias("host"))


def page_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """A digest of each page's main part that doesn't hang on the order of its items."""
    return _signals(spark, folder, "main").select("page_id", web.fingerprint(F.col("s.main")).alias("fingerprint"))


def page_link_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Where each page's links go, in their order, each once."""
    links = _signals(spark, folder, "links").select("page_id", F.posexplode("s.links").alias("place", "l"))
    return links.select("page_id", "place", F.col("l.url").alias("url"), web.host_of(F.col("l.url")).alias("host"))


def page_heads(spark: SparkSession, folder: str) -> DataFrame:
    """Title and numbers of links, scripts and pictures of each page."""
    return _signals(spark, folder, "title", "n_links", "n_scripts", "n_images").select("page_id", F.col("s.title").alias("title"), F.col("s.n_links").alias("n_links"), F.col("s.n_scripts").alias("n_scripts"), F.col("s.n_images").alias("n_images"))


_HREFS = r"""h AS (SELECT page_id, regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || regexp_replace(unnest(x), '#.*$', '') AS u, generate_subscripts(x, 1) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '<a[^>]*href="(/[^"]*)"', 1) AS x FROM pages)),
l AS (SELECT page_id, u, min(i) AS i FROM h GROUP BY page_id, u)"""
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"page_text": page_text, "page_links": page_links, "page_fingerprint": page_fingerprint, "page_link_urls": page_link_urls, "page_heads": page_heads}
ORACLES = {
    "page_link_urls": f"WITH {_HREFS} SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS place, u AS url, lower(regexp_extract(u, '^[a-zA-Z]+://([^/?#:]*)', 1)) AS host FROM l",
    "page_heads": rf"""WITH {_HREFS}, n AS (SELECT page_id, count(*) AS n FROM l GROUP BY page_id)
SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS title, CAST(coalesce(n, 0) AS INTEGER) AS n_links,
CAST(len(regexp_extract_all(html, '<script')) AS INTEGER) AS n_scripts, CAST(len(regexp_extract_all(html, '<img')) AS INTEGER) AS n_images FROM pages LEFT JOIN n USING (page_id)""",
}

"""The engine in SQL: views of the tables and of what is derived of them, functions of values, a table function and an aggregate.

``register`` names them in a session; after that a query needs nothing but SQL. Functions whose meaning SQL can express are SQL functions, which the optimiser sees through; the table function reads HTML and
the aggregate sums in Python, both over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from tideglass.functions.html import links_of, parse
from tideglass.functions.web import split_page
from tideglass.operators import crawl
from tideglass.plans import search, state
from tideglass.session import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Name, parameters, type and body of each function.
FUNCTIONS = {
    "host_of": ("url STRING", "STRING", "lower(coalesce(try_parse_url(url, 'HOST'), ''))"),
    "url_key": ("url STRING", "STRING", "substring(sha1(cast(url AS BINARY)), 1, 16)"),
    "content_hash": ("text STRING", "STRING", "concat('sha256:', sha2(text, 256))"),
    "squash": ("text STRING", "STRING", r"regexp_replace(java_method('com.ibm.icu.text.Normalizer', 'compose', coalesce(text, ''), true), r'(?U)\s+', '')"),
    "interval_days": ("since_change DOUBLE", "INT", f"CASE WHEN since_change IS NULL OR since_change < {crawl.FRESH} THEN {crawl.INTERVALS[0]} WHEN since_change < {crawl.SLOW} THEN {crawl.INTERVALS[1]} ELSE {crawl.INTERVALS[2]} END"),
    "ctr": ("clicks BIGINT, impressions BIGINT", "DOUBLE", "CASE WHEN impressions = 0 THEN 0.0D ELSE round(clicks / impressions, 6) END"),
    "nth_weekday": ("year INT, month INT, weekday INT, n INT", "DATE", "date_add(make_date(year, month, 1), pmod(weekday - weekday(make_date(year, month, 1)), 7) + 7 * (n - 1))"),
}


@F.udtf(returnType="place int, target string, labels array<string>")
class PageLinks:
    """The links of a page, in their order: absolute addresses, once each, with their labels."""

    def eval(self, html: str | None, url: str | None) -> Iterator[tuple]:
        for place, link in enumerate(links_of(parse(html or ""), url or "")):
            yield place, link["url"], link["labels"]


def _weighted(values: pa.Array, weights: pa.Array) -> float:
    both = pc.and_(pc.is_valid(values), pc.is_valid(weights))
    v, w = values.filter(both), weights.filter(both)
    total = pc.sum(w).as_py()
    return pc.sum(pc.multiply(v.cast(pa.float64()), w.cast(pa.float64()))).as_py() / total if total else 0.0


def weighted_mean() -> object:
    """An aggregate of (value, weight): the mean of the values by their weights, 0 where there is no weight. It takes a group as a whole, so large groups should be summed up first."""

    @F.arrow_udf(DoubleType())
    def mean(values: pa.Array, weights: pa.Array) -> float:
        return _weighted(values, weights)

    return mean


def derived(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Views of what is derived of the tables: facts of searches, the log of fetches with what changed, and pages with the first of their series."""
    pages = table(spark, folder, "pages").withColumn("p", split_page(F.col("url"))).select("page_id", "url", F.col("p.first").alias("first_url"), F.col("p.page").cast(LongType()).alias("page"))
    return {"facts": search.facts(spark, folder), "fetches": state.change_detection(spark, folder), "page_series": pages}


def register(spark: SparkSession, folder: str) -> None:
    """Views of all tables of a folder and of what is derived of them, the functions, the table function ``page_links`` and the aggregate ``weighted_mean``, for this session. Names that are there already are replaced."""
    for name in TABLES:
        table(spark, folder, name).createOrReplaceTempView(name)
    for name, df in derived(spark, folder).items():
        df.createOrReplaceTempView(name)
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("page_links", PageLinks)
    spark.udf.register("weighted_mean", weighted_mean())

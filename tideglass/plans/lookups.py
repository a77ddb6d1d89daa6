"""Queries over keyword and host tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.operators import keywords, registries
from tideglass.plans import offers
from tideglass.session import table


def keyword_hits(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents hold each long word of the test items anywhere, also inside other words, the sum of the first places in them, and the earliest."""
    words = table(spark, folder, "benchmark").select(F.explode(F.split("text", r"[\s.,]+")).alias("word")).filter(F.length("word") >= 5)
    found = keywords.with_hits(table(spark, folder, "documents").select("text"), words).select(F.explode("hits").alias("h"))
    return found.groupBy(F.col("h.word").alias("word")).agg(F.count("*").alias("documents"), F.sum("h.start").alias("starts"), F.min("h.start").alias("earliest"))


def offer_funnels(spark: SparkSession, folder: str) -> DataFrame:
    """The best funnel of each offer by a table of keywords: the words of the profile, and for each supplier region a word of its own."""
    rows = [(i, kind, w) for i, (kind, words) in enumerate(offers.PROFILE.funnels) for w in words]
    rules = spark.createDataFrame(rows, "place long, kind string, word string").unionByName(table(spark, folder, "supplier").select((100 + F.col("s_suppkey")).alias("place"), F.lit("shop").alias("kind"), F.concat(F.lit("#"), F.col("s_suppkey") % 40, F.lit(" ")).alias("word")))
    o = offers.offers(spark, folder)
    fields = [(1.0, F.col("name")), (0.7, F.concat_ws(" ", "condition", "advertiser")), (0.5, F.col("raw"))]
    return keywords.first_rule(o, rules, fields, "id")


def registry_match(spark: SparkSession, folder: str) -> DataFrame:
    """Platform of each order's address, by a registry of nations and, under them, suppliers; the longest host counts."""
    o = F.col
    urls = table(spark, folder, "orders").select(
        o("o_orderkey").alias("id"), F.concat(F.lit("https://P"), o("o_orderkey") % 97, F.when(o("o_orderkey") % 5 == 0, F.lit(".x")).otherwise(""), F.lit(".c"), o("o_custkey") % 31, F.lit(".example.jp/a?b=.c1.example.jp")).alias("url")
    )
    nations = table(spark, folder, "nation").filter("n_nationkey % 2 = 0").select(F.concat(F.lit("C"), "n_nationkey", F.lit(".example.jp.")).alias("host"), F.col("n_name").alias("platform"), F.lit("crawl").alias("policy"))
    suppliers = table(spark, folder, "supplier").select(F.concat(F.lit("p"), F.col("s_suppkey") % 97, F.lit(".c"), "s_nationkey", F.lit(".example.jp")).alias("host"), F.lit("shop").alias("platform"), F.lit("skip").alias("policy"))
    return registries.kinds(urls, nations.unionByName(suppliers)).select("id", "platform", "policy")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"keyword_hits": keyword_hits, "offer_funnels": offer_funnels, "registry_match": registry_match}
ORACLES = {
    "keyword_hits": r"""WITH k AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(regexp_split_to_array(text, '[\s.,]+')) AS w FROM benchmark) WHERE length(w) >= 5), d AS (SELECT lower(text) AS t FROM documents),
m AS (SELECT w, t, strpos(t, w) - 1 AS first FROM d JOIN k ON contains(t, w))
SELECT w AS word, count(*) AS documents, CAST(sum(first) AS BIGINT) AS starts, CAST(min(first) AS INTEGER) AS earliest FROM m GROUP BY w""",
    "offer_funnels": """WITH o AS (SELECT p_partkey AS id, lower(p_name) AS a, lower(concat_ws(' ', CASE WHEN p_partkey % 5 <> 0 THEN p_type END, p_brand || ' ')) AS b, lower(concat_ws(' ', p_type, p_name)) AS c FROM part),
r AS (SELECT * FROM (VALUES (0, 'ring', 'ring'), (1, 'bolt', 'bolt'), (1, 'bolt', 'promo'), (2, 'gear', 'gear'), (2, 'gear', 'large')) t(place, kind, w) UNION ALL SELECT 100 + s_suppkey, 'shop', concat('#', s_suppkey % 40, ' ') FROM supplier),
h AS (SELECT id, place, kind, CASE WHEN contains(a, w) THEN 1.0 WHEN contains(b, w) THEN 0.7 WHEN contains(c, w) THEN 0.5 END AS weight FROM o, r)
SELECT id, CAST(max(weight) AS DOUBLE) AS weight, arg_max(kind, (weight, -place)) AS kind FROM h WHERE weight IS NOT NULL GROUP BY id""",
    "registry_match": """WITH u AS (SELECT o_orderkey AS id, concat('p', o_orderkey % 97, CASE WHEN o_orderkey % 5 = 0 THEN '.x' ELSE '' END, '.c', o_custkey % 31, '.example.jp') AS host FROM orders),
r AS (SELECT concat('c', n_nationkey, '.example.jp') AS h, n_name AS platform, 'crawl' AS policy FROM nation WHERE n_nationkey % 2 = 0 UNION SELECT concat('p', s_suppkey % 97, '.c', s_nationkey, '.example.jp'), 'shop', 'skip' FROM supplier),
m AS (SELECT id, arg_max(platform, length(h)) AS platform, arg_max(policy, length(h)) AS policy FROM u JOIN r ON host = h OR ends_with(host, '.' || h) GROUP BY id)
SELECT u.id, coalesce(platform, 'unknown') AS platform, coalesce(policy, 'none') AS policy FROM u LEFT JOIN m USING (id)""",
}

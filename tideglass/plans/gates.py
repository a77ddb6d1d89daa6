"""Queries of the frontier, of gates and of states, over rows of the tables read as pages, pictures, wordings, files and requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.operators import site
from tideglass.session import table

#: Pages of a source, links of a rule, pages of a run of extraction.
LIMIT, LINKS, BUDGET = 60, 4, 100


def frontier(spark: SparkSession, folder: str) -> DataFrame:
    """Nations as sources, their suppliers as seeds, the parts that these shipped as links; two rules, one of them for few links, and some links to other hosts."""
    c = F.col
    host = lambda n: F.concat(F.lit("https://c"), n, F.lit(".jp/"))
    suppliers = table(spark, folder, "supplier").select(c("s_suppkey").alias("k"), c("s_nationkey").alias("source_id"), F.concat(host(c("s_nationkey")), F.lit("s"), "s_suppkey").alias("url"))
    seeds = suppliers.select("source_id", "url", F.lit("seed").alias("kind"), c("k").cast("int").alias("place"))
    links = table(spark, folder, "lineitem").join(suppliers, c("l_suppkey") == c("k")).select(
        "url", (c("l_orderkey") * 10 + c("l_linenumber")).cast("int").alias("place"), F.concat(F.when(c("l_partkey") % 9 == 0, F.lit("https://other.jp/")).otherwise(host(c("source_id"))), F.lit("p"), "l_partkey").alias("target")
    )
    rules = [(0, r"/p\d*5$", "list", LINKS), (1, r"/p\d*0$", "detail", None)]
    follows = seeds.select("source_id", F.col("url").alias("seed_url"), F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(p).alias("pattern"), F.lit(k).alias("kind"), F.lit(m).cast("int").alias("max_links")) for n, p, k, m in rules))).alias("r")).select("source_id", "seed_url", "r.*")
    most = table(spark, folder, "nation").select(c("n_nationkey").alias("source_id"), F.lit(LIMIT).alias("limit"), F.array(F.concat(F.lit("c"), "n_nationkey", F.lit(".jp"))).alias("hosts"))
    return site.frontier(seeds, links, follows, most)


def image_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Items as pictures on the pages of their orders; parts that are small are registered."""
    images = table(spark, folder, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), F.col("l_linenumber").cast("string").alias("src"), F.when(F.col("l_linenumber") % 4 == 3, "").when(F.col("l_linenumber") % 4 != 2, F.col("l_partkey").cast("string")).alias("asset"))
    parts = table(spark, folder, "part").select(F.col("p_partkey").cast("string").alias("asset_id"), (F.col("p_size") < 40).alias("usable"))
    return site.image_faults(images, site.registered_assets(parts))


def translations(spark: SparkSession, folder: str) -> DataFrame:
    """Names of parts as wordings: all in the default language, some in the others."""
    k, name = F.col("p_partkey"), F.concat("p_name", F.lit(" "), "p_partkey")
    part = table(spark, folder, "part")
    keys = part.select(name.alias("key"), F.explode(F.array(*map(F.lit, ("ja", "en", "zh")))).alias("locale")).select("locale", "key")
    of = lambda code, some: part.filter(some).select(F.lit(code).alias("locale"), name.alias("key"), F.concat(F.lit(f"{code}:"), "p_type").alias("text"))
    return site.translations(keys, of("ja", k % 7 != 0).unionByName(of("en", k % 2 == 0)).unionByName(of("zh", k % 5 == 0)), "ja")


def freeze_wording(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as records: a new wording for all, other facts for some, no old record for others."""
    k = F.col("c_custkey")
    row = lambda name, nation, bal: F.struct(name.alias("name"), nation.alias("nation"), bal.alias("seen"))
    old = F.when(k % 5 != 0, row(F.col("c_name"), F.col("c_nationkey"), F.lit(1)))
    new = row(F.lower("c_name"), F.when(k % 4 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")), F.lit(2))
    return site.freeze_wording(table(spark, folder, "customer").select(k.alias("key"), old.alias("old"), new.alias("new")), ["name"], ["seen"], ["name", "nation", "seen"])


def extract_queue(spark: SparkSession, folder: str) -> DataFrame:
    """The first pages of a run that wait for extraction: returned items."""
    states = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.format_string("/%010d/%d", "l_orderkey", "l_linenumber").alias("url"), (F.col("l_returnflag") == "R").alias("pending_extract"), F.when(F.col("l_linenumber") != 2, F.lit("h")).alias("content_hash"))
    return site.queue(states, BUDGET)


def cached_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as requests, finished orders as what a cache holds for them; the newest counts."""
    cache = table(spark, folder, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("response"), F.struct(F.to_date("o_orderdate"), "o_orderkey").alias("at"))
    return site.cached(table(spark, folder, "customer").select(F.col("c_custkey").alias("key")), cache)


def forgotten_states(spark: SparkSession, folder: str) -> DataFrame:
    """States of customers' pages that an open order keeps alive, by segment."""
    states = table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("url"), "c_mktsegment")
    alive = table(spark, folder, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").cast("string").alias("url"))
    return site.forget(states, alive).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum(F.col("url").cast("long")).alias("keys"))


def run_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Events as reports of runs: their counters, added up by stage and key."""
    value = F.floor("value").cast("long")
    return site.bump(table(spark, folder, "events").select(F.create_map(F.lit("crawl"), F.create_map(F.col("event_type"), F.lit(1).cast("long"), F.lit("value"), value), F.lit("build"), F.create_map(F.lit("pages"), F.col("user_id").cast("long"))).alias("stages")))


def llm_usage(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("user_id").cast("long")
    return site.usage_total(table(spark, folder, "events").select(F.struct(F.lit(1).cast("long").alias("calls"), F.when(F.col("event_type") == "view", 1).otherwise(0).cast("long").alias("cached_calls"), n.alias("input_tokens"), F.when(n % 2 == 0, n).alias("output_tokens")).alias("llm")))


def dist_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files of a site: too many bytes, and redirects written in their words."""
    d = table(spark, folder, "documents").filter("text IS NOT NULL")
    files = d.select(F.concat(F.lit("d/"), "doc_id").alias("path"), (F.length("text") * 1000).cast("long").alias("size"), F.lit("").alias("text"))
    lines = table(spark, folder, "nation").agg(F.concat_ws("\n", F.array_sort(F.collect_list(F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("/"), "n_name", F.lit(" /x 301"))).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("/"), "n_name")).otherwise(F.concat(F.lit("# "), "n_name"))))).alias("text"))
    return site.dist_faults(files.unionByName(lines.select(F.lit("_redirects").alias("path"), F.lit(10).cast("long").alias("size"), "text")))


def review_rows(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    return site.review_table(table(spark, folder, "part").select(F.lpad(k.cast("string"), 8, "0").alias("id"), F.concat("p_name", F.lit("|"), "p_type").alias("title"), F.concat(F.lit("https://p/"), k).alias("url"), F.when(k % 2 == 0, F.col("p_brand")).alias("note"), F.when(k % 3 == 0, "pending").otherwise("done").alias("policy")))


def asset_gates(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as pictures that were fetched: by licence, address, answer, kind and size."""
    i = F.col("doc_id")
    content = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    kind = F.when(i % 7 == 3, "text/html").when(i % 2 == 0, "image/PNG; q=1").otherwise("image/jpeg")
    verdict = site.asset_verdict(i % 5 != 1, F.concat(F.lit("https://u/"), F.when(i % 11 == 4, F.lit("logo/")).otherwise(""), i), i % 13 != 6, kind, content, ["logo"])
    return table(spark, folder, "documents").select(i.alias("id"), verdict.alias("v")).select("id", "v.asset_id", "v.reason")


_SEEDS = "s AS (SELECT s_suppkey AS k, s_nationkey AS src, concat('https://c', s_nationkey, '.jp/s', s_suppkey) AS url FROM supplier)"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "frontier": frontier, "image_faults": image_faults, "translations": translations, "freeze_wording": freeze_wording, "extract_queue": extract_queue, "cached_responses": cached_responses, "forgotten_states": forgotten_states,
    "run_counters": run_counters, "llm_usage": llm_usage, "dist_faults": dist_faults, "review_rows": review_rows, "asset_gates": asset_gates,
}
ORACLES = {
    "frontier": f"""WITH {_SEEDS}, l AS (SELECT k, src, url, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_partkey % 9 = 0 THEN 'https://other.jp/p' ELSE concat('https://c', src, '.jp/p') END || l_partkey AS target, l_partkey % 10 AS e FROM lineitem JOIN s ON l_suppkey = k),
f AS (SELECT *, CASE WHEN e = 5 THEN 0 ELSE 1 END AS rule, row_number() OVER (PARTITION BY src, url, e ORDER BY pos, target) AS n FROM l WHERE e IN (0, 5)),
u AS (SELECT src, url, 'seed' AS kind, 0 AS hop, k AS seed, 0 AS rule, 0 AS pos FROM s UNION ALL SELECT src, target, CASE WHEN rule = 0 THEN 'list' ELSE 'detail' END, 1, k, rule, pos FROM f WHERE rule = 1 OR n <= 4),
o AS (SELECT src, url, arg_min(kind, (hop, seed, rule, pos)) AS kind, min((hop, seed, rule, pos)) AS ord FROM u WHERE NOT starts_with(url, 'https://other') GROUP BY src, url),
p AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ord, url) AS place FROM o)
SELECT src AS source_id, url, kind, CAST(place AS INTEGER) AS place FROM p WHERE place <= 60""",
    "image_faults": """WITH i AS (SELECT CAST(l_orderkey AS VARCHAR) AS path, CAST(l_linenumber AS VARCHAR) AS src, CASE WHEN l_linenumber % 4 = 3 THEN '' WHEN l_linenumber % 4 <> 2 THEN CAST(l_partkey AS VARCHAR) END AS asset FROM lineitem),
k AS (SELECT CAST(p_partkey AS VARCHAR) AS asset FROM part WHERE p_size < 40)
SELECT path, src, i.asset, CASE WHEN coalesce(i.asset, '') = '' THEN 'unmarked' ELSE 'unregistered' END AS fault FROM i LEFT JOIN k ON k.asset = i.asset WHERE coalesce(i.asset, '') = '' OR k.asset IS NULL""",
    "translations": """WITH p AS (SELECT p_partkey AS k, concat(p_name, ' ', p_partkey) AS key, p_type AS t FROM part),
e AS (SELECT l AS locale, key, CASE WHEN l = 'ja' AND k % 7 <> 0 OR l = 'en' AND k % 2 = 0 OR l = 'zh' AND k % 5 = 0 THEN concat(l, ':', t) END AS own, CASE WHEN k % 7 <> 0 THEN 'ja:' || t END AS fall FROM p, (VALUES ('ja'), ('en'), ('zh')) v(l))
SELECT locale, key, coalesce(own, fall) AS text, own IS NULL AND fall IS NOT NULL AS missed FROM e""",
    "freeze_wording": """SELECT c_custkey AS key, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 4 <> 0 THEN c_name ELSE lower(c_name) END AS name, CASE WHEN c_custkey % 4 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS nation, 2 AS seen, c_custkey % 5 <> 0 AND c_custkey % 4 <> 0 AS frozen FROM customer""",
    "extract_queue": "SELECT l_suppkey AS source_id, format('/{:010d}/{}', l_orderkey, l_linenumber) AS url FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber <> 2 ORDER BY url, source_id LIMIT 100",
    "cached_responses": "WITH c AS (SELECT o_custkey AS k, arg_max(o_orderkey, (CAST(o_orderdate AS DATE), o_orderkey)) AS r FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT c_custkey AS key, r AS response, r IS NOT NULL AS hit FROM customer LEFT JOIN c ON k = c_custkey",
    "forgotten_states": "SELECT c_mktsegment, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') GROUP BY 1",
    "run_counters": "SELECT 'crawl' AS stage, event_type AS key, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'crawl', 'value', CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) FROM events UNION ALL SELECT 'build', 'pages', CAST(sum(user_id) AS BIGINT) FROM events",
    "llm_usage": "SELECT count(*) AS calls, count(*) FILTER (event_type = 'view') AS cached_calls, CAST(sum(user_id) AS BIGINT) AS input_tokens, CAST(coalesce(sum(user_id) FILTER (user_id % 2 = 0), 0) AS BIGINT) AS output_tokens FROM events",
    "dist_faults": """SELECT 'no_index' AS fault, 'index.html' AS path UNION ALL SELECT 'large', concat('d/', doc_id) FROM documents WHERE length(text) * 1000 > 26214400
UNION ALL SELECT 'many', CAST(count(*) + 1 AS VARCHAR) FROM documents WHERE text IS NOT NULL HAVING count(*) + 1 > 20000 UNION ALL SELECT 'redirect', '/' || n_name FROM nation WHERE n_nationkey % 3 = 1""",
    "review_rows": "SELECT concat('| ', lpad(CAST(p_partkey AS VARCHAR), 8, '0'), ' | ', p_name, '\\|', p_type, ' | https://p/', p_partkey, ' | ', CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END, ' |') AS row FROM part WHERE p_partkey % 3 = 0",
    "asset_gates": """WITH d AS (SELECT doc_id AS i, octet_length(encode(coalesce(text, ''))) AS n, coalesce(text, '') AS t FROM documents),
r AS (SELECT i, t, CASE WHEN i % 5 = 1 THEN 'licence' WHEN i % 11 = 4 THEN 'excluded' WHEN i % 13 = 6 THEN 'fetch' WHEN i % 7 = 3 THEN 'type' WHEN n > 5000000 THEN 'large' WHEN n < 1000 THEN 'small' END AS reason FROM d)
SELECT i AS id, CASE WHEN reason IS NULL THEN sha256(t)[1:16] END AS asset_id, reason FROM r""",
}

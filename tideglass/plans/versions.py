"""Queries over tables with versions: facts that are restated, states by key, and the ledger of builds.

Each writes its table, in more than one version, to a folder of its own beside the checkpoints, and reads the versions that it made.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.operators import crawl
from tideglass.plans import search
from tideglass.session import shared_folder, table
from tideglass.sources import tables
from tideglass.sources.versions import VersionedTable

#: Days that are fetched again, as their numbers aren't final; days that the first fetch doesn't know at all.
AGAIN, UNKNOWN = 5, 2


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}"


def _versions(of: VersionedTable, numbers: list[int]) -> DataFrame:
    parts = [of.read(v).withColumn("version", F.lit(v)) for v in numbers]
    for more in parts[1:]:
        parts[0] = parts[0].unionByName(more)
    return parts[0]


def facts_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of each month after the first fetch, which lacks the last days and has half of the impressions of the days before them, and after the second, which replaces these days."""
    path, facts = _folder(spark), search.facts(spark, folder)
    last = search.last_day(spark, folder)
    if last is None:
        return spark.createDataFrame([], "version int, month string, n long, clicks long, impressions long")
    known = facts.filter(F.col("day") <= last - timedelta(days=UNKNOWN))
    early = F.col("day") > last - timedelta(days=AGAIN)
    first = tables.write_facts(known.withColumn("impressions", F.when(early, F.floor(F.col("impressions") / 2)).otherwise(F.col("impressions"))), path, "page")
    days = [(last - timedelta(days=i)).isoformat() for i in range(AGAIN)]
    second = tables.write_facts(facts.filter(early), path, "page", days)
    return _versions(VersionedTable(spark, path), [first, second]).groupBy("version", "month").agg(F.count("*").alias("n"), F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))


def index_states_versions(spark: SparkSession, folder: str) -> DataFrame:
    """The last known state of each customer's page after the checks of the first years and after all: the same table, changed by key."""
    path = _folder(spark)
    checks = table(spark, folder, "orders").selectExpr("CAST(o_custkey AS STRING) AS url", "o_orderstatus AS state", "to_date(o_orderdate) AS checked", "o_orderkey AS id")
    early = F.col("checked") < F.lit("1995-07-01").cast("date")
    order = F.struct("checked", "id")
    first = tables.upsert_by_key(checks.filter(early), path, ["url"], order)
    second = tables.upsert_by_key(checks.filter(~early), path, ["url"], order)
    return _versions(VersionedTable(spark, path), [first, second]).select("version", "url", "state", F.col("checked").cast("string").alias("checked"))


def ledger_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Three builds of the documents as pages: the first; one in which texts with a digit are others; one with another layout, in which all are. Days move in the second build only."""
    path, docs = _folder(spark), table(spark, folder, "documents").filter("doc_id IS NOT NULL")
    numbers = []
    for build, (day, layout, salt) in enumerate((("2026-09-01", "plain", F.lit("")), ("2026-09-08", "plain", F.when(F.col("text").rlike("[0-9]"), "+").otherwise("")), ("2026-09-15", "wide", F.lit("w")))):
        stored, relearn = tables.load_ledger(spark, path, layout)
        built = docs.filter(F.lit(build > 0) | (F.coalesce("n_chars", F.lit(0)) < 5000)).select(
            F.concat(F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.sha2(F.concat(F.coalesce("text", F.lit("")), salt), 256).alias("fingerprint"), F.lit("2026-12-01").cast("date").alias("first_seen")
        )
        numbers.append(tables.save_ledger(crawl.ledger(stored, built, F.lit(day).cast("date"), relearn), path, layout))
    return _versions(VersionedTable(spark, path), numbers).select("version", "path", "fingerprint", F.col("lastmod").cast("string").alias("lastmod"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"facts_versions": facts_versions, "index_states_versions": index_states_versions, "ledger_versions": ledger_versions}
ORACLES = {
    "facts_versions": """WITH f AS (SELECT CAST(l_shipdate AS DATE) AS day, CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS clicks, CAST(l_quantity AS BIGINT) AS impressions, (SELECT CAST(max(l_shipdate) AS DATE) FROM lineitem) AS last FROM lineitem),
v AS (SELECT 1 AS version, day, clicks, CASE WHEN day > last - 5 THEN impressions // 2 ELSE impressions END AS impressions FROM f WHERE day <= last - 2 UNION ALL SELECT 2, day, clicks, impressions FROM f)
SELECT version, strftime(day, '%Y-%m') AS month, count(*) AS n, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions FROM v GROUP BY ALL""",
    "index_states_versions": """WITH c AS (SELECT o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) AS d, o_orderkey AS id FROM orders),
a AS (SELECT 1 AS version, * FROM c WHERE d < DATE '1995-07-01' UNION ALL SELECT 2, * FROM c)
SELECT version, CAST(o_custkey AS VARCHAR) AS url, arg_max(o_orderstatus, (d, id)) AS state, CAST(max(d) AS VARCHAR) AS checked FROM a GROUP BY version, o_custkey""",
    "ledger_versions": """WITH d AS (SELECT concat('/', doc_id) AS path, coalesce(text, '') AS t, coalesce(n_chars, 0) < 5000 AS early, regexp_matches(coalesce(text, ''), '[0-9]') AS digit FROM documents WHERE doc_id IS NOT NULL)
SELECT 1 AS version, path, sha256(t) AS fingerprint, '2026-09-01' AS lastmod FROM d WHERE early
UNION ALL SELECT 2, path, sha256(t || CASE WHEN digit THEN '+' ELSE '' END), CASE WHEN early AND NOT digit THEN '2026-09-01' ELSE '2026-09-08' END FROM d
UNION ALL SELECT 3, path, sha256(t || 'w'), CASE WHEN early AND NOT digit THEN '2026-09-01' ELSE '2026-09-08' END FROM d""",
}

"""A replay of model calls over the tables: customers' pages are asked about in the order of their orders."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.operators import model_calls
from tideglass.session import shared_folder, table

#: Tokens of a run, as a share of what all requests would cost: one in BUDGET_SHARE.
BUDGET_SHARE = 3


def model_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as requests for their customer's page; a provider that knows six of seven customers; two runs with a third of the tokens each, the second of which finds what the first has logged."""
    log = f"{shared_folder(spark)}/calls-{uuid.uuid4().hex}"
    orders = table(spark, folder, "orders")
    requests = orders.select(F.sha2(F.concat(F.lit("page "), "o_custkey"), 256).alias("key"), F.col("o_orderkey").alias("place"), (F.col("o_custkey") % 50 + 10).alias("tokens"))
    customers = table(spark, folder, "customer").filter("c_custkey % 7 <> 3")
    provider = customers.select(F.sha2(F.concat(F.lit("page "), "c_custkey"), 256).alias("key"), F.col("c_name").alias("response"), F.lit(100).alias("input_tokens"), F.lit(20).alias("output_tokens"))
    budget = requests.dropDuplicates(["key"]).agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0] // BUDGET_SHARE
    now = F.lit("2026-09-01 00:00:00").cast("timestamp")
    runs = [model_calls.replay(requests, provider, log, budget, now, "m").groupBy("status").agg(F.count("*").alias("n"), F.min("place").alias("first"), F.max("place").alias("last"), F.count("response").alias("responses")).withColumn("run", F.lit(i)) for i in (1, 2)]
    return runs[0].unionByName(runs[1])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"model_replay": model_replay}
ORACLES = {
    "model_replay": """WITH r AS (SELECT o_custkey AS k, o_orderkey AS place, o_custkey % 50 + 10 AS tokens FROM orders), d AS (SELECT k, min(place) AS place, any_value(tokens) AS tokens FROM r GROUP BY k),
b AS (SELECT sum(tokens) // 3 AS budget FROM d), known AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 7 <> 3),
a AS (SELECT k, sum(tokens) OVER (ORDER BY place) <= budget AS asked FROM d, b), one AS (SELECT a.k, asked, asked AND known.k IS NOT NULL AS got FROM a LEFT JOIN known ON known.k = a.k),
m AS (SELECT d.k, sum(tokens) OVER (ORDER BY place) <= budget AS asked FROM d JOIN one ON one.k = d.k, b WHERE NOT got), two AS (SELECT m.k, asked, asked AND known.k IS NOT NULL AS got FROM m LEFT JOIN known ON known.k = m.k),
s AS (SELECT 1 AS run, place, CASE WHEN got THEN 'answered' WHEN asked THEN 'unanswered' ELSE 'over_budget' END AS status FROM r JOIN one ON one.k = r.k UNION ALL
SELECT 2, place, CASE WHEN one.got THEN 'cached' WHEN two.got THEN 'answered' WHEN two.asked THEN 'unanswered' ELSE 'over_budget' END FROM r JOIN one ON one.k = r.k LEFT JOIN two ON two.k = r.k)
SELECT run, status, count(*) AS n, min(place) AS first, max(place) AS last, CASE WHEN status IN ('cached', 'answered') THEN count(*) ELSE 0 END AS responses FROM s GROUP BY run, status""",
}

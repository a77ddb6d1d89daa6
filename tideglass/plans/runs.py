"""Reports over pipeline runs: daily sums, totals, cost, shifts of parsed fields, stalled hosts, accuracy, histograms.

An event is a run: its user is the host, its type the stage, its value the tokens of the stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.session import table

PRICE_IN, PRICE_OUT, STALLED_DAYS, EDGES = 1.0, 5.0, 3, [900.0, 1200.0, 1500.0, 1800.0]


def runs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.to_date("ts").alias("day"), F.col("ts").cast("timestamp").alias("at"), F.col("user_id").alias("host"), F.col("event_type").alias("stage"), F.round(F.col("value") * 100).cast("long").alias("tokens")
    )


def _count(stage: str) -> Column:
    return F.count_if(F.col("stage") == stage)


def _daily() -> list[Column]:
    spent = lambda s: F.coalesce(F.sum(F.when(F.col("stage") == s, F.col("tokens"))), F.lit(0))
    return [
        F.count("*").alias("runs"), _count("error").alias("errors"), _count("view").alias("fetched"), _count("click").alias("changed"),
        spent("view").alias("tokens_in"), spent("click").alias("tokens_out"), F.max("tokens").alias("pages"),
    ]


def weekly_runs(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each day; pages is the largest of the day, the rest are sums."""
    return runs(spark, folder).groupBy("day").agg(*_daily())


def weekly_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """The same with a row for all days, whose day is NULL."""
    return runs(spark, folder).rollup("day").agg(*_daily())


def cost(tokens_in: Column, tokens_out: Column) -> Column:
    return F.round(tokens_in / 1e6 * PRICE_IN + tokens_out / 1e6 * PRICE_OUT, 6)


def weekly_cost(spark: SparkSession, folder: str) -> DataFrame:
    """Total cost, the mean of the days there are, and 30 times that."""
    per = weekly_runs(spark, folder)
    whole = per.agg(F.sum("tokens_in").alias("i"), F.sum("tokens_out").alias("o"), F.count("*").alias("days"))
    total = cost(F.col("i"), F.col("o"))
    return whole.select("days", total.alias("cost"), F.round(total / F.col("days") * 30, 6).alias("month_estimate"))


def field_shift(spark: SparkSession, folder: str) -> DataFrame:
    """Each stage's share of a day's runs on the first and last day that have it; the largest change first."""
    per = runs(spark, folder).groupBy("day", "stage").agg(F.count("*").alias("n"))
    days = per.groupBy("day").agg(F.sum("n").alias("total"))
    share = per.join(days, "day").withColumn("share", F.col("n") / F.col("total"))
    ends = share.groupBy("stage").agg(F.round(F.min_by("share", "day"), 6).alias("first"), F.round(F.max_by("share", "day"), 6).alias("last"))
    shift = ends.withColumn("shift", F.round(F.col("last") - F.col("first"), 6))
    return shift.orderBy(F.desc(F.abs("shift")), "stage")


def stalled_hosts(spark: SparkSession, folder: str) -> DataFrame:
    """Hosts with errors and how many days ago they last succeeded; NULL for never, which counts as longest."""
    r = runs(spark, folder)
    end = r.agg(F.max("day").alias("today"))
    per = r.groupBy("host").agg(_count("error").alias("errors"), F.max(F.when(F.col("stage") == "purchase", F.col("day"))).alias("success"))
    aged = per.crossJoin(F.broadcast(end)).withColumn("age", F.datediff("today", "success"))
    return aged.filter((F.col("errors") > 0) & (F.col("age").isNull() | (F.col("age") >= STALLED_DAYS))).select("host", "errors", "age")


def extraction_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Status counts and the parsed rate of each field: a document's label is a field's value, no label a missing one."""
    labels = table(spark, folder, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = table(spark, folder, "documents").select("doc_id", "lang").join(labels, "doc_id", "left")
    long = rows.select("lang", F.expr("stack(2, 'quality', quality, 'toxic', toxic) AS (field, value)"))
    status = long.withColumn("parsed", F.col("value").isNotNull())
    per = status.groupBy("lang", "field").agg(F.count("*").alias("total"), F.count_if("parsed").alias("parsed"), F.count_if(~F.col("parsed")).alias("missing"))
    return per.withColumn("rate", F.round(F.col("parsed") / F.col("total"), 6))


def eval_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Expected values left-joined with what was got: correct and total for each field. Documents of 1000 characters on are taken to be of good quality."""
    expected = table(spark, folder, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    got = table(spark, folder, "documents").groupBy("doc_id").agg(F.max(F.when(F.col("n_chars") >= 1000, 1).otherwise(0)).alias("g_quality"), F.lit(0).alias("g_toxic"))
    joined = expected.join(got, "doc_id", "left")
    long = joined.select(F.expr("stack(2, 'quality', quality, g_quality, 'toxic', toxic, g_toxic) AS (field, want, have)"))
    per = long.groupBy("field").agg(F.count("want").alias("total"), F.count_if(F.col("want") == F.col("have")).alias("correct"))
    return per.withColumn("accuracy", F.round(F.col("correct") / F.col("total"), 6))


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """bin, n for each of len(edges) + 1 bins, empty ones too: a value below an edge is in that edge's bin."""
    bins = df.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("bin"))
    place = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        place = F.when(F.col(value) < edges[i], i).otherwise(place)
    counts = df.filter(F.col(value).isNotNull()).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def price_bins(spark: SparkSession, folder: str) -> DataFrame:
    return histogram(table(spark, folder, "part"), "p_retailprice", EDGES)


_RUNS = "WITH r AS (SELECT CAST(ts AS DATE) AS day, user_id AS host, event_type AS stage, CAST(round(value * 100) AS BIGINT) AS tokens FROM events)"
_DAILY = """count(*) AS runs, count(*) FILTER (stage = 'error') AS errors, count(*) FILTER (stage = 'view') AS fetched, count(*) FILTER (stage = 'click') AS changed,
CAST(coalesce(sum(tokens) FILTER (stage = 'view'), 0) AS BIGINT) AS tokens_in, CAST(coalesce(sum(tokens) FILTER (stage = 'click'), 0) AS BIGINT) AS tokens_out, max(tokens) AS pages"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "weekly_runs": weekly_runs,
    "weekly_rollup": weekly_rollup,
    "weekly_cost": weekly_cost,
    "field_shift": field_shift,
    "robots_stalled_hosts": stalled_hosts,
    "extraction_metrics": extraction_metrics,
    "eval_accuracy": eval_accuracy,
    "histogram_bins": price_bins,
}
ORACLES = {
    "weekly_runs": f"{_RUNS} SELECT day, {_DAILY} FROM r GROUP BY day",
    "weekly_rollup": f"{_RUNS} SELECT day, {_DAILY} FROM r GROUP BY ROLLUP (day)",
    "weekly_cost": f"{_RUNS}, c AS (SELECT count(DISTINCT day) AS days, round(coalesce(sum(tokens) FILTER (stage = 'view'), 0) / 1e6 * 1.0 + coalesce(sum(tokens) FILTER (stage = 'click'), 0) / 1e6 * 5.0, 6) AS cost FROM r) SELECT days, cost, round(cost / days * 30, 6) AS month_estimate FROM c",
    "field_shift": f"""{_RUNS}, p AS (SELECT day, stage, count(*) / sum(count(*)) OVER (PARTITION BY day) AS share FROM r GROUP BY day, stage),
e AS (SELECT stage, round(arg_min(share, day), 6) AS first, round(arg_max(share, day), 6) AS last FROM p GROUP BY stage) SELECT stage, first, last, round(last - first, 6) AS shift FROM e""",
    "robots_stalled_hosts": f"""{_RUNS}, h AS (SELECT host, count(*) FILTER (stage = 'error') AS errors, CAST(date_diff('day', max(day) FILTER (stage = 'purchase'), (SELECT max(day) FROM r)) AS INTEGER) AS age FROM r GROUP BY host)
SELECT host, errors, age FROM h WHERE errors > 0 AND (age IS NULL OR age >= 3)""",
    "extraction_metrics": """WITH l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id), r AS (SELECT lang, quality, toxic FROM documents LEFT JOIN l USING (doc_id)),
u AS (SELECT lang, 'quality' AS field, quality AS value FROM r UNION ALL SELECT lang, 'toxic', toxic FROM r)
SELECT lang, field, count(*) AS total, count(value) AS parsed, count(*) - count(value) AS missing, round(count(value) / count(*), 6) AS rate FROM u GROUP BY lang, field""",
    "eval_accuracy": """WITH l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id), g AS (SELECT doc_id, max(CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END) AS q FROM documents GROUP BY doc_id),
u AS (SELECT 'quality' AS field, quality AS w, q AS h FROM l LEFT JOIN g USING (doc_id) UNION ALL SELECT 'toxic', toxic, CASE WHEN q IS NULL THEN NULL ELSE 0 END FROM l LEFT JOIN g USING (doc_id))
SELECT field, count(w) AS total, count(*) FILTER (w = h) AS correct, round(count(*) FILTER (w = h) / count(w), 6) AS accuracy FROM u GROUP BY field""",
    "histogram_bins": """WITH b AS (SELECT CASE WHEN p_retailprice < 900 THEN 0 WHEN p_retailprice < 1200 THEN 1 WHEN p_retailprice < 1500 THEN 2 WHEN p_retailprice < 1800 THEN 3 ELSE 4 END AS bin FROM part WHERE p_retailprice IS NOT NULL)
SELECT CAST(i AS INTEGER) AS bin, count(b.bin) AS n FROM range(5) t(i) LEFT JOIN b ON b.bin = i GROUP BY i""",
}

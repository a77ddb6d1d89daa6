"""Search-performance queries: daily facts per page, periods, joins, anti-joins and top lists.

Facts are line items read as day, page, clicks, impressions and position (in hundredths, whole
numbers, so that sums are exact). The period ``now`` is the last DAYS days that the facts have, ``prev`` as many before.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideglass.session import table

DAYS, LOW_IMPRESSIONS, LOW_CTR, DROP, DROP_IMPRESSIONS, TOP = 90, 30, 0.02, 3, 10, 10
PAGE, PAGE_AND_SHOP = "CAST(l_partkey AS STRING)", "concat(l_partkey, '/', l_suppkey)"


def facts(spark: SparkSession, folder: str, page: str = PAGE, since: date | None = None) -> DataFrame:
    rows = table(spark, folder, "lineitem")
    if since is not None:
        rows = rows.filter(F.col("l_shipdate") >= F.lit(datetime(since.year, since.month, since.day)).cast("timestamp_ntz"))
    return rows.selectExpr(
        "to_date(l_shipdate) AS day",
        f"{page} AS page",
        "IF(l_linenumber = 1, 1L, 0L) AS clicks",
        "CAST(l_quantity AS BIGINT) AS impressions",
        "CAST(round(l_discount * 100) AS BIGINT) AS position",
    )


def with_period(f: DataFrame, last: date, days: int = DAYS) -> DataFrame:
    """Adds ``period``: now, prev, or NULL for older days."""
    age = F.datediff(F.lit(last), "day")
    return f.withColumn("period", F.when(age < days, "now").when(age < 2 * days, "prev"))


def last_day(spark: SparkSession, folder: str) -> date:
    """The last day that the facts have; one value, from a scan of one column."""
    return table(spark, folder, "lineitem").agg(F.to_date(F.max("l_shipdate")).alias("d")).first().d


def two_periods(spark: SparkSession, folder: str, days: int = DAYS) -> DataFrame:
    """The facts of both periods; the scan reads no older days."""
    last = last_day(spark, folder)
    if last is None:
        return with_period(facts(spark, folder), date(1970, 1, 1), days).limit(0)
    since = last - timedelta(days=2 * days - 1)
    return with_period(facts(spark, folder, since=since), last, days).filter("period IS NOT NULL")


def measures(of: Column | None = None) -> list[Column]:
    """Sums of clicks and impressions, the ratio of sums and the weighted position, of the rows where ``of`` holds."""
    keep = lambda c: F.when(of, c) if of is not None else c
    clicks, shown = F.coalesce(F.sum(keep(F.col("clicks"))), F.lit(0)), F.coalesce(F.sum(keep(F.col("impressions"))), F.lit(0))
    weighted = F.coalesce(F.sum(keep(F.col("position") * F.col("impressions"))), F.lit(0))
    zero = F.lit(0.0)
    return [
        clicks.alias("clicks"),
        shown.alias("impressions"),
        F.when(shown == 0, zero).otherwise(F.round(clicks / shown, 6)).alias("ctr"),
        F.when(shown == 0, zero).otherwise(F.round(weighted / shown, 6)).alias("position"),
    ]


def totals(spark: SparkSession, folder: str) -> DataFrame:
    periods = two_periods(spark, folder)
    return periods.groupBy("period").agg(*measures())


def by_page(spark: SparkSession, folder: str) -> DataFrame:
    return two_periods(spark, folder).filter("period = 'now'").groupBy("page").agg(*measures())


def low_ctr(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with many impressions and few clicks."""
    pages = by_page(spark, folder).select("page", "clicks", "impressions")
    keep = (F.col("impressions") >= LOW_IMPRESSIONS) & (F.col("clicks") < LOW_CTR * F.col("impressions"))
    return pages.filter(keep).orderBy(F.desc("impressions"), "page").limit(TOP)


def period_delta(spark: SparkSession, folder: str) -> DataFrame:
    """Both periods of each page side by side, by conditional sums in one pass."""
    periods = two_periods(spark, folder)
    sums = {f"{m}_{p}": F.coalesce(F.sum(F.when(F.col("period") == p, F.col(m))), F.lit(0)) for p in ("now", "prev") for m in ("clicks", "impressions")}
    both = periods.groupBy("page").agg(*(c.alias(n) for n, c in sums.items()))
    return both.withColumn("impressions_delta", F.col("impressions_now") - F.col("impressions_prev"))


def dropped_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Pages whose position rose by DROP or more between the periods, both with enough impressions."""
    periods = two_periods(spark, folder)
    of = lambda p: F.when(F.col("period") == p, F.col("impressions"))
    at = lambda p: F.sum(F.when(F.col("period") == p, F.col("position") * F.col("impressions"))) / F.sum(of(p))
    pages = periods.groupBy("page").agg(F.sum(of("now")).alias("n"), F.sum(of("prev")).alias("p"), F.round(at("now"), 6).alias("position_now"), F.round(at("prev"), 6).alias("position_prev"))
    pages = pages.filter((F.col("n") >= DROP_IMPRESSIONS) & (F.col("p") >= DROP_IMPRESSIONS)).withColumn("drop", F.round(F.col("position_now") - F.col("position_prev"), 6))
    return pages.filter(F.col("drop") >= DROP).orderBy(F.desc("drop"), "page").limit(TOP).select("page", "position_now", "position_prev", "drop")


def top_queries(spark: SparkSession, folder: str) -> DataFrame:
    pages = by_page(spark, folder).withColumnRenamed("page", "query")
    return pages.orderBy(F.desc("impressions"), "query").limit(TOP)


def new_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages shown in the period and never before it, in all history."""
    last = last_day(spark, folder)
    f = with_period(facts(spark, folder, PAGE_AND_SHOP), last or date(1970, 1, 1)).filter("impressions > 0")
    now = F.coalesce(F.col("period") == "now", F.lit(False))
    pages = f.groupBy("page").agg(F.bool_and(now).alias("new"), F.sum("impressions").alias("impressions"))
    return pages.filter("new").select("page", "impressions")


def silent_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of the site that were never shown."""
    shown = facts(spark, folder).filter("impressions >= 48").select("page")
    return table(spark, folder, "part").selectExpr("CAST(p_partkey AS STRING) AS page").join(shown, "page", "left_anti")


def replace_days(stored: DataFrame, fresh: DataFrame, days: DataFrame) -> DataFrame:
    """Facts after a restatement: all rows of the given days go, also where no fresh row comes for a day."""
    return stored.join(days.select("day").distinct(), "day", "left_anti").unionByName(fresh.join(days.select("day").distinct(), "day", "left_semi"))


def restated(spark: SparkSession, folder: str) -> DataFrame:
    """The odd days are stored, and every third day is restated from the rows of the first part keys."""
    f = facts(spark, folder)
    days = f.filter(F.dayofmonth("day") % 3 == 0).select("day")
    out = replace_days(f.filter(F.dayofmonth("day") % 2 == 1), f.filter(F.col("page").cast("long") % 5 == 0).withColumn("clicks", F.col("clicks") + 1), days)
    return out.groupBy("day").agg(F.count("*").alias("n"), F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))


def inspections(spark: SparkSession, folder: str) -> DataFrame:
    """Orders read as page inspections: url, state, whether it passed, the day of the check."""
    return table(spark, folder, "orders").selectExpr("concat('/o/', o_orderkey) AS url", "o_orderstatus AS state", "o_orderstatus = 'F' AS passed", "to_date(o_orderdate) AS checked")


def index_states(spark: SparkSession, folder: str) -> DataFrame:
    """Pages per state, their share of all, and the first and last check."""
    per = inspections(spark, folder).groupBy("state").agg(F.count("*").alias("pages"), F.sum(F.col("passed").cast("long")).alias("indexed"), F.min("checked").alias("oldest"), F.max("checked").alias("newest"))
    return per.withColumn("share", F.round(F.col("pages") / F.sum("pages").over(Window.partitionBy()), 6))


def index_examples(spark: SparkSession, folder: str) -> DataFrame:
    """The three pages of each state that were checked last."""
    order = Window.partitionBy("state").orderBy(F.desc("checked"), "url")
    return inspections(spark, folder).withColumn("nth", F.row_number().over(order)).filter("nth <= 3").select("state", "nth", "url", "checked")


def index_week_ago(spark: SparkSession, folder: str) -> DataFrame:
    """As of a week before the last day: the latest day with counts up to then, and its count for each state."""
    daily = inspections(spark, folder).groupBy("checked", "state").agg(F.count("*").alias("pages"))
    last = daily.agg(F.date_sub(F.max("checked"), 7).alias("asof"))
    past = daily.crossJoin(F.broadcast(last)).filter("checked <= asof")
    return past.groupBy("state").agg(F.max("checked").alias("day"), F.max_by("pages", "checked").alias("pages"))


def inspect_pick(spark: SparkSession, folder: str) -> DataFrame:
    """The next 200 pages to inspect: never inspected ones first, then the oldest check."""
    last = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("page")).agg(F.max(F.to_date("o_orderdate")).alias("checked"))
    pages = table(spark, folder, "customer").select(F.col("c_custkey").alias("page")).join(last, "page", "left")
    return pages.orderBy(F.asc_nulls_first("checked"), "page").limit(200)


def _sql(body: str, page: str = "CAST(l_partkey AS VARCHAR)") -> str:
    return f"""WITH facts AS (SELECT CAST(l_shipdate AS DATE) AS day, {page} AS page,
  CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS clicks, CAST(l_quantity AS BIGINT) AS impressions,
  CAST(round(l_discount * 100) AS BIGINT) AS position FROM lineitem),
periods AS (SELECT *, CASE WHEN date_diff('day', day, (SELECT max(day) FROM facts)) < 90 THEN 'now'
  WHEN date_diff('day', day, (SELECT max(day) FROM facts)) < 180 THEN 'prev' END AS period FROM facts)
{body}"""


_INSPECT = "WITH i AS (SELECT '/o/' || o_orderkey AS url, o_orderstatus AS state, o_orderstatus = 'F' AS passed, CAST(o_orderdate AS DATE) AS checked FROM orders)"
_MEASURES = """CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions,
CASE WHEN sum(impressions) = 0 THEN 0.0 ELSE round(sum(clicks) / sum(impressions), 6) END AS ctr,
CASE WHEN sum(impressions) = 0 THEN 0.0 ELSE round(sum(position * impressions) / sum(impressions), 6) END AS position"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "search_low_ctr": low_ctr,
    "search_totals": totals,
    "search_by_page": by_page,
    "search_period_delta": period_delta,
    "search_dropped_rank": dropped_rank,
    "search_top_queries": top_queries,
    "search_new_pages": new_pages,
    "search_silent_pages": silent_pages,
    "search_replace_days": restated,
    "index_states": index_states,
    "index_examples_top3": index_examples,
    "index_asof_week": index_week_ago,
    "inspect_pick": inspect_pick,
}
ORACLES = {
    "search_low_ctr": _sql("""SELECT page, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions
FROM periods WHERE period = 'now' GROUP BY page
HAVING sum(impressions) >= 30 AND sum(clicks) < 0.02 * sum(impressions) ORDER BY impressions DESC, page LIMIT 10"""),
    "search_totals": _sql(f"SELECT period, {_MEASURES} FROM periods WHERE period IS NOT NULL GROUP BY period"),
    "search_by_page": _sql(f"SELECT page, {_MEASURES} FROM periods WHERE period = 'now' GROUP BY page"),
    "search_period_delta": _sql("""SELECT page, CAST(coalesce(sum(clicks) FILTER (period = 'now'), 0) AS BIGINT) AS clicks_now, CAST(coalesce(sum(impressions) FILTER (period = 'now'), 0) AS BIGINT) AS impressions_now,
CAST(coalesce(sum(clicks) FILTER (period = 'prev'), 0) AS BIGINT) AS clicks_prev, CAST(coalesce(sum(impressions) FILTER (period = 'prev'), 0) AS BIGINT) AS impressions_prev,
CAST(coalesce(sum(impressions) FILTER (period = 'now'), 0) - coalesce(sum(impressions) FILTER (period = 'prev'), 0) AS BIGINT) AS impressions_delta FROM periods WHERE period IS NOT NULL GROUP BY page"""),
    "search_dropped_rank": _sql(""", p AS (SELECT page, sum(impressions) FILTER (period = 'now') AS n, sum(impressions) FILTER (period = 'prev') AS p,
round(sum(position * impressions) FILTER (period = 'now') / sum(impressions) FILTER (period = 'now'), 6) AS position_now,
round(sum(position * impressions) FILTER (period = 'prev') / sum(impressions) FILTER (period = 'prev'), 6) AS position_prev FROM periods GROUP BY page)
SELECT page, position_now, position_prev, round(position_now - position_prev, 6) AS "drop" FROM p WHERE n >= 10 AND p >= 10 AND round(position_now - position_prev, 6) >= 3 ORDER BY "drop" DESC, page LIMIT 10"""),
    "search_top_queries": _sql(f"SELECT page AS query, {_MEASURES} FROM periods WHERE period = 'now' GROUP BY page ORDER BY impressions DESC, query LIMIT 10"),
    "search_new_pages": _sql("SELECT page, CAST(sum(impressions) AS BIGINT) AS impressions FROM periods WHERE impressions > 0 GROUP BY page HAVING bool_and(coalesce(period, '') = 'now')", "l_partkey || '/' || l_suppkey"),
    "search_silent_pages": "SELECT CAST(p_partkey AS VARCHAR) AS page FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE CAST(l_quantity AS BIGINT) >= 48)",
    "search_replace_days": _sql(""", o AS (SELECT day, clicks, impressions FROM facts WHERE day(day) % 2 = 1 AND day(day) % 3 <> 0
UNION ALL SELECT day, clicks + 1, impressions FROM facts WHERE CAST(page AS BIGINT) % 5 = 0 AND day(day) % 3 = 0)
SELECT day, count(*) AS n, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions FROM o GROUP BY day"""),
    "index_states": _INSPECT + " SELECT state, count(*) AS pages, CAST(sum(CAST(passed AS BIGINT)) AS BIGINT) AS indexed, min(checked) AS oldest, max(checked) AS newest, round(count(*) / (SELECT count(*) FROM i), 6) AS share FROM i GROUP BY state",
    "index_examples_top3": _INSPECT + " SELECT state, CAST(row_number() OVER w AS INTEGER) AS nth, url, checked FROM i WINDOW w AS (PARTITION BY state ORDER BY checked DESC, url) QUALIFY nth <= 3",
    "index_asof_week": _INSPECT + ", d AS (SELECT checked, state, count(*) AS pages FROM i GROUP BY ALL) SELECT state, max(checked) AS day, arg_max(pages, checked) AS pages FROM d WHERE checked <= (SELECT max(checked) FROM i) - 7 GROUP BY state",
    "inspect_pick": "SELECT c_custkey AS page, max(CAST(o_orderdate AS DATE)) AS checked FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey ORDER BY checked NULLS FIRST, page LIMIT 200",
}

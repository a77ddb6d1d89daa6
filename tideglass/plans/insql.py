"""Queries that are written in SQL, over the views and functions of ``tideglass.sql``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tideglass import sql

_LINKS = "SELECT page_id, place, target, host_of(target) AS host, array_join(labels, ' / ') AS labels FROM pages, LATERAL page_links(html, url)"
TEXTS = {
    # scalar functions over a view
    "sql_changes": "SELECT user_id, count_if(changed) AS changes, interval_days(cast(max(errors) AS DOUBLE)) AS days, url_key(concat('/u/', user_id)) AS key FROM fetches GROUP BY user_id",
    # a table function
    "sql_page_links": f"SELECT page_id, place, target, host FROM ({_LINKS})",
    # an aggregate, beside built-in ones and a function
    "sql_positions": "SELECT page, sum(clicks) AS clicks, sum(impressions) AS impressions, ctr(sum(clicks), sum(impressions)) AS ctr FROM facts GROUP BY page",
    # (an aggregate in Python takes a group as a whole: days are summed up by built-in functions before)
    "sql_weighted_position": "SELECT year(day) AS year, round(weighted_mean(position, impressions), 6) AS position FROM (SELECT day, sum(position * impressions) / sum(impressions) AS position, sum(impressions) AS impressions FROM facts GROUP BY day) GROUP BY year(day)",
    # views alone
    "sql_series": "SELECT host_of(first_url) AS host, count(*) AS pages, sum(page) AS numbers, content_hash(min(first_url)) AS first FROM page_series GROUP BY host_of(first_url)",
    "sql_nth_weekday": "SELECT o_orderkey AS id, cast(nth_weekday(year(o_orderdate), month(o_orderdate), cast(o_custkey % 7 AS INT), cast(1 + o_orderkey % 4 AS INT)) AS STRING) AS day FROM orders",
}


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        sql.register(spark, folder)
        return spark.sql(text)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(text) for name, text in TEXTS.items()}
_HREFS = r"""h AS (SELECT page_id, regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || regexp_replace(unnest(x), '#.*$', '') AS u, generate_subscripts(x, 1) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '<a[^>]*href="(/[^"]*)"', 1) AS x FROM pages)),
l AS (SELECT page_id, u, min(i) AS i FROM h GROUP BY page_id, u)"""
ORACLES = {
    "sql_changes": """WITH l AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'error' THEN 500 WHEN event_type = 'signup' THEN 304 ELSE 200 END AS status, CAST(floor(value / 40) AS BIGINT) AS digest FROM events),
m AS (SELECT *, last_value(CASE WHEN status = 200 THEN digest END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS had,
count(*) FILTER (status IN (200, 304)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM l),
e AS (SELECT *, count(*) FILTER (status = 500) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS errors FROM m)
SELECT user_id, count(*) FILTER (status = 200 AND digest IS DISTINCT FROM had) AS changes, CAST(CASE WHEN max(errors) < 7 THEN 1 WHEN max(errors) < 28 THEN 3 ELSE 7 END AS INTEGER) AS days, sha1(concat('/u/', user_id))[1:16] AS key FROM e GROUP BY user_id""",
    "sql_page_links": f"WITH {_HREFS} SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS place, u AS target, lower(regexp_extract(u, '^[a-zA-Z]+://([^/?#:]*)', 1)) AS host FROM l",
    "sql_positions": "SELECT CAST(l_partkey AS VARCHAR) AS page, CAST(count(*) FILTER (l_linenumber = 1) AS BIGINT) AS clicks, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS impressions, CASE WHEN sum(CAST(l_quantity AS BIGINT)) = 0 THEN 0.0 ELSE round(count(*) FILTER (l_linenumber = 1) / sum(CAST(l_quantity AS BIGINT)), 6) END AS ctr FROM lineitem GROUP BY 1",
    "sql_weighted_position": "SELECT CAST(year(l_shipdate) AS INTEGER) AS year, round(sum(CAST(round(l_discount * 100) AS BIGINT) * CAST(l_quantity AS BIGINT)) / sum(CAST(l_quantity AS BIGINT)), 6) AS position FROM lineitem GROUP BY 1",
    "sql_nth_weekday": """WITH o AS (SELECT o_orderkey AS id, date_trunc('month', o_orderdate)::DATE AS m, o_custkey % 7 AS w, o_orderkey % 4 AS n FROM orders)
SELECT id, CAST(m + CAST((w - (isodow(m) - 1) + 7) % 7 + 7 * n AS INTEGER) AS VARCHAR) AS day FROM o""",
}

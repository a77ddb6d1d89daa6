"""Queries of the holiday calendar and of opening status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.operators import calendar
from tideglass.session import prepare, table


def _order_days(spark: SparkSession, folder: str) -> tuple[DataFrame, int, int]:
    """Days on which there are orders, with how many, and the years of the first and the last of them."""
    days = table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("day")).filter("day IS NOT NULL").groupBy("day").agg(F.count("*").alias("orders"))
    r = days.agg(F.coalesce(F.min(F.year("day")), F.lit(2000)).alias("a"), F.coalesce(F.max(F.year("day")), F.lit(2000)).alias("z")).first()
    return days, r.a, r.z


def holidays(spark: SparkSession, folder: str) -> DataFrame:
    """The holidays of the years of the orders, and how many orders there are on each."""
    days, first, last = _order_days(spark, folder)
    return calendar.holidays(prepare(spark), first, last).join(days, "day", "left").select("day", "name", F.coalesce("orders", F.lit(0)).alias("orders"))


def next_business_day(spark: SparkSession, folder: str) -> DataFrame:
    """For each day with orders, the first day from it on that is no Saturday, Sunday or holiday; and the business days up to thirty days later."""
    days, first, last = _order_days(spark, folder)
    known = calendar.days(prepare(spark), first, last + 1)
    working = known.select(F.col("next_business").alias("b")).filter("b IS NOT NULL").distinct()
    within = days.select("day").join(working, F.col("b").between(F.col("day"), F.date_add("day", 30))).groupBy("day").agg(F.count("*").alias("within"))
    return days.join(known.select("day", F.col("next_business").alias("next")), "day").join(within, "day", "left").select("day", "next", F.coalesce("within", F.lit(0)).alias("within"))


def _places(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("s_suppkey")
    behavior = F.element_at(F.array(*[F.lit(b) for b in ("closed", "open", "next_day", "next_weekday", "unspecified")]), (k % 5 + 1).cast("int"))
    return table(spark, folder, "supplier").select(k.alias("place"), (k % 7).cast("int").alias("weekday"), behavior.alias("behavior"), F.date_add(F.lit("2026-08-01").cast("date"), (k % 30).cast("int")).alias("rule_at"), (k % 13 != 0).alias("hours"), (k % 17 == 0).alias("stale"))


def _notices(spark: SparkSession, folder: str) -> DataFrame:
    k, start = F.col("s_suppkey"), F.lit("2026-09-01").cast("date")
    rows = table(spark, folder, "supplier").select(k, F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i")).filter("s_suppkey % 3 = i OR s_suppkey % 8 = i")
    first = F.date_add(start, ((k * 3 + F.col("i") * 2) % 28).cast("int"))
    return rows.select(k.alias("place"), first.alias("from_day"), F.date_add(first, (k % 4).cast("int")).alias("to_day"), F.when((k + F.col("i")) % 2 == 0, "closed").otherwise("open").alias("kind"), F.when(k % 10 != 0, F.date_add(F.lit("2026-08-10").cast("date"), ((k + F.col("i") * 7) % 20).cast("int"))).alias("at"))


def open_status(spark: SparkSession, folder: str) -> DataFrame:
    """Each supplier on each day of September 2026, which has five holidays in a row of days off."""
    month = calendar.days(prepare(spark), 2026, 2026)
    full = calendar.resolve(_places(spark, folder), _notices(spark, folder), month.filter("day BETWEEN DATE '2026-08-20' AND DATE '2026-10-10'"))
    return full.filter("day BETWEEN DATE '2026-09-01' AND DATE '2026-09-30'")


def open_week(spark: SparkSession, folder: str) -> DataFrame:
    """Days of each state in the week of the holidays, for each place."""
    return open_status(spark, folder).filter("day BETWEEN DATE '2026-09-19' AND DATE '2026-09-25'").groupBy("place").agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("open", "closed", "unknown")))


_VALUES = ", ".join(f"({m}, {d}, '{n}')" for m, d, n in calendar.FIXED)
_HOLIDAYS = f"""y AS (SELECT i AS y FROM range(1979, 2101) t(i)), f(m, d, name) AS (VALUES {_VALUES}), mon(m, nth, name) AS (VALUES {', '.join(f"({m}, {k}, '{n}')" for m, k, n in calendar.MONDAYS)}), eq(m, base, name) AS (VALUES {', '.join(f"({m}, {b}e0, '{n}')" for m, b, n in calendar.EQUINOXES)}),
n AS (SELECT make_date(y, m, d) AS day, name FROM y, f UNION ALL
SELECT make_date(y, m, CAST(1 + (8 - isodow(make_date(y, m, 1))) % 7 + 7 * (nth - 1) AS BIGINT)), name FROM y, mon UNION ALL
SELECT make_date(y, m, CAST(floor(base + 0.242194e0 * (y - 1980) - floor((y - 1980) / 4)) AS BIGINT)), name FROM y, eq UNION ALL
SELECT make_date(y, 2, 23), '天皇誕生日' FROM y WHERE y >= 2020),
u AS (SELECT day, min(name) AS name FROM n GROUP BY day),
s AS (SELECT min(c) AS day FROM (SELECT day AS sunday, day + CAST(i AS INTEGER) AS c FROM u, range(1, 11) t(i) WHERE isodow(day) = 7) WHERE c NOT IN (SELECT day FROM u) GROUP BY sunday),
k AS (SELECT day, name FROM u UNION ALL SELECT day, '{calendar.SUBSTITUTE}' FROM s),
b AS (SELECT DISTINCT a.day + 1 AS day FROM u a WHERE a.day + 2 IN (SELECT day FROM k) AND a.day + 1 NOT IN (SELECT day FROM k) AND isodow(a.day + 1) <> 7),
h AS (SELECT day, name FROM k UNION ALL SELECT day, '{calendar.BRIDGE}' FROM b)"""
_DAYS = f"{_HOLIDAYS}, d AS (SELECT CAST(r AS DATE) AS day FROM range(DATE '2026-01-01', DATE '2028-01-01', INTERVAL 1 DAY) t(r)), w AS (SELECT d.day, name, CASE WHEN name IS NULL AND isodow(d.day) < 6 THEN d.day END AS bd FROM d LEFT JOIN h USING (day)), c AS (SELECT day, name, min(bd) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING) AS nb FROM w)"
_STATUS = f"""{_DAYS},
p AS (SELECT s_suppkey AS place, s_suppkey % 7 AS wd, ['closed', 'open', 'next_day', 'next_weekday', 'unspecified'][s_suppkey % 5 + 1] AS bh, DATE '2026-08-01' + CAST(s_suppkey % 30 AS INTEGER) AS rule_at, s_suppkey % 13 <> 0 AS hours, s_suppkey % 17 = 0 AS stale FROM supplier),
no AS (SELECT s_suppkey AS place, DATE '2026-09-01' + CAST((s_suppkey * 3 + i * 2) % 28 AS INTEGER) AS a, DATE '2026-09-01' + CAST((s_suppkey * 3 + i * 2) % 28 + s_suppkey % 4 AS INTEGER) AS z, CASE WHEN (s_suppkey + i) % 2 = 0 THEN 'closed' ELSE 'open' END AS kind,
CASE WHEN s_suppkey % 10 <> 0 THEN DATE '2026-08-10' + CAST((s_suppkey + i * 7) % 20 AS INTEGER) END AS stamp FROM supplier, range(3) t(i) WHERE s_suppkey % 3 = i OR s_suppkey % 8 = i),
g AS (SELECT p.*, c.day, c.name, isodow(c.day) - 1 AS dow, (SELECT x.name FROM c x WHERE x.day = c.day - 1) AS pn, c.day - CAST((isodow(c.day) - 1 - wd - 1 + 14) % 7 + 1 AS INTEGER) AS hit FROM p, c WHERE c.day BETWEEN DATE '2026-09-01' AND DATE '2026-09-30'),
r AS (SELECT g.*, CASE WHEN dow = wd THEN CASE WHEN bh = 'closed' OR g.name IS NULL THEN 'closed' WHEN bh = 'unspecified' THEN 'unknown' ELSE 'open' END
WHEN bh = 'next_day' AND (dow + 6) % 7 = wd AND pn IS NOT NULL THEN CASE WHEN g.name IS NOT NULL THEN 'unknown' ELSE 'closed' END
WHEN bh = 'next_weekday' AND hc.name IS NOT NULL AND t.nb = g.day THEN 'closed' ELSE 'open' END AS rule FROM g LEFT JOIN c hc ON hc.day = hit LEFT JOIN c t ON t.day = hit + 1),
q AS (SELECT r.place, r.day, any_value(rule) AS rule, any_value(rule_at) AS rule_at, any_value(hours) AS hours, any_value(stale) AS stale, count(*) FILTER (kind = 'closed') AS nc, count(*) FILTER (kind = 'open') AS nopen, max(stamp) FILTER (kind = 'closed') AS ca, max(stamp) FILTER (kind = 'open') AS oa FROM r LEFT JOIN no ON no.place = r.place AND r.day BETWEEN a AND z GROUP BY r.place, r.day),
x AS (SELECT *, CASE WHEN nc > 0 AND nopen > 0 THEN CASE WHEN ca > oa THEN 'closed' WHEN oa > ca THEN 'open' ELSE 'unknown' END WHEN nc > 0 THEN 'closed' WHEN nopen > 0 THEN 'open' END AS n FROM q),
z AS (SELECT *, CASE WHEN n IS NULL THEN rule WHEN n <> 'open' THEN n WHEN rule = 'closed' THEN CASE WHEN coalesce(greatest(ca, oa) > rule_at, false) THEN 'open' ELSE 'unknown' END ELSE 'open' END AS st FROM x),
status AS (SELECT place, day, CASE WHEN stale OR (st = 'open' AND NOT hours) THEN 'unknown' ELSE st END AS state, CASE WHEN stale THEN 'stale' WHEN st = 'open' AND NOT hours THEN 'no_data' WHEN n IS NOT NULL THEN 'notice' WHEN rule <> 'open' THEN 'rule' ELSE 'hours' END AS reason FROM z)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"holidays": holidays, "next_business_day": next_business_day, "open_status": open_status, "open_week": open_week}
ORACLES = {
    "holidays": f"WITH {_HOLIDAYS}, o AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1), e AS (SELECT min(year(day)) AS a, max(year(day)) AS z FROM o) SELECT day, name, coalesce(n, 0) AS orders FROM h LEFT JOIN o USING (day), e WHERE year(day) BETWEEN a AND z",
    "next_business_day": f"""WITH {_HOLIDAYS}, o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), r AS (SELECT CAST(t AS DATE) AS day FROM range(DATE '1979-01-01', DATE '2100-01-01', INTERVAL 1 DAY) x(t)),
wd AS (SELECT day FROM r WHERE isodow(day) < 6 AND day NOT IN (SELECT day FROM h))
SELECT o.day, min(wd.day) AS next, count(*) FILTER (wd.day <= o.day + 30) AS within FROM o JOIN wd ON wd.day >= o.day AND wd.day <= o.day + 40 GROUP BY o.day""",
    "open_status": f"WITH {_STATUS} SELECT place, day, state, reason FROM status",
    "open_week": f"WITH {_STATUS} SELECT place, count(*) FILTER (state = 'open') AS open, count(*) FILTER (state = 'closed') AS closed, count(*) FILTER (state = 'unknown') AS unknown FROM status WHERE day BETWEEN DATE '2026-09-19' AND DATE '2026-09-25' GROUP BY place",
}

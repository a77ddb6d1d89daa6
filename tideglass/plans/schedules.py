"""Queries of opening hours, closing days, date ranges and the days that follow from them.

The tables hold no such texts. Each row of a table stands for one of the texts below, by its key; the SQL has the meaning of each text, written down by hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.functions import schedule
from tideglass.operators import status
from tideglass.session import prepare, table

#: text, periods ("start-end/last entry", weekdays, holidays, season) and note.
HOURS = [
    ("9:00〜17:00", "540-1020 d h=", ""),
    ("9:00～17:00（入館は16:30まで）", "540-1020/990 d h=", ""),
    ("9:00〜12:00 13:00〜17:00", "540-720,780-1020 d h=", ""),
    ("平日 9:00〜17:00、土日祝 9:00〜18:00", "540-1020 d01234 h-=;540-1080 d56 h+=", ""),
    ("3月〜9月 9:00〜17:00 / 10月〜2月 9:00〜16:30", "540-1020 d h=301-931;540-990 d h=1001-231", ""),
    ("営業時間 03/21~10/20 8:30~17:00 10/21~11/30 8:00~17:00", "510-1020 d h=321-1020;480-1020 d h=1021-1130", ""),
    ("午前9時30分~午後5時\n※特別な催しの金曜日は午後7時まで", "570-1020 d h=", ""),
    ("月〜金 9:00〜17:00", "540-1020 d01234 h=", ""),
    ("金〜月曜 10時〜16時", "600-960 d0456 h=", ""),
    ("入園自由", "open", "always_open"),
    ("24時間", "open", "always_open"),
    ("開庁時間 8:30〜17:15", None, "office_hours"),
    ("始発 8:36", None, "no_time_range"),
    ("9:00〜17:00（電話でのお問い合わせは9:00〜16:00）", "540-1020 d h=", ""),
    ("1月 7時00分~17時00分\n2月 7時00分~17時30分", "420-1020 d h=101-131;420-1050 d h=201-231", ""),
    ("22:00〜26:00", "1320-120 d h=", ""),
    ("", None, "no_text"),
]
#: text, rules (kind, weekdays, nths, span, behaviour on holidays) and note.
CLOSURES = [
    ("毎週月曜日", "weekly d0 n - closed", ""),
    ("月曜日（祝日の場合は翌日）", "weekly d0 n - next_day", ""),
    ("月曜日（祝日の場合は翌平日）", "weekly d0 n - next_weekday", ""),
    ("月曜日（祝日の場合は開館）", "weekly d0 n - open", ""),
    ("月曜日（祝日に関する記載あり）", "weekly d0 n - unspecified", ""),
    ("月〜水曜", "weekly d012 n - closed", ""),
    ("第2・第4水曜日", "nth_weekday d2 n24 - closed", ""),
    ("第3月曜日（祝日の場合は翌平日）", "nth_weekday d0 n3 - next_weekday", ""),
    ("毎週火曜日、年末年始（12/29〜1/3）", "weekly d1 n - closed;annual_span d n 1229-103 closed", ""),
    ("9月12日〜15日", "annual_span d n 912-915 closed", ""),
    ("年中無休", "", "always_open"),
    ("不定休", "irregular d n - closed", "irregular"),
    ("公式サイトをご確認ください", None, "no_closure_rule"),
]
#: text, first and last day for the year 2026, and note.
RANGES = [
    ("2026年9月15日〜9月20日", "2026-09-15", "2026-09-20", None),
    ("9月15日〜20日", "2026-09-15", "2026-09-20", None),
    ("12月29日〜1月3日", "2026-12-29", "2027-01-03", None),
    ("9月15日（火）", "2026-09-15", "2026-09-15", "single_day"),
    ("R7年11月11日(火)~11月20日(木)", "2025-11-11", "2025-11-20", None),
    ("令和7年10月29日", "2025-10-29", "2025-10-29", "single_day"),
    ("10月1日(水)", "2025-10-01", "2025-10-01", "single_day"),
    ("9/16(水)~9/18(金)", "2026-09-16", "2026-09-18", None),
    ("1月5日(火)", "2027-01-05", "2027-01-05", "single_day"),
    ("2026年10月1日(水)", None, None, "weekday_mismatch"),
    ("2026年2月30日〜3月2日", None, None, "invalid_date"),
    ("近日中", None, None, "no_date_range"),
    ("", None, None, "no_text"),
]
SERVICES = [("平日ダイヤ", "d01234 h-", ""), ("土休日ダイヤ", "d56 h+", ""), ("毎日運航", "d h", ""), ("月曜・祝", "d0 h+", ""), ("日曜（祝日を除く）", "d6 h-", ""), ("1月〜3月", None, "no_service_days"), ("", None, "no_text")]


def _pick(texts: list[str], key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, texts)), (key % len(texts) + 1).cast("int"))


def _days(d: Column) -> Column:
    return F.concat(F.lit("d"), F.array_join(d["weekdays"].cast("array<string>"), ""), F.lit(" h"), F.when(d["include_holidays"], "+").when(d["exclude_holidays"], "-").otherwise(""))


def _span(s: Column, none: str) -> Column:
    day = lambda m, d: (s[m] * 100 + s[d]).cast("string")
    return F.when(s.isNull(), none).otherwise(F.concat_ws("-", day("start_month", "start_day"), day("end_month", "end_day")))


def hours_text(periods: Column) -> Column:
    of = lambda r: F.concat(r["start"].cast("string"), F.lit("-"), r["end"].cast("string"), F.coalesce(F.concat(F.lit("/"), r["last_entry"].cast("string")), F.lit("")))
    one = lambda p: F.when(p["always_open"], "open").otherwise(F.concat(F.array_join(F.transform(p["ranges"], of), ","), F.lit(" "), _days(p["days"]), F.lit("="), _span(p["season"], "")))
    return F.array_join(F.transform(periods, one), ";")


def closures_text(rules: Column) -> Column:
    one = lambda r: F.concat_ws(" ", r["kind"], F.concat(F.lit("d"), F.array_join(r["weekdays"].cast("array<string>"), "")), F.concat(F.lit("n"), F.array_join(r["nths"].cast("array<string>"), "")), _span(r["annual"], "-"), r["holiday_behavior"])
    return F.array_join(F.transform(rules, one), ";")


def hours_parse(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), _pick([t for t, _, _ in HOURS], F.col("o_orderkey")).alias("text"))
    return rows.select("id", schedule.parse_opening_hours(F.col("text")).alias("p")).select("id", hours_text(F.col("p.value")).alias("value"), F.coalesce("p.note", F.lit("")).alias("note"))


def closures_parse(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), _pick([t for t, _, _ in CLOSURES], F.col("o_orderkey")).alias("text"))
    return rows.select("id", schedule.parse_closures(F.col("text")).alias("p")).select("id", closures_text(F.col("p.value")).alias("value"), F.coalesce("p.note", F.lit("")).alias("note"))


def service_days_parse(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), _pick([t for t, _, _ in SERVICES], F.col("c_custkey")).alias("text"))
    return rows.select("id", schedule.parse_service_days(F.col("text")).alias("p")).select("id", _days(F.col("p.value")).alias("value"), F.coalesce("p.note", F.lit("")).alias("note"))


def date_range_parse(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), _pick([t for t, *_ in RANGES], F.col("o_orderkey")).alias("text"))
    return rows.select("id", schedule.parse_date_range(F.col("text"), F.lit(2026)).alias("p")).select("id", F.col("p.value.start").cast("string").alias("first"), F.col("p.value.end").cast("string").alias("last"), F.col("p.note").alias("note"))


def schedule_days(spark: SparkSession, folder: str) -> DataFrame:
    """Each supplier on each day of September 2026, from its texts: closing days and hours by its key, and a service on workdays or weekends for some."""
    prepare(spark)
    k = F.col("s_suppkey")
    service = F.when(k % 10 == 3, "平日ダイヤ").when(k % 10 == 7, "土休日ダイヤ").otherwise("")
    texts = table(spark, folder, "supplier").select(k.alias("place"), _pick([t for t, _, _ in CLOSURES], k).alias("closing"), _pick([t for t, _, _ in HOURS], k * 5).alias("open"), service.alias("service"))
    never = F.lit(None).cast("timestamp")
    places = texts.select("place", schedule.parse_closures(F.col("closing"))["value"].alias("closures"), schedule.parse_opening_hours(F.col("open"))["value"].alias("hours"), schedule.parse_service_days(F.col("service"))["value"].alias("service_days"), never.alias("evidence_at"), never.alias("fetched_at"))
    notices = spark.createDataFrame([], "place long, from_day date, to_day date, kind string, fetched_at timestamp")
    calendar = status.dimension(status.layered(spark, 2026, 2026))
    days = status.resolve(places, notices, calendar, "2026-09-01", "2026-09-30")
    times = F.array_join(F.transform("periods", lambda p: F.concat_ws("-", p["start"].cast("string"), p["end"].cast("string"))), ",")
    return days.select("place", F.col("day").cast("string").alias("day"), "state", F.array_join("codes", ",").alias("codes"), times.alias("times"))


def _quoted(v: str | None) -> str:
    return "NULL" if v is None else "'" + v + "'"


def _meanings(table_name: str, key: str, rows: list[tuple], columns: list[str]) -> str:
    values = ", ".join(f"({i}, {', '.join(_quoted(v) for v in r[1:])})" for i, r in enumerate(rows))
    return f"SELECT {key} AS id, {', '.join(columns)} FROM {table_name} JOIN (VALUES {values}) m(i, {', '.join(columns)}) ON {key} % {len(rows)} = i"


# The rules and hours of each text as rows, for the SQL of the days: (text, kind, weekday, nth, first and last day, behaviour) and (text, weekdays or NULL, on holidays, from, to).
_RULE_ROWS = [
    (0, "weekly", 0, 0, 0, 0, "closed"), (1, "weekly", 0, 0, 0, 0, "next_day"), (2, "weekly", 0, 0, 0, 0, "next_weekday"), (3, "weekly", 0, 0, 0, 0, "open"), (4, "weekly", 0, 0, 0, 0, "unspecified"),
    (5, "weekly", 0, 0, 0, 0, "closed"), (5, "weekly", 1, 0, 0, 0, "closed"), (5, "weekly", 2, 0, 0, 0, "closed"), (6, "nth_weekday", 2, 2, 0, 0, "closed"), (6, "nth_weekday", 2, 4, 0, 0, "closed"), (7, "nth_weekday", 0, 3, 0, 0, "next_weekday"),
    (8, "weekly", 1, 0, 0, 0, "closed"), (9, "annual", 0, 0, 912, 915, "closed"), (11, "irregular", 0, 0, 0, 0, "closed"),
]
_HOUR_ROWS = [
    (0, "0123456", "", 101, 1231, "540-1020"), (1, "0123456", "", 101, 1231, "540-1020"), (2, "0123456", "", 101, 1231, "540-720,780-1020"), (3, "01234", "-", 101, 1231, "540-1020"), (3, "56", "+", 101, 1231, "540-1080"),
    (4, "0123456", "", 301, 931, "540-1020"), (5, "0123456", "", 321, 1020, "510-1020"), (6, "0123456", "", 101, 1231, "570-1020"), (7, "01234", "", 101, 1231, "540-1020"), (8, "0456", "", 101, 1231, "600-960"), (9, "0123456", "", 101, 1231, "open"),
    (10, "0123456", "", 101, 1231, "open"), (13, "0123456", "", 101, 1231, "540-1020"), (15, "0123456", "", 101, 1231, "1320-120"),
]
_ROWS = lambda rows: ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else f"'{v}'" for v in r) + ")" for r in rows)
# The holidays of September 2026 are the 21st to the 23rd; the first business day after each is the 24th.
_DAYS_SQL = f"""WITH d AS (SELECT CAST(r AS DATE) AS day FROM range(DATE '2026-09-01', DATE '2026-10-01', INTERVAL 1 DAY) t(r)),
c AS (SELECT day, isodow(day) - 1 AS wd, month(day) * 100 + day(day) AS md, (day(day) - 1) // 7 + 1 AS nth, day BETWEEN DATE '2026-09-21' AND DATE '2026-09-23' AS hol FROM d),
rules(i, kind, rwd, rnth, a, z, bh) AS (VALUES {_ROWS(_RULE_ROWS)}), hrs(i, days, hm, a, z, t) AS (VALUES {_ROWS(_HOUR_ROWS)}),
g AS (SELECT s_suppkey AS place, c.*, CASE s_suppkey % 10 WHEN 3 THEN NOT hol AND wd < 5 WHEN 7 THEN hol OR wd > 4 ELSE true END AS served FROM supplier, c),
v AS (SELECT g.place, g.day, kind, CASE
WHEN kind = 'irregular' THEN 'unknown:irregular_closed' WHEN kind = 'annual' THEN CASE WHEN md BETWEEN a AND z THEN 'closed:annual_closed' END
WHEN wd = rwd AND (rnth = 0 OR nth = rnth) THEN CASE WHEN bh = 'closed' OR NOT hol THEN 'closed:' || kind || '_closed' WHEN bh = 'unspecified' THEN 'unknown:substitute_ambiguous' ELSE 'open:holiday_open_exception' END
WHEN bh = 'next_day' AND g.day = DATE '2026-09-22' AND rwd = 0 THEN 'unknown:substitute_ambiguous'
WHEN bh = 'next_weekday' AND g.day = DATE '2026-09-24' AND rwd = 0 THEN 'closed:substitute_closed' END AS said FROM g JOIN rules ON rules.i = g.place % {len(CLOSURES)}),
e AS (SELECT place, day, CASE WHEN bool_or(starts_with(said, 'closed')) THEN 'closed' WHEN bool_or(starts_with(said, 'unknown')) THEN 'unknown' ELSE 'open' END AS st,
string_agg(DISTINCT CASE WHEN NOT starts_with(said, 'open') THEN regexp_replace(said, '^.*:', '') END, ',') AS why, string_agg(DISTINCT CASE WHEN starts_with(said, 'open') THEN regexp_replace(said, '^.*:', '') END, ',') AS exc FROM v WHERE said IS NOT NULL GROUP BY place, day),
h AS (SELECT g.place, g.day, string_agg(t, ',') AS t FROM g JOIN hrs ON hrs.i = (g.place * 5) % {len(HOURS)} WHERE md BETWEEN a AND z AND CASE hm WHEN '+' THEN hol OR contains(days, CAST(wd AS VARCHAR)) WHEN '-' THEN NOT hol AND contains(days, CAST(wd AS VARCHAR)) ELSE contains(days, CAST(wd AS VARCHAR)) END GROUP BY 1, 2),
x AS (SELECT g.place, g.day, served, coalesce(st, 'open') AS st, why, exc, h.t FROM g LEFT JOIN e USING (place, day) LEFT JOIN h USING (place, day))
SELECT place, CAST(day AS VARCHAR) AS day, CASE WHEN NOT served THEN 'closed' WHEN st = 'open' AND t IS NULL THEN 'unknown' ELSE st END AS state,
CASE WHEN NOT served THEN 'not_in_service' WHEN st <> 'open' THEN concat_ws(',', why, exc) WHEN t IS NULL THEN concat_ws(',', exc, 'no_data') ELSE concat_ws(',', CASE WHEN t = 'open' THEN 'always_open' ELSE 'regular_hours' END, exc) END AS codes,
CASE WHEN served AND st = 'open' AND t <> 'open' THEN t ELSE '' END AS times FROM x"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"hours_parse": hours_parse, "closures_parse": closures_parse, "service_days_parse": service_days_parse, "date_range_parse": date_range_parse, "schedule_days": schedule_days}
ORACLES = {
    "hours_parse": _meanings("orders", "o_orderkey", HOURS, ["value", "note"]),
    "closures_parse": _meanings("orders", "o_orderkey", CLOSURES, ["value", "note"]),
    "service_days_parse": _meanings("customer", "c_custkey", SERVICES, ["value", "note"]),
    "date_range_parse": _meanings("orders", "o_orderkey", RANGES, ["first", "last", "note"]),
    "schedule_days": _DAYS_SQL,
}

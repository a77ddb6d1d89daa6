"""Queries of locale forms and of personal data in rendered texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.functions import locales, web
from tideglass.session import table

CODES = ["ja", "en", "zh-Hant", "zh-TW", "en-GB", "fr"]


def locale_dates(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    code = F.element_at(F.array(*[F.lit(c) for c in CODES]), (k % len(CODES) + 1).cast("int"))
    rows = table(spark, folder, "orders").select(k.alias("id"), code.alias("code"), F.to_date("o_orderdate").alias("day"), F.floor("o_totalprice").alias("yen"))
    return rows.select("id", "code", locales.format_day(F.col("day"), F.col("code")).alias("date"), locales.format_day(F.col("day"), F.col("code"), "short").alias("short"), locales.format_money(F.col("yen"), F.col("code")).alias("money"))


def pii_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as contact lines: addresses of people and public bodies, phone numbers in wide and narrow digits, names, and what looks like them."""
    k = F.col("c_custkey")
    four = F.lpad((k % 10_000).cast("string"), 4, "0")
    wide = F.translate(F.concat(F.lit("03-1234-"), four), "0123456789-", "０１２３４５６７８９－")
    line = F.element_at(
        F.array(
            F.concat(F.lit("連絡先 user"), k.cast("string"), F.lit("@example.com まで")), F.concat(F.lit("代表 info"), k.cast("string"), F.lit("@city.matsumoto.nagano.jp")), F.concat(F.lit("電話 "), wide), F.concat(F.lit("〒390-"), four),
            F.lit("山田様のご厚意、皆様へ"), F.concat(F.lit("担当者：佐藤"), F.lit(" 記念財団様")), F.lit("所有者: 5万円 新婚さん 様式"),
        ),
        (k % 7 + 1).cast("int"),
    )
    rows = table(spark, folder, "customer").select(k.alias("id"), F.inline(web.personal_data(line)))
    return rows.select("id", "kind", "value")


_MONTHS = "'January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December'"
_DAYS = {"ja": "'月', '火', '水', '木', '金', '土', '日'", "zh-Hant": "'週一', '週二', '週三', '週四', '週五', '週六', '週日'", "en": "'Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'"}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"locale_dates": locale_dates, "pii_findings": pii_findings}
ORACLES = {
    "locale_dates": f"""WITH o AS (SELECT o_orderkey AS id, ['ja', 'en', 'zh-Hant', 'zh-TW', 'en-GB', 'fr'][o_orderkey % 6 + 1] AS code, CAST(o_orderdate AS DATE) AS d, format('{{:,}}', CAST(floor(o_totalprice) AS BIGINT)) AS a FROM orders),
p AS (SELECT *, CASE WHEN code = 'ja' THEN 'ja' WHEN starts_with(code, 'zh') THEN 'zh' ELSE 'en' END AS l, [{_MONTHS}][month(d)] AS mo FROM o)
SELECT id, code, CASE WHEN l = 'en' THEN day(d) || ' ' || mo || ' ' || year(d) ELSE year(d) || '年' || month(d) || '月' || day(d) || '日' END AS date,
CASE l WHEN 'en' THEN [{_DAYS['en']}][isodow(d)] || ', ' || day(d) || ' ' || mo[1:3] WHEN 'ja' THEN month(d) || '月' || day(d) || '日（' || [{_DAYS['ja']}][isodow(d)] || '）' ELSE month(d) || '月' || day(d) || '日（' || [{_DAYS['zh-Hant']}][isodow(d)] || '）' END AS short,
CASE l WHEN 'en' THEN '¥' || a WHEN 'ja' THEN a || '円' ELSE a || '日圓' END AS money FROM p""",
    "pii_findings": """SELECT c_custkey AS id, 'email' AS kind, 'user' || c_custkey || '@example.com' AS value FROM customer WHERE c_custkey % 7 = 0 UNION ALL
SELECT c_custkey, 'phone', '03-1234-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') FROM customer WHERE c_custkey % 7 = 2 UNION ALL SELECT c_custkey, 'name', '山田' FROM customer WHERE c_custkey % 7 = 4 UNION ALL SELECT c_custkey, 'name', '佐藤' FROM customer WHERE c_custkey % 7 = 5""",
}

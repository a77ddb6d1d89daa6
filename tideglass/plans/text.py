"""Queries of scalar parsers and text gates.

Japanese texts are rendered from numbers of the tables and parsed back, as the tables hold none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.functions import forms, jp, web
from tideglass.session import table


def yen_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    price = F.round(F.col("o_totalprice")).cast("long")
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), price.alias("yen"))
    man, rest = F.floor(F.col("yen") / 10_000), F.col("yen") % 10_000
    text = F.when(F.col("id") % 4 == 0, F.concat(F.col("yen").cast("string"), F.lit("円"))).when(F.col("id") % 4 == 1, F.concat(man.cast("string"), F.lit("万"), F.format_number(rest, 0), F.lit("円")))
    text = text.when(F.col("id") % 4 == 2, F.concat(F.lit("価格 "), F.format_number(F.col("yen"), 0), F.lit("〜900円"))).otherwise(F.lit("応相談"))
    return rows.withColumn("text", text).select("id", "text", jp.parse_yen(F.col("text")).alias("p")).select("id", "text", F.col("p.value").alias("value"), F.col("p.note").alias("note"))


def area_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(k % 4 == 0, F.concat(size, F.lit(".5㎡"))).when(k % 4 == 1, F.concat(size, F.lit("坪"))).when(k % 4 == 2, F.concat(size, F.lit("LDK"))).otherwise(F.concat(size, F.lit("平米 と "), size, F.lit("平米")))
    rows = table(spark, folder, "part").select(k.alias("id"), text.alias("text"))
    return rows.select("id", "text", jp.parse_area(F.col("text")).alias("p")).select("id", "text", F.col("p.value").alias("value"), F.col("p.note").alias("note"))


def era_date_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    heisei = F.concat(F.lit("平成"), (F.year(d) - 1988).cast("string"), F.lit("年"), F.month(d).cast("string"), F.lit("月"), F.dayofmonth(d).cast("string"), F.lit("日"))
    text = F.when(k % 3 == 0, heisei).when(k % 3 == 1, F.date_format(d, "yyyy/M/d")).otherwise(F.lit("令和8年2月30日"))
    rows = table(spark, folder, "orders").select(k.alias("id"), text.alias("text"))
    return rows.select("id", jp.parse_date(F.col("text")).alias("p")).select("id", F.col("p.value").alias("day"), F.col("p.note").alias("note"))


def minutes_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    k, m = F.col("p_partkey"), (F.col("p_size") * 7 + 5).cast("int")
    hours = F.concat(F.floor(m / 60).cast("string"), F.lit("時間"), (m % 60).cast("string"), F.lit("分"))
    text = F.when(k % 4 == 0, F.concat(m.cast("string"), F.lit("分"))).when(k % 4 == 1, F.concat(F.lit("約"), hours)).when(k % 4 == 2, hours).otherwise(F.lit("半日ほど"))
    rows = table(spark, folder, "part").select(k.alias("id"), text.alias("text"))
    return rows.select("id", jp.parse_minutes(F.col("text")).alias("p")).select("id", F.col("p.value").alias("value"), F.col("p.note").alias("note"))


def year_parse(spark: SparkSession, folder: str) -> DataFrame:
    k, y = F.col("o_orderkey"), F.year("o_orderdate")
    text = F.when(k % 5 == 0, F.concat(F.lit("平成"), (y - 1988).cast("string"), F.lit("年"))).when(k % 5 == 1, F.concat(y.cast("string"), F.lit("年頃"))).when(k % 5 == 2, F.concat(F.lit("築"), (y % 50).cast("string"), F.lit("年"))).when(k % 5 == 3, F.concat(F.lit("H"), (y - 1988).cast("string"), F.lit("年"))).otherwise(F.lit("不詳"))
    rows = table(spark, folder, "orders").select(k.alias("id"), text.alias("text"))
    return rows.select("id", jp.parse_year(F.col("text")).alias("p")).select("id", F.col("p.value").alias("value"), F.col("p.note").alias("note"))


def yen_format(spark: SparkSession, folder: str) -> DataFrame:
    value = F.when(F.col("o_orderkey") % 10 != 0, F.round(F.col("o_totalprice") * 1000).cast("long"))
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), forms.format_yen(value).alias("text"))


def url_host(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", web.host_of(F.col("url")).alias("host"))


def url_pagination(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", web.split_page(F.col("url")).alias("p")).select("page_id", F.col("p.first").alias("first"), F.col("p.page").alias("page"))


def host_suffix(spark: SparkSession, folder: str) -> DataFrame:
    """Nations as sub-domains: which listed platform each lies under."""
    k = F.col("c_custkey")
    host = F.concat(F.when(k % 3 == 0, "").when(k % 3 == 1, "www.").otherwise("x"), F.element_at(F.array(*[F.lit(h) for h in web.PLATFORMS]), (k % len(web.PLATFORMS) + 1).cast("int")))
    return table(spark, folder, "customer").select(k.alias("id"), web.under_host(host, web.PLATFORMS).alias("platform"))


def content_hash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of the same text: its hash, how many documents and the first."""
    docs = table(spark, folder, "documents").select("doc_id", web.content_hash(F.col("text")).alias("hash"))
    return docs.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1")


def quote_verify(spark: SparkSession, folder: str) -> DataFrame:
    """Two parts of each document as a quote of it: joined by an ellipsis, as one, or not there at all."""
    t, i = F.col("text"), F.col("doc_id")
    head, tail = F.substring(t, 5, 30), F.substring(t, 60, 25)
    quote = F.when(i % 3 == 0, head).when(i % 3 == 1, F.concat(head, F.lit("..."), tail)).otherwise(F.concat(F.lit("zz"), head))
    return table(spark, folder, "documents").select("doc_id", web.quote_status(quote, t).alias("status"))


def quote_width(spark: SparkSession, folder: str) -> DataFrame:
    """Prices in wide digits as a page has them, quoted in narrow ones, with compatibility characters on either side: the number itself, the next one, a company's mark, and both joined."""
    k, price = F.col("o_orderkey"), F.round("o_totalprice").cast("long")
    wide = F.translate(price.cast("string"), "0123456789", "０１２３４５６７８９")
    source = F.concat(F.lit("価格は\u3000"), wide, F.lit(" 円です。㈱ﾃｽﾄＡ"))
    quote = F.when(k % 4 == 0, F.concat(F.lit("価格は "), price, F.lit("円"))).when(k % 4 == 1, F.concat(F.lit("価格は"), price + 1, F.lit("円"))).when(k % 4 == 2, F.lit("(株)テストA")).otherwise(F.concat(F.lit("価格は"), price, F.lit("円…(株)テストＡ")))
    rows = table(spark, folder, "orders").select(k.alias("id"), quote.alias("quote"), source.alias("source"))
    return rows.select("id", web.quote_status(F.col("quote"), F.col("source")).alias("status"))


def verbatim_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, item_id of documents and test items that share 30 characters in a row.

    A run of 30 characters of a document holds one of its blocks of 15 whole. So documents are cut into such blocks, items into all their runs of 15, and both meet by hash; the pairs
    that meet are looked at whole.
    """
    block = web.VERBATIM // 2
    docs = table(spark, folder, "documents").select("doc_id", F.col("text").alias("source"))
    items = table(spark, folder, "benchmark").select("item_id", F.col("text").alias("item"))
    blocks = F.transform(F.regexp_extract_all("source", F.lit(f"(?s).{{{block}}}"), F.lit(0)), lambda b: F.xxhash64(b))
    cut_docs = docs.select("doc_id", F.explode(F.array_distinct(blocks)).alias("h"))
    runs = items.select("item_id", F.explode(web.windows(F.col("item"), block)).alias("h"))
    met = cut_docs.join(runs, "h").select("doc_id", "item_id").distinct()
    return met.join(items, "item_id").join(docs, "doc_id").filter(web.verbatim(F.col("item"), F.col("source"))).select("doc_id", "item_id").distinct()


def pii_email(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "documents").select("doc_id", F.explode(web.emails(F.col("text"))).alias("email"))
    return found.filter(~web.is_government(F.col("email"))).groupBy("doc_id", "email").agg(F.count("*").alias("n"))


def license_verdict(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", web.licence(F.col("text")).alias("v")).select("doc_id", F.col("v.licence").alias("licence"), F.col("v.verdict").alias("verdict"))


def page_trust_checks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", F.array_join(web.page_faults(F.col("html")), ",").alias("faults"))


_ANY = lambda patterns, column: "(" + " OR ".join(f"regexp_matches({column}, '{p}')" for p in patterns) + ")"
_ALLOW = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for p, n in web.ALLOWED) + " END"
_HOSTS = ", ".join(f"('{h}', {i})" for i, h in enumerate(web.PLATFORMS))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "yen_roundtrip": yen_roundtrip,
    "area_roundtrip": area_roundtrip,
    "era_date_roundtrip": era_date_roundtrip,
    "minutes_roundtrip": minutes_roundtrip,
    "year_parse": year_parse,
    "yen_format": yen_format,
    "url_host": url_host,
    "url_pagination": url_pagination,
    "host_suffix_match": host_suffix,
    "content_hash_dedup": content_hash_dedup,
    "quote_verify": quote_verify,
    "quote_width": quote_width,
    "verbatim_overlap": verbatim_overlap,
    "pii_email": pii_email,
    "license_verdict": license_verdict,
    "page_trust_checks": page_trust_checks,
}
ORACLES = {
    "quote_width": """WITH o AS (SELECT o_orderkey AS id, CAST(round(o_totalprice) AS BIGINT) AS p FROM orders),
s AS (SELECT id, concat('価格は', p, '円です。(株)テストA') AS source, CASE id % 4 WHEN 0 THEN ['価格は' || p || '円'] WHEN 1 THEN ['価格は' || (p + 1) || '円'] WHEN 2 THEN ['(株)テストA'] ELSE ['価格は' || p || '円', '(株)テストA'] END AS q FROM o)
SELECT id, CASE WHEN len(list_filter(q, lambda x: NOT contains(source, x))) > 0 THEN 'missing' WHEN len(q) > 1 THEN 'joined' ELSE 'quote' END AS status FROM s""",
    "yen_roundtrip": """WITH r AS (SELECT o_orderkey AS id, CAST(round(o_totalprice) AS BIGINT) AS yen FROM orders)
SELECT id, CASE id % 4 WHEN 0 THEN yen || '円' WHEN 1 THEN (yen // 10000) || '万' || format('{:,}', yen % 10000) || '円' WHEN 2 THEN '価格 ' || format('{:,}', yen) || '〜900円' ELSE '応相談' END AS text,
CASE WHEN id % 4 < 2 THEN yen END AS value, CASE id % 4 WHEN 2 THEN 'range' WHEN 3 THEN 'negotiable' END AS note FROM r""",
    "area_roundtrip": """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_size || '.5㎡' WHEN 1 THEN p_size || '坪' WHEN 2 THEN p_size || 'LDK' ELSE p_size || '平米 と ' || p_size || '平米' END AS text,
CASE p_partkey % 4 WHEN 0 THEN p_size + 0.5e0 WHEN 1 THEN round(CAST(p_size AS DOUBLE) * 3.305785e0, 2) END AS value, CASE p_partkey % 4 WHEN 1 THEN 'from_tsubo' WHEN 2 THEN 'no_unit' WHEN 3 THEN 'multiple' END AS note FROM part""",
    "era_date_roundtrip": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS DATE) END AS day, CASE WHEN o_orderkey % 3 = 2 THEN 'invalid_date' END AS note FROM orders",
    "minutes_roundtrip": "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 < 3 THEN CAST(p_size * 7 + 5 AS INTEGER) END AS value, CASE p_partkey % 4 WHEN 1 THEN 'approx' WHEN 3 THEN 'vague' END AS note FROM part",
    "year_parse": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 IN (0, 1, 3) THEN CAST(year(o_orderdate) AS INTEGER) END AS value, CASE o_orderkey % 5 WHEN 1 THEN 'approx' WHEN 2 THEN 'relative_age' WHEN 4 THEN 'unknown' END AS note FROM orders",
    "yen_format": """WITH v AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 <> 0 THEN CAST(round(o_totalprice * 1000) AS BIGINT) END AS v FROM orders),
p AS (SELECT id, v, v // 100000000 AS oku, v % 100000000 AS below, v % 10000 AS tail FROM v),
r AS (SELECT *, CASE WHEN below % 1000 = 500 AND (below // 1000) % 2 = 0 THEN below // 1000 ELSE (below + 500) // 1000 END AS tenths FROM p)
SELECT id, CASE WHEN v IS NULL THEN '—' WHEN v < 10000 THEN format('{:,}', v) || '円'
ELSE CASE WHEN oku > 0 THEN format('{:,}', oku) || '億' ELSE '' END || CASE WHEN tail > 0 THEN format('{:,}', tenths // 10) || '.' || (tenths % 10) || '万' WHEN below > 0 THEN format('{:,}', below // 10000) || '万' ELSE '' END || '円' END AS text FROM r""",
    "url_host": "SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) AS host FROM pages",
    "url_pagination": r"""SELECT page_id, CASE WHEN regexp_matches(url, '^[^?#]*?/page/\d+/?($|[?#])') THEN regexp_replace(url, '^([^?#]*?)/page/\d+/?', '\1/')
WHEN regexp_matches(url, '(?i)[?&](page|paged|p|pg|pageno|page_no)=\d+(&|#|$)') THEN regexp_replace(regexp_replace(regexp_replace(url, '(?i)([?&])(page|paged|p|pg|pageno|page_no)=\d+', '\1'), '[?&]+$', ''), '([?&])&+', '\1') ELSE url END AS first,
coalesce(TRY_CAST(CASE WHEN regexp_matches(url, '^[^?#]*?/page/\d+/?($|[?#])') THEN regexp_extract(url, '/page/(\d+)', 1) ELSE regexp_extract(url, '(?i)[?&](page|paged|p|pg|pageno|page_no)=(\d+)(&|#|$)', 2) END AS INTEGER), 1) AS page FROM pages""",
    "host_suffix_match": f"""WITH h(platform, i) AS (VALUES {_HOSTS}), c AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'www.' ELSE 'x' END || h.platform AS host FROM customer JOIN h ON h.i = c_custkey % 10)
SELECT id, (SELECT arg_min(platform, i) FROM h WHERE c.host = platform OR ends_with(c.host, '.' || platform)) AS platform FROM c""",
    "content_hash_dedup": "SELECT 'sha256:' || sha256(text) AS hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1",
    "quote_verify": r"""WITH d AS (SELECT doc_id, regexp_replace(text, '[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', '', 'g') AS body, text[5:34] AS h, text[60:84] AS t FROM documents),
q AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN h WHEN 1 THEN h || '...' || t ELSE 'zz' || h END AS quote FROM d),
w AS (SELECT *, regexp_replace(quote, '\s+', '', 'g') AS whole, list_filter(list_transform(string_split_regex(quote, '…+|\.{3}|[\r\n]+'), lambda p: regexp_replace(p, '\s+', '', 'g')), lambda p: p <> '') AS parts FROM q)
SELECT doc_id, CASE WHEN whole <> '' AND contains(body, whole) THEN 'quote' WHEN len(parts) >= 2 AND len(list_filter(parts, lambda p: NOT (len(p) >= 4 AND contains(body, p)))) = 0 THEN 'joined' ELSE 'missing' END AS status FROM w""",
    "verbatim_overlap": """WITH w AS (SELECT DISTINCT item_id, text[i:i + 29] AS run FROM (SELECT item_id, text, unnest(range(1, greatest(len(text) - 28, 1))) AS i FROM benchmark)),
d AS (SELECT doc_id, text, unnest(range(1, greatest(len(text) - 28, 1))) AS i FROM documents)
SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, text[i:i + 29] AS run FROM d) x JOIN w USING (run)""",
    "pii_email": rf"""WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '{web.EMAIL}')) AS email FROM documents), m AS (SELECT *, lower(regexp_extract(email, '@(.*)$', 1)) AS dom FROM e)
SELECT doc_id, email, count(*) AS n FROM m WHERE NOT (ends_with(dom, '.lg.jp') OR ends_with(dom, '.go.jp') OR regexp_matches(dom, '(?:^|\.)(?:city|town|vill|village|pref|metro|city-office)\.[a-z0-9.\-]+\.jp$')) GROUP BY ALL""",
    "license_verdict": f"""WITH v AS (SELECT doc_id, {_ALLOW} AS a, {_ANY(web.DENIED, 'text')} AS d FROM documents)
SELECT doc_id, CASE WHEN NOT d THEN a END AS licence, CASE WHEN a IS NOT NULL AND NOT d THEN 'granted' WHEN a IS NOT NULL THEN 'mixed' WHEN d THEN 'denied' ELSE 'none' END AS verdict FROM v""",
    "page_trust_checks": r"""SELECT page_id, concat_ws(',', CASE WHEN NOT regexp_matches(html, '(?is)<title[^>]*>\s*[^<\s]') THEN 'title' END, CASE WHEN NOT regexp_matches(html, '(?i)<html[^>]*\slang=') THEN 'lang' END,
CASE WHEN NOT regexp_matches(html, '(?i)<link[^>]*rel=["'']?canonical') THEN 'canonical' END, CASE WHEN NOT regexp_matches(html, '(?i)<meta[^>]*property=["'']og:title') THEN 'og:title' END, CASE WHEN NOT regexp_matches(html, '(?i)application/ld\+json') THEN 'json_ld' END) AS faults FROM pages""",
}

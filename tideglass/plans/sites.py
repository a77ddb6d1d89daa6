"""Queries of pages, sites, robots rules, addresses, extraction and states.

Where the tables hold no such inputs, each row of a table stands for one of the cases below, by its key; the SQL has what each case means, written down by hand.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.functions import forms, html, jp, jsonld, listing, web
from tideglass.operators import extract, site
from tideglass.plans.schedules import _meanings, _pick, hours_text
from tideglass.session import table

#: address, what is kept, what is removed.
ADDRESSES = [("長野県栄村大字堺123-4", "長野県栄村大字堺", "123-4"), ("札幌市北1条西2丁目", "札幌市北1条西2丁目", None), ("札幌市北1条西2丁目3番地", "札幌市北1条西2丁目", "3番地"), ("高松市二番町", "高松市二番町", None), ("坂出市字西甲５番地", "坂出市字西", "甲5番地"), ("十二番地", "", "十二番地"), ("", "", None)]
_ROW = "<tr><td>A-{0}</td><td>栄村堺</td><td>{0}50万円</td><td>120㎡</td></tr>"
#: page, url, class, confidence in hundredths, rows of offers.
PAGES = [
    ("<body><main><table><tr><th>所在地</th><th>価格</th></tr>" + "".join(_ROW.format(i) for i in range(11, 19)) + "</table></main></body>", "https://v.jp/list/", "listing_index", "71", "8"),
    ("<body><main><dl><dt>価格</dt><dd>300万円</dd><dt>所在地</dt><dd>堺</dd><dt>土地面積</dt><dd>200㎡</dd><dt>築年</dt><dd>昭和45年</dd></dl></main></body>", "https://v.jp/1", "listing_detail", "74", "1"),
    ("<body><main><p>補助金の交付。補助対象経費の上限額は50万円、申請書と要綱はこちら。</p></main></body>", "https://v.jp/2", "not_listing", "69", "0"),
    ("<head><script></script><script></script></head><body><div id='app'></div><script>webpackJsonp</script></body>", "https://v.jp/3", "spa", "90", "0"),
    ("<body><main><p>村の暮らしの案内です。</p></main></body>", "https://v.jp/4", "not_listing", "65", "0"),
    ("<body><p>x</p></body>", "https://x.athome.co.jp/", "third_party", "99", "0"),
]
_LD = lambda x: f'<script type="application/ld+json">{json.dumps(x)}</script>'
#: page, declared hours, note.
DECLARED = [
    (_LD({"@type": "Museum", "openingHoursSpecification": {"dayOfWeek": ["Saturday", "PublicHolidays"], "opens": "10:00", "closes": "17:00"}}), "600-1020 d5 h+=", "jsonld_place"),
    (_LD({"@type": "Organization", "openingHours": "Mo-Fr 08:30-17:15"}), "510-1035 d01234 h=", "jsonld_organization"),
    (_LD({"@graph": [{"@type": "Organization", "openingHours": "Mo-Fr 08:30-17:15"}, {"@type": "Park", "openingHours": "Mo-Su 09:00-16:00"}]}), "540-960 d h=", "jsonld_place"),
    (_LD({"@type": "Place", "openingHoursSpecification": [{"opens": "9:00"}]}), None, "no_opening_hours"),
    ("<p>none</p>", None, "no_jsonld"),
]
_ROBOTS = "User-agent: *\nDisallow: /private\nAllow: /private/open\nDisallow: /*.pdf$\nCrawl-delay: 2\n\nUser-agent: tide\nDisallow: /"
#: status, file, path, verdict.
ROBOTS = [("200", _ROBOTS, "/x", "yes 2.0"), ("200", _ROBOTS, "/private/x", "no 2.0"), ("200", _ROBOTS, "/private/open", "yes 2.0"), ("200", _ROBOTS, "/a.pdf", "no 2.0"), ("200", _ROBOTS, "/a.pdf?x", "yes 2.0"), ("404", "", "/x", "yes -"), ("503", "", "/x", "no -"), ("200", "", "/x", "yes -")]
_SOURCE = "売ります。価格は 300万円、所在地は長野県栄村です。"
#: quotes of price and place, price, its status, place, its status.
QUOTES = [
    (("300万円", "長野県栄村"), "3000000", "parsed", "長野県栄村", "parsed"), (("400万円", "長野県"), None, "quote_not_in_source", "長野県", "parsed"), (("価格は", None), None, "unparsed", None, "not_found"),
    (("価格は300万円", "所在地は"), "3000000", "parsed", "所在地は", "parsed"), ((None, "栄町"), None, "not_found", None, "quote_not_in_source"),
]


def address_district(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), forms.strip_street_number(_pick([a for a, _, _ in ADDRESSES], F.col("c_custkey"))).alias("p"))
    return rows.select("id", F.col("p.kept").alias("kept"), F.col("p.removed").alias("removed"))


def page_class(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of the kinds above, for each customer."""
    k = F.col("c_custkey")
    rows = table(spark, folder, "customer").select(k.alias("id"), _pick([p[0] for p in PAGES], k).alias("html"), _pick([p[1] for p in PAGES], k).alias("url"))
    rows = rows.withColumn("s", html.page_signals()(F.col("html"), F.col("url")))
    rows = rows.select("id", listing.classify(F.col("s"), F.col("html"), F.col("url")).alias("c"), listing.listing_score(F.col("s"), F.col("url")).alias("n"))
    return rows.select("id", F.col("c.page_class").alias("page_class"), F.round(F.col("c.confidence") * 100).cast("int").cast("string").alias("confidence"), F.col("n.rows").cast("string").alias("offers"))


def page_signals(spark: SparkSession, folder: str) -> DataFrame:
    """What the pass over each stored page finds: its class, rows, prices and whether it goes on."""
    rows = table(spark, folder, "pages").select("page_id", "url", "html", html.page_signals()(F.col("html"), F.col("url")).alias("s"))
    rows = rows.select("page_id", listing.classify(F.col("s"), F.col("html"), F.col("url")).alias("c"), listing.listing_score(F.col("s"), F.col("url")).alias("n"), listing.pagination(F.col("s.anchors"), F.col("s.has_next"), F.col("url")).alias("p"), F.size("s.link_rows").alias("link_rows"))
    return rows.select("page_id", "c.page_class", "c.confidence", F.col("n.score").alias("score"), "p.is_paginated", "p.current_page", "link_rows")


def declared_hours(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), jsonld.opening_hours(_pick([d[0] for d in DECLARED], F.col("c_custkey"))).alias("h"))
    return rows.select("id", hours_text(F.col("h.value")).alias("value"), F.col("h.note").alias("note"))


def robots_verdict(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, folder, "orders").select(k.alias("id"), _pick([r[0] for r in ROBOTS], k).cast("int").alias("status"), _pick([r[1] for r in ROBOTS], k).alias("body"), _pick([r[2] for r in ROBOTS], k).alias("path"))
    told = rows.select("id", site.robots_verdict(site.robots_rules(F.col("body")), F.col("status"), F.col("path"), "glass").alias("v"))
    return told.select("id", F.concat(F.when(F.col("v.allowed"), "yes ").otherwise("no "), F.coalesce(F.col("v.crawl_delay").cast("string"), F.lit("-"))).alias("verdict"))


def extraction_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of a model, one for each customer, against one page."""
    k = F.col("c_custkey")
    answers = [json.dumps({"items": [{"price_quote": a, "place_quote": b}]}, ensure_ascii=False) for (a, b), *_ in QUOTES]
    pages = table(spark, folder, "customer").select(k.alias("id"), F.lit(_SOURCE).alias("text"), _pick(answers, k).alias("data"))
    spec = extract.Spec((extract.QuoteField("price_quote", "price", jp.parse_yen), extract.QuoteField("place_quote", "place")))
    items = extract.apply(spec, pages)
    return items.select("id", F.col("price.value").cast("string").alias("price"), F.col("price.status").alias("price_status"), F.col("place.value").alias("place"), F.col("place.status").alias("place_status"))


def crawl_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Events as fetches of each user's pages."""
    kind = F.col("event_type")
    fetches = table(spark, folder, "events").select(
        F.col("user_id").alias("source_id"), F.when(kind == "error", 500).when(kind == "signup", 304).otherwise(200).alias("status"), (kind == "purchase").alias("changed"), (kind == "signup").alias("not_modified"), F.when(kind == "error", "HTTP 500").alias("error"), (F.col("value") > 90).alias("stale"),
    )
    return site.crawl_counts(fetches)


def source_status(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as sources, their orders as records, and their orders' items as pages, of which returned ones wait."""
    sources = table(spark, folder, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_mktsegment").alias("policy"))
    orders = table(spark, folder, "orders")
    records = orders.select(F.col("o_custkey").alias("source_id"), F.when(F.col("o_orderstatus") == "F", "active").otherwise("stale").alias("status"))
    pages = table(spark, folder, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("source_id")), "l_orderkey")
    return site.source_status(sources, records, pages.select("source_id", (F.col("l_returnflag") == "R").alias("pending_extract")))


def _versions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The pages of every four numbers in their addresses, each language's first, and which of them each names: those whose address is no shorter than its own."""
    part = lambda pattern: F.regexp_extract("url", r"^[a-z]+://[^/]+" + pattern, 1)
    pages = table(spark, folder, "pages").select("page_id", part(r"(/[a-z]{2}/\d+)").alias("url_path"), part(r"/([a-z]{2})/\d+").alias("locale"), F.floor(part(r"/[a-z]{2}/(\d+)").try_cast("long") / 4).alias("number"), F.length("url").alias("size")).filter("url_path <> ''")
    firsts = pages.groupBy("number", "locale").agg(F.min("page_id").alias("page_id"))
    pages = pages.join(firsts, ["number", "locale", "page_id"])
    other = pages.select("number", F.col("page_id").alias("other"), F.col("locale").alias("l"), F.col("url_path").alias("u"), F.col("size").alias("z"))
    return pages, pages.join(other, "number").filter((F.col("z") >= F.col("size")) | (F.col("l") == F.col("locale")))


def hreflang_reciprocity(spark: SparkSession, folder: str) -> DataFrame:
    """Each page that names another as its version: whether that one names it back."""
    _, named = _versions(spark, folder)
    named = named.select("page_id", "other").filter("page_id <> other")
    back = named.select(F.col("page_id").alias("other"), F.col("other").alias("page_id"), F.lit(True).alias("back"))
    return named.join(back, ["page_id", "other"], "left").select("page_id", F.col("other").alias("alternate"), F.when(F.col("back"), "mutual").otherwise("one_way").alias("state"))


def page_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of the pages' versions in other languages."""
    pages, named = _versions(spark, folder)
    alternates = named.groupBy("page_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("l", "u")))).alias("alternates"))
    rows = pages.join(alternates, "page_id").withColumn("noindex", F.lit(False)).withColumn("path", F.col("page_id").cast("string"))
    return site.alternate_faults(rows, ["de", "en", "es", "fr"], "en")


def markup_faults(spark: SparkSession, folder: str) -> DataFrame:
    faults = site.markup_faults(F.col("html"), F.lit(False), F.lit(True))
    return table(spark, folder, "pages").select("page_id", F.array_join(faults, ",").alias("faults"))


def number_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Areas, counts, days and ids in their shown forms."""
    k = F.col("p_partkey")
    return table(spark, folder, "part").select(k.alias("id"), forms.format_m2(F.when(k % 7 != 0, F.col("p_size") * 37 + F.when(k % 2 == 0, 0.5).otherwise(0.0))).alias("area"), forms.format_number(k * 12345).alias("n"), forms.suggest_id(F.concat_ws(" ", F.lit("買取"), "p_name", "p_brand")).alias("slug"))


def host_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The other forms of each page's site, and its origin."""
    return table(spark, folder, "pages").select("page_id", forms.origin_of(F.col("url")).alias("origin"), F.array_join(forms.host_variants(F.col("url")), " ").alias("variants"), F.size(web.windows(F.col("url"), 10)).alias("windows"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "address_district": address_district, "page_class": page_class, "page_signals": page_signals, "declared_hours": declared_hours, "robots_verdict": robots_verdict, "extraction_fields": extraction_fields, "crawl_counts": crawl_counts, "source_status": source_status,
    "page_versions": page_versions, "hreflang_reciprocity": hreflang_reciprocity, "markup_faults": markup_faults, "number_forms": number_forms, "host_forms": host_forms,
}
ORACLES = {
    "address_district": _meanings("customer", "c_custkey", ADDRESSES, ["kept", "removed"]),
    "page_class": _meanings("customer", "c_custkey", [p[1:] for p in PAGES], ["page_class", "confidence", "offers"]),
    "declared_hours": _meanings("customer", "c_custkey", DECLARED, ["value", "note"]),
    "robots_verdict": _meanings("orders", "o_orderkey", [("", r[3]) for r in ROBOTS], ["verdict"]),
    "extraction_fields": _meanings("customer", "c_custkey", QUOTES, ["price", "price_status", "place", "place_status"]),
    "crawl_counts": """SELECT user_id AS source_id, count(*) FILTER (event_type NOT IN ('error', 'signup')) AS fetched, count(*) FILTER (event_type = 'purchase') AS changed, count(*) FILTER (event_type NOT IN ('error', 'purchase')) AS unchanged,
count(*) FILTER (event_type = 'signup') AS not_modified, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (value > 90) AS stale_cache FROM events GROUP BY user_id""",
    "source_status": """WITH r AS (SELECT o_custkey AS s, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS a FROM orders GROUP BY 1), p AS (SELECT o_custkey AS s, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT c_custkey AS source_id, c_mktsegment AS policy, coalesce(r.n, 0) AS records, coalesce(r.a, 0) AS active, coalesce(p.n, 0) AS urls, coalesce(p.w, 0) AS pending FROM customer LEFT JOIN r ON r.s = c_custkey LEFT JOIN p ON p.s = c_custkey""",
    "page_versions": r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[a-z]{2}/\d+)', 1) AS u, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]{2})/\d+', 1) AS l, TRY_CAST(regexp_extract(url, '^[a-z]+://[^/]+/[a-z]{2}/(\d+)', 1) AS BIGINT) // 4 AS n, length(url) AS z FROM pages),
f AS (SELECT * FROM p WHERE u <> '' QUALIFY row_number() OVER (PARTITION BY n, l ORDER BY page_id) = 1),
e AS (SELECT a.page_id, a.l, a.u, b.page_id AS other, b.l AS ol, b.u AS ou FROM f a JOIN f b ON a.n = b.n AND (b.z >= a.z OR b.l = a.l)),
names AS (SELECT page_id, string_agg(ol || ou, ',' ORDER BY ol) AS names FROM e GROUP BY 1)
SELECT CAST(e.page_id AS VARCHAR) AS path, CASE WHEN NOT list_contains(['de', 'en', 'es', 'fr'], e.ol) THEN 'unknown_alternate' ELSE 'one_way' END AS fault, e.ol AS code FROM e JOIN names m ON m.page_id = e.page_id JOIN names o ON o.page_id = e.other
WHERE list_contains(['de', 'en', 'es', 'fr'], e.l) AND (NOT list_contains(['de', 'en', 'es', 'fr'], e.ol) OR m.names <> o.names) UNION ALL SELECT CAST(page_id AS VARCHAR), 'unknown_locale', l FROM f WHERE NOT list_contains(['de', 'en', 'es', 'fr'], l)""",
    "hreflang_reciprocity": r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[a-z]{2}/\d+)', 1) AS u, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]{2})/\d+', 1) AS l, TRY_CAST(regexp_extract(url, '^[a-z]+://[^/]+/[a-z]{2}/(\d+)', 1) AS BIGINT) // 4 AS n, length(url) AS z FROM pages),
f AS (SELECT * FROM p WHERE u <> '' QUALIFY row_number() OVER (PARTITION BY n, l ORDER BY page_id) = 1),
e AS (SELECT a.page_id AS a, b.page_id AS b FROM f a JOIN f b ON a.n = b.n AND a.page_id <> b.page_id AND b.z >= a.z)
SELECT e.a AS page_id, e.b AS alternate, CASE WHEN x.a IS NULL THEN 'one_way' ELSE 'mutual' END AS state FROM e LEFT JOIN e x ON x.a = e.b AND x.b = e.a""",
    "markup_faults": r"""SELECT page_id, concat_ws(',', CASE WHEN NOT regexp_matches(html, '(?i)<link[^>]+rel=["'']canonical["'']') THEN 'canonical' END, CASE WHEN NOT contains(html, 'property="og:title"') AND NOT contains(html, 'property=''og:title''') THEN 'og:title' END,
CASE WHEN NOT contains(html, 'property="og:type"') AND NOT contains(html, 'property=''og:type''') THEN 'og:type' END, CASE WHEN NOT contains(html, 'property="og:url"') AND NOT contains(html, 'property=''og:url''') THEN 'og:url' END,
CASE WHEN NOT regexp_matches(html, '(?i)<link[^>]+hreflang=["'']') THEN 'hreflang' END, CASE WHEN NOT regexp_matches(html, '(?i)application/ld\+json') THEN 'json_ld' END) AS faults FROM pages""",
    "number_forms": r"""SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN '—' ELSE format('{:,}', p_size * 37) || CASE WHEN p_partkey % 2 = 0 THEN '.5' ELSE '' END || '㎡' END AS area, format('{:,}', p_partkey * 12345) AS n,
regexp_replace(lower(array_to_string(regexp_extract_all(p_name || ' ' || p_brand, '[0-9A-Za-z]+'), '-'))[1:40], '^-+|-+$', '', 'g') AS slug FROM part""",
    "host_forms": r"""WITH h AS (SELECT page_id, url, regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) AS origin, regexp_extract(url, '^(?:[^/]*//)?([^/]*)', 1) AS host FROM pages), o AS (SELECT *, CASE WHEN starts_with(host, 'www.') THEN host[5:] ELSE 'www.' || host END AS other FROM h)
SELECT page_id, origin, 'http://' || host || '/ https://' || other || '/ http://' || other || '/' AS variants, CAST(len(list_distinct(list_transform(range(1, greatest(length(url) - 8, 1)), lambda i: url[i:i + 9]))) AS INTEGER) AS windows FROM o""",
}

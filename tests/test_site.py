"""Robots rules, the frontier, discovery, gates, extraction, stores and the other operators on tables, on hand-made rows."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tideglass.functions import jp, locales, schedule, web
from tideglass.operators import extract, reports, site
from tideglass.sources import tables
from tideglass.sources.versions import VersionedTable

ROBOTS = """# rules
User-agent: *
Disallow: /private
Allow: /private/open
Crawl-delay: 2.5
Disallow: /*.pdf$

User-agent: tide
User-agent: other
Disallow: /
Allow: /only
Sitemap: https://a.jp/sitemap.xml
"""


def test_robots(spark):
    cases = [
        (200, ROBOTS, "/x", "some", True, 2.5), (200, ROBOTS, "/private/x", "some", False, 2.5), (200, ROBOTS, "/private/open/x", "some", True, 2.5), (200, ROBOTS, "/a/b.pdf", "some", False, 2.5), (200, ROBOTS, "/a/b.pdf?x", "some", True, 2.5),
        (200, ROBOTS, "/x", "tideglass", False, None), (200, ROBOTS, "/only/x", "tideglass", True, None), (200, "", "/x", "some", True, None), (404, None, "/x", "some", True, None), (503, None, "/x", "some", False, None), (None, None, "/x", "some", False, None),
    ]
    for token in ("some", "tideglass"):
        mine = [c for c in cases if c[3] == token]
        df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(mine)], "i int, status int, body string, path string")
        got = df.select("i", site.robots_verdict(site.robots_rules(F.col("body")), F.col("status"), F.col("path"), token).alias("v")).orderBy("i").collect()
        assert [tuple(r.v) for r in got] == [c[4:] for c in mine]
    assert spark.createDataFrame([(ROBOTS,)], "b string").select(site.robots_sitemaps(F.col("b"))).first()[0] == ["https://a.jp/sitemap.xml"]


def test_frontier(spark):
    seeds = spark.createDataFrame([("s", "http://a.jp/", "top", 0), ("s", "http://a.jp/news", "news", 1), ("t", "http://b.jp/", "top", 0)], "source_id string, url string, kind string, place int")
    links = spark.createDataFrame([("http://a.jp/", i, u) for i, u in enumerate(["http://a.jp/item/2", "http://a.jp/item/1", "http://x.jp/item/9", "http://a.jp/item/3", "http://a.jp/", "http://a.jp/item/2"])] + [("http://a.jp/item/2", 0, "http://a.jp/item/77")], "url string, place int, target string")
    follows = spark.createDataFrame([("s", "http://a.jp/", r"/item/\d+", "item", 4, 0)], "source_id string, seed_url string, pattern string, kind string, max_links int, rule int")
    limits = spark.createDataFrame([("s", 4, ["a.jp"]), ("t", 0, ["b.jp"])], "source_id string, limit int, hosts array<string>")
    got = site.frontier(seeds, links, follows, limits).orderBy("source_id", "place").collect()
    assert [(r.source_id, r.url, r.kind, r.place) for r in got] == [("s", "http://a.jp/", "top", 1), ("s", "http://a.jp/news", "news", 2), ("s", "http://a.jp/item/2", "item", 3), ("s", "http://a.jp/item/1", "item", 4)]


def test_discovery(spark):
    sitemaps = spark.createDataFrame([("http://a.jp/s.xml", "<loc>http://a.jp/sitemap-2.xml</loc><loc>http://a.jp/akiya/1</loc><loc>http://a.jp/other</loc>"), ("http://a.jp/sitemap-2.xml", "<loc> http://a.jp/AKIYA/2 </loc><loc>http://a.jp/sitemap-3.xml</loc>"), ("http://a.jp/sitemap-3.xml", "<loc>http://a.jp/akiya/3</loc>")], "url string, body string")
    roots = spark.createDataFrame([("s", "http://a.jp/s.xml")], "source_id string, root string")
    hits = site.sitemap_hits(sitemaps, roots, "akiya")
    assert sorted(r.url for r in hits.collect()) == ["http://a.jp/AKIYA/2", "http://a.jp/akiya/1"]
    assert sorted(r.url for r in tables.sitemap_urls(sitemaps).collect())[0] == "http://a.jp/AKIYA/2"
    sources = spark.createDataFrame([("s", "http://a.jp/")], "source_id string, official_url string")
    links = spark.createDataFrame([("s", "http://a.jp/", 0, "http://a.jp/akiya/1", "list"), ("s", "http://a.jp/", 1, "http://b.jp/x", "akiya bank"), ("s", "http://a.jp/", 2, "http://a.jp/akiya/1", "akiya"), ("s", "http://a.jp/", 3, "http://a.jp/no", "no")], "source_id string, found_on string, at int, url string, text string")
    got = site.discover(sources, links, hits, "akiya").collect()
    assert [(r.url, r.score, r.text) for r in got] == [("http://a.jp/akiya/1", 4, "akiya"), ("http://a.jp/AKIYA/2", 2, ""), ("http://b.jp/x", 2, "akiya bank")]


def test_crawl_counts(spark):
    rows = [("s", 200, True, False, None, False), ("s", 200, False, False, None, True), ("s", 304, False, True, None, False), ("s", 500, False, False, "HTTP 500", False)]
    df = spark.createDataFrame(rows, "source_id string, status int, changed boolean, not_modified boolean, error string, stale boolean")
    assert tuple(site.crawl_counts(df).first()) == ("s", 2, 1, 2, 1, 1, 1)


def test_gates(spark):
    images = spark.createDataFrame([("a", "1.png", "k"), ("a", "2.png", ""), ("b", "3.png", "zz"), ("b", "4.png", None)], "path string, src string, asset string")
    assets = site.registered_assets(spark.createDataFrame([("k", True), ("zz", False)], "asset_id string, usable boolean"))
    assert sorted((r.src, r.fault) for r in site.image_faults(images, assets).collect()) == [("2.png", "unmarked"), ("3.png", "unregistered"), ("4.png", "unmarked")]
    good = '<link rel="canonical" href="x"><meta property="og:title"><meta property=\'og:type\'><meta property="og:url"><script type="application/ld+json">{"a": 1}</script>'
    df = spark.createDataFrame([(0, good, False, False), (1, good.replace('{"a": 1}', "{a"), False, True), (2, "", False, False), (3, "", True, True)], "i int, html string, noindex boolean, lang boolean")
    got = df.select("i", site.markup_faults(F.col("html"), F.col("noindex"), F.col("lang")).alias("f")).orderBy("i").collect()
    assert [r.f for r in got] == [[], ["hreflang", "broken_json_ld"], ["canonical", "og:title", "og:type", "og:url", "json_ld"], ["hreflang"]]
    files = spark.createDataFrame([("robots.txt", "User-agent: *"), ("404.html", ""), ("about/index.html", "運営者"), ("x.html", site.BEACON)], "path string, text string")
    want = [("missing", "sitemap.xml"), ("no_disclaimer", "about/index.html"), ("no_sitemap_line", "robots.txt")]
    assert sorted(tuple(r) for r in site.site_faults(files, True).collect()) == want
    assert sorted(tuple(r) for r in site.site_faults(files, False).collect()) == sorted([*want, ("stray_beacon", "x.html")])
    assert ("no_beacon", "") in [tuple(r) for r in site.site_faults(files.filter("path <> 'x.html'"), True).collect()]


def test_alternates(spark):
    schema = "path string, url_path string, locale string, alternates map<string,string>, noindex boolean"
    both = {"ja": "/a/", "en": "/en/a/"}
    rows = [
        ("a", "/a/", None, both, False), ("en/a", "/en/a/", "en", both, False), ("b", "/b/", "ja", {"ja": "/b/", "en": "/en/b/"}, False), ("c", "/c/", "ja", {}, False), ("d", "/d/", "ja", None, True), ("e", "/e/", "fr", both, False),
        ("f", "/f/", "ja", {"ja": "/x/", "ko": "/f/"}, False), ("g", "/g/", "ja", {"ja": "/g/", "en": "/en/a/"}, False),
    ]
    got = sorted(tuple(r) for r in site.alternate_faults(spark.createDataFrame(rows, schema), ["ja", "en"], "ja").collect())
    assert got == [("b", "missing", "en"), ("c", "no_alternates", "ja"), ("e", "unknown_locale", "fr"), ("f", "missing", "ja"), ("f", "not_itself", "ja"), ("f", "unknown_alternate", "ko"), ("g", "one_way", "en")]
    languages = spark.createDataFrame([("ja", "ja", 0), ("en", "en-GB", 1)], "code string, lang string, place int")
    links = site.hreflang_links(spark.createDataFrame(rows[:1], schema), languages, "ja", "https://s.jp")
    assert [tuple(r) for r in links.collect()] == [("a", "ja", "https://s.jp/a/"), ("a", "en-GB", "https://s.jp/en/a/"), ("a", "x-default", "https://s.jp/a/")]
    pages = spark.createDataFrame([("a", "/a/", date(2026, 9, 1), "weekly", 0.5, False), ("z", "/z/", date(2026, 9, 2), "daily", 1.0, True)], "path string, url_path string, lastmod date, changefreq string, priority double, noindex boolean")
    row = site.sitemap_rows(pages, links, "https://s.jp").collect()
    assert len(row) == 1 and row[0].row.startswith("  <url><loc>https://s.jp/a/</loc><lastmod>2026-09-01</lastmod><changefreq>weekly</changefreq><priority>0.5</priority>") and row[0].row.count("xhtml:link") == 3


def test_assets_and_words(spark):
    rows = [(True, "u", True, "image/PNG; x", b"x" * 2000), (False, "u", True, "image/png", b""), (True, "u/private/1", True, "image/png", b""), (True, "u", False, None, None), (True, "u", True, "text/html", b""), (True, "u", True, "image/png", b"x"), (True, "u", True, "image/webp", b"x" * 5_000_001)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, allowed boolean, url string, ok boolean, kind string, content binary")
    got = df.select("i", site.asset_verdict(F.col("allowed"), F.col("url"), F.col("ok"), F.col("kind"), F.col("content"), ["/private/"]).alias("v")).orderBy("i").collect()
    assert [r.v.reason for r in got] == [None, "licence", "excluded", "fetch", "type", "small", "large"] and len(got[0].v.asset_id) == 16
    catalog = spark.createDataFrame([("ja", "k", "はい"), ("en", "k", "yes"), ("ja", "only", "のみ")], "locale string, key string, text string")
    keys = spark.createDataFrame([("en", "k"), ("en", "only"), ("en", "none")], "locale string, key string")
    assert sorted((r.key, r.text, r.missed) for r in site.translations(keys, catalog, "ja").collect()) == [("k", "yes", False), ("none", None, False), ("only", "のみ", True)]
    same = lambda c, f: spark.createDataFrame([(v,) for v in c], "v string").select(f(F.col("v"))).collect()
    assert [r[0] for r in same(["ja", "zh-Hant", "en-GB", "xx"], locales.og_locale)] == ["ja_JP", "zh_TW", "en_GB", "xx"]
    assert [r[0] for r in same(["", "en"], lambda v: locales.dist_path(v, F.lit("/a\\b.html")))] == ["a/b.html", "en/a/b.html"]
    assert [r[0] for r in same(["", "en"], lambda v: locales.localised_path(v, F.lit("a/")))] == ["/a/", "/en/a/"]


def test_states(spark):
    states = spark.createDataFrame([("s", "u2", True, "h"), ("s", "u1", True, "h"), ("s", "u3", False, "h"), ("t", "u4", True, None)], "source_id string, url string, pending_extract boolean, content_hash string")
    assert [r.url for r in site.queue(states, 1).collect()] == ["u1"] and site.queue(states, 9).count() == 2
    assert site.forget(states, spark.createDataFrame([("u1",), ("u1",)], "url string")).count() == 1
    sources = spark.createDataFrame([("s", "crawl"), ("z", "link_only")], "source_id string, policy string")
    records = spark.createDataFrame([("s", "active"), ("s", "stale")], "source_id string, status string")
    assert sorted(tuple(r) for r in site.source_status(sources, records, states).collect()) == [("s", "crawl", 2, 1, 3, 2), ("z", "link_only", 0, 0, 0, 0)]
    cache = spark.createDataFrame([("k", "old", 1), ("k", "new", 2)], "key string, response string, at int")
    assert sorted((r.key, r.response, r.hit) for r in site.cached(spark.createDataFrame([("k",), ("m",)], "key string"), cache).collect()) == [("k", "new", True), ("m", None, False)]
    kind = "struct<price:int,note:string,at:string>"
    both = spark.createDataFrame([(1, (5, "old words", "d1"), (5, "new words", "d2")), (2, (5, "old", "d1"), (6, "new", "d2")), (3, None, (1, "first", "d2"))], f"key int, old {kind}, new {kind}")
    assert [tuple(r) for r in site.freeze_wording(both, ["note"], ["at"], ["price", "note", "at"]).orderBy("key").collect()] == [(1, 5, "old words", "d2", True), (2, 6, "new", "d2", False), (3, 1, "first", "d2", False)]
    log = spark.createDataFrame([("2026-09-10", "a", "ok"), ("2026-09-12", "a", "fail"), ("2026-09-12", "b", "reselect")], "at string, key string, result string")
    assert tuple(site.recheck_summary(log, F.lit("2026-09-11")).first()) == (0, 1, 0, 0, 1)
    st = spark.createDataFrame([("a", 2, "d1", "gone", None, None), ("b", 0, None, None, "d2", "timeout"), ("c", 1, "d1", "x", None, None)], "key string, failures long, failed_since string, reason string, waiting_since string, waiting_reason string")
    assert [tuple(r) for r in site.recheck_open(st, spark.createDataFrame([("a", "A"), ("b", "B")], "key string, label string")).collect()] == [("a", "A", "failing", "d1", 2, "gone"), ("b", "B", "waiting", "d2", None, "timeout")]
    reports = spark.createDataFrame([((1, 0, 10, 5), {"crawl": {"fetched": 2}}), ((2, 1, 20, 5), {"crawl": {"fetched": 3, "errors": 1}})], "llm struct<calls:long,cached_calls:long,input_tokens:long,output_tokens:long>, stages map<string,map<string,long>>")
    assert tuple(site.usage_total(reports).first()) == (3, 1, 30, 10)
    assert sorted(tuple(r) for r in site.bump(reports).collect()) == [("crawl", "errors", 1), ("crawl", "fetched", 5)]


def test_extraction(spark):
    fields = extract.QuoteField("price_quote", "price", jp.parse_yen), extract.QuoteField("place_quote", "place"), extract.QuoteField("none", "other"), extract.QuoteField("hours_quote", "hours", schedule.parse_opening_hours)
    spec = extract.Spec(fields, hours="hours")
    text = "売ります。価格は 300万円、所在地は長野県栄村です。広い庭と大きな木のある静かな村の一軒家で、駅から歩いて十五分の所にあります。"
    answer = {"items": [
        {"price_quote": "300万円", "place_quote": "長野県栄村", "title": " 家 ", "summary": "静かな家"}, {"price_quote": "400万円", "place_quote": "  ", "summary": "広い庭と大きな木のある静かな村の一軒家で、駅から歩いて十五分の所"},
        {"price_quote": "価格は", "summary": "x" * 200}, "no object", None,
    ]}
    html = '<script type="application/ld+json">{"@type": "Place", "openingHours": "Mo-Su 09:00-17:00"}</script>'
    pages = spark.createDataFrame([("p", text, json.dumps(answer), html), ("q", text, "{broken", html), ("r", text, '{"items": 3}', html), ("s", None, None, None)], "page string, text string, data string, html string")
    got = extract.apply(spec, pages, html="html").orderBy("page", "item").collect()
    assert [(r.page, r.item) for r in got] == [("p", 0), ("p", 1), ("p", 2)]
    assert [tuple(r.price) for r in got] == [(3_000_000, "300万円", "parsed", None), (None, "400万円", "quote_not_in_source", "quote_not_in_source"), (None, "価格は", "unparsed", "no_number")]
    assert [(r.place.value, r.place.status) for r in got] == [("長野県栄村", "parsed"), (None, "not_found"), (None, "not_found")] and got[0].title == "家"
    assert [(r.summary, r.flags) for r in got] == [("静かな家", ["hours_from_jsonld"]), (None, ["summary_verbatim_overlap"]), ("x" * 120, ["summary_truncated"])]
    assert got[0].hours.note == "jsonld_place" and got[0].hours.value[0].ranges[0].start == 540 and got[1].hours.status == "not_found"
    counts = {(r.target, r.status): r.n for r in extract.metrics(spec, extract.apply(spec, pages, html="html")).collect()}
    assert counts["price", "parsed"] == 1 and counts["other", "not_found"] == 3


def test_licence_of_a_page(spark):
    rows = [("<a href='https://creativecommons.org/licenses/by/3.0/'>x</a> <b>here</b>", "x here"), ("", "クリエイティブ・コモンズ 表示-継承 4.0"), ("無断転載", "CC BY 4.0"), ("<p>All Rights Reserved</p>", ""), ("", None), (None, "PD-old"), ("", "CC BY 4.0.1 and CC0-ish")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, html string, text string")
    got = [r.v for r in df.select("i", web.licence_of_page(F.col("html"), F.col("text")).alias("v")).orderBy("i").collect()]
    assert [(v.licence, v.verdict) for v in got] == [("CC-BY-3.0", "granted"), ("CC-BY-SA-4.0", "granted"), (None, "mixed"), (None, "denied"), (None, "none"), ("public-domain", "granted"), (None, "none")]
    assert "creativecommons.org/licenses/by/3.0" in got[0].evidence


def test_verbatim(spark):
    source = "abcdefghijklmnopqrstuvwxyz0123456789" * 3
    cases = [(source[3:33], True), (source[3:32], False), ("x" * 40, False), ("zz" + source[10:40] + "zz", True), ("", False), (None, False)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = df.select("i", web.verbatim(F.coalesce("t", F.lit("")), F.lit(source)).alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == [v for _, v in cases]


def test_files(spark, tmp_path):
    p = lambda name: str(tmp_path / name)
    assert tables.read_json(spark, p("none.json"), {"d": 1}) == {"d": 1}
    tables.write_json(spark, p("a.json"), {"b": {3, 1}, "a": date(2026, 9, 1), "ü": None})
    tables.write_json(spark, p("a.json"), {"b": {3, 1}, "a": date(2026, 9, 1), "ü": None})
    assert tables.read_json(spark, p("a.json")) == {"a": "2026-09-01", "b": [1, 3], "ü": None}
    df = spark.createDataFrame([(2, None, ((1, None),)), (1, "x", None)], "z int, a string, m struct<q:struct<y:int,b:string>>")
    assert tables.write_jsonl(df.repartition(2), p("rows")) == 2
    lines = sorted(r.value for r in spark.read.text(p("rows")).collect())
    assert lines == ['{"a":"x","m":null,"z":1}', '{"a":null,"m":{"q":{"b":null,"y":1}},"z":2}']
    assert tables.read_jsonl(spark, p("rows"), "z int, a string").count() == 2 and tables.read_jsonl(spark, p("nowhere"), "z int").count() == 0
    (tmp_path / "records").mkdir()
    (tmp_path / "records" / "a.jsonl").write_text('{"record_id": "b"}\n\n{"x": 1}\n{"record_id": "a"}\n{broken\n')
    assert [r.record_id for r in tables.read_records(spark, p("records"), "record_id string").collect()] == ["a", "b"]
    (tmp_path / "assets").mkdir()
    (tmp_path / "assets" / "a.jsonl").write_text('{"asset_id": "k"}\n{broken\n{"asset_id": "k"}\n')
    good, bad = tables.read_assets(spark, p("assets"), "asset_id string")
    assert good.count() == 1 and bad.count() == 1
    tables.append_log(df, p("log"))
    tables.append_log(df, p("log"))
    assert spark.read.text(p("log")).count() == 4
    assert tables.snapshot(spark.createDataFrame([(1.23456,)], "v double"), p("snap")) == 1 and spark.read.text(p("snap")).first().value == '{"v":1.2346}'
    for case, files in {"one": ("page.html", "expected.json"), "two": ("page.html",)}.items():
        (tmp_path / "cases" / case).mkdir(parents=True)
        for f in files:
            (tmp_path / "cases" / case / f).write_text("{}")
    assert [(r.case, r.expected) for r in tables.read_eval_cases(spark, p("cases")).collect()] == [("one", "{}")] and tables.read_eval_cases(spark, p("nothing")).count() == 0
    reports = spark.createDataFrame([("s", datetime(2026, 9, 1), 1), ("s", datetime(2026, 9, 2), 2), ("t", datetime(2026, 9, 3), 3)], "service string, started_at timestamp, v int")
    tables.append_report(reports, p("reports"))
    assert tables.latest_report(spark, p("reports"), "s").first().v == 2 and tables.latest_report(spark, p("reports"), "none").count() == 0


def test_holiday_list(spark, tmp_path):
    path = tmp_path / "h.csv"
    path.write_bytes("国民の祝日・休日月日,国民の祝日・休日名称\r\n2026/1/1,元日\r\n2026/1/12,成人の日\r\nx,y\r\n2026/2/31,no\r\n".encode("cp932"))
    assert sorted((str(r.day), r.name) for r in tables.read_holidays(spark, str(path)).collect()) == [("2026-01-01", "元日"), ("2026-01-12", "成人の日")]
    path.write_bytes(b"a,b\r\n")
    with pytest.raises(ValueError, match="no holidays"):
        tables.read_holidays(spark, str(path))


def test_facts_are_replaced_by_day(spark, tmp_path):
    path = str(tmp_path / "facts")
    of = lambda *rows: spark.createDataFrame([(date.fromisoformat(d), p, n) for d, p, n in rows], "day date, page string, clicks long")
    tables.write_facts(of(("2026-01-05", "a", 1), ("2026-02-05", "a", 2), ("2026-02-06", "b", 3)), path, "page")
    tables.write_facts(of(("2026-03-01", "q", 9)), path, "query")
    tables.write_facts(of(("2026-02-06", "b", 4), ("2026-02-07", "c", 5)), path, "page", ["2026-01-05", "2026-02-06"])
    got = sorted((str(r.day), r.page, r.clicks) for r in tables.read_facts(spark, path, "page").collect())
    assert got == [("2026-02-05", "a", 2), ("2026-02-06", "b", 4), ("2026-02-07", "c", 5)]
    assert tables.read_facts(spark, path, "query").count() == 1 and tables.read_facts(spark, path, "page", "2026-02-06").count() == 2


def test_raw_pages(spark, tmp_path):
    text = "空き家の一覧です。価格は三百万円。"
    rows = [("s", "1", text.encode("cp932"), None, None, "h1"), ("s", "2", b"<meta charset='euc-jp'>" + text.encode("euc_jp"), None, None, "h2"), ("s", "3", text.encode("utf-8-sig"), None, None, None), ("s", "4", text.encode("euc_jp"), "text/html; charset=EUC-JP", None, "h4"), ("s", "5", text.encode("cp932"), "text/html; charset=iso-8859-1", "cp932", "h5"), ("s", "6", b"\xff\x81", None, "klingon", "h6")]
    df = spark.createDataFrame([(*r, datetime(2026, 9, 1)) for r in rows], "source_id string, url string, content binary, content_type string, encoding string, content_hash string, fetched_at timestamp")
    df.write.parquet(str(tmp_path / "raw"))
    raw = tables.read_raw(spark, str(tmp_path / "raw"))
    got = {r.url: r.text for r in raw.collect()}
    assert all(got[i].endswith(text) for i in "12345") and "�" in got["6"]
    states = spark.createDataFrame([("s", "1", "h1"), ("s", "2", "other"), ("s", "3", None), ("s", "9", "h9")], "source_id string, url string, content_hash string")
    assert sorted((r.url, r.current) for r in tables.matches_state(states, raw).collect()) == [("1", True), ("2", False), ("3", False), ("9", False)]
    store = str(tmp_path / "counts")
    tables.upsert_by_key(spark.createDataFrame([("d1", 1), ("d2", 2)], "day string, n int"), store, ["day"])
    tables.upsert_by_key(spark.createDataFrame([("d2", 5), ("d3", 3)], "day string, n int"), store, ["day"])
    assert sorted((r.day, r.n) for r in VersionedTable(spark, store).read().collect()) == [("d1", 1), ("d2", 5), ("d3", 3)]


def test_deployment_and_maps(spark):
    files = spark.createDataFrame([("a.html", 10, ""), ("big.bin", 26 * 1024 * 1024, None), ("_redirects", 5, "/a /b 301\n# note\nx /y\n/only\n\n")], "path string, size long, text string")
    assert sorted(tuple(r) for r in site.dist_faults(files).collect()) == [("large", "big.bin"), ("no_index", "index.html"), ("redirect", "/only"), ("redirect", "x /y")]
    got = spark.createDataFrame([("栄村 役場", "k"), ("x", None)], "q string, k string").select(site.map_links(F.col("q"), F.col("k")).alias("m"), site.street_links(F.lit(36.9), F.lit(138.5), F.col("k")).alias("s")).collect()
    assert got[0].m.link == "https://www.google.com/maps/search/?api=1&query=%E6%A0%84%E6%9D%91+%E5%BD%B9%E5%A0%B4" and "q=%E6%A0%84%E6%9D%91%20%E5%BD%B9%E5%A0%B4&language=ja" in got[0].m.src
    assert got[0].s.link.endswith("viewpoint=36.9%2C138.5")
    rows = spark.createDataFrame([("b", "B|x", "u", None, "pending"), ("a", "A", "u", "n", "crawl")], "id string, title string, url string, note string, policy string")
    assert [r.row for r in site.review_table(rows).collect()] == ["| b | B\\|x | u |  |"]


def test_configuration(spark, tmp_path, monkeypatch):
    from tideglass import config

    (tmp_path / "site.toml").write_text('[site]\nname = "x"\n[paths]\nraw = "r"\n')
    (tmp_path / ".env").write_text("# note\nKEY=' v '\nEMPTY=\nREF=op://x\n")
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert config.find_root(tmp_path / "a" / "b") == tmp_path.resolve() and config.site_settings(tmp_path) == {"name": "x", "paths": {"raw": "r"}}
    assert config.secret(tmp_path, "KEY").strip() == "v" and config.secret(tmp_path, "EMPTY") is None and config.secret(tmp_path, "NONE") is None
    monkeypatch.setenv("KEY", "env")
    assert config.secret(tmp_path, "KEY") == "env"
    for name, required in (("REF", False), ("NONE", True)):
        with pytest.raises(ValueError):
            config.secret(tmp_path, name, required)
    (tmp_path / "s.json").write_text(json.dumps({"sources": [{"id": "a", "policy": "crawl", "operator_kind": "municipality", "more": 1}, {"id": "b", "policy": "crawl", "operator_kind": "third_party"}, {"id": "c", "policy": "link_only"}]}))
    found = config.sources(spark, tmp_path / "s.json")
    assert found.count() == 3 and [r.id for r in config.gate(found).collect()] == ["b"]
    with pytest.raises(ValueError):
        config.gate(found, ["third_party"])
    (tmp_path / "t.json").write_text('{"sources": [{"id": "a"}, {"id": "a"}]}')
    with pytest.raises(ValueError, match="more than once"):
        config.sources(spark, tmp_path / "t.json")
    (tmp_path / "ja.json").write_text('{"nav": {"today": "今日", "none": null}, "n": 1}')
    assert sorted(tuple(r) for r in config.catalog(spark, tmp_path, ["ja", "en"]).collect()) == [("ja", "n", "1"), ("ja", "nav.today", "今日")]
    assert config.profile({"funnels": [{"kind": "k", "keywords": ["a"]}], "thresholds": {"min_score": 10.0}}).min_score == 10.0
    with pytest.raises(ValueError):
        config.profile({})
    import base64

    account = json.dumps({"client_email": "e", "private_key": "k", "token_uri": "t"})
    assert config.service_account(account) == config.service_account(base64.b64encode(account.encode()).decode())
    with pytest.raises(ValueError):
        config.service_account("{}")


def test_command_line(capsys):
    from tideglass.__main__ import main

    assert main(["list"]) == 0 and "hours_parse" in capsys.readouterr().out
    assert main(["sql", "url_host"]) == 0 and "pages" in capsys.readouterr().out


def test_services():
    import sys
    import types

    from tideglass.service import Service, load_service

    class Mine(Service):
        sources = spec = records = pages = lambda self, *a: None

    sys.modules["mine_service"] = types.SimpleNamespace(service=Mine)
    assert isinstance(load_service("mine_service"), Mine) and load_service("mine_service").finalize("r") == "r"
    sys.modules["no_service"] = types.SimpleNamespace()
    with pytest.raises(TypeError):
        load_service("no_service")


def test_reports(spark):
    kind = "day string, fields map<string,struct<parsed:long,total:long>>"
    runs = spark.createDataFrame([("d1", {"price": (8, 10), "place": (0, 0)}), ("d1", {"price": (0, 10)}), ("d2", {"price": (9, 10), "place": (1, 2)})], kind)
    rates = reports.parsed_rates(runs)
    assert sorted(tuple(r) for r in rates.collect()) == [("d1", "place", 0, 0, None), ("d1", "price", 8, 20, 0.4), ("d2", "place", 1, 2, 0.5), ("d2", "price", 9, 10, 0.9)]
    assert [tuple(r) for r in reports.rate_shift(rates).collect()] == [("price", 0.4, 0.9)]
    days = spark.createDataFrame([("d1", 60, 1_000_000, 200_000), ("d2", 120, 0, 0)], "day string, seconds long, tokens_in long, tokens_out long")
    assert tuple(reports.month_estimate(days, 1.0, 5.0).first()) == (45.0, 30.0) and tuple(reports.month_estimate(days.limit(0), 1.0, 5.0).first()) == (0.0, 0.0)
    errors = spark.createDataFrame([("http://a.jp/x: robots.txt 503",), ("http://a.jp/y: robots.txt により拒否",), ("http://b.jp/: timeout",)], "error string")
    assert [tuple(r) for r in reports.robots_errors(errors).collect()] == [("a.jp", 2)]
    states = spark.createDataFrame([("http://a.jp/1", "robots.txt 503", datetime(2026, 9, 10)), ("http://a.jp/2", "robots.txt により拒否", datetime(2026, 9, 12)), ("http://b.jp/", "robots.txt を取得できない", None), ("http://c.jp/", "robots.txt 503", datetime(2026, 9, 13)), ("http://d.jp/", None, None), ("http://e.jp/", "robots.txt 503", datetime(2026, 9, 1))], "url string, error string, fetched_at timestamp")
    now = F.lit(datetime(2026, 9, 14))
    assert [tuple(r) for r in reports.stalled_hosts(states, now).collect()] == [("b.jp", None, "unreachable"), ("e.jp", 13, "status 503"), ("a.jp", 4, "status 503")]
    assert [r.host for r in reports.stalled_hosts(states, now, spark.createDataFrame([("http://e.jp/",)], "url string")).collect()] == ["e.jp"]


def test_index_reports(spark):
    urls = spark.createDataFrame([("u1", "PASS", "ok", "2026-09-02", "2026-09-01"), ("u2", "NEUTRAL", "x", "2026-09-01", "2026-09-03"), ("u3", None, "x", None, None), ("u4", "FAIL", None, "2026-09-05", "2026-09-04")], "url string, verdict string, state string, checked_on string, last_crawl string")
    site_rows = spark.createDataFrame([(f"u{i}",) for i in range(8)], "url string")
    got = reports.index_summary(urls, spark.createDataFrame([(3,), (4,)], "submitted long"), site_rows).first()
    assert tuple(got) == (8, 7, 4, 1, 0.5, 0.25, "2026-09-01", "2026-09-05")
    assert reports.index_summary(urls.limit(0), spark.createDataFrame([], "submitted long"), site_rows.limit(0)).first().coverage == 0.0
    assert [tuple(r) for r in reports.ranked_states(urls).collect()] == [("x", 2), ("none", 1), ("ok", 1)]
    assert sorted((r.state, r.place, r.url) for r in reports.examples(urls, 1).filter("state IS NOT NULL").collect()) == [("x", 1, "u2")]
    facts = spark.createDataFrame([(date(2026, 9, 1), "old", 5), (date(2026, 9, 8), "old", 5), (date(2026, 9, 8), "new", 3), (date(2026, 9, 1), "seen0", 0), (date(2026, 9, 9), "seen0", 2)], "day date, key string, impressions long")
    assert sorted(tuple(r) for r in reports.new_keys(facts, F.lit(date(2026, 9, 7)), F.lit(date(2026, 9, 13))).collect()) == [("new", 3), ("seen0", 2)]
    expected = spark.createDataFrame([("c", "1", 10, "a"), ("c", "2", 20, None), ("c", "3", 30, "b")], "case string, key string, price int, place string")
    found = spark.createDataFrame([("c", "1", 0, 10, "z"), ("c", "1", 1, 11, "a"), ("c", "2", 2, 21, "q")], "case string, key string, item int, price int, place string")
    per, missing = reports.evaluate(expected, found, ["price", "place"])
    assert sorted((r.field, r.correct, r.total) for r in per.collect()) == [("place", 0, 2), ("price", 1, 3)] and [r.key for r in missing.collect()] == ["3"]
    records = spark.createDataFrame([(1, None), (2, [("d0", "created", [])])], "id int, history array<struct<at:string,event:string,fields:array<string>>>")
    events = spark.createDataFrame([(1, "created", []), (2, "unchanged", [])], "id int, event string, changed array<string>")
    assert {r.id: [h.event for h in r.history] for r in reports.with_history(records, events, "id", F.lit("d1")).collect()} == {1: ["created"], 2: ["created"]}


def test_hashes_and_findings(spark):
    df = spark.createDataFrame([("<main><ul><li>a</li><li>b</li></ul></main>", "<main><ul><li>b</li>\n<li>a</li></ul></main>", "")], "a string, b string, c string")
    r = df.select(*(web.fingerprint(F.col(c)).alias(c) for c in "abc")).first()
    assert r.a == r.b and r.a.startswith("sha256:") and r.c == ""
    assert spark.createDataFrame([("公開 2026-09-14 更新\n 本文",)], "t string").select(web.normalise_for_hash(F.col("t"), [r"\d{4}-\d\d-\d\d", "更新"])).first()[0] == "公開本文"
    text = "連絡は me@x.jp か info@city.a.nagano.jp、電話 ０３－１２３４－５６７８、山田様と皆様、担当者: 佐藤"
    got = spark.createDataFrame([(text,)], "t string").select(web.personal_findings(F.col("t")).alias("a"), web.personal_findings(F.col("t"), ["ME@x.jp"], ["03-1234-5678"], False).alias("b")).first()
    assert [(f.kind, f.value) for f in got.a] == [("email", "me@x.jp"), ("phone", "03-1234-5678"), ("name", "山田様"), ("name", "担当者: 佐藤")] and "連絡は" in got.a[0].snippet
    assert [(f.kind, f.value) for f in got.b] == [("email", "info@city.a.nagano.jp"), ("name", "山田様"), ("name", "担当者: 佐藤")]

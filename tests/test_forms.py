"""Small expressions, page classification, JSON-LD and the HTML pass, on hand-made inputs."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from tideglass.functions import forms, html, jsonld, listing


def run(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in rows.select("i", f(F.col("v")).alias("out")).orderBy("i").collect()]


def same(spark, f, cases, kind="string"):
    assert run(spark, f, list(cases), kind) == list(cases.values())


def test_numbers_and_days(spark):
    same(spark, forms.format_yen, {None: "—", 0: "0円", 9_999: "9,999円", 10_000: "1万円", 68_500: "6.8万円", 400_000: "40万円", 120_000_000: "1億2,000万円", 100_000_000: "1億円", 123_456_789: "1億2,345.7万円", 100_005_000: "1億0.5万円"}, "long")
    same(spark, forms.format_m2, {None: "—", 120.0: "120㎡", 1234.56: "1,234.6㎡"}, "double")
    same(spark, forms.format_number, {None: "—", 1234567: "1,234,567"}, "long")
    at = datetime(2026, 9, 14, 15, 30)
    same(spark, forms.format_date, {at: "2026年9月15日", None: "—"}, "timestamp")
    same(spark, forms.format_datetime, {at: "2026年9月15日 00:30", None: "—"}, "timestamp")


def test_names_and_addresses_of_pages(spark):
    same(spark, forms.suggest_id, {"空き家 Kaitori Pro 2": "kaitori-pro-2", "買取": "", "a" * 50: "a" * 40, "x" * 39 + " yz": "x" * 39})
    same(spark, forms.strip_query, {"http://a.jp/x?utm=1#f": "http://a.jp/x", "http://a.jp/x": "http://a.jp/x"})
    same(
        spark, forms.thumbnail_url,
        {"https://up.org/wiki/commons/a/ab/F_o.jpg?utm=1": "https://up.org/wiki/commons/thumb/a/ab/F_o.jpg/640px-F_o.jpg", "https://up.org/wiki/commons/a/ab/F.SVG": "https://up.org/wiki/commons/thumb/a/ab/F.SVG/640px-F.SVG.png", "https://up.org/x.jpg": None},
    )
    same(spark, forms.file_title, {"https://c.org/wiki/File:A_b%20c.jpg": "A b c.jpg", "https://c.org/wiki/Plain": "Plain"})
    same(spark, forms.category_name, {"https://c.org/wiki/Category:%E5%AF%92%E9%9C%9E_x/": "寒霞 x"})
    same(spark, forms.url_path, {"a/index.html": "/a/", "index.html": "/", "a\\b.html": "/a/b.html", "/x/": "/x/"})
    same(spark, forms.host_variants, {"https://www.a.jp/x": ["http://www.a.jp/", "https://a.jp/", "http://a.jp/"], "https://a.jp": ["http://a.jp/", "https://www.a.jp/", "http://www.a.jp/"]})
    same(spark, forms.origin_of, {"https://a.jp:8080/x?y": "https://a.jp:8080", "nothing": ""})
    same(spark, forms.agent_token, {"tide/1.0 (x)": "tide", "tide x": "tide", "": "*"})


def test_reasons_and_keys(spark):
    same(spark, forms.robots_reason, {"robots.txt により拒否": "refused", "robots.txt 503: x": "status 503", "timeout": "unreachable"})
    same(spark, forms.supports_sampling, {"x-HAIKU-4-5": True, "y-3-z": True, "opus-9": False})
    same(spark, forms.needs_permission, {"利用には申請が必要": "申請", "自由に使えます": None})
    same(spark, lambda c: forms.box_label(c, F.lit(None).cast("string")), {"CC BY-NC 4.0": "CC BY-NC（非営利）", "CC BY-SA 1.0": "CC BY-SA（継承）", "GFDL": "GFDL", "?": "判定できない表記"})
    same(spark, forms.canonical_encoding, {" Shift_JIS ": "cp932", "UTF8": "utf-8", "x-euc-jp": "euc_jp", "klingon": None, None: None})
    same(spark, lambda v: forms.unreachable(v["s"], v["e"], v["b"]), {}, "struct<s:int,e:string,b:boolean>")
    got = run(spark, lambda v: forms.unreachable(v["s"], v["e"], v["b"]), [(0, "timeout", False), (0, "robots", True), (0, None, False), (403, None, False), (404, "x", False), (429, None, None)], "struct<s:int,e:string,b:boolean>")
    assert got == [True, False, False, True, False, True]
    assert run(spark, forms.nice_ticks, [0.0, -1.0, 10.0, 7.0, 120.0], "double") == [[0.0, 1.0], [0.0, 1.0], [0.0, 5.0, 10.0], [0.0, 2.0, 4.0, 6.0, 8.0], [0.0, 50.0, 100.0, 150.0]]
    import hashlib

    payload = json.dumps({"provider": "p", "model": 'm"1', "system": "s\n", "user": "ü", "schema": {"a": 1}}, ensure_ascii=False, sort_keys=True)
    key = forms.request_key(*(F.lit(x) for x in ("p", 'm"1', "s\n", "ü", '{"a": 1}')))
    assert spark.range(1).select(key).first()[0] == hashlib.sha256(payload.encode()).hexdigest()[:24]
    assert [tuple(r) for r in run(spark, lambda v: forms.prepare_input(v, 3), ["abc", "abcd", None])] == [("abc", False), ("abc", True), (None, None)]


def test_street_numbers(spark):
    cases = {
        "長野県栄村大字堺123-4": ("長野県栄村大字堺", "123-4"), "札幌市北1条西2丁目": ("札幌市北1条西2丁目", None), "札幌市北1条西2丁目3番地": ("札幌市北1条西2丁目", "3番地"), "高松市 二番町": ("高松市 二番町", None),
        "坂出市字西 甲５番地": ("坂出市字西", "甲5番地"), "十二番地": ("", "十二番地"), "": ("", None), "小布施町中松、": ("小布施町中松", None), "12丁目": ("12丁目", None),
    }
    assert [tuple(r) for r in run(spark, forms.strip_street_number, list(cases))] == list(cases.values())
    assert run(spark, forms.has_street_number, list(cases)) == [v[1] is not None for v in cases.values()]


ROW = "<tr><td>A-{0}</td><td>栄村堺</td><td>{0}50万円</td><td>120㎡</td></tr>"
INDEX = "<html><body><main><table><tr><th>物件番号</th><th>所在地</th><th>価格</th></tr>" + "".join(ROW.format(i) for i in range(11, 19)) + "</table><a href='/list/page/2/'>次へ</a></main></body></html>"
DETAIL = "<html><body><main><dl><dt>価格</dt><dd>300万円</dd><dt>所在地</dt><dd>堺</dd><dt>土地面積</dt><dd>200㎡</dd><dt>延床面積</dt><dd>90㎡</dd><dt>築年</dt><dd>昭和45年</dd><dt>間取り</dt><dd>5DK</dd><dt>構造</dt><dd>木造</dd></dl></main></body></html>"
SCHEME = "<html><body><main><h1>補助金の交付</h1><p>補助対象経費の上限額は50万円、申請書と要綱はこちら。申請期間と申請方法。</p></main></body></html>"
SPA = "<html><head><script></script><script></script></head><body><div id='app'></div><script>webpackJsonp</script></body></html>"
PLAIN = "<html><body><main><p>村の暮らしの案内です。</p></main></body></html>"


def test_page_classes(spark):
    pages = [(INDEX, "https://v.jp/list/"), (DETAIL, "https://v.jp/1"), (SCHEME, "https://v.jp/2"), (SPA, "https://v.jp/3"), (PLAIN, "https://v.jp/4"), (INDEX, "https://x.athome.co.jp/"), (None, None), ("", "")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "i int, html string, url string").select("i", "html", "url", html.page_signals()(F.col("html"), F.col("url")).alias("s"))
    got = df.select("i", listing.classify(F.col("s"), F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))).alias("c"), listing.listing_score(F.col("s"), F.col("url")).alias("n"), listing.pagination(F.col("s.anchors"), F.col("s.has_next"), F.coalesce("url", F.lit(""))).alias("p")).orderBy("i").collect()
    assert [r.c.page_class for r in got] == ["listing_index", "listing_detail", "not_listing", "spa", "not_listing", "third_party", "not_listing", "not_listing"]
    n = got[0].n
    assert (n.rows, n.property_prices, n.other_prices, n.prices, n.offer_numbers, n.price_column, n.place_column, n.is_listing) == (8, 8, 0, 8, 8, True, True, True)
    assert n.score == round(8 * 0.08 + 8 * 0.03 + 5 * 0.02 + 0.2, 3) if 8 * 0.08 + 8 * 0.03 + 5 * 0.02 + 0.2 < 1 else n.score == 1.0
    assert got[0].c.confidence == round(0.55 + 8 * 0.02, 2) and got[1].c.confidence == round(0.5 + 6 * 0.08, 2)
    assert got[2].n.scheme_dominant and got[2].n.other_prices == 1 and got[2].c.confidence == round(0.6 + got[2].n.scheme_hits * 0.015, 2)
    assert (got[0].p.is_paginated, got[0].p.current_page, got[0].p.first_page_url) == (True, 1, None)
    import re

    assert re.fullmatch(got[0].p.follow_pattern, "http://v.jp/list/page/7") and not re.fullmatch(got[0].p.follow_pattern, "https://w.jp/list/page/7")
    assert got[4].p.follow_pattern is None and not got[4].p.is_paginated


def test_later_pages(spark):
    df = spark.createDataFrame([("https://v.jp/list?page=3&x=1",), ("https://v.jp/a/page/2/",)], "url string")
    none = F.expr("cast(array() as array<struct<href:string,text:string>>)")
    got = df.select(listing.pagination(none, F.lit(False), F.col("url")).alias("p")).collect()
    assert [(r.p.current_page, r.p.first_page_url, r.p.is_paginated) for r in got] == [(3, "https://v.jp/list?x=1", True), (2, "https://v.jp/a/", True)]


def ld(*blocks):
    return "<html>" + "".join(f'<script type="application/ld+json">{b if isinstance(b, str) else json.dumps(b)}</script>' for b in blocks) + "</html>"


def test_declared_hours(spark):
    every = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
    spec = {"dayOfWeek": every, "opens": "09:00", "closes": "17:00"}
    cases = [
        ld({"@type": "TouristAttraction", "name": "村", "openingHoursSpecification": spec}),
        ld({"@type": "Organization", "openingHours": "Mo-Fr 08:30-17:15"}, "{broken", {"@graph": [{"@type": "https://schema.org/Museum", "openingHoursSpecification": [{"dayOfWeek": ["https://schema.org/Saturday", "PublicHolidays"], "opens": "10:00:00", "closes": "24:00"}]}]}),
        ld({"@type": "Organization", "openingHours": ["Sa-Mo 9:00-12:00", "xx"]}),
        ld({"@type": "Place", "openingHoursSpecification": [{**spec, "validFrom": "2026-01-01"}, {"opens": "9:00"}, {"dayOfWeek": "Funday", "opens": "9:00", "closes": "10:00"}]}),
        ld({"@type": "WebPage", "mainEntity": {"@type": ["Thing", "Park"], "openingHoursSpecification": {"opens": "7:05", "closes": "8:00"}}}),
        ld([{"@type": "Person"}]), "<p>none</p>", "", None, ld("[1, null, \"x\"]"),
    ]
    got = run(spark, jsonld.opening_hours, cases)
    plain = lambda v: v and [([(r.start, r.end) for r in p.ranges], tuple(p.days.weekdays), p.days.include_holidays) for p in v]
    assert [(plain(g.value), g.note) for g in got] == [
        ([([(540, 1020)], (), False)], "jsonld_place"), ([([(600, 0)], (5,), True)], "jsonld_place"), ([([(540, 720)], (0, 5, 6), False)], "jsonld_organization"), (None, "no_opening_hours"), ([([(425, 480)], (), False)], "jsonld_place"),
        (None, "no_opening_hours"), (None, "no_jsonld"), (None, "no_jsonld"), (None, "no_jsonld"), (None, "no_jsonld"),
    ]
    assert json.loads(got[0].quote) == {"@type": "TouristAttraction", "name": "村", "openingHoursSpecification": spec} and got[3].quote is None


def test_html_text():
    text = lambda x, s=None: html.page_text(html.parse(x), s)
    assert text("<body><ul><li>a<li>b</ul><p>x<b>y</b><p>z<br>w<table><tr><td>1<td>2</table><script>no</script>") == "a\n\nb\n\nxy\n\nz\nw\n\n1 | 2"
    assert text("<body><nav>menu</nav><div id=contents>" + "long text " * 9 + "</div><p>other</p>") == ("long text " * 9).strip()
    assert text("<body><main>short</main><p>" + "long text " * 9 + "</p>").startswith("short\n\nlong text")
    assert text("<body><form>" + "all the page " * 5 + "</form><p>x</p>").startswith("all the page") and text("<body><form>find</form><p>" + "page " * 9 + "</p>") == ("page " * 9).strip()
    assert text("<body><div class='a b'>" + "one " * 9 + "</div><div>" + "two " * 9 + "</div>", ".b") == ("one " * 9).strip()
    assert text("<body><canvas>x</canvas>１㎡　ａ</body>") == "1m2 a" and text("") == ""


def test_html_rows_and_links():
    page = html.parse("<base href='http://b.jp/d/'><h2>Towns</h2><table><tr><th>n</th></tr><tr><td>One</td><td><a href='x#f'> one </a></td></tr></table><p><a href='x'>two</a><a href='mailto:q@r.jp'>m</a><a href='/y'><img alt='pic'></a>")
    assert html.links_of(page, "http://a.jp/") == [{"url": "http://b.jp/d/x", "labels": ["one", "two"]}, {"url": "http://b.jp/y", "labels": ["pic"]}]
    assert html.link_rows_of(page, "http://a.jp/") == [{"url": "http://b.jp/d/x", "text": "one", "context": "One one", "heading": "Towns"}, {"url": "http://b.jp/y", "text": "pic", "context": "two m", "heading": "Towns"}]
    assert html.headers_of(page) == ["n"] and "One one" in html.rows_of(page)
    assert html.contacts_of(html.parse("<body>call<script>x</script><a href='tel:0879-1'>us</a></body>")) == "call us 0879-1"
    got = html.signals_of("<body><main>a<p data-volatile>now</p><img src=x.png data-asset=k></main></body>", "http://a.jp/")
    assert got["main"] == '<main>a<img src="x.png" data-asset="k"></main>' and got["images"] == [{"src": "x.png", "asset": "k"}]
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert html.page_text(html.parse(deep)) == "x" and html.rows_of(html.parse(deep)) == ["x"]

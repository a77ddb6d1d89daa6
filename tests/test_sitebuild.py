"""Templates as expressions, the gates of a build, and the site as a sink: in parallel, whole, or not at all."""

import hashlib
from datetime import date, datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from tideglass.functions.templates import TemplateError, Templates, beacon, shown_field, wording
from tideglass.operators import build
from tideglass.plans import sitebuild
from tideglass.sources import site_sink

SHAPE = "locale string, name string, n int, flag boolean, at timestamp, tags array<string>, items array<struct<t:string,p:double,sub:array<int>>>, info map<string,string>, one struct<a:struct<b:string>>"


def row(spark, **values):
    base = {"locale": "ja", "name": "<A&'\">", "n": 0, "flag": None, "at": datetime(2026, 9, 1, 3), "tags": ["x", None], "items": [("t<", 1.5, [1, 2]), (None, None, [])], "info": {"k": "v"}, "one": (("deep",),)}
    return spark.createDataFrame([tuple({**base, **values}.values())], SHAPE)


def made(df, text, texts=None, **more):
    return df.select(Templates({"page": text, **(texts or {})}, **more).column("page", df.schema).alias("v")).first().v


def test_values_are_escaped(spark):
    df = row(spark)
    assert made(df, "{{ name }}|{{ name | raw }}|{{ flag }}|{{ one.a.b }}|{{ info.k }}|{{ info.none }}") == "&lt;A&amp;&#39;&#34;&gt;|<A&'\">||deep|v|"
    assert made(df, "") == "" and made(df, "a {b} % }} c") == "a {b} % }} c"
    assert made(df, "{{ one | json }}") == '{"a":{"b":"deep"}}'


def test_conditions_and_loops(spark):
    df = row(spark)
    assert made(df, "{% if n %}a{% else %}b{% endif %}{% if not n %}c{% endif %}{% if flag %}d{% endif %}{% if tags %}e{% endif %}{% if name %}f{% endif %}{% if at %}g{% endif %}") == "bcefg"
    assert made(df, "{% for i in items %}[{{ i.t }}:{{ i.p }}{% for s in i.sub %}-{{ s }}{{ name }}{% endfor %}]{% endfor %}") == "[t&lt;:1.5-1&lt;A&amp;&#39;&#34;&gt;-2&lt;A&amp;&#39;&#34;&gt;][:]"
    assert made(df, "{% for t in tags %}<{{ t }}>{% endfor %}") == "<x><>"
    assert made(row(spark, tags=None, items=[]), "{% for t in tags %}x{% endfor %}{% for i in items %}y{% endfor %}{% if tags %}z{% endif %}") == ""


def test_forms_and_wordings(spark):
    words = wording({"ja": {"hi": "やあ", "only": "だけ"}, "en": {"hi": "Hi <b>"}}, "ja")
    ja, en = row(spark, n=12345), row(spark, n=12345, locale="en")
    text = "{{ n | yen }} {{ n | number }} {{ n | money }} {{ at | day }} {{ 'hi' | t }} {{ 'only' | t }} {{ 'none' | t }}"
    assert made(ja, text, translate=words) == "1.2万円 12,345 12,345円 2026年9月1日 やあ だけ none"
    assert made(en, text, translate=words) == "1.2万円 12,345 ¥12,345 1 September 2026 Hi &lt;b&gt; だけ none"


def test_parts(spark):
    df = row(spark)
    assert made(df, "<{% include b %}>", {"b": "{{ n }}{% include c %}", "c": "!"}) == "<0!>"
    trust = "struct<updated_at:timestamp,record_count:int,sources:array<struct<url:string,label:string,fetched_at:timestamp>>,operator:struct<name:string,url:string,contact:string,label:string>>"
    full = df.withColumn("trust", F.lit(None).cast(trust))
    assert "data-trust" in made(full, "{% include trust %}", translate=wording({}, "ja"))
    assert made(df.select(F.lit("v").alias("a")), "{{ a }}") == "v"


@pytest.mark.parametrize("text", ["{{ nothing }}", "{{ one.z }}", "{{ items }}", "{{ n | shout }}", "{% if n %}", "{% for x in n %}{% endfor %}", "{% while n %}", "{{ n + 1 }}", "{% include page %}", "{% include nowhere %}", "{{ tags.x }}"])
def test_faulty_templates_fail_before_any_page(spark, text):
    with pytest.raises(TemplateError):
        made(row(spark), text)


def test_beacon_and_fields(spark):
    assert beacon("cloudflare", None) == beacon("other", "t") == ""
    assert "&quot;x&#x27;" in beacon("cloudflare", "\"x'")
    df = spark.createDataFrame([("1", None), ("1", "一"), ("1", "1"), (None, "？"), (None, None), ("<", "")], "v string, q string")
    assert [r[0] for r in df.select(shown_field(F.col("v"), F.col("q"))).collect()] == ["1", '1 <span class="quote">（原文: 一）</span>', "1", '<span class="missing">記載なし（原文: ？）</span>', '<span class="missing">記載なし</span>', "&lt;"]


# -- the sink


def tree(path):
    return {str(f.relative_to(path)): f.read_bytes() for f in path.rglob("*") if f.is_file()}


def test_files_are_written_by_all_tasks(spark, tmp_path):
    target = tmp_path / "dist"
    files = spark.range(200).select(F.concat(F.lit("d"), F.col("id") % 7, F.lit("/é "), "id", F.lit(".html")).alias("path"), F.concat(F.lit("ü"), "id").alias("body"))
    site_sink.write_site(files.repartition(6), str(target))
    assert tree(target) == {f"d{i % 7}/é {i}.html": f"ü{i}".encode() for i in range(200)}
    # what was there goes
    site_sink.write_site(spark.createDataFrame([("a.html", None), ("b.bin", "x")], "path string, body string"), f"file://{target}")
    assert tree(target) == {"a.html": b"", "b.bin": b"x"}
    site_sink.write_site(spark.createDataFrame([("i.png", bytearray(b"\x00\xff"))], "path string, body binary"), str(target))
    assert tree(target) == {"i.png": b"\x00\xff"}
    assert [p.name for p in tmp_path.iterdir()] == ["dist"]
    site_sink.write_site(files.limit(0), str(target))
    assert tree(target) == {}


def test_an_aborted_job_leaves_no_file(spark, tmp_path):
    target = tmp_path / "dist"
    good = spark.createDataFrame([("a.html", "old")], "path string, body string")
    site_sink.write_site(good, str(target))
    late = F.when(F.col("id") == 99, F.raise_error(F.lit("broken row")).cast("string")).otherwise(F.lit("x"))
    files = spark.range(100).repartition(4).select(F.concat("id", F.lit(".html")).alias("path"), late.alias("body"))
    with pytest.raises(Exception, match="broken row"):
        site_sink.write_site(files.filter("path <> ''"), str(target))
    assert tree(tmp_path) == {"dist/a.html": b"old"}
    for path in ("../out.html", "/etc/x", "a//b", "", None, "a/./b", "a\\b"):
        with pytest.raises(Exception, match="no path of a file"):
            site_sink.write_site(good.unionByName(spark.createDataFrame([(path, "x")], good.schema)), str(target))
        assert tree(tmp_path) == {"dist/a.html": b"old"}
    with pytest.raises(site_sink.DuplicatePaths):
        site_sink.write_site(good.unionByName(good), str(target))


def test_a_task_that_runs_twice_does_no_harm(tmp_path):
    import pyarrow as pa

    writer = site_sink.SiteWriter(str(tmp_path / "dist"), "job")
    batch = pa.RecordBatch.from_arrays([pa.array(["p/a.html"]), pa.array(["one"])], ["path", "body"])
    assert [writer.write(iter([batch])) for _ in range(2)] == [site_sink.Written(1, 3)] * 2
    assert not (tmp_path / "dist").exists()
    writer.commit([None])
    assert tree(tmp_path) == {"dist/p/a.html": b"one"}
    other = site_sink.SiteWriter(str(tmp_path / "dist"), "two")
    other.write(iter([batch]))
    other.abort([])
    # a task that is still running then fails, and leaves nothing
    deeper = pa.RecordBatch.from_arrays([pa.array(["q/r/b.html"]), pa.array(["two"])], ["path", "body"])
    for late in (batch, deeper):
        with pytest.raises(OSError):
            other.write(iter([late]))
    assert tree(tmp_path) == {"dist/p/a.html": b"one"}


def test_maps_of_large_sites_have_parts(spark, monkeypatch):
    entries = spark.range(95).select(F.concat("id", F.lit(".html")).alias("path"), F.concat(F.lit("<url>"), "id", F.lit("</url>")).alias("row"))
    one = {r.path: r.body for r in site_sink.map_files(entries, "https://b", False).collect()}
    assert list(one) == ["sitemap.xml"] and one["sitemap.xml"].count("<url>") == 95 and "xhtml" not in one["sitemap.xml"]
    monkeypatch.setattr(site_sink, "MAP_PAGES", 50)
    monkeypatch.setattr(site_sink, "PART_PAGES", 20)
    parts = {r.path: r.body for r in site_sink.map_files(entries, "https://b", True).collect()}
    assert sorted(parts) == [*(f"sitemap-{i:05d}.xml" for i in range(5)), "sitemap.xml"]
    assert sum(b.count("<url>") for b in parts.values()) == 95 and parts["sitemap.xml"].count("<loc>https://b/sitemap-0") == 5
    none = site_sink.map_files(entries.limit(0), "https://b", False).collect()
    assert [r.path for r in none] == ["sitemap.xml"]


def test_a_file_in_pieces(spark, tmp_path):
    target = tmp_path / "dist"
    files = spark.range(50).select(F.concat("id", F.lit(".html")).alias("path"), F.lit("x").alias("body"))
    pieces = spark.range(3000).repartition(7).select(F.concat(F.lit("m/"), F.col("id") % 3).alias("path"), F.format_string("%05d", "id").alias("piece"), F.concat("id", F.lit("\n")).alias("body"))
    site_sink.write_site(files, str(target), pieces)
    want = {f"{i}.html": b"x" for i in range(50)} | {f"m/{k}": "".join(f"{i}\n" for i in range(k, 3000, 3)).encode() for k in range(3)}
    assert tree(target) == want
    got = site_sink.read_site(spark, str(target)).collect()
    assert {(r.path, r.bytes, r.sha256) for r in got} == {(k, len(v), hashlib.sha256(v).hexdigest()) for k, v in want.items()} and len(got) == len(want)
    for again in (pieces.unionByName(pieces.limit(1)), pieces.withColumn("path", F.lit("1.html"))):
        with pytest.raises(site_sink.DuplicatePaths):
            site_sink.write_site(files, str(target), again)
    assert tree(target) == want


def test_one_map_of_a_large_site_is_as_in_sql(spark, monkeypatch):
    """Beyond MAP_PAGES pages, too, the query's site has the one map that its SQL has."""
    monkeypatch.setattr(site_sink, "MAP_PAGES", 7)
    monkeypatch.setattr(site_sink, "PART_PAGES", 5)
    monkeypatch.setattr(site_sink, "READ_FILES", 4, raising=False)
    con = duckdb.connect()
    for t in ("supplier", "nation", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = con.sql(f"SELECT path, bytes, sha256 FROM ({sitebuild.ORACLES['site_files']})").fetchall()
    got = sitebuild.site_files(spark, "/root/testdata/sf0.001").select("path", "bytes", "sha256").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_a_map_without_pages(spark, tmp_path):
    pages = site_rows(spark, **{p: {"noindex": True} for p in ("index.html", "about/index.html", "en/index.html", "en/about/index.html")})
    maps = []
    for one_map in (False, True):
        of = of_site()
        of.one_map = one_map
        build.build(pages, of, ["page"], str(tmp_path / f"d{one_map}"))
        maps.append((tmp_path / f"d{one_map}" / "sitemap.xml").read_bytes())
    assert maps[0] == maps[1]


# -- builds

PAGE = '<!doctype html><html lang="{{ locale }}"><head><title>{{ title }}</title>{% include head %}</head><body>{{ text }}{% if img %}<img src="{{ img }}" data-asset="{{ asset_id }}">{% endif %}</body></html>'


def site_rows(spark, **change):
    """The first page and one about it, in two languages."""
    out = []
    for locale, prefix in (("ja", ""), ("en", "en/")):
        for rel in ("index.html", "about/index.html"):
            alternates = {"ja": f"/{rel}", "en": f"/en/{rel}"}
            base = {"path": prefix + rel, "url_path": f"/{prefix}{rel}", "template": "page", "locale": locale, "alternates": alternates, "noindex": False, "title": "T", "text": "hello", "img": None, "asset_id": None, "description": "", "og_type": "website", "og_locale": "ja_JP", "site_name": "S", "structured_data": ["{}"], "beacon": "", "lastmod": date(2026, 9, 1), "changefreq": "daily", "priority": 1.0}
            out.append(tuple({**base, **change.get(prefix + rel, {})}.values()))
    shape = "path string, url_path string, template string, locale string, alternates map<string,string>, noindex boolean, title string, text string, img string, asset_id string, description string, og_type string, og_locale string, site_name string, structured_data array<string>, beacon string, lastmod date, changefreq string, priority double"
    return spark.createDataFrame(out, shape)


def of_site():
    return build.Site("https://s.jp", [("ja", "ja"), ("en", "en")], Templates({"page": PAGE}), [("/a", "/b", 302)])


def test_a_whole_site(spark, tmp_path):
    target = tmp_path / "dist"
    assets = spark.createDataFrame([("k1",)], "asset_id string")
    pages = site_rows(spark, **{"index.html": {"img": "/i.png", "asset_id": "k1"}, "en/about/index.html": {"noindex": True}})
    more = spark.createDataFrame([("static/i.css", "p{}")], "path string, body string")
    index = site_sink.index_files(spark.createDataFrame([(2, "b"), (1, "a")], "n int, t string"), F.lit("all"), ["n"])
    assert build.build(pages, of_site(), ["page"], str(target), assets, more.unionByName(index)) == 4
    files = tree(target)
    assert sorted(files) == ["_headers", "_redirects", "about/index.html", "en/about/index.html", "en/index.html", "index.html", "robots.txt", "search/all.json", "sitemap.xml", "static/i.css"]
    assert files["search/all.json"] == b'[{"n":1,"t":"a"},{"n":2,"t":"b"}]\n' and files["_redirects"] == b"/a /b 302\n"
    head = files["en/index.html"].decode()
    assert '<link rel="alternate" hreflang="x-default" href="https://s.jp/index.html">' in head and head.count("hreflang=") == 3
    assert files["sitemap.xml"].decode().count("<url>") == 3 and b"xmlns:xhtml" in files["sitemap.xml"]


@pytest.mark.parametrize(
    ("change", "fault"),
    [
        ({"index.html": {"template": "other"}}, "no_template"), ({"index.html": {"img": "/i.png"}}, "image_unmarked"), ({"index.html": {"img": "/i.png", "asset_id": "zz"}}, "image_unregistered"), ({"index.html": {"structured_data": []}}, "json_ld"),
        ({"index.html": {"structured_data": ["{"]}}, "broken_json_ld"), ({"index.html": {"text": "連絡は user@example.com まで"}}, "personal_data"), ({"en/index.html": {"alternates": {"en": "/en/index.html"}}}, "one_way"), ({"en/index.html": {"locale": "fr"}}, "unknown_locale"),
    ],
)
def test_gates(spark, tmp_path, change, fault):
    """A page that must not be published stops the build, and the site stays."""
    target = tmp_path / "dist"
    assets = spark.createDataFrame([("k1",)], "asset_id string")
    site_sink.write_site(spark.createDataFrame([("a.html", "old")], "path string, body string"), str(target))
    with pytest.raises(build.BuildError, match=fault):
        build.build(site_rows(spark, **change), of_site(), ["page"], str(target), assets)
    assert tree(tmp_path) == {"dist/a.html": b"old"}

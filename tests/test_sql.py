"""SQL over the views and functions of the engine."""

import pytest

from tideglass import sql
from tideglass.functions import web
from tideglass.operators.crawl import interval_days

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def named(spark):
    sql.register(spark, FOLDER)
    sql.register(spark, FOLDER)  # names may be there already
    return spark


def one(spark, text):
    return spark.sql(f"SELECT {text} AS v").first().v


def test_functions_are_those_of_the_library(named):
    from pyspark.sql import functions as F

    urls = ["https://A.example.com/x?y", "nothing", None, ""]
    rows = named.createDataFrame([(u,) for u in urls], "u string")
    rows.createOrReplaceTempView("given")
    got = named.sql("SELECT host_of(u), url_key(u), content_hash(u), squash(u) FROM given").collect()
    want = rows.select(web.host_of(F.col("u")), web.url_key(F.col("u")), web.content_hash(F.col("u")), F.coalesce(web.squash(F.col("u")), F.lit(""))).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    assert one(named, "squash('３ ０　円 ')") == "30円"
    days = named.createDataFrame([(d,) for d in (None, 0.0, 6.9, 7.0, 28.0)], "d double")
    days.createOrReplaceTempView("days_given")
    assert [r[0] for r in named.sql("SELECT interval_days(d) FROM days_given").collect()] == [r[0] for r in days.select(interval_days(F.col("d"))).collect()]
    assert [one(named, x) for x in ("ctr(0, 0)", "ctr(1, 3)")] == [0.0, 0.333333]
    assert [str(one(named, f"nth_weekday(2026, 9, 0, {n})")) for n in (1, 3)] == ["2026-09-07", "2026-09-21"]


def test_table_function(named):
    html = '<a href="/a#x">one</a><a href="b">two</a><a href="/a">again</a><a href="mailto:x">no</a>'
    named.createDataFrame([(html, "https://h.jp/d/"), (None, "https://h.jp/"), ("", None)], "html string, url string").createOrReplaceTempView("given_pages")
    got = named.sql("SELECT place, target, labels FROM given_pages, LATERAL page_links(html, url) ORDER BY place").collect()
    assert [tuple(r) for r in got] == [(0, "https://h.jp/a", ["one", "again"]), (1, "https://h.jp/d/b", ["two"])]


def test_aggregate(named):
    got = named.sql("SELECT k, weighted_mean(v, w) AS m FROM VALUES ('a', 1.0D, 1L), ('a', 4.0D, 2L), ('a', NULL, 9L), ('a', 9.0D, NULL), ('b', 5.0D, 0L) AS t(k, v, w) GROUP BY k ORDER BY k").collect()
    assert [(r.k, r.m) for r in got] == [("a", 3.0), ("b", 0.0)]


def test_views(named):
    assert named.sql("SELECT count(*) AS n FROM facts").first().n == named.sql("SELECT count(*) AS n FROM lineitem").first().n
    assert named.sql("SELECT count(*) AS n FROM fetches JOIN events USING (event_id)").first().n == named.sql("SELECT count(*) AS n FROM events").first().n
    assert named.sql("SELECT min(page) AS n FROM page_series").first().n >= 1

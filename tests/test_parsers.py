from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideglass.functions import forms, jp, web


def results(spark, parser, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", parser(F.col("t")).alias("p")).orderBy("i").collect()
    return [(r.p.value, r.p.note) for r in rows]


def test_yen(spark):
    cases = {
        "1,200万円": (12_000_000, None), "1億2,000万円": (120_000_000, None), "6.8万円": (68_000, None), "６８，０００円": (68_000, None), "300万円〜500万円": (None, "range"),
        "売買 500万円 / 賃貸 5万円": (None, "multiple"), "価格 応相談": (None, "negotiable"), "3LDK": (None, "no_number"), "なし": (None, "no_number"), "1.00005万円": (None, "fraction"), "築40年 500万円": (5_000_000, None), None: (None, None),
    }
    got = results(spark, jp.parse_yen, list(cases))
    assert {k: v for k, v in zip(cases, got, strict=True) if k is not None} == {k: v for k, v in cases.items() if k is not None}
    assert got[list(cases).index(None)][0] is None


def test_area_year_date_minutes(spark):
    assert results(spark, jp.parse_area, ["120.5㎡", "36.4坪", "100〜200㎡", "3LDK", "広い", "10m2 と 20m2"]) == [(120.5, None), (120.33, "from_tsubo"), (None, "range"), (None, "no_unit"), (None, "no_number"), (None, "multiple")]
    assert results(spark, jp.parse_year, ["昭和45年", "令和元年", "1985年頃", "築40年", "H12年", "不詳", "いつか"]) == [(1970, None), (2019, None), (1985, "approx"), (None, "relative_age"), (2000, None), (None, "unknown"), (None, "no_year")]
    assert results(spark, jp.parse_date, ["令和8年3月31日", "2026/3/5", "締切 令和8年2月30日", "未定"]) == [(date(2026, 3, 31), None), (date(2026, 3, 5), None), (None, "invalid_date"), (None, "no_date")]
    assert results(spark, jp.parse_minutes, ["約60分", "1時間30分", "半日", "25時間", "", "駅"]) == [(60, "approx"), (90, None), (None, "vague"), (None, "out_of_range"), (None, "no_text"), (None, "no_duration")]


def test_nfkc(spark):
    assert [r[0] for r in spark.createDataFrame([("㎡ｱ１",), (None,)], "t string").select(jp.nfkc("t")).collect()] == ["m2ア1", None]


def test_further_forms(spark):
    """What is written around, between and instead of values."""
    yen = {"790万円（税込）": 7_900_000, "72,000円/月": 72_000, "月額 4万円": 40_000, "3万5千円": 35_000, "250万": 2_500_000, "6,000,000円": 6_000_000, "価格：1,100万円（相談可）": 11_000_000, "築1980年 価格600万円": 6_000_000, "３，３００万円": 33_000_000}
    assert results(spark, jp.parse_yen, list(yen)) == [(v, None) for v in yen.values()]
    assert results(spark, jp.parse_yen, ["300万円～500万円", "4DK", "土地 250㎡", "No.4321", ""]) == [(None, "range"), *[(None, "no_number")] * 4]
    assert results(spark, jp.parse_area, ["99.5m²", "延床面積 88.5平米", "2,234.56㎡", "110.5㎡（33.4坪）", "土地 250㎡ 建物 110㎡", "面積不明"]) == [(99.5, None), (88.5, None), (2234.56, None), (110.5, None), (None, "multiple"), (None, "no_number")]
    assert results(spark, jp.parse_year, ["昭和50年築", "平成4年3月", "令和3年", "S50年", "H4.4", "1980年築", "築約30年", "築年不詳", "3LDK", "価格 600万円", "１９８０年"]) == [(1975, None), (1992, None), (2021, None), (1975, None), (1992, None), (1980, None), (None, "relative_age"), (None, "unknown"), (None, "no_year"), (None, "no_year"), (1980, None)]
    assert [(str(v) if v else None, n) for v, n in results(spark, jp.parse_date, ["2027年4月30日", "2027/04/30", "2027-4-30", "締切 令和9年2月30日", "随時"])] == [("2027-04-30", None)] * 3 + [(None, "invalid_date"), (None, "no_date")]
    got = spark.createDataFrame([("25.5%",), ("2割5分",), ("３０％",), ("x",), (None,)], "t string").select(jp.parse_percent(F.col("t"))).collect()
    assert [r[0] for r in got] == [25.5, 20.0, 30.0, None, None]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 9_999), st.integers(10, 99_999_999).map(lambda v: v * 1000)), min_size=1, max_size=40))
def test_yen_comes_back(spark, values):
    """The shown form keeps a decimal of 万, so whole thousands come back."""
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", jp.parse_yen(forms.format_yen(F.col("v")))["value"].alias("back")).collect()
    assert all(r.v == r.back for r in rows)


@pytest.mark.parametrize(
    ("url", "first", "page"),
    [("https://a.jp/x/page/3/", "https://a.jp/x/", 3), ("https://a.jp/x?page=2&q=1", "https://a.jp/x?q=1", 2), ("https://a.jp/x?q=1", "https://a.jp/x?q=1", 1), ("https://a.jp/x?q=1&PAGE=4", "https://a.jp/x?q=1", 4)],
)
def test_pages_of_urls(spark, url, first, page):
    got = spark.createDataFrame([(url,)], "u string").select(web.split_page(F.col("u")).alias("p")).first().p
    assert (got.first, got.page) == (first, page)


def test_hosts_licences_quotes(spark):
    row = spark.createDataFrame([("HTTPS://WWW.Athome.co.jp/x", "CC BY 4.0", "CC BY-NC 4.0 または public domain", "ab cd efgh", "xx abcdefgh yy")], "u string, a string, b string, q string, s string").select(
        web.host_of(F.col("u")).alias("h"), web.under_host(web.host_of(F.col("u")), web.PLATFORMS).alias("p"), web.licence(F.col("a")).alias("a"), web.licence(F.col("b")).alias("b"), web.quote_status(F.col("q"), F.col("s")).alias("q"), web.verbatim(F.col("s"), F.col("s"), 5).alias("v")
    ).first()
    assert (row.h, row.p, row.a.licence, row.a.verdict, row.b.licence, row.b.verdict, row.q, row.v) == ("www.athome.co.jp", "athome.co.jp", "CC-BY-4.0", "granted", None, "mixed", "quote", True)

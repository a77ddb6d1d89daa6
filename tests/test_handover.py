"""The report of a screening, forms that are filled, and terms of use."""

from pyspark.sql import functions as F

from tideglass.operators import handover

SHAPE = "id int, name string, advertiser string, condition string, verdict string, score double, kind string, tier string, why string"


def lines(df):
    return [r.line for r in handover.report(df, "p").orderBy("place").collect()]


def test_report(spark):
    rows = [(1, "b|x", "ad", "cond\nition", "apply", 70.4, "k", "unknown", ""), (2, "a", None, None, "apply", 70.4, "k", "light", ""), (3, "c", "ad", "", "apply", 90.0, None, "unknown", "x"), (4, "no", "ad", "", "reject", 0.0, None, None, "brand")]
    got = lines(spark.createDataFrame(rows, SHAPE).repartition(3))
    assert got == [
        "# 案件の選定結果（プロファイル: p）", "申請 3 件 / 保留 0 件 / 除外 1 件（合計 4 件）", "## 申請する順", "| # | 案件名 | 広告主 | 種別 | 成果条件 | 点 | 理由 |", "| --- | --- | --- | --- | --- | --- | --- |",
        "| 1 | c | ad | - | unknown | 90 | x |", "| 2 | a | - | k | light | 70 | - |", "| 3 | b｜x | ad | k | cond ition | 70 | - |", "## 除外", "| # | 案件名 | 広告主 | 除外理由 |", "| --- | --- | --- | --- |", "| 1 | no | ad | brand |",
    ]
    assert lines(spark.createDataFrame([], SHAPE)) == ["# 案件の選定結果（プロファイル: p）", "申請 0 件 / 保留 0 件 / 除外 0 件（合計 0 件）", "## 申請する順", "採用できる案件が無い。", "## 除外", "除外した案件は無い。"]


def test_forms(spark):
    df = spark.createDataFrame([(1, None, ["a", "b"])], "id int, name string, tags array<string>")
    values = {"id": F.col("id"), "name": F.col("name"), "tags": handover.listed(F.col("tags")), "tags_list": F.col("tags")}
    row = df.select(handover.filled("x({id}, {name}, [{tags}], {other})", values, "None").alias("a"), handover.filled("no holes", values).alias("b"), handover.handed_over({"n": "{name}", "i": " {id} ", "t": {"l": "{tags_list}", "s": "#{id}"}, "k": True}, values).alias("c")).first()
    assert (row.a, row.b) == ('x(1, None, ["a", "b"], {other})', "no holes")
    assert row.c == '{"n":null,"i":1,"t":{"l":["a","b"],"s":"#1"},"k":true}'


def test_terms(spark):
    by = "https://creativecommons.org/licenses/by/4.0/"
    pages = [f"<a href='{by}'>CC BY 4.0</a>", f"<a href='{by}'>CC BY 4.0</a> ご利用には申請が必要です", "すべて転載を禁じます", "要相談", ""]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in pages], "h string").select(handover.terms(F.col("h"))).collect()]
    assert [g.allowed for g in got] == [True, False, False, False, False]
    assert got[0].licence == "CC-BY-4.0" and got[1].permission == "申請" and got[1].reason == "permission: 申請" and got[4].reason == "none"

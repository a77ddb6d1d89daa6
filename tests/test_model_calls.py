"""Replayed model calls, running sums over ranges, and quotes whatever the width of their characters."""

import random

import pytest
from pyspark.sql import functions as F

from tideglass.functions import web
from tideglass.functions.base import nfkc
from tideglass.operators import model_calls
from tideglass.sources.versions import VersionedTable

NOW = "2026-09-01 00:00:00"
REQUESTS = "key string, place int, tokens int, note string"
PROVIDER = "key string, response string, input_tokens int, output_tokens int"


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_running_total(spark, ranges):
    rng = random.Random(1)
    rows = [(i, rng.randrange(20), f"k{i % 3}") for i in rng.sample(range(1000), 200)]
    got = model_calls.running_total(spark.createDataFrame(rows, "i int, v int, _range string"), ["i"], "v", "upto", ranges)
    want, upto = [], 0
    for i, v, k in sorted(rows):
        upto += v
        want.append((i, v, k, upto))
    assert sorted(tuple(r) for r in got.select("i", "v", "_range", "upto").collect()) == want
    assert model_calls.running_total(spark.createDataFrame([], "i int, v int"), ["i"], "v", "upto").collect() == []


def run(spark, requests, provider, log, budget):
    got = model_calls.replay(spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(provider, PROVIDER), log, budget, F.lit(NOW).cast("timestamp"), "m1")
    return sorted((r.place, r.key, r.status, r.response) for r in got.collect())


def test_a_fixture_is_replayed(spark, tmp_path):
    log = str(tmp_path / "log")
    requests = [("a", 1, 10, None), ("b", 2, 10, "x"), ("a", 3, 10, None), ("c", 4, 10, None), (None, 5, 1, None), ("d", 6, None, None)]
    provider = [("a", "{1}", 5, 2), ("c", "{3}", 6, 1), ("d", None, 0, 0), ("z", "{9}", 1, 1)]
    first = run(spark, requests, provider, log, None)
    assert first == [(1, "a", "answered", "{1}"), (2, "b", "unanswered", None), (3, "a", "answered", "{1}"), (4, "c", "answered", "{3}"), (5, None, "unanswered", None), (6, "d", "unanswered", None)]
    # a second run asks nothing that was answered, whatever the provider would say now
    again = run(spark, requests, [("a", "other", 1, 1), ("b", "{2}", 1, 1)], log, None)
    assert again == [(1, "a", "cached", "{1}"), (2, "b", "answered", "{2}"), (3, "a", "cached", "{1}"), (4, "c", "cached", "{3}"), (5, None, "unanswered", None), (6, "d", "unanswered", None)]
    logged = VersionedTable(spark, log).read()
    assert sorted((r.key, r.response) for r in logged.collect()) == [("a", "{1}"), ("b", "{2}"), ("c", "{3}")]
    spent = model_calls.usage(logged, {"m1": (1.0, 5.0)}).first()
    assert (spent.calls, spent.input_tokens, spent.output_tokens, spent.cost) == (3, 12, 4, 0.000032)
    assert model_calls.usage(logged, {"m2": (1.0, 5.0)}).first().cost is None


@pytest.mark.parametrize(("budget", "n"), [(0, 0), (9, 0), (10, 1), (19, 1), (20, 2), (29, 2), (55, 4), (10**6, 5)])
def test_cut_off_exactly_at_the_budget(spark, tmp_path, budget, n):
    """Requests of 10, 10, 10 (asked for twice, paid once), 20 and 10 tokens, in the order of their places; none is asked after the first that is too dear."""
    requests = [("a", 1, 10, None), ("b", 2, 10, None), ("c", 3, 10, None), ("c", 4, 10, None), ("d", 5, 20, None), ("e", 6, 10, None)]
    provider = [(k, k, 1, 1) for k in "abcde"]
    got = run(spark, requests, provider, str(tmp_path / "log"), budget)
    asked = "abcde"[:n]
    assert got == [(p, k, "answered" if k in asked else "over_budget", k if k in asked else None) for k, p, _, _ in requests]


def test_what_is_logged_stays(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "log"))
    of = lambda *rows: spark.createDataFrame(list(rows), "key string, v int")
    table.add(of(("a", 1), ("a", 0), (None, 5)), ["key"])
    table.add(of(("a", 9), ("b", 2), (None, 6)), ["key"])
    assert sorted(((r.key or "-", r.v) for r in table.read().collect())) == [("-", 5), ("a", 1), ("b", 2)]
    assert len(table.manifest()["parts"]) == 2


def test_normal_form(spark):
    import unicodedata

    texts = ["価格は３００万円", "ﾊﾟﾋﾟﾌﾟ㍻①㈱", "ﬁ é", "", None, "　　x"]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(nfkc("t")).collect()] == [t and unicodedata.normalize("NFKC", t) for t in texts]


def test_quotes_of_any_width(spark):
    rows = [("価格は３００万円", "価格は 300万円です"), ("300万円", "価格は３００万円"), ("㈱テスト", "(株) テスト"), ("ﾃｽﾄ", "テスト"), ("400万円", "価格は３００万円"), ("価格は３００万円…です。はい", "価格は 300万円 と です。はい"), (None, "x"), ("", "x"), ("x", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "q string, s string").select(web.quote_status(F.col("q"), F.col("s"))).collect()]
    assert got[:6] == ["quote", "quote", "quote", "quote", "missing", "joined"] and set(got[6:]) <= {"missing", None}

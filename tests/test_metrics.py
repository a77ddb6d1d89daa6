"""Partial metrics: merged days equal one run over all of them."""

import random
from datetime import date, timedelta

from tideglass.operators import metrics

SHAPE = "day date, target string, status string, note string"


def values(rng, n):
    return [(date(2026, 9, 1) + timedelta(days=rng.randrange(6)), rng.choice("ab"), rng.choice(metrics.STATUSES), rng.choice(["x", "y", None])) for _ in range(n)]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_merged_days_equal_one_run(spark, tmp_path):
    rng, path = random.Random(2), str(tmp_path / "m")
    all_values = values(rng, 300)
    df = lambda vs: spark.createDataFrame(vs, SHAPE)
    whole = metrics.partial(df(all_values))
    # in any cut
    cuts = [all_values[i::3] for i in range(3)]
    assert rows(metrics.merge(*(metrics.partial(df(c)) for c in cuts))) == rows(whole)
    # by day, stored in any order, one of them twice
    days = sorted({v[0] for v in all_values}, reverse=True)
    metrics.save(metrics.partial(df([v for v in all_values if v[0] == days[0]][:3])), path)
    for d in days:
        metrics.save(metrics.partial(df([v for v in all_values if v[0] == d])), path)
    assert rows(metrics.load(spark, path).select(*whole.columns)) == rows(whole)
    assert rows(metrics.rates(metrics.load(spark, path))) == rows(metrics.rates(whole))
    some = [str(d) for d in (days[3], days[1])]
    assert rows(metrics.load(spark, path, *some).select(*whole.columns)) == rows(metrics.partial(df([v for v in all_values if some[0] <= str(v[0]) <= some[1]])))
    # the first version is still there
    assert metrics.load(spark, path, version=1).agg({"n": "sum"}).first()[0] == 3


def test_rates(spark):
    d = date(2026, 9, 1)
    vs = [(d, "a", "parsed", None)] * 3 + [(d, "a", "unparsed", "x")] * 2 + [(d, "a", "unparsed", "y"), (d, "a", "not_found", None), (d, "b", "not_found", None), (d, "a", "parsed", "ignored")]
    got = {r.target: r for r in metrics.rates(metrics.partial(spark.createDataFrame(vs, SHAPE)), 1).collect()}
    assert (got["a"].n, got["a"].parsed, got["a"].parsed_rate, got["a"].found_rate, got["a"].notes) == (8, 4, 0.571429, 0.875, ["x:2"])
    assert (got["b"].n, got["b"].parsed_rate, got["b"].found_rate, got["b"].notes) == (1, 0.0, 0.0, [])
    assert metrics.rates(metrics.partial(spark.createDataFrame([], SHAPE))).collect() == []

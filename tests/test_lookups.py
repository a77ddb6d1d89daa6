"""Keyword tables and host registries against looking for each entry by itself."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideglass.operators import keywords, registries


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abAé日", max_size=40), max_size=4), st.lists(st.text("abAé日", max_size=4), max_size=8))
def test_automaton(texts, words):
    automaton = keywords._automaton(sorted({w.lower() for w in words if w}))
    got = [[(h["word"], h["start"], h["n"]) for h in keywords._found(automaton, t.lower())] for t in texts]
    assert got == keywords.plain_hits(texts, words)


@pytest.mark.parametrize("shard_bytes", [keywords.SHARD_BYTES, 300])
def test_hits(spark, shard_bytes):
    """In one shard and in many; null, empty, repeated and overlapping words; null, empty and repeated texts; columns with other names."""
    texts = ["The RING and the string", None, "", "aaaa", "ring", "ring", "日本の空き家", "nothing"]
    words = ["ring", "RING", "string", None, "", "aa", "a", "空き", "家", "zzz"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "i int, `a.b` string, word string")
    got = keywords.with_hits(df, spark.createDataFrame([(w, 1) for w in words], "word string, n int"), F.col("`a.b`"), shard_bytes=shard_bytes)
    assert got.columns == ["i", "a.b", "word", "hits"]
    assert [[tuple(h) for h in r.hits] for r in got.orderBy("i").collect()] == keywords.plain_hits(texts, words)
    none = keywords.with_hits(df, spark.createDataFrame([], "word string"), F.col("`a.b`"))
    assert all(r.hits == [] for r in none.collect())
    exact = keywords.with_hits(df, spark.createDataFrame([("RING",)], "word string"), F.col("`a.b`"), fold=False)
    assert [r.i for r in exact.filter(F.size("hits") > 0).collect()] == [0]


def test_a_hundred_thousand_keywords(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(4, 9)))
    words = [word() for _ in range(100_000)]
    texts = [" ".join([*(rng.choice(words) for _ in range(6)), word()]) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    table = spark.createDataFrame([(w,) for w in words], "word string")
    want = keywords.plain_hits(texts, words)
    for shard_bytes in (keywords.SHARD_BYTES, 3_000_000):
        got = keywords.with_hits(df, table, shard_bytes=shard_bytes).orderBy("i").collect()
        assert [[tuple(h) for h in r.hits] for r in got] == want


def test_rules(spark):
    offers = spark.createDataFrame([(1, "Gold Ring", "bolt", "x"), (2, "plain", "RING and bolt", None), (3, None, None, "a gear"), (4, "none", "", "")], "id int, name string, cond string, raw string")
    rules = spark.createDataFrame([(0, "jewel", "ring"), (1, "part", "bolt"), (1, "part", "gear"), (1, "part", "gear"), (2, "other", "ring")], "place int, kind string, word string")
    fields = [(1.0, F.col("name")), (0.7, F.col("cond")), (0.5, F.col("raw"))]
    assert sorted(tuple(r) for r in keywords.first_rule(offers, rules, fields, "id").collect()) == [(1, 1.0, "jewel"), (2, 0.7, "jewel"), (3, 0.5, "part")]


def joined_rows(plan):
    """Rows that the joins of a plan that has run gave."""
    own = plan.metrics().apply("numOutputRows").value() if plan.nodeName().endswith("Join") else 0
    return own + sum(joined_rows(plan.children().apply(i)) for i in range(plan.children().size()))


def test_many_rules_with_the_same_word(spark):
    """A hit is joined to one rule, not to all that have its word; of several with the smallest place the last kind counts."""
    texts = spark.range(100).select("id", F.concat(F.lit("a Ring "), F.col("id") % 2).alias("t"))
    rules = spark.range(3000).select((F.col("id") % 1000 + 5).alias("place"), F.concat(F.lit("k"), F.col("id") % 7).alias("kind"), F.when(F.col("id") % 2 == 0, "ring").otherwise("RING").alias("word"))
    rules = rules.unionByName(spark.createDataFrame([(5, "odd", "g 1"), (None, "z", "ring"), (1, None, "g 0"), (0, "no", None)], "place long, kind string, word string"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        best = keywords.first_rule(texts, rules, [(1.0, F.col("t"))], "id")
        got = sorted(tuple(r) for r in best.collect())
        assert joined_rows(best._jdf.queryExecution().executedPlan()) == 200
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert got == [(i, 1.0, "odd" if i % 2 else None) for i in range(100)]


HOSTS = [("example.jp", "whole", "a"), (".City.Example.jp.", "city", "b"), ("deep.city.example.jp", "deep", "c"), ("", "none", "d"), (None, "null", "e"), ("jp", "country", "f"), ("other.com", "z", "g"), ("other.com", "a", "g")]


def test_hosts(spark):
    registry = spark.createDataFrame(HOSTS, "host string, platform string, policy string")
    urls = ["https://www.example.jp/x", "https://EXAMPLE.jp", "https://a.city.example.jp:8080/?q=deep.city.example.jp", "https://deep.city.example.jp", "https://notexample.jp/", "https://example.jp.evil.net", "nothing", None, "", "http://x.other.com", "https://jp"]
    rows = spark.createDataFrame([(i, u, {"k": 1}, "x") for i, u in enumerate(urls)] + [(11, urls[0], None, "x")], "i int, url string, m map<string,int>, _host string")
    got = {r.i: r.entry and r.entry.platform for r in registries.match(rows, registry).collect()}
    assert got == {0: "whole", 1: "whole", 2: "city", 3: "deep", 4: "country", 5: None, 6: None, 7: None, 8: None, 9: "a", 10: "country", 11: "whole"}
    assert registries.match(rows, registry).columns == ["i", "url", "m", "_host", "entry"]
    assert sorted(r.i for r in registries.allowed(rows, registry.filter("host like '%xample%'")).collect()) == [0, 1, 2, 3, 11]
    kinds = {r.i: (r.platform, r.policy) for r in registries.kinds(rows, registry).collect()}
    assert kinds[3] == ("deep", "c") and kinds[5] == ("unknown", "none")
    assert registries.match(rows, registry.limit(0)).filter("entry IS NOT NULL").count() == 0
    assert registries.match(rows.limit(0), registry).count() == 0


def test_a_large_registry_is_one_join(spark):
    """A hundred thousand entries; no list of hosts and no comparison of each with each in the plan."""
    registry = spark.range(100_000).select(F.concat(F.lit("h"), "id", F.lit(".jp")).alias("host"), F.col("id").cast("string").alias("platform"), F.lit("p").alias("policy"))
    rows = spark.range(0, 200_000, 1000).select(F.concat(F.lit("http://a.b.h"), "id", F.lit(".jp/")).alias("url"), "id")
    found = registries.kinds(rows, registry)
    plan = found._jdf.queryExecution().toString()
    assert "BroadcastNestedLoop" not in plan and "Cartesian" not in plan and "h77.jp" not in plan
    assert {(r.id, r.platform) for r in found.collect()} == {(i, str(i) if i < 100_000 else "unknown") for i in range(0, 200_000, 1000)}

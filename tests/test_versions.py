"""Tables with versions: what readers see while writers write, die and meet; and the stores that are built on them."""

import threading
from datetime import date

import pytest
from pyspark.sql import functions as F

from tideglass.operators import crawl
from tideglass.sources import tables
from tideglass.sources.versions import Conflict, VersionedTable


@pytest.fixture
def store(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "store"))


def rows(spark, *values):
    return spark.createDataFrame(list(values), "k string, m string, n int")


def seen(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions_stay_readable(spark, store):
    assert store.versions() == [] and store.manifest()["version"] == 0
    assert store.read(schema="k string").collect() == []
    with pytest.raises(FileNotFoundError):
        store.read()
    assert store.write(rows(spark, ("a", "x", 1), ("b", "y", 2)), ["m"], {"note": "first"}) == 1
    first = store.read()
    assert store.write(rows(spark, ("c", None, 3)), ["m"]) == 2
    assert seen(store.read()) == [("c", None, 3)]
    assert seen(store.read(1)) == seen(first) == [("a", "x", 1), ("b", "y", 2)]
    assert store.manifest(2)["info"] == {"note": "first"}
    assert [p["values"] for p in store.manifest(2)["parts"]] == [{"m": None}]


def test_parts_that_are_not_touched_are_taken_over_by_name(spark, store):
    store.write(rows(spark, ("a", "x/1 =%", 1), ("b", "y", 2), ("c", "z", 3)), ["m"])
    store.change(lambda _: (rows(spark, ("d", "y", 4)), lambda v: v["m"] in ("y", "z")), ["m"])
    assert seen(store.read()) == [("a", "x/1 =%", 1), ("d", "y", 4)]
    old, new = ({p["values"]["m"]: p["folder"] for p in store.manifest(v)["parts"]} for v in (1, 2))
    assert set(new) == {"x/1 =%", "y"} and old["x/1 =%"] == new["x/1 =%"] and old["y"] != new["y"]
    # a read of one part opens no file of the others
    assert all("y" in f for f in store.read(2, lambda v: v["m"] == "y").inputFiles())


def test_a_writer_that_dies_leaves_the_table_as_it_was(spark, store, monkeypatch):
    store.write(rows(spark, ("a", "x", 1)), ["m"])
    half = rows(spark, ("a", "x", 5), ("b", "y", 6)).withColumn("n", F.when(F.col("k") == "b", F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="lost"):
        store.write(half, ["m"])
    assert seen(store.read()) == [("a", "x", 1)]
    # dead after all rows were written, before the manifest
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            store.write(rows(spark, ("z", "z", 9)), ["m"])
    assert store.versions() == [1] and seen(store.read()) == [("a", "x", 1)]
    fs, p = store._at("rows")
    assert len(fs.listStatus(p)) > 1
    assert store.expire() == [] and len(fs.listStatus(p)) == 1
    assert seen(store.read()) == [("a", "x", 1)]
    assert store.write(rows(spark, ("b", "y", 2)), ["m"]) == 2


def test_one_of_two_writers_is_first_and_the_other_goes_on_from_there(spark, store):
    store.write(rows(spark, ("a", "x", 1)), ["m"])
    asked = []

    def slow(last):
        asked.append(last["version"])
        if len(asked) == 1:  # another writer comes in between
            store.change(lambda _: (rows(spark, ("b", "y", 2)), lambda v: v["m"] == "y"), ["m"])
        return rows(spark, ("c", "z", 3)), lambda v: v["m"] == "z"

    assert store.change(slow, ["m"]) == 3
    assert asked == [1, 2]
    assert seen(store.read()) == [("a", "x", 1), ("b", "y", 2), ("c", "z", 3)]
    with pytest.raises(Conflict):
        store._commit(3, {"version": 3})


def test_writers_at_the_same_time(spark, store):
    store.write(rows(spark, ("a", "0", 0)), ["m"])
    failed = []

    def write(i):
        try:
            store.change(lambda _: (rows(spark, (f"k{i}", str(i), i)), lambda v: v["m"] == str(i)), ["m"])
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(1, 5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    assert seen(store.read()) == [("a", "0", 0), *[(f"k{i}", str(i), i) for i in range(1, 5)]]
    assert store.versions() == [1, 2, 3, 4, 5]


def test_expire(spark, store):
    for i in range(4):
        store.change(lambda _, i=i: (rows(spark, (f"k{i}", str(i % 2), i)), lambda v, i=i: v["m"] == str(i % 2)), ["m"])
    assert store.expire(keep=2) == [1, 2]
    assert store.versions() == [3, 4]
    assert seen(store.read(3)) == [("k1", "1", 1), ("k2", "0", 2)]
    assert seen(store.read()) == [("k2", "0", 2), ("k3", "1", 3)]


def test_upsert(spark, store):
    first = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), (None, 1, "n"), ("b", 1, "b")], "k string, at int, v string")
    store.upsert(first, ["k"], F.col("at"), buckets=3)
    assert seen(store.read().select("k", "v").fillna("-")) == [("-", "n"), ("a", "y"), ("b", "b")]
    store.upsert(spark.createDataFrame([(None, 2, "m", 1.5), ("c", 1, "c", None)], "k string, at int, v string, w double"), ["k"], buckets=99)
    assert seen(store.read().select("k", "v", "w").fillna("-", ["k"]).fillna(0.0, ["w"])) == [("-", "m", 1.5), ("a", "y", 0.0), ("b", "b", 0.0), ("c", "c", 0.0)]
    assert {p["values"]["_bucket"] for p in store.manifest()["parts"]} <= {"0", "1", "2"}
    with pytest.raises(ValueError, match="at was int"):
        store.upsert(spark.createDataFrame([("a", "late")], "k string, at string"), ["k"])
    store.upsert(first.limit(0), ["k"])
    assert store.read().count() == 4


def test_facts_of_an_earlier_fetch(spark, tmp_path):
    path = str(tmp_path / "facts")
    of = lambda *values: spark.createDataFrame([(date.fromisoformat(d), n) for d, n in values], "day date, clicks long")
    assert tables.write_facts(of(("2026-01-31", 1), ("2026-02-01", 2)), path, "page") == 1
    assert tables.write_facts(of(("2026-02-01", 7)), path, "page", ["2026-02-01", "2026-03-09"]) == 2
    both = [sorted(r.clicks for r in tables.read_facts(spark, path, "page", version=v).collect()) for v in (1, 2)]
    assert both == [[1, 2], [1, 7]]
    # the last fact of a month goes, and the month with it
    tables.write_facts(of(), path, "page", ["2026-01-31"])
    assert [r.month for r in tables.read_facts(spark, path, "page").collect()] == ["2026-02"]
    assert tables.read_facts(spark, path, "page", "2026-02-01").inputFiles() == [f for f in tables.read_facts(spark, path, "page").inputFiles()]


def test_ledger_and_layout(spark, tmp_path):
    looks, path = tmp_path / "looks", str(tmp_path / "ledger")
    (looks / "parts").mkdir(parents=True)
    (looks / "parts" / "head.html").write_text("<h1>{{ name }}</h1>")
    (looks / "page.html").write_text("<main>{{ body }}</main>")
    key = lambda version=1: tables.layout_key(spark, [str(looks), str(tmp_path / "nowhere")], version)
    one = key()
    assert one == key() != key(2) and tables.layout_key(spark, []).startswith("sha256:")
    built = lambda *pages: spark.createDataFrame([(p, f, date(2026, 12, 1)) for p, f in pages], "path string, fingerprint string, first_seen date")

    def build(day, layout, *pages):
        stored, relearn = tables.load_ledger(spark, path, layout)
        out = crawl.ledger(stored, built(*pages), F.lit(day).cast("date"), relearn).cache()
        tables.save_ledger(out, path, layout)
        return {r.path: (r.how, str(r.lastmod)) for r in out.collect()}

    assert build("2026-09-01", one, ("/a", "1"), ("/b", "1"), ("/c", "1")) == {p: ("added", "2026-09-01") for p in ("/a", "/b", "/c")}
    assert build("2026-09-02", one, ("/a", "1"), ("/b", "2")) == {"/a": ("kept", "2026-09-01"), "/b": ("changed", "2026-09-02")}
    (looks / "page.html").write_text("<main class=wide>{{ body }}</main>")
    assert key() != one
    assert build("2026-09-03", key(), ("/a", "8"), ("/b", "9"), ("/c", "1")) == {"/a": ("relearned", "2026-09-01"), "/b": ("relearned", "2026-09-02"), "/c": ("added", "2026-09-03")}
    assert build("2026-09-04", key(), ("/a", "8")) == {"/a": ("kept", "2026-09-01")}
    # a file that moves is a change too
    before = key()
    (looks / "parts" / "head.html").rename(looks / "head.html")
    assert key() != before


def test_records_and_assets(spark, tmp_path):
    p = lambda name: str(tmp_path / name)
    records = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("", 4), ("b", 1)], "record_id string, v int")
    assert tables.save_records(records, p("records")) == 2
    assert [tuple(r) for r in tables.read_records(spark, p("records"), "record_id string, v int").collect()] == [("a", 2), ("b", 1)]
    for i in range(3):
        tables.add_assets(spark.createDataFrame([("k", i), (f"own{i}", i)], "asset_id string, v int"), p("assets"))
    good, bad = tables.read_assets(spark, p("assets"), "asset_id string, v int")
    assert seen(good) == [("k", 2), ("own0", 0), ("own1", 1), ("own2", 2)] and bad.count() == 0
    good, bad = tables.read_assets(spark, p("none"), "asset_id string, v int")
    assert good.collect() == [] and bad.collect() == []


def test_json_is_put_in_place_of_the_old_one(spark, tmp_path):
    path = str(tmp_path / "state.json")
    for v in (1, 2):
        tables.write_json(spark, path, {"v": v})
        assert tables.read_json(spark, path) == {"v": v}
    assert sorted(x.name for x in tmp_path.iterdir() if not x.name.startswith(".")) == ["state.json"]

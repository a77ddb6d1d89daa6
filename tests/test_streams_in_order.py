"""Streams whose rows arrive in any order and any number of batches, against the folds over the whole tables."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tideglass.operators import crawl
from tideglass.streaming import changes, ordered

LOG = "url string, seq long, at timestamp, status int, digest string"
T0 = datetime(2026, 9, 1)
#: A row for each key that moves the watermark past all others; it is not compared.
END = T0 + timedelta(days=400)


def run(spark, tmp_path, batches, shape, of, writes=None):
    """writes: gets the changes to the state of each batch. Rows of all batches, one file and one batch each, through a stream; and how many came late."""
    path = tmp_path / "in"
    late = 0
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").json(str(path / str(i)))
        stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).json(str(path / "*"))
        query = of(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        query.awaitTermination(180)
        late += ordered.late_rows(query)
        if writes is not None:
            writes += [int(o["numRowsUpdated"]) + int(o["numRowsRemoved"]) for p in query.recentProgress for o in p["stateOperators"]]
    return spark.read.parquet(str(tmp_path / "out")).collect(), late


@pytest.fixture
def few_partitions(spark):
    had = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", had)


@pytest.mark.parametrize("n_batches", [1, 4])
def test_a_shuffled_stream_is_the_table(spark, tmp_path, few_partitions, n_batches):
    rng = random.Random(7)
    rows = [(f"u{rng.randrange(4)}", i, T0 + timedelta(minutes=10 * (i // 3)), rng.choice([200, 200, 304, 500]), rng.choice([*"abc", None])) for i in range(90)]
    shuffled = rng.sample(rows, len(rows))
    # (within a stream, a row may lag as far as the whole of it)
    batches = [shuffled[i::n_batches] for i in range(n_batches)]
    batches.append([(f"u{k}", 10**6, END, 200, "z") for k in range(4)])
    batches.append([("end", 10**6, END + timedelta(days=9), 200, "z")])
    got, late = run(spark, tmp_path, batches, LOG, lambda s: changes.detect_in_order(s, "1 day"))
    ours = sorted((r.url, r.seq, r.status, r.changed, r.errors) for r in got if r.seq < 10**6)
    want = crawl.detect_changes(spark.createDataFrame(rows, LOG), "url", ["at", "seq"], "status", "digest")
    assert ours == sorted((r.url, r.seq, r.status, r.changed, r.errors) for r in want.collect())
    assert late == 0


def test_a_row_takes_no_call_to_the_state(spark, tmp_path, few_partitions):
    """What a batch brings is held as one table for each bucket, however many times it has; keys that share a bucket keep values of their own, and rows that aren't due wait on."""
    rng = random.Random(5)
    rows = [(f"u{rng.randrange(20)}", i, T0 + timedelta(seconds=i), rng.choice([200, 304, 500]), rng.choice([*"ab", None])) for i in range(1500)]
    shuffled = rng.sample(rows, len(rows))
    middle = T0 + timedelta(days=1, seconds=700)  # half of the rows are due when it has come
    batches = [shuffled, [("end", 10**6, middle, 200, "z")], [("end", 10**6, END, 200, "z")], [("end", 10**6, END + timedelta(days=9), 200, "z")]]
    writes = []
    got, late = run(spark, tmp_path, batches, LOG, lambda s: changes.detect_in_order(s, "1 day"), writes)
    want = crawl.detect_changes(spark.createDataFrame(rows, LOG), "url", ["at", "seq"], "status", "digest")
    assert sorted((r.url, r.seq, r.status, r.changed, r.errors) for r in got if r.seq < 10**6) == sorted((r.url, r.seq, r.status, r.changed, r.errors) for r in want.collect())
    assert late == 0 and 0 < sum(writes) < 1000


def test_all_keys_in_one_bucket(spark, tmp_path, few_partitions, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKETS", 1, raising=False)
    test_a_shuffled_stream_is_the_table(spark, tmp_path, None, 2)


def test_late_rows_are_left_out_and_counted(spark, tmp_path, few_partitions):
    at = lambda h: T0 + timedelta(hours=h)
    batches = [
        [("a", 1, at(0), 200, "x"), ("a", 3, at(10), 200, "y")],
        [("a", 2, at(9), 200, "x"), (None, 9, at(10), 200, "q"), ("a", None, at(10), 200, "q"), ("a", 8, None, 200, "q")],  # in time, though out of order; rows without a key, a number or a time
        [("a", 0, at(1), 200, "never")],  # hours too late
        [("a", 4, at(11), 500, None), ("b", 1, at(30), 200, "b")],
        [("b", 2, at(60), 200, "b")],
        [("b", 3, at(90), 200, "b")],
    ]
    got, late = run(spark, tmp_path, batches, LOG, lambda s: changes.detect_in_order(s, "2 hours"))
    assert sorted((r.url, r.seq, r.changed, r.errors) for r in got if r.seq < 3 or r.url == "a") == [("a", 1, True, 0), ("a", 2, False, 0), ("a", 3, True, 0), ("a", 4, False, 1), ("b", 1, True, 0), ("b", 2, False, 0)]
    assert late == 1


def test_the_guard_in_order(spark, tmp_path, few_partitions):
    rng = random.Random(3)
    shape = "metric string, at timestamp, day date, count long, total long"
    rows = [(m, T0 + timedelta(days=d), date(2026, 9, 1) + timedelta(days=d), rng.randrange(60), 0 if d == 5 else 100) for m in "ab" for d in range(25)]
    shuffled = rng.sample(rows, len(rows))
    batches = [shuffled[:20], shuffled[20:], [(m, END, date(2027, 12, 1), 0, 1) for m in "ab"], [("c", END + timedelta(days=99), date(2028, 3, 1), 0, 1)]]
    got, _ = run(spark, tmp_path, batches, shape, lambda s: changes.guard(s, 0.1, 0.5, "60 days"))
    want = crawl.guard(spark.createDataFrame(rows, shape).select("metric", F.col("day"), "count", "total"), 0.1, 0.5)
    tidy = lambda rs: sorted((r.metric, str(r.day), round(r.share, 9), None if r.baseline is None else round(r.baseline, 9), r.ok) for r in rs if r.day < date(2027, 1, 1))
    assert tidy(got) == tidy(want.collect())

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tideglass.operators import calendar, crawl
from tideglass.streaming import changes


def test_intervals(spark):
    now = datetime(2026, 9, 12, 3)
    rows = [("a", now - timedelta(days=2), now - timedelta(days=8), None), ("b", now - timedelta(days=1), now - timedelta(days=2), None), ("c", now, now, "x"), ("d", None, None, None), ("e", now - timedelta(days=6), now - timedelta(days=40), None)]
    states = spark.createDataFrame(rows, "source_id string, fetched_at timestamp, changed_at timestamp, error string")
    got = {r.source_id: (r.due, r.interval, r.why) for r in crawl.due(states, F.lit(now)).collect()}
    assert got == {"a": (False, 3, "wait"), "b": (True, 1, "interval"), "c": (True, 1, "error"), "d": (True, 1, "never"), "e": (False, 7, "wait")}


def _recheck_by_hand(nights):
    s = {"checked": None, "failures": 0, "waiting": None, "tried": None, "again": 0}
    for night, result in nights:
        if s["waiting"] and (night - s["tried"]).days < 7:
            continue
        if result == "ok":
            s.update(checked=night, failures=0, waiting=None, tried=None)
        elif result == "fail":
            s["failures"] += 1
            s.update(waiting=None, tried=night)
            if s["failures"] >= 3:
                s.update(checked=night, failures=0, tried=None, again=s["again"] + 1)
        else:
            s.update(waiting=s["waiting"] or night, tried=night)
    return s["checked"], s["failures"], s["waiting"], s["again"]


def test_recheck_is_the_loop(spark):
    rng, rows = random.Random(3), []
    for key in range(40):
        rows += [(key, date(2026, 9, 1) + timedelta(days=i), rng.choice(["ok", "fail", "fail", "fail", "skip", "unreachable"])) for i in range(30) if rng.random() < 0.8]
    got = {r.key: (r.checked_on, r.failures, r.waiting_since, r.reselected) for r in crawl.recheck(spark.createDataFrame(rows, "key int, night date, result string")).collect()}
    for key in range(40):
        assert got[key] == _recheck_by_hand([(n, r) for k, n, r in rows if k == key]), key


def test_guard_keeps_its_baseline(spark):
    shares = [10, 11, 40, 12, 41, 13]
    days = spark.createDataFrame([("m", date(2026, 9, 1 + i), s, 100) for i, s in enumerate(shares)], "metric string, day date, count long, total long")
    got = [(r.ok, r.baseline) for r in crawl.guard(days, 0.05).orderBy("day").collect()]
    assert got == [(True, None), (True, 0.1), (False, 0.11), (True, 0.11), (False, 0.12), (True, 0.12)]


def test_replaced_days_without_fresh_rows_go(spark):
    from tideglass.plans.search import replace_days

    f = "day date, page string, clicks long, impressions long, position long"
    d1, d2, d3 = date(2026, 1, 1), date(2026, 1, 2), date(2026, 1, 3)
    stored = spark.createDataFrame([(d1, "a", 1, 1, 1), (d2, "a", 1, 1, 1), (d3, "a", 1, 1, 1)], f)
    fresh = spark.createDataFrame([(d2, "b", 2, 2, 2)], f)
    days = spark.createDataFrame([(d2,), (d3,)], "day date")
    assert sorted((r.day, r.page) for r in replace_days(stored, fresh, days).collect()) == [(d1, "a"), (d2, "b")]


def test_calendar(spark):
    names = {r.day: r.name for r in calendar.holidays(spark, 2019, 2027).collect()}
    assert names[date(2026, 9, 21)] == "敬老の日" and names[date(2026, 9, 22)] == calendar.BRIDGE and names[date(2026, 9, 23)] == "秋分の日"
    assert names[date(2026, 5, 6)] == calendar.SUBSTITUTE and date(2019, 2, 23) not in names and date(2020, 2, 24) in names
    days = {r.day: r.next_business for r in calendar.days(spark, 2026, 2026).collect()}
    assert days[date(2026, 9, 19)] == date(2026, 9, 24)


def test_opening(spark):
    places = spark.createDataFrame([(1, 0, "next_day", date(2026, 8, 1), True, False), (2, 0, "next_weekday", date(2026, 8, 1), True, False), (3, 0, "unspecified", date(2026, 8, 1), True, False), (4, 0, "closed", date(2026, 8, 1), True, True)], "place int, weekday int, behavior string, rule_at date, hours boolean, stale boolean")
    notices = spark.createDataFrame([(3, date(2026, 9, 28), date(2026, 9, 28), "open", date(2026, 9, 1))], "place int, from_day date, to_day date, kind string, at date")
    got = {(r.place, r.day.day): r.state for r in calendar.resolve(places, notices, calendar.days(spark, 2026, 2026)).filter("month(day) = 9").collect()}
    assert [got[1, d] for d in (14, 21, 22, 23, 24)] == ["closed", "open", "unknown", "open", "open"]
    assert [got[2, d] for d in (21, 22, 23, 24)] == ["open", "open", "open", "closed"]
    assert (got[3, 21], got[3, 28], got[4, 3]) == ("unknown", "open", "unknown")


def test_stream_agrees_with_table(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"u{rng.randrange(5)}", i, rng.choice([200, 200, 304, 500]), rng.choice("abc")) for i in range(60)]
    kind = "url string, seq long, status int, digest string"
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], kind).coalesce(1).write.json(str(tmp_path / f"in/{part}"))
        log = spark.readStream.schema(kind).json(str(tmp_path / "in/*"))
        query = changes.detect(log).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = {(r.url, r.seq): (r.changed, r.errors) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.url, r.seq): (r.changed, r.errors) for r in crawl.detect_changes(spark.createDataFrame(rows, kind), "url", ["seq"], "status", "digest").collect()}
    assert got == want

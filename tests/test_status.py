"""Days resolved from texts. In September 2026 the 19th is a Saturday, and 21 (Monday), 22 and 23 are holidays in a row."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tideglass.functions import schedule
from tideglass.operators import status

TEN_TO_FIVE = "10:00〜17:00（入館は16:30まで）"
NOTICE = "place long, from_day date, to_day date, kind string, fetched_at timestamp"


@pytest.fixture(scope="module")
def calendar(spark):
    return status.dimension(status.layered(spark, 2026, 2027)).cache()


def resolved(spark, calendar, cases, first, last, notices=(), **more):
    """state and codes by (place, day). cases: closures, hours, service days, evidence_at, fetched_at of places 0, 1, ..."""
    rows = [(i, *(c + (None,) * (5 - len(c)))) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "place long, closing string, open string, service string, evidence_at timestamp, fetched_at timestamp")
    parsed = df.select("place", "evidence_at", "fetched_at", schedule.parse_closures(F.col("closing"))["value"].alias("closures"), schedule.parse_opening_hours(F.col("open"))["value"].alias("hours"), schedule.parse_service_days(F.col("service"))["value"].alias("service_days"))
    told = spark.createDataFrame([(p, date.fromisoformat(a), date.fromisoformat(z), k, at) for p, a, z, k, at in notices], NOTICE)
    got = status.resolve(parsed, told, calendar, first, last, **more).collect()
    return {(r.place, str(r.day)): (r.state, list(r.codes), [(p.start, p.end) for p in r.periods]) for r in got}


OPEN = lambda *codes: ("open", ["regular_hours", *codes], [(600, 1020)])
CLOSED = lambda *codes: ("closed", list(codes), [])
UNKNOWN = lambda *codes: ("unknown", list(codes), [])


def test_rules_and_holidays(spark, calendar):
    cases = [(c, TEN_TO_FIVE) for c in ("月曜日（祝日の場合は翌日）", "月曜日（祝日の場合は翌平日）", "月曜日（祝日の場合は開館）", "月曜日（祝日に関する記載あり）", "月曜日", "第3月曜日（祝日の場合は翌平日）", "不定休", "年中無休", "9月12日〜13日", "第2土曜、火曜", None)]
    got = resolved(spark, calendar, cases, "2026-09-12", "2026-09-24")
    want = {
        0: {"2026-09-12": OPEN(), "2026-09-14": CLOSED("weekly_closed"), "2026-09-21": OPEN("holiday_open_exception"), "2026-09-22": UNKNOWN("substitute_ambiguous"), "2026-09-23": OPEN(), "2026-09-24": OPEN()},
        1: {"2026-09-14": CLOSED("weekly_closed"), "2026-09-15": OPEN(), "2026-09-21": OPEN("holiday_open_exception"), "2026-09-22": OPEN(), "2026-09-23": OPEN(), "2026-09-24": CLOSED("substitute_closed")},
        2: {"2026-09-14": CLOSED("weekly_closed"), "2026-09-21": OPEN("holiday_open_exception"), "2026-09-22": OPEN(), "2026-09-24": OPEN()},
        3: {"2026-09-14": CLOSED("weekly_closed"), "2026-09-21": UNKNOWN("substitute_ambiguous")},
        4: {"2026-09-14": CLOSED("weekly_closed"), "2026-09-21": CLOSED("weekly_closed")},
        5: {"2026-09-14": OPEN(), "2026-09-21": OPEN("holiday_open_exception"), "2026-09-24": CLOSED("substitute_closed")},
        6: {"2026-09-14": UNKNOWN("irregular_closed")},
        7: {"2026-09-14": OPEN(), "2026-09-21": OPEN()},
        8: {"2026-09-12": CLOSED("annual_closed"), "2026-09-13": CLOSED("annual_closed"), "2026-09-14": OPEN()},
        9: {"2026-09-12": CLOSED("nth_weekday_closed"), "2026-09-15": CLOSED("weekly_closed"), "2026-09-19": OPEN()},
        10: {"2026-09-14": OPEN()},
    }
    assert {(p, d): got[p, d] for p, days in want.items() for d in days} == {(p, d): v for p, days in want.items() for d, v in days.items()}


def test_hours_and_service_days(spark, calendar):
    cases = [(None, "7月〜8月 9:00〜17:00"), (None, None), (None, "入園自由"), (None, "土日祝 9:00〜18:00"), (None, TEN_TO_FIVE, "土休日ダイヤ"), ("月曜", TEN_TO_FIVE, "平日ダイヤ"), (None, "9:00〜12:00 13:00〜17:00")]
    got = resolved(spark, calendar, cases, "2026-09-18", "2026-09-21")
    assert got[0, "2026-09-18"] == UNKNOWN("no_data") and got[1, "2026-09-18"] == UNKNOWN("no_data") and got[2, "2026-09-18"] == ("open", ["always_open"], [])
    assert got[3, "2026-09-18"] == UNKNOWN("no_data") and got[3, "2026-09-21"] == ("open", ["regular_hours"], [(540, 1080)])
    assert got[4, "2026-09-18"] == CLOSED("not_in_service") and got[4, "2026-09-21"] == OPEN()
    assert got[5, "2026-09-18"] == OPEN() and got[5, "2026-09-21"] == CLOSED("not_in_service")
    assert got[6, "2026-09-18"] == ("open", ["regular_hours"], [(540, 720), (780, 1020)])


def test_notices(spark, calendar):
    at = lambda d: datetime(2026, 9, d)
    cases = [("月曜", TEN_TO_FIVE, None, at(1))] * 7 + [("月曜", TEN_TO_FIVE)]
    notices = [
        (0, "2026-09-15", "2026-09-16", "closed", None), (1, "2026-09-14", "2026-09-14", "open", at(2)), (2, "2026-09-14", "2026-09-14", "open", at(1)), (3, "2026-09-14", "2026-09-14", "open", None), (4, "2026-09-15", "2026-09-15", "closed", at(3)),
        (4, "2026-09-15", "2026-09-15", "open", at(4)), (5, "2026-09-15", "2026-09-15", "closed", at(3)), (5, "2026-09-15", "2026-09-15", "open", at(3)), (6, "2026-09-15", "2026-09-15", "schedule_change", at(3)), (7, "2026-09-14", "2026-12-14", "open", at(1)), (99, "2026-09-14", "2026-09-14", "open", at(1)),
    ]
    got = resolved(spark, calendar, cases, "2026-09-14", "2026-09-16", notices)
    assert got[0, "2026-09-15"] == CLOSED("special_closure_notice") and got[0, "2026-09-14"] == CLOSED("weekly_closed")
    assert got[1, "2026-09-14"] == OPEN("weekly_closed", "special_open_notice", "conflicting")
    assert got[2, "2026-09-14"] == got[3, "2026-09-14"] == UNKNOWN("weekly_closed", "special_open_notice", "conflicting")
    assert got[4, "2026-09-15"] == OPEN("special_closure_notice", "special_open_notice")
    assert got[5, "2026-09-15"] == UNKNOWN("special_closure_notice", "special_open_notice", "conflicting")
    assert got[6, "2026-09-15"] == OPEN() and got[7, "2026-09-14"] == OPEN("weekly_closed", "special_open_notice", "conflicting")


def test_stale_sources(spark, calendar):
    cases = [("月曜", TEN_TO_FIVE, None, None, datetime(2026, 9, d)) for d in (1, 2)] + [("月曜", TEN_TO_FIVE)]
    got = resolved(spark, calendar, cases, "2026-09-15", "2026-09-15", now=F.lit(datetime(2026, 9, 15)), stale_after_days=14)
    assert got == {(0, "2026-09-15"): UNKNOWN("stale_source", "regular_hours"), (1, "2026-09-15"): OPEN(), (2, "2026-09-15"): UNKNOWN("stale_source", "regular_hours")}


def test_layers_of_holidays(spark):
    primary = spark.createDataFrame([(date(2026, 1, 1), "元日"), (date(2105, 1, 1), "元日")], "day date, name string")
    extra = spark.createDataFrame([(date(2026, 9, 25), "開館記念日"), (date(2103, 5, 5), "x")], "day date, name string")
    got = {str(r.day): (r.name, r.covered) for r in status.layered(spark, 2026, 2105, primary, extra).collect()}
    assert got["2026-09-21"] == (None, True) and got["2026-01-01"] == ("元日", True) and got["2026-09-25"] == ("開館記念日", True)
    assert got["2027-01-01"] == ("元日", True) and got["2101-01-01"] == (None, False) and got["2103-05-05"] == ("x", True) and got["2105-01-02"] == (None, True)


def test_years_without_holidays(spark):
    """Where holidays are unknown, only what doesn't hang on them is told."""
    calendar = status.dimension(status.layered(spark, 2105, 2105))
    cases = [("月曜", TEN_TO_FIVE), ("月曜（祝日の場合は翌日）", TEN_TO_FIVE), (None, TEN_TO_FIVE, "土休日ダイヤ"), (None, "平日 9:00〜17:00")]
    got = resolved(spark, calendar, cases, "2105-06-01", "2105-06-02")
    monday = "2105-06-01"
    assert date.fromisoformat(monday).weekday() == 0
    assert got[0, monday] == CLOSED("weekly_closed") and got[1, monday] == UNKNOWN("holiday_unknown") and got[1, "2105-06-02"] == UNKNOWN("holiday_unknown")
    assert got[2, monday] == got[3, monday] == UNKNOWN("holiday_unknown")


def test_week_of_a_place(spark, calendar):
    places = spark.createDataFrame([(1,), (1,)], "place long").select("place", schedule.parse_closures(F.lit("月曜"))["value"].alias("closures"), schedule.parse_opening_hours(F.lit(TEN_TO_FIVE))["value"].alias("hours"), schedule.parse_service_days(F.lit(""))["value"].alias("service_days"), F.lit(None).cast("timestamp").alias("evidence_at"), F.lit(None).cast("timestamp").alias("fetched_at"))
    none = spark.createDataFrame([], NOTICE)
    assert sorted(r.state for r in status.resolve_days(places, none, calendar, "2026-09-12").collect()) == ["closed"] * 2 + ["open"] * 12
    assert status.resolve_days(places.limit(0), none, calendar, "2026-09-12").count() == 0

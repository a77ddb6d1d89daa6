"""Whether a place is open on a day, by its service days, closing rules, notices and hours, with the reasons.

A calendar dimension has one row for each day, with the holiday on it, whether holidays of its year are known at all, the next business
day, and what is known of the seven days before it. Places meet it by day, so that each place and day is decided within its row. What can't be told
is unknown, never open or closed.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideglass.functions.base import once
from tideglass.functions.schedule import in_span, selects
from tideglass.operators.calendar import FROM_YEAR, TO_YEAR, holidays, nth_of_weekday

#: Days looked ahead for a business day, and back for a day whose closing may have moved.
AHEAD, BACK = 10, 7
CODES = {"weekly": "weekly_closed", "nth_weekday": "nth_weekday_closed"}


def layered(spark: SparkSession, first: int, last: int, primary: DataFrame | None = None, extra: DataFrame | None = None) -> DataFrame:
    """day, name (NULL for no holiday), covered: of each day from the year ``first`` to ``last``.

    Days of ``extra`` (day, name) beat all else. In years that ``primary`` has days of, these are all holidays; other years are computed, where the rules hold. A day of neither is not covered.
    """
    whole = spark.range(1).select(F.explode(F.sequence(F.make_date(F.lit(first), F.lit(1), F.lit(1)), F.make_date(F.lit(last), F.lit(12), F.lit(31)))).alias("day"))
    computed = holidays(spark, max(first, FROM_YEAR), min(last, TO_YEAR)).select("day", F.col("name").alias("computed")) if first <= TO_YEAR and last >= FROM_YEAR else None
    days = whole.join(computed, "day", "left") if computed is not None else whole.withColumn("computed", F.lit(None).cast("string"))
    listed = F.lit(False)
    if primary is not None:
        years = primary.select(F.year("day").alias("y")).distinct().withColumn("listed", F.lit(True))
        days = days.join(primary.groupBy("day").agg(F.max("name").alias("primary")), "day", "left").join(years, F.year("day") == F.col("y"), "left")
        listed = F.coalesce("listed", F.lit(False))
    else:
        days = days.withColumn("primary", F.lit(None).cast("string"))
    if extra is not None:
        days = days.join(extra.groupBy("day").agg(F.max("name").alias("extra")), "day", "left")
    else:
        days = days.withColumn("extra", F.lit(None).cast("string"))
    name = F.coalesce("extra", F.when(listed, F.col("primary")).otherwise(F.col("computed")))
    return days.select("day", name.alias("name"), (F.col("extra").isNotNull() | listed | F.year("day").between(FROM_YEAR, TO_YEAR)).alias("covered"))


def dimension(layers: DataFrame) -> DataFrame:
    """The days of ``layered`` with next_business (NULL if a day that isn't covered comes first) and back: array of the days before, the nearest first, each with day, holiday
    (name), covered and target, the first business day after it. It has a row for each day of some years, so its windows are bounded."""
    by_day = Window.orderBy("day")
    ahead = by_day.rowsBetween(0, AHEAD - 1)
    business = F.min(F.when(F.col("covered") & F.col("name").isNull() & (F.weekday("day") < 5), F.col("day"))).over(ahead)
    unknown = F.min(F.when(~F.col("covered"), F.col("day"))).over(ahead)
    known = layers.withColumn("next_business", F.when(unknown.isNull() | (business < unknown), business))
    known = known.withColumn("_target", F.lead("next_business").over(by_day))
    before = F.collect_list(F.struct("day", F.col("name").alias("holiday"), "covered", F.col("_target").alias("target"))).over(by_day.rowsBetween(-BACK, -1))
    return known.select("day", "name", "covered", "next_business", F.reverse(before).alias("back"))


def _hits(rule: Column, day: Column) -> Column:
    """Whether a weekday rule hits a day, whatever the holidays."""
    return F.array_contains(rule["weekdays"], F.weekday(day)) & ((rule["kind"] != "nth_weekday") | F.array_contains(rule["nths"], nth_of_weekday(day)))


def _said(state: str | None, code: Column | str) -> Column:
    return F.struct(F.lit(state).cast("string").alias("state"), (F.lit(code) if isinstance(code, str) else code).cast("string").alias("code"))


def rule_verdict(rule: Column, day: Column, name: Column, covered: Column, back: Column) -> Column:
    """state and code of what one closing rule says of a day; NULL if nothing."""
    behavior, own_code = rule["holiday_behavior"], F.coalesce(*[F.when(rule["kind"] == k, c) for k, c in CODES.items()])
    own = (
        F.when(behavior == "closed", _said("closed", own_code))
        .when(~covered, _said("unknown", "holiday_unknown"))
        .when(name.isNull(), _said("closed", own_code))
        .when(behavior == "unspecified", _said("unknown", "substitute_ambiguous"))
        .otherwise(_said("open", "holiday_open_exception"))
    )
    previous = F.try_element_at(back, F.lit(1))
    next_day = F.when(_hits(rule, previous["day"]) & previous["holiday"].isNotNull(), F.when(name.isNotNull(), _said("unknown", "substitute_ambiguous")).otherwise(_said("closed", "substitute_closed")))
    # the nearest day before that the rule hits decides
    nearest = F.try_element_at(F.filter(back, lambda b: _hits(rule, b["day"])), F.lit(1))
    moved = F.when(nearest["target"].isNull(), _said("unknown", "substitute_ambiguous")).when(nearest["target"] == day, _said("closed", "substitute_closed"))
    next_weekday = F.when(nearest["holiday"].isNotNull(), moved)
    substitute = F.when(behavior.isin("next_day", "next_weekday"), F.when(~covered, _said("unknown", "holiday_unknown")).when(behavior == "next_day", next_day).otherwise(next_weekday))
    return (
        F.when(rule["kind"] == "irregular", _said("unknown", "irregular_closed"))
        .when(rule["kind"] == "annual_span", F.when(in_span(rule["annual"], day), _said("closed", "annual_closed")))
        .when(rule["kind"] == "dates", F.when(F.array_contains(rule["dates"], day), _said("closed", "date_closed")))
        .when(_hits(rule, day), own)
        .otherwise(substitute)
    )


def evaluate_closures(rules: Column, day: Column, name: Column, covered: Column, back: Column) -> Column:
    """state and codes: closed if a rule says so, else unknown if one says so, else open; exceptions come last."""
    said = F.filter(F.transform(rules, lambda r: rule_verdict(r, day, name, covered, back)), lambda v: v["code"].isNotNull())

    def settled(v: Column) -> Column:
        of = lambda s: F.transform(F.filter(v, lambda x: x["state"] == s), lambda x: x["code"])
        state = F.when(F.size(of("closed")) > 0, "closed").when(F.size(of("unknown")) > 0, "unknown").otherwise("open")
        first = F.when(state == "closed", of("closed")).when(state == "unknown", of("unknown")).otherwise(F.expr("cast(array() as array<string>)"))
        return F.struct(state.alias("state"), F.concat(first, of("open")).alias("codes"))

    return once(F.coalesce(said, F.expr("cast(array() as array<struct<state:string,code:string>>)")), settled)


def notice_states(notices: DataFrame, first: Column, last: Column) -> DataFrame:
    """place, day, notice (closed, open or unknown), notice_codes, notice_at of the days from ``first`` to ``last`` that notices tell of.

    notices: place, from_day, to_day, kind (closed, open, schedule_change), fetched_at. Changes of schedule say nothing of a day. Of both kinds the newer counts; if neither is, the day is unknown.
    """
    told = notices.filter(F.col("kind").isin("closed", "open"))
    told = told.withColumns({"_a": F.greatest("from_day", first), "_z": F.least("to_day", last)}).filter("_a <= _z")
    days = told.select("place", "kind", "fetched_at", F.explode(F.sequence("_a", "_z")).alias("day"))
    newest = lambda k: F.max(F.when(F.col("kind") == k, F.col("fetched_at")))
    n = lambda k: F.count_if(F.col("kind") == k)
    one = days.groupBy("place", "day").agg(n("closed").alias("n_closed"), n("open").alias("n_open"), newest("closed").alias("closed_at"), newest("open").alias("open_at"))
    both = (F.col("n_closed") > 0) & (F.col("n_open") > 0)
    settled = F.when(F.col("closed_at") > F.col("open_at"), "closed").when(F.col("open_at") > F.col("closed_at"), "open").otherwise("unknown")
    codes = F.concat(F.array_repeat(F.lit("special_closure_notice"), F.col("n_closed").cast("int")), F.array_repeat(F.lit("special_open_notice"), F.col("n_open").cast("int")))
    return one.select("place", "day", F.when(both, settled).when(F.col("n_closed") > 0, "closed").otherwise("open").alias("notice"), F.when(both & (settled == "unknown"), F.array_append(codes, F.lit("conflicting"))).otherwise(codes).alias("notice_codes"), F.greatest("closed_at", "open_at").alias("notice_at"))


def is_stale(fetched_at: Column, now: Column, days: int) -> Column:
    """What was never fetched is stale, and what was fetched so many days ago or more."""
    return fetched_at.isNull() | (F.expr(f"INTERVAL {days} DAYS") <= now - fetched_at)


def resolve(places: DataFrame, notices: DataFrame, calendar: DataFrame, first: str, last: str, now: Column | None = None, stale_after_days: int | None = None) -> DataFrame:
    """place, day, state (open, closed, unknown), codes (the reasons in order), periods (the times of an open day).

    places: place, hours (periods of ``parse_opening_hours``), closures (rules of ``parse_closures``), service_days (a selector or NULL), evidence_at (when the newest evidence of rules and hours was
    fetched), fetched_at. notices as in ``notice_states``. calendar: ``dimension``. First come the service days: a day outside them is closed. Then the rules; a notice beats
    them, but an opening notice beats a closing rule only if it is newer, and leaves the day unknown otherwise. An open day needs hours. Last, what is stale is unknown, for whatever reasons were found.
    Arrays that are NULL count as empty; a place that occurs more than once is resolved for each row.
    """
    a, z = F.lit(first).cast("date"), F.lit(last).cast("date")
    rows = places.withColumn("day", F.explode(F.sequence(a, z)))
    rows = rows.join(F.broadcast(calendar.filter(F.col("day").between(a, z))), "day").join(notice_states(notices, a, z), ["place", "day"], "left")
    day, name, covered = F.col("day"), F.col("name"), F.col("covered")
    is_holiday = F.when(covered, name.isNotNull())
    none = F.expr("cast(array() as array<string>)")
    ruled = F.when(F.coalesce(F.size("closures"), F.lit(0)) > 0, evaluate_closures(F.col("closures"), day, name, covered, F.col("back"))).otherwise(F.struct(F.lit("open").alias("state"), none.alias("codes")))
    rows = rows.withColumn("rule", ruled).withColumn("served", F.when(F.col("service_days").isNull(), True).otherwise(selects(F.col("service_days"), day, is_holiday)))
    # the periods of the day, with whether they apply: NULL where that hangs on unknown holidays
    applies = lambda p: F.when(p["season"].isNotNull() & ~in_span(p["season"], day), False).otherwise(selects(p["days"], day, is_holiday))
    hours = F.transform("hours", lambda p: F.struct(applies(p).alias("applies"), p["ranges"].alias("ranges"), p["always_open"].alias("always")))
    rows = rows.withColumn("hour", once(hours, lambda h: F.struct(F.flatten(F.transform(F.filter(h, lambda p: p["applies"]), lambda p: p["ranges"])).alias("ranges"), F.exists(h, lambda p: p["applies"].isNull()).alias("undecided"), F.exists(h, lambda p: F.coalesce(p["applies"], F.lit(False)) & p["always"]).alias("always"))))
    newer = F.col("notice_at").isNotNull() & (F.col("evidence_at").isNull() | (F.col("notice_at") > F.col("evidence_at")))
    conflict = (F.col("notice") == "open") & (F.col("rule.state") == "closed")
    state = F.when(F.col("notice").isNull(), F.col("rule.state")).when(conflict, F.when(newer, "open").otherwise("unknown")).otherwise(F.col("notice"))
    codes = F.concat(F.col("rule.codes"), F.coalesce("notice_codes", none), F.when(conflict, F.array(F.lit("conflicting"))).otherwise(none))
    rows = rows.withColumn("told", state).withColumn("codes", codes)
    n_ranges = F.coalesce(F.size("hour.ranges"), F.lit(0))
    timed = (
        F.when(F.coalesce("hour.always", F.lit(False)), F.struct(F.lit("open").alias("state"), F.concat(F.array(F.lit("always_open")), "codes").alias("codes")))
        .when(n_ranges > 0, F.struct(F.lit("open").alias("state"), F.concat(F.array(F.lit("regular_hours")), "codes").alias("codes")))
        .when(F.coalesce("hour.undecided", F.lit(False)), F.struct(F.lit("unknown").alias("state"), F.array_append("codes", F.lit("holiday_unknown")).alias("codes")))
        .otherwise(F.struct(F.lit("unknown").alias("state"), F.array_append("codes", F.lit("no_data")).alias("codes")))
    )
    final = (
        F.when(F.col("served").isNull(), F.struct(F.lit("unknown").alias("state"), F.array(F.lit("holiday_unknown")).alias("codes")))
        .when(~F.col("served"), F.struct(F.lit("closed").alias("state"), F.array(F.lit("not_in_service")).alias("codes")))
        .when(F.col("told") == "open", timed)
        .otherwise(F.struct(F.col("told").alias("state"), F.col("codes").alias("codes")))
    )
    rows = rows.withColumn("final", final)
    stale = F.lit(False) if stale_after_days is None else is_stale(F.col("fetched_at"), now if now is not None else F.current_timestamp(), stale_after_days)
    shown = (F.col("final.state") == "open") & ~stale
    return rows.select(
        "place", "day", F.when(stale, "unknown").otherwise(F.col("final.state")).alias("state"), F.when(stale, F.concat(F.array(F.lit("stale_source")), "final.codes")).otherwise(F.col("final.codes")).alias("codes"),
        F.when(shown, F.coalesce("hour.ranges", F.expr("cast(array() as array<struct<start:int,end:int,last_entry:int>>)"))).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,last_entry:int>>)")).alias("periods"),
    )


def resolve_days(places: DataFrame, notices: DataFrame, calendar: DataFrame, start: str, n: int = 7, **more: object) -> DataFrame:
    """``resolve`` for ``n`` days from ``start`` on."""
    return resolve(places, notices, calendar, start, str(date.fromisoformat(start) + timedelta(days=n - 1)), **more)

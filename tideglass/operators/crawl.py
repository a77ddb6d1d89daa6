"""Keyed state of a crawl: what is due, what changed, what has been read, and records that are merged into history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days since the last change up to which a source is fresh, and is slow; the intervals in days for each.
FRESH, SLOW, INTERVALS, SLACK = 7, 28, (1, 3, 7), 0.25


def days_between(later: Column, earlier: Column) -> Column:
    """Fraction of days, from microseconds."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000)


def interval_days(since_change: Column) -> Column:
    """1, 3 or 7 days by how long ago the last change was; 1 if none was ever seen."""
    return F.when(since_change.isNull() | (since_change < FRESH), INTERVALS[0]).when(since_change < SLOW, INTERVALS[1]).otherwise(INTERVALS[2])


def due(states: DataFrame, now: Column) -> DataFrame:
    """source_id, due, interval, why, of states with source_id, fetched_at, changed_at and error.

    A source is due if a page of it had an error or none was fetched, and else once its interval, less a quarter of a day, has gone by since the last fetch.
    """
    per = states.groupBy("source_id").agg(F.max("fetched_at").alias("fetched"), F.max("changed_at").alias("changed"), F.bool_or(F.col("error").isNotNull()).alias("failed"))
    interval = interval_days(days_between(now, F.col("changed")))
    since = days_between(now, F.col("fetched"))
    why = F.when(F.col("failed"), "error").when(F.col("fetched").isNull(), "never").when(since >= interval - SLACK, "interval").otherwise("wait")
    shown = F.when(F.col("failed") | F.col("fetched").isNull(), INTERVALS[0]).otherwise(interval)
    return per.select("source_id", (why != "wait").alias("due"), shown.alias("interval"), why.alias("why"))


def detect_changes(log: DataFrame, key: str, order: list[str], status: str, digest: str) -> DataFrame:
    """Adds last_hash, changed and errors to a log of fetches.

    A fetch with status 200 changes a page if its digest differs from that of the last such fetch (or there is none); 304 and errors keep the old one. errors
    counts the errors since the last fetch that wasn't one.
    """
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ok, fine = F.col(status) == 200, F.col(status).isin(200, 304)
    had = F.last(F.when(ok, F.col(digest)), ignorenulls=True)
    seen = log.withColumn("_had", had.over(before)).withColumn("last_hash", had.over(upto)).withColumn("_run", F.count(F.when(fine, 1)).over(upto))
    in_run = Window.partitionBy(key, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = seen.withColumn("changed", ok & ~F.col(digest).eqNullSafe(F.col("_had"))).withColumn("errors", F.count(F.when(~fine, 1)).over(in_run))
    return seen.drop("_had", "_run")


def page_read_at(error: Column, fetched_at: Column, content: Column, extracted: Column) -> Column:
    """When a page was last read; NULL unless it was fetched without an error and what was extracted is what it holds now."""
    return F.when(error.isNull() & (content == extracted), fetched_at)


def read_at(wanted: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """key, read_at: the oldest reading of all pages of a key; NULL if one of them lacks one. ``wanted`` has key and url, states url and page_read."""
    joined = wanted.filter("url IS NOT NULL").distinct().join(states, "url", "left")
    return joined.groupBy(key).agg(F.when(F.count("*") == F.count("page_read"), F.min("page_read")).alias("read_at"))


def upsert(old: DataFrame, new: DataFrame, key: str, fields: list[str], now: Column) -> DataFrame:
    """Records after a night: event (created, updated, unchanged, unseen), changed fields, status and the two dates.

    Both have the key and the fields; old also has status, first_seen_at and last_seen_at. A field that differs (NULL counts as a value) takes the new value; a stale
    record that is seen again becomes active, which is a change. Records that aren't in ``new`` stay as they are.
    """
    o, n = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    created, seen = F.col(f"o.{key}").isNull(), F.col("n._new").isNotNull()
    differ = [F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), F.lit(f)) for f in sorted(fields)]
    revived = F.when(F.col("o.status") == "stale", F.lit("status"))
    changed = F.when(~created & seen, F.array_compact(F.array(*differ, revived))).otherwise(F.array().cast("array<string>"))
    event = F.when(created, "created").when(~seen, "unseen").when(F.size(changed) > 0, "updated").otherwise("unchanged")
    values = [F.when(seen, F.col(f"n.{f}")).otherwise(F.col(f"o.{f}")).alias(f) for f in fields]
    return both.select(
        F.coalesce(f"o.{key}", f"n.{key}").alias(key), event.alias("event"), changed.alias("changed"), *values,
        F.when(created | (seen & (F.col("o.status") == "stale")), "active").otherwise(F.col("o.status")).alias("status"),
        F.coalesce("o.first_seen_at", now).alias("first_seen_at"), F.when(seen, now).otherwise(F.col("o.last_seen_at")).alias("last_seen_at"),
    )


def mark_stale(records: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Active records that weren't seen for ``days`` days become stale; none is deleted."""
    old = (F.col("status") == "active") & (F.col("last_seen_at") < now - F.expr(f"INTERVAL {days} DAYS"))
    return records.withColumn("status", F.when(old, "stale").otherwise(F.col("status")))


def ledger(stored: DataFrame, built: DataFrame, today: Column, relearn: bool = False) -> DataFrame:
    """path, fingerprint, lastmod, how (added, kept, relearned, changed) of the pages that were built.

    stored: path, fingerprint, lastmod; built: path, fingerprint, first_seen. The date of a new page is its first day but never a later one than today; it
    moves to today if the fingerprint changes, but not in a build whose layout changed. Pages that weren't built are dropped.
    """
    s, b = stored.alias("s"), built.alias("b")
    joined = b.join(s, F.col("b.path") == F.col("s.path"), "left")
    how = F.when(F.col("s.path").isNull(), "added").when(F.col("s.fingerprint") == F.col("b.fingerprint"), "kept").otherwise("relearned" if relearn else "changed")
    day = F.when(how == "added", F.least("b.first_seen", today)).when(how == "changed", today).otherwise(F.col("s.lastmod"))
    return joined.select("b.path", "b.fingerprint", day.alias("lastmod"), how.alias("how"))


def guard(days: DataFrame, max_rise: float, max_share: float | None = None) -> DataFrame:
    """day, share, baseline, ok for each metric, in the order of the days: metric, day, count, total.

    A day passes if its share isn't over the limit and hasn't risen by more than ``max_rise`` from the last day that passed; only passing days become the baseline. Each
    step needs the step before: an ordered fold over one array for each metric, which has as many elements as days.
    """
    ordered = days.groupBy("metric").agg(F.array_sort(F.collect_list(F.struct("day", F.when(F.col("total") > 0, F.col("count") / F.col("total")).otherwise(0.0).alias("share")))).alias("days"))
    kind = "array<struct<day:date,share:double,baseline:double,ok:boolean>>"
    start = F.struct(F.lit(None).cast("double").alias("base"), F.array().cast(kind).alias("out"))

    def step(acc: Column, d: Column) -> Column:
        over = F.lit(False) if max_share is None else d["share"] > max_share
        ok = ~(over | F.coalesce(d["share"] - acc["base"] > max_rise, F.lit(False)))
        row = F.struct(d["day"].alias("day"), d["share"].alias("share"), acc["base"].alias("baseline"), ok.alias("ok"))
        return F.struct(F.when(ok, d["share"]).otherwise(acc["base"]).alias("base"), F.array_append(acc["out"], row).alias("out"))

    folded = ordered.withColumn("rows", F.aggregate("days", start, step, lambda a: a["out"]))
    return folded.select("metric", F.inline("rows"))


#: Nights of failures after which another choice is made; days that an unreachable target waits.
RETRY_NIGHTS, WAIT_DAYS = 3, 7


def recheck(outcomes: DataFrame) -> DataFrame:
    """State of each key after its nights: checked_on, failures, waiting_since, reselected; outcomes are key, night, result.

    ok starts afresh; fail counts a night and on the third another choice is made, which starts afresh too; skip and unreachable begin to wait, or wait on. A night within
    a wait is passed over.
    """
    nights = outcomes.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("night", "result"))).alias("nights"))
    none = F.lit(None).cast("date")
    start = F.struct(none.alias("checked_on"), F.lit(0).alias("failures"), none.alias("waiting_since"), none.alias("last_tried"), F.lit(0).alias("reselected"))

    def step(s: Column, n: Column) -> Column:
        waits = F.coalesce(s["waiting_since"].isNotNull() & (F.datediff(n["night"], s["last_tried"]) < WAIT_DAYS), F.lit(False))
        failures = s["failures"] + 1
        chosen = failures >= RETRY_NIGHTS

        def state(checked: Column, count: Column, waiting: Column, tried: Column, again: Column) -> Column:
            return F.struct(checked.alias("checked_on"), count.alias("failures"), waiting.alias("waiting_since"), tried.alias("last_tried"), again.alias("reselected"))

        fresh = state(n["night"], F.lit(0), none, none, s["reselected"])
        wait = state(s["checked_on"], s["failures"], F.coalesce(s["waiting_since"], n["night"]), n["night"], s["reselected"])
        fail = state(F.when(chosen, n["night"]).otherwise(s["checked_on"]), F.when(chosen, 0).otherwise(failures), none, F.when(chosen, none).otherwise(n["night"]), s["reselected"] + chosen.cast("int"))
        return F.when(waits, s).when(n["result"] == "ok", fresh).when(n["result"] == "fail", fail).otherwise(wait)

    folded = nights.withColumn("s", F.aggregate("nights", start, step))
    return folded.select("key", "s.checked_on", "s.failures", "s.waiting_since", "s.reselected")


def recheck_pick(targets: DataFrame, today: Column, per_night: int, wait_days: int = WAIT_DAYS) -> DataFrame:
    """The targets of a night: those that failed before, outside the quota, then ``per_night`` by their date, never checked ones first, then by key.

    targets: key, checked, failures, waiting_since, last_tried.
    """
    waits = F.col("waiting_since").isNotNull() & F.coalesce(F.datediff(today, "last_tried") < wait_days, F.lit(False))
    open_ = targets.filter(~waits)
    queue = open_.filter("failures = 0").orderBy(F.asc_nulls_first("checked"), "key").limit(per_night)
    return open_.filter("failures > 0").unionByName(queue)

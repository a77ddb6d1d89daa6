"""A holiday calendar as a dimension table, and opening status by rules, notices and hours.

Status is open, closed or unknown; unknown is never taken for either. Dimensions are made by rule and have
a row for each day of the covered years, so their size is bounded by the years.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FROM_YEAR, TO_YEAR = 1980, 2099
# Fixed values: (month, day, name) of the holidays on fixed days; (month, nth Monday, name); names of the others.
FIXED = [(1, 1, "元日"), (2, 11, "建国記念の日"), (4, 29, "昭和の日"), (5, 3, "憲法記念日"), (5, 4, "みどりの日"), (5, 5, "こどもの日"), (8, 11, "山の日"), (11, 3, "文化の日"), (11, 23, "勤労感謝の日")]
MONDAYS = [(1, 2, "成人の日"), (7, 3, "海の日"), (9, 3, "敬老の日"), (10, 2, "スポーツの日")]
EQUINOXES = [(3, 20.8431, "春分の日"), (9, 23.2488, "秋分の日")]
BIRTHDAY = (2020, 2, 23, "天皇誕生日")
SUBSTITUTE, BRIDGE = "休日（振替休日）", "休日（国民の休日）"
#: Days that are looked ahead for a substitute or a business day; no run of holidays is longer.
AHEAD = 10


def named_holidays(spark: SparkSession, first: int = FROM_YEAR, last: int = TO_YEAR) -> DataFrame:
    """day, name by law for each year, without substitutes and bridges."""
    years = spark.range(first, last + 1).select(F.col("id").cast("int").alias("y"))
    past = F.col("y") - 1980
    days = [F.struct(F.make_date("y", F.lit(m), F.lit(d)).alias("day"), F.lit(n).alias("name")) for m, d, n in FIXED]
    for m, nth, n in MONDAYS:
        start = F.make_date("y", F.lit(m), F.lit(1))
        days.append(F.struct(F.date_add(start, F.pmod(-F.weekday(start), F.lit(7)) + 7 * (nth - 1)).alias("day"), F.lit(n).alias("name")))
    for m, base, n in EQUINOXES:
        day = F.floor(F.lit(base) + 0.242194 * past - F.floor(past / 4)).cast("int")
        days.append(F.struct(F.make_date("y", F.lit(m), day).alias("day"), F.lit(n).alias("name")))
    since, m, d, n = BIRTHDAY
    days.append(F.when(F.col("y") >= since, F.struct(F.make_date("y", F.lit(m), F.lit(d)).alias("day"), F.lit(n).alias("name"))))
    return years.select(F.inline(F.array_compact(F.array(*days))))


def holidays(spark: SparkSession, first: int = FROM_YEAR, last: int = TO_YEAR) -> DataFrame:
    """day, name with substitutes (the next day that is none, after a holiday on a Sunday) and bridges (a day between two holidays, no Sunday)."""
    named = named_holidays(spark, first - 1, last + 1).groupBy("day").agg(F.min("name").alias("name"))
    sundays = named.filter(F.weekday("day") == 6).select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(AHEAD)), lambda i: F.struct(F.date_add("day", i).alias("day"), i.alias("i"), F.col("day").alias("sunday")))).alias("c")).select("c.*")
    free = sundays.join(named.select("day"), "day", "left_anti").groupBy("sunday").agg(F.min_by("day", "i").alias("day"))
    known = named.unionByName(free.select("day", F.lit(SUBSTITUTE).alias("name")))
    between = known.select(F.date_sub("day", 1).alias("day")).intersect(named.select(F.date_add("day", 1).alias("day")))
    bridges = between.join(known.select("day"), "day", "left_anti").filter(F.weekday("day") != 6).select("day", F.lit(BRIDGE).alias("name"))
    return known.unionByName(bridges).filter(F.year("day").between(first, last))


def days(spark: SparkSession, first: int, last: int) -> DataFrame:
    """day, name (NULL for none), next_business (the first day from it on that is no Saturday, Sunday or holiday)."""
    whole = spark.range(1).select(F.explode(F.sequence(F.make_date(F.lit(first), F.lit(1), F.lit(1)), F.make_date(F.lit(last), F.lit(12), F.lit(31)))).alias("day"))
    named = whole.join(holidays(spark, first, last), "day", "left")
    business = F.when(F.col("name").isNull() & (F.weekday("day") < 5), F.col("day"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(0, AHEAD)
    return named.withColumn("next_business", F.min(business).over(ahead))


def nth_of_weekday(day: Column) -> Column:
    return (F.floor((F.dayofmonth(day) - 1) / 7) + 1).cast("int")


def rule_state(on: Column, after: Column, name: Column, behavior: Column) -> Column:
    """What a weekly rule says of a day.

    ``on``: the rule's weekday hits the day. ``after``: the state that the day has as a substitute (closed, unknown or NULL). A day that is hit is closed unless
    it is a holiday; then it is open if the rule moves or opens, closed if it says so, and unknown if it says nothing. A day that isn't hit may be a substitute.
    """
    own = F.when((behavior == "closed") | name.isNull(), "closed").when(behavior == "unspecified", "unknown").otherwise("open")
    return F.when(on, own).when(behavior.isin("next_day", "next_weekday"), after)


def resolve(places: DataFrame, notices: DataFrame, calendar: DataFrame) -> DataFrame:
    """place, day, state and reason.

    places: place, weekday (0 is Monday), behavior, rule_at, hours (has opening hours), stale. notices: place, from_day, to_day, kind (closed, open), at. calendar: day, name,
    next_business. closed beats unknown beats open among rules; a notice beats the rule, but an opening notice only if it is newer than the closing rule; two kinds of notices are
    settled by the newer, and unknown if neither is. An open day needs hours; what is stale is unknown.
    """
    cal = F.broadcast(calendar)
    back = calendar.select(F.date_add("day", 1).alias("day"), F.weekday("day").alias("prev_weekday"), F.col("name").alias("prev_name"))
    grid = places.crossJoin(cal).join(F.broadcast(back), "day", "left")
    # the last hit in the seven days before, and where it moves if it is a holiday
    hit = F.date_sub("day", F.pmod(F.weekday("day") - F.col("weekday") - 1, F.lit(7)) + 1)
    moved = calendar.select(F.date_sub("day", 1).alias("hit"), F.col("next_business").alias("target"))
    hits = calendar.select(F.col("day").alias("hit"), F.col("name").alias("hit_name")).join(moved, "hit", "left")
    grid = grid.withColumn("hit", hit).join(F.broadcast(hits), "hit", "left")
    next_day = F.when((F.col("prev_weekday") == F.col("weekday")) & F.col("prev_name").isNotNull(), F.when(F.col("name").isNotNull(), "unknown").otherwise("closed"))
    next_weekday = F.when(F.col("hit_name").isNotNull() & (F.col("target") == F.col("day")), "closed")
    after = F.when(F.col("behavior") == "next_day", next_day).when(F.col("behavior") == "next_weekday", next_weekday)
    grid = grid.withColumn("rule", F.coalesce(rule_state(F.weekday("day") == F.col("weekday"), after, F.col("name"), F.col("behavior")), F.lit("open")))
    told = notices.select(F.col("place").alias("p"), "from_day", "to_day", "kind", "at")
    newest = lambda k: F.max(F.when(F.col("kind") == k, F.col("at")))
    heard = grid.join(told, (F.col("place") == F.col("p")) & F.col("day").between(F.col("from_day"), F.col("to_day")), "left")
    one = heard.groupBy("place", "day").agg(
        *(F.first(c).alias(c) for c in ("rule", "rule_at", "hours", "stale")), F.count_if(F.col("kind") == "closed").alias("n_closed"), F.count_if(F.col("kind") == "open").alias("n_open"), newest("closed").alias("closed_at"), newest("open").alias("open_at")
    )
    both = (F.col("n_closed") > 0) & (F.col("n_open") > 0)
    settled = F.when(F.col("closed_at") > F.col("open_at"), "closed").when(F.col("open_at") > F.col("closed_at"), "open").otherwise("unknown")
    notice = F.when(both, settled).when(F.col("n_closed") > 0, "closed").when(F.col("n_open") > 0, "open")
    fresh = F.coalesce(F.greatest("closed_at", "open_at") > F.col("rule_at"), F.greatest("closed_at", "open_at").isNotNull())
    state = F.when(notice.isNull(), F.col("rule")).when(notice != "open", notice).when(F.col("rule") == "closed", F.when(fresh, "open").otherwise("unknown")).otherwise("open")
    reason = F.when(notice.isNotNull(), "notice").when(F.col("rule") != "open", "rule").otherwise("hours")
    return one.select("place", "day", F.when(F.col("stale"), "unknown").when((state == "open") & ~F.col("hours"), "unknown").otherwise(state).alias("state"), F.when(F.col("stale"), "stale").when((state == "open") & ~F.col("hours"), "no_data").otherwise(reason).alias("reason"))

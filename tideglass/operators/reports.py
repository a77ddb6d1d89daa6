"""Reports over runs, inspections and extractions: rates, stalled hosts, summaries and evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.functions import forms
from tideglass.functions.web import host_of

# What errors of robots rules say, and the verdict of a page that is indexed.
ROBOTS, INDEXED = "robots.txt", "PASS"
STALLED_DAYS = 3


def parsed_rates(runs: DataFrame) -> DataFrame:
    """day, field, parsed, total, rate (NULL for no total). runs: day, fields, a map from field to a struct of parsed and total."""
    each = runs.select("day", F.explode("fields").alias("field", "n"))
    sums = each.groupBy("day", "field").agg(F.sum("n.parsed").alias("parsed"), F.sum("n.total").alias("total"))
    return sums.withColumn("rate", F.try_divide(F.col("parsed"), F.col("total")))


def rate_shift(rates: DataFrame) -> DataFrame:
    """field, first, last: the rates of the first and the last day that have any fields, where both have a total; the largest change first, equal ones by name."""
    ends = rates.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    at = rates.join(F.broadcast(ends), (F.col("day") == F.col("first_day")) | (F.col("day") == F.col("last_day")))
    both = at.groupBy("field").agg(F.max(F.when(F.col("day") == F.col("first_day"), F.col("rate"))).alias("first"), F.max(F.when(F.col("day") == F.col("last_day"), F.col("rate"))).alias("last"))
    return both.filter("first IS NOT NULL AND last IS NOT NULL").orderBy(F.desc(F.abs(F.col("last") - F.col("first"))), "field")


def month_estimate(days: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """minutes and cost of thirty days like those that are there. days: day, seconds, tokens_in, tokens_out."""
    cost = F.sum("tokens_in") / 1e6 * price_in + F.sum("tokens_out") / 1e6 * price_out
    n = F.count("*")
    zero = lambda c: F.when(n == 0, 0.0).otherwise(c / n * 30)
    return days.agg(zero(F.sum("seconds") / 60).alias("minutes"), zero(cost).alias("cost"))


def robots_errors(errors: DataFrame) -> DataFrame:
    """host, n: how often runs left a host out for its robots rules. errors: error, the url before the first colon and space."""
    found = errors.filter(F.col("error").contains(ROBOTS)).select(F.split("error", f": {ROBOTS}", 2)[0].alias("url"))
    return found.groupBy(F.coalesce(F.nullif(host_of(F.col("url")), F.lit("")), F.col("url")).alias("host")).agg(F.count("*").alias("n"))


def stalled_hosts(states: DataFrame, now: Column, seeds: DataFrame | None = None) -> DataFrame:
    """host, age, reason of hosts whose robots rules have kept a page from being fetched for STALLED_DAYS days or ever (NULL, the longest), those first, then by age and host.

    states: url, error, fetched_at. Of a host's pages the longest counts; with ``seeds`` (url) only pages that are still gone to.
    """
    held = states.filter(F.coalesce(F.col("error").contains(ROBOTS), F.lit(False)))
    held = held if seeds is None else held.join(seeds.select("url").distinct(), "url", "left_semi")
    aged = held.select(host_of(F.col("url")).alias("host"), F.floor((F.unix_seconds(now) - F.unix_seconds("fetched_at")) / 86400).cast("int").alias("age"), forms.robots_reason(F.col("error")).alias("reason"), "url")
    worst = aged.groupBy("host").agg(F.max_by(F.struct("age", "reason"), F.struct(F.col("age").isNull(), "age", "url")).alias("w")).select("host", "w.*")
    return worst.filter(F.col("age").isNull() | (F.col("age") >= STALLED_DAYS)).orderBy(F.col("age").isNotNull(), F.desc("age"), "host")


def index_summary(urls: DataFrame, sitemaps: DataFrame, site: DataFrame) -> DataFrame:
    """One row: site_urls, submitted, inspected, indexed, coverage, indexed_share, oldest, newest. urls: url, verdict, checked_on. sitemaps: submitted. site: url."""
    one = urls.agg(F.count("*").alias("inspected"), F.count_if(F.col("verdict") == INDEXED).alias("indexed"), F.min("checked_on").alias("oldest"), F.max("checked_on").alias("newest"))
    told = sitemaps.agg(F.coalesce(F.sum("submitted"), F.lit(0)).alias("submitted"))
    pages = site.agg(F.count("*").alias("site_urls"))
    share = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b))
    return pages.crossJoin(told).crossJoin(one).select("site_urls", "submitted", "inspected", "indexed", share("inspected", "site_urls").alias("coverage"), share("indexed", "inspected").alias("indexed_share"), "oldest", "newest")


def new_keys(facts: DataFrame, start: Column, end: Column) -> DataFrame:
    """key, impressions of pages or queries that were shown from ``start`` to ``end`` and never before, in all history. facts: day, key, impressions."""
    shown = facts.filter("impressions > 0")
    sums = shown.groupBy("key").agg(F.min("day").alias("first"), F.sum(F.when(F.col("day").between(start, end), F.col("impressions"))).alias("impressions"))
    return sums.filter((F.col("first") >= start) & F.col("impressions").isNotNull()).select("key", "impressions")


def evaluate(expected: DataFrame, got: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(field, correct, total, accuracy) over the expected values, and the keys that nothing was found for. Both have case, key and the fields; of several items with a key the first (item) counts."""
    first = got.groupBy("case", "key").agg(*(F.min_by(f, "item").alias(f"_got_{f}") for f in fields), F.lit(True).alias("_found"))
    met = expected.join(first, ["case", "key"], "left")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).isNotNull().alias("asked"), F.coalesce(F.col(f) == F.col(f"_got_{f}"), F.lit(False)).alias("right")) for f in fields])).alias("e")
    per = met.select(each).select("e.*").filter("asked").groupBy("field").agg(F.count_if("right").alias("correct"), F.count("*").alias("total")).withColumn("accuracy", F.try_divide("correct", "total"))
    return per, met.filter(F.col("_found").isNull()).select("case", "key")


def with_history(records: DataFrame, events: DataFrame, key: str, at: Column) -> DataFrame:
    """records with ``history`` grown by what a night did to them. records: history, an array of at, event and fields (or NULL). events: the key, event and changed, as ``crawl.upsert`` gives; only created, updated and stale ones are history."""
    told = events.filter(F.col("event").isin("created", "updated", "stale")).select(F.col(key), F.col("event").alias("_event"), F.col("changed").alias("_changed"))
    entry = F.struct(at.cast("string").alias("at"), F.col("_event").alias("event"), F.col("_changed").alias("fields"))
    had = F.coalesce("history", F.expr("cast(array() as array<struct<at:string,event:string,fields:array<string>>>)"))
    return records.join(told, key, "left").withColumn("history", F.when(F.col("_event").isNotNull(), F.array_append(had, entry)).otherwise(had)).drop("_event", "_changed")


def ranked_states(urls: DataFrame) -> DataFrame:
    """state, n: how many pages are in each state, the most frequent first; pages without one are "none"."""
    return urls.groupBy(F.coalesce(F.nullif("state", F.lit("")), F.lit("none")).alias("state")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "state")


def examples(urls: DataFrame, n: int = 3) -> DataFrame:
    """state, place, url of up to n pages of each state that aren't indexed, those first that were crawled last. urls: url, verdict, state, last_crawl."""
    order = Window.partitionBy("state").orderBy(F.desc_nulls_last("last_crawl"), F.desc("url"))
    left = urls.filter(~(F.coalesce("verdict", F.lit("")) == INDEXED))
    return left.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).select("state", "place", "url")

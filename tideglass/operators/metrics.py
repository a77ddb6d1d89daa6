"""Metrics of extraction as partial aggregates that are stored by day and merged: a day is counted once, and any span of days is a sum of what is stored.

A partial has, for each day, field, status and note, how many values came out so. Partials add up whatever way days are put together, so that merged days equal one run over all of them; a day that is run again
replaces its own partial and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.sources.versions import VersionedTable

KIND = "day date, target string, status string, note string, n long"
STATUSES = ("parsed", "unparsed", "not_found", "quote_not_in_source")


def partial(values: DataFrame) -> DataFrame:
    """day, target, status, note, n of rows with day, target, status and note."""
    return values.groupBy("day", "target", "status", "note").agg(F.count("*").alias("n"))


def of_items(items: DataFrame, day: Column, targets: list[str]) -> DataFrame:
    """Rows of day, target, status and note of the items that ``extract.apply`` gives."""
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("target"), F.col(f"{t}.status").alias("status"), F.col(f"{t}.note").alias("note")) for t in targets)))
    return items.select(day.alias("day"), each.alias("f")).select("day", "f.*")


def merge(*partials: DataFrame) -> DataFrame:
    """Partials as one."""
    out = partials[0]
    for more in partials[1:]:
        out = out.unionByName(more)
    return out.groupBy("day", "target", "status", "note").agg(F.sum("n").alias("n"))


def save(partials: DataFrame, path: str) -> int:
    """The partials of some days in place of what is stored for these days; the number of the version. Each day is a part of its own, other days aren't read."""
    table = VersionedTable(partials.sparkSession, path)
    days = {str(r.day) for r in partials.select("day").distinct().collect()}  # (the days of a run)
    return table.change(lambda _: (partials.select("day", "target", "status", "note", "n"), lambda v: v["day"] in days), ["day"])


def load(spark: SparkSession, path: str, since: str | None = None, until: str | None = None, version: int | None = None) -> DataFrame:
    """Stored partials from a day to another one, both included; only these days are opened."""
    wanted = lambda v: v["day"] is not None and (since is None or v["day"] >= since) and (until is None or v["day"] <= until)
    return VersionedTable(spark, path).read(version, wanted, KIND)


def rates(partials: DataFrame, notes: int = 3) -> DataFrame:
    """target, n, the number of each status, parsed_rate (of what was found at all), found_rate, and the commonest notes of values that weren't parsed, with their numbers."""
    by_note = partials.filter("status <> 'parsed' AND note IS NOT NULL").groupBy("target", "note").agg(F.sum("n").alias("m"))
    top = by_note.groupBy("target").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("less"), "note"))), 1, notes).alias("t"))
    named = top.select("target", F.transform("t", lambda x: F.concat(x["note"], F.lit(":"), (-x["less"]).cast("string"))).alias("notes"))
    counts = [F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0)).alias(s) for s in STATUSES]
    per = partials.groupBy("target").agg(F.sum("n").alias("n"), *counts)
    found = F.col("n") - F.col("not_found")
    share = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(F.round(a / b, 6))
    return per.join(named, "target", "left").select("target", "n", *STATUSES, share(F.col("parsed"), found).alias("parsed_rate"), share(found, F.col("n")).alias("found_rate"), F.coalesce("notes", F.array().cast("array<string>")).alias("notes"))

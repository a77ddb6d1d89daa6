"""Registries of hosts as tables: which entry a host belongs to, for any number of entries.

An entry holds for its host and all hosts under it; the longest one that fits counts. Each different host is split into the few hosts that it lies under, these are joined to the registry by equality,
and the result goes back to the rows by host. So a registry of a million hosts is one join, neither a list in the plan nor a comparison of each host with each entry; and a host that stands in a
third of all rows is looked up once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.functions.web import host_of
from tideglass.session import fresh



def tidy(host: Column) -> Column:
    """Lower case, without dots at the ends."""
    return F.regexp_replace(F.lower(F.trim(host)), r"^\.+|\.+$", "")


def above(host: Column) -> Column:
    """The host itself and the hosts that it lies under, longest first; none for an empty one."""
    parts = F.split(host, r"\.")
    return F.when(host != "", F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).otherwise(F.array().cast("array<string>"))


def match(rows: DataFrame, registry: DataFrame, url: str = "url", host: str = "host", entry: str = "entry") -> DataFrame:
    """All columns of rows and ``entry``: the row of the registry with the longest host that the url's host is or lies under, NULL if there is none. A column of rows with that name is replaced.

    Of several entries for one host the smallest as JSON counts. Entries without a host fit nothing, nor do urls without one.
    """
    held, place, found = fresh(rows, "_host", "_above", "_entry")
    named = rows.withColumn(held, tidy(host_of(F.col(url))))
    whole = F.struct(*(F.col(f"`{c}`") for c in registry.columns))
    entries = registry.withColumn(place, tidy(F.col(host))).filter(F.col(place) != "").groupBy(place).agg(F.min_by(whole, F.to_json(whole)).alias(found))
    hosts = named.select(held).filter(F.col(held) != "").distinct()
    split = hosts.select(held, F.explode(above(F.col(held))).alias(place))
    best = split.join(entries, place).groupBy(held).agg(F.max_by(found, F.length(place)).alias(found))
    return named.join(best, held, "left").withColumn(entry, F.col(found)).drop(held, *([found] if found != entry else []))


def allowed(rows: DataFrame, registry: DataFrame, url: str = "url", host: str = "host") -> DataFrame:
    """The rows whose host is in the registry or lies under an entry of it."""
    (entry,) = fresh(rows, "_allowed")
    return match(rows, registry.select(host), url, host, entry).filter(F.col(entry).isNotNull()).drop(entry)


def kinds(rows: DataFrame, registry: DataFrame, url: str = "url") -> DataFrame:
    """All columns of rows with platform and policy of the registry's entry (host, platform, policy); ``unknown`` and ``none`` for hosts that it doesn't have."""
    (entry,) = fresh(rows, "_kind")
    met = match(rows, registry.select("host", "platform", "policy"), url, "host", entry)
    return met.withColumns({"platform": F.coalesce(F.col(entry)["platform"], F.lit("unknown")), "policy": F.coalesce(F.col(entry)["policy"], F.lit("none"))}).drop(entry)

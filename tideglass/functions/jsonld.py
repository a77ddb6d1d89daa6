"""Opening hours that a page declares as JSON-LD.

Blocks come out of the HTML by a pattern and parse as VARIANT. Their nodes are found level by level, with a bound on the
depth, and read by expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideglass.functions.base import once
from tideglass.functions.schedule import PERIODS

SCRIPT = r"(?is)<script[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
# Keys below which further nodes stand; types of places and of organisations; names of days.
BELOW = ["@graph", "containsPlace", "location", "subOrganization", "department", "mainEntity"]
PLACES = ["place", "touristattraction", "touristdestination", "museum", "civicstructure", "park", "landmarksorhistoricalbuildings", "aquarium", "zoo", "amusementpark", "artgallery", "performingartstheater", "library", "campground", "beach", "placeofworship", "buddhisttemple", "hindutemple", "church", "stadiumorarena", "movietheater", "touristinformationcenter"]
ORGANISATIONS = ["organization", "localbusiness", "corporation", "governmentorganization"]
DAY_NAMES = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
HOLIDAYS = "publicholidays"
#: Levels of nodes inside nodes that are looked at.
DEPTH = 6
CLOCK = r"^\s*(\d{1,2}):(\d{2})(?::\d{2})?\s*$"
SHORT = r"((?:[A-Za-z]{2}(?:\s*[-–]\s*[A-Za-z]{2})?)(?:\s*,\s*[A-Za-z]{2}(?:\s*[-–]\s*[A-Za-z]{2})?)*)\s+(\d{1,2}:\d{2})\s*[-–]\s*(\d{1,2}:\d{2})"


def _listed(v: Column) -> Column:
    """A variant as an array: its elements if it is an array, itself otherwise, nothing if it is null."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(v.isNotNull() & ~F.is_variant_null(v), F.array(v)), F.expr("cast(array() as array<variant>)"))


def nodes(html: Column) -> Column:
    """array<variant> of all objects in the JSON-LD of a page: the blocks' own, those of graphs and lists, and those inside them. Broken blocks are left out."""
    blocks = F.array_compact(F.transform(F.regexp_extract_all(html, F.lit(SCRIPT), F.lit(1)), lambda b: F.try_parse_json(F.trim(b))))
    objects = lambda a: F.filter(F.flatten(F.transform(a, _listed)), lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    level = objects(blocks)
    found = [level]
    below = lambda v: F.concat(*[_listed(F.try_variant_get(v, f"$['{k}']", "variant")) for k in BELOW])
    for _ in range(DEPTH):
        level = objects(F.flatten(F.transform(level, below)))
        found.append(level)
    return F.concat(*found)


def _text(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$['{key}']", "string")


def _clock(text: Column) -> Column:
    h, m = F.regexp_extract(text, CLOCK, 1).try_cast("int"), F.regexp_extract(text, CLOCK, 2).try_cast("int")
    h = F.when((h == 24) & (m == 0), 0).otherwise(h)
    return F.when(h.between(0, 23) & m.between(0, 59), h * 60 + m)


def _selector(weekdays: Column, holidays: Column) -> Column:
    every = F.size(weekdays) == 7
    return F.struct(F.when(every, F.expr("cast(array() as array<int>)")).otherwise(weekdays).alias("weekdays"), (holidays & ~every).alias("include_holidays"), F.lit(False).alias("exclude_holidays"))


def _period(start: Column, end: Column, days: Column, label: Column) -> Column:
    one = F.struct(start.alias("start"), end.alias("end"), F.lit(None).cast("int").alias("last_entry"))
    return F.struct(F.array(one).alias("ranges"), days.alias("days"), F.lit(None).cast("struct<start_month:int,start_day:int,end_month:int,end_day:int>").alias("season"), F.lit(False).alias("always_open"), label.alias("label"))


def _of_spec(spec: Column) -> Column:
    """A period of one specification; NULL if it holds for a time only, lacks an end or has a day that isn't known."""
    names = F.transform(_listed(F.try_variant_get(spec, "$.dayOfWeek", "variant")), lambda d: F.replace(F.lower(F.trim(F.element_at(F.split(F.coalesce(F.try_variant_get(d, "$", "string"), F.lit("?")), "/"), -1))), F.lit(" "), F.lit("")))
    known = F.array(*map(F.lit, DAY_NAMES))

    def read(x: Column) -> Column:
        sound = F.forall(x["names"], lambda n: F.array_contains(known, n) | (n == HOLIDAYS))
        weekdays = F.array_sort(F.array_distinct(F.transform(F.filter(x["names"], lambda n: n != HOLIDAYS), lambda n: (F.array_position(known, n) - 1).cast("int"))))
        lasting = F.coalesce(_text(spec, "validFrom"), F.lit("")) == ""
        lasting = lasting & (F.coalesce(_text(spec, "validThrough"), F.lit("")) == "")
        return F.when(lasting & sound & x["a"].isNotNull() & x["z"].isNotNull(), _period(x["a"], x["z"], _selector(weekdays, F.array_contains(x["names"], HOLIDAYS)), F.lit(None).cast("string")))

    return once(F.struct(names.alias("names"), _clock(_text(spec, "opens")).alias("a"), _clock(_text(spec, "closes")).alias("z")), read)


def _of_short(text: Column) -> Column:
    """A period of the short form ("Mo-Fr 09:00-17:00"); runs of days may go over Sunday."""
    short = F.array(*[F.lit(d[:2]) for d in DAY_NAMES])
    index = lambda d: F.array_position(short, d) - 1

    def read(x: Column) -> Column:
        runs = F.transform(F.split(F.lower(F.replace(x["days"], F.lit("–"), F.lit("-"))), ","), lambda p: F.struct(index(F.trim(F.split(p, "-")[0])).alias("a"), index(F.trim(F.element_at(F.split(p, "-"), -1))).alias("z")))
        covered = lambda r, d: F.when(r["a"] <= r["z"], d.between(r["a"], r["z"])).otherwise((d >= r["a"]) | (d <= r["z"]))
        weekdays = F.filter(F.array(*map(F.lit, range(7))), lambda d: F.exists(runs, lambda r: covered(r, d)))
        sound = F.forall(runs, lambda r: (r["a"] >= 0) & (r["z"] >= 0))
        return F.when(text.rlike(SHORT) & sound & x["from"].isNotNull() & x["to"].isNotNull(), _period(x["from"], x["to"], _selector(weekdays, F.lit(False)), F.substring(text, 1, 60)))

    return once(F.struct(F.regexp_extract(text, SHORT, 1).alias("days"), _clock(F.regexp_extract(text, SHORT, 2)).alias("from"), _clock(F.regexp_extract(text, SHORT, 3)).alias("to")), read)


def opening_hours(html: Column) -> Column:
    """struct of value (periods), quote (the declaring part, as JSON) and note.

    Places come before organisations, whose hours may be those of an office: jsonld_place, jsonld_organization. Without a value: no_jsonld, no_opening_hours.
    """

    def read(node: Column) -> Column:
        specs = F.array_compact(F.transform(_listed(F.try_variant_get(node, "$.openingHoursSpecification", "variant")), _of_spec))
        short = F.array_compact(F.transform(_listed(F.try_variant_get(node, "$.openingHours", "variant")), lambda v: _of_short(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("")))))
        types = F.transform(_listed(F.coalesce(F.try_variant_get(node, "$['@type']", "variant"), F.try_variant_get(node, "$.type", "variant"))), lambda t: F.lower(F.element_at(F.split(F.coalesce(F.try_variant_get(t, "$", "string"), F.lit("")), "/"), -1)))
        part = lambda k: F.to_json(F.try_variant_get(node, f"$['{k}']", "variant"))
        kind = F.coalesce(part("@type"), part("type"))
        quote = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), v) for k, v in (("@type", kind), ("name", part("name")), ("openingHoursSpecification", part("openingHoursSpecification")), ("openingHours", part("openingHours")))]), F.lit("}"))
        rank = F.when(F.arrays_overlap(types, F.array(*map(F.lit, PLACES))), 0).when(F.arrays_overlap(types, F.array(*map(F.lit, ORGANISATIONS))), 1)
        return once(specs, lambda s: F.struct(F.when(F.size(s) > 0, s).otherwise(short).cast(PERIODS).alias("value"), quote.alias("quote"), rank.alias("rank")))

    def chosen(all_nodes: Column) -> Column:
        timed = F.filter(F.transform(all_nodes, read), lambda n: (F.size(n["value"]) > 0) & n["rank"].isNotNull())
        first = once(timed, lambda t: F.coalesce(F.try_element_at(F.filter(t, lambda n: n["rank"] == 0), F.lit(1)), F.try_element_at(t, F.lit(1))))
        note = lambda f: F.when(f["rank"] == 0, "jsonld_place").when(f["rank"] == 1, "jsonld_organization").otherwise("no_opening_hours")
        none = F.struct(F.lit(None).cast(PERIODS).alias("value"), F.lit(None).cast("string").alias("quote"), F.lit("no_jsonld").alias("note"))
        return F.when(F.size(all_nodes) == 0, none).otherwise(once(first, lambda f: F.struct(f["value"].alias("value"), f["quote"].alias("quote"), note(f).alias("note"))))

    return once(nodes(F.coalesce(html, F.lit(""))), chosen)

"""From a model's quotes to typed values: each quote must stand in the page, then an expression parses it. Models themselves are out of scope: their answers come from a table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.functions import jsonld, web
from tideglass.functions.base import once

NOT_FOUND, NOT_IN_SOURCE, UNPARSED, PARSED = "not_found", "quote_not_in_source", "unparsed", "parsed"


@dataclass(frozen=True)
class QuoteField:
    """A key of the answer, the column that it fills, and what parses it into a struct of value and note; without a parser the quote is the value."""

    quote: str
    target: str
    parser: Callable[[Column], Column] | None = None


@dataclass(frozen=True)
class Spec:
    """What is taken from an answer. ``items`` is the key of its list, or None if the answer is one item. A summary is cut to its length, and dropped if it repeats ``overlap`` characters of the page.
    ``hours`` names a target that declared hours fill where the text gave none."""

    fields: tuple[QuoteField, ...]
    items: str | None = "items"
    free: tuple[str, ...] = ("title", "summary")
    summary: str | None = "summary"
    summary_chars: int = 120
    overlap: int = 30
    hours: str | None = None


def _text(item: Column, key: str) -> Column:
    return F.nullif(F.trim(F.try_variant_get(item, f"$['{key}']", "string")), F.lit(""))


def _field(field: QuoteField, item: Column, source: Column) -> Column:
    """struct of value, quote, status and note."""

    def checked(x: Column) -> Column:
        parsed = field.parser(x["quote"]) if field.parser else F.struct(x["quote"].alias("value"), F.lit(None).cast("string").alias("note"))
        joined = F.when(x["found"] == "joined", "quote_joined")

        def told(p: Column) -> Column:
            status = F.when(x["quote"].isNull(), NOT_FOUND).when(x["found"] == "missing", NOT_IN_SOURCE).when(p["value"].isNull(), UNPARSED).otherwise(PARSED)
            note = F.when(status == NOT_FOUND, None).when(status == NOT_IN_SOURCE, NOT_IN_SOURCE).when(status == UNPARSED, F.coalesce(p["note"], F.lit(UNPARSED))).otherwise(F.coalesce(p["note"], joined))
            return F.struct(F.when(status == PARSED, p["value"]).alias("value"), x["quote"].alias("quote"), status.alias("status"), note.alias("note"))

        return once(parsed, told)

    return once(_text(item, field.quote), lambda q: once(F.struct(q.alias("quote"), F.when(q.isNotNull(), web.quote_status(q, source)).alias("found")), checked))


def apply(spec: Spec, pages: DataFrame, text: str = "text", data: str = "data", html: str | None = None) -> DataFrame:
    """A row for each item of each page's answer: the page's columns without the answer, item (its place), a struct of value, quote, status and note for each target, the free columns, and flags.

    ``data`` has the answers as JSON; answers that don't parse, have no list of items, or items that are no objects give no rows.
    """
    answer = pages.withColumn("_answer", F.try_parse_json(data))
    listed = F.array("_answer") if spec.items is None else F.coalesce(F.try_variant_get("_answer", f"$['{spec.items}']", "array<variant>"), F.expr("cast(array() as array<variant>)"))
    rows = answer.select(*(c for c in pages.columns if c != data), F.posexplode(listed).alias("item", "_item"))
    rows = rows.filter(F.col("_item").isNotNull() & F.schema_of_variant("_item").startswith("OBJECT"))
    source = F.coalesce(F.col(text), F.lit(""))
    item = F.col("_item")
    out = rows.select(*(c for c in rows.columns if c != "_item"), *(_field(f, item, source).alias(f.target) for f in spec.fields), *(_text(item, n).alias(n) for n in spec.free))
    flags = F.expr("cast(array() as array<string>)")
    if spec.summary:
        whole = F.col(spec.summary)
        short = F.substring(whole, 1, spec.summary_chars)
        copied = F.coalesce(web.verbatim(web.squash(short), web.squash(source), spec.overlap), F.lit(False))
        out = out.withColumn("_copied", copied)
        flags = F.array_compact(F.array(F.when(F.length(whole) > spec.summary_chars, "summary_truncated"), F.when(F.col("_copied"), "summary_verbatim_overlap")))
        out = out.withColumn("flags", flags).withColumn(spec.summary, F.when(~F.col("_copied"), short)).drop("_copied")
    else:
        out = out.withColumn("flags", flags)
    if spec.hours and html:
        target = spec.hours
        declared = jsonld.opening_hours(F.col(html))
        out = out.withColumn("_declared", F.when((F.col("item") == 0) & (F.col(f"{target}.status") != PARSED), declared))
        filled = F.col("_declared.value").isNotNull()
        value = F.struct(F.col("_declared.value").alias("value"), F.col("_declared.quote").alias("quote"), F.lit(PARSED).alias("status"), F.col("_declared.note").alias("note"))
        out = out.withColumns({target: F.when(filled, value).otherwise(F.col(target)), "flags": F.when(filled, F.array_append("flags", F.lit(f"{target}_from_jsonld"))).otherwise(F.col("flags"))}).drop("_declared")
    return out


def metrics(spec: Spec, items: DataFrame) -> DataFrame:
    """target, status, note, n: how often each field came out how."""
    each = F.explode(F.array(*[F.struct(F.lit(f.target).alias("target"), F.col(f"{f.target}.status").alias("status"), F.col(f"{f.target}.note").alias("note")) for f in spec.fields]))
    return items.select(each.alias("f")).select("f.*").groupBy("target", "status", "note").agg(F.count("*").alias("n"))

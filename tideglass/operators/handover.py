"""What comes of a screening: a report in Markdown, and the hand-over of each offer in a form that its taker gives.

Reports are rows of text with their place, one for each offer, made where the offers are; only their numbers within a section come of an order over it. Forms are filled by expressions.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.functions import forms, web
from tideglass.functions.base import once
from tideglass.operators.model_calls import running_total
from tideglass.session import fresh

# Headings of the report, of its tables, and what stands where there is nothing.
SECTIONS = {"apply": "## 申請する順", "hold": "## 保留（今は出さないが、候補として残す）", "reject": "## 除外"}
COLUMNS = ["#", "案件名", "広告主", "種別", "成果条件", "点", "理由"]
REJECTED = ["#", "案件名", "広告主", "除外理由"]
NONE = {"apply": "採用できる案件が無い。", "reject": "除外した案件は無い。"}
_HOLE = re.compile(r"\{([a-z_]+)\}")


def cell(text: Column) -> Column:
    """Text as a cell of a table: no bars and line breaks, a dash for nothing."""
    flat = F.trim(F.replace(F.translate(F.coalesce(text.cast("string"), F.lit("")), "|", "｜"), F.lit("\n"), F.lit(" ")))
    return F.when(flat == "", "-").otherwise(flat)


def _line(cells: list[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def report(screened: DataFrame, profile: str) -> DataFrame:
    """place, line of the report of a screening, to be read by place: counts, then a table for each verdict. screened: id, name, advertiser, condition, verdict, score, kind, tier, why; within a verdict by falling score, name and id, which must be different for each row."""
    section, less, one, upto = fresh(screened, "_section", "_less", "_one", "_upto")
    of_verdict = F.when(F.col("verdict") == "apply", 1).when(F.col("verdict") == "hold", 2).otherwise(3)
    keyed = screened.withColumns({section: of_verdict, less: -F.col("score"), one: F.lit(1)})
    counts = screened.agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in SECTIONS))
    # numbers come of a running sum over ranges of the order, so that no task has a whole section
    a, h = F.col("_counts.apply"), F.col("_counts.hold")
    before = F.when(F.col(section) == 1, 0).when(F.col(section) == 2, a).otherwise(a + h)
    numbered = running_total(keyed, [section, less, "name", "id"], one, upto).crossJoin(F.broadcast(counts.select(F.struct("*").alias("_counts")))).withColumn("n", (F.col(upto) - before).cast("long"))
    number, score = F.col("n").cast("string"), F.bround("score", 0).cast("long").cast("string")  # (halves to even)
    tier = F.when(F.col("tier").isNotNull() & (F.col("tier") != "unknown"), F.col("tier")).otherwise(F.coalesce(F.nullif("condition", F.lit("")), F.lit("unknown")))
    full = _line([number, cell(F.col("name")), cell(F.col("advertiser")), cell(F.col("kind")), cell(tier), score, cell(F.col("why"))])
    short = _line([number, cell(F.col("name")), cell(F.col("advertiser")), cell(F.col("why"))])
    place = lambda s, part, n: F.struct(s.alias("section"), part.alias("part"), n.alias("n"))
    rows = numbered.select(place(F.col(section), F.lit(2), F.col("n")).alias("place"), F.when(F.col("verdict") == "reject", short).otherwise(full).alias("line"))
    total = F.col("apply") + F.col("hold") + F.col("reject")
    head = counts.select(F.array(F.lit(f"# 案件の選定結果（プロファイル: {profile}）"), F.format_string("申請 %d 件 / 保留 %d 件 / 除外 %d 件（合計 %d 件）", "apply", "hold", "reject", total)).alias("lines"), F.lit(0).alias("section"))
    for i, (verdict, title) in enumerate(SECTIONS.items(), 1):
        names = REJECTED if verdict == "reject" else COLUMNS
        table = F.array(F.lit(title), F.lit("| " + " | ".join(names) + " |"), F.lit("| " + " | ".join("---" for _ in names) + " |"))
        nothing = F.array(F.lit(title), F.lit(NONE[verdict])) if verdict in NONE else F.array().cast("array<string>")
        head = head.unionByName(counts.select(F.when(F.col(verdict) > 0, table).otherwise(nothing).alias("lines"), F.lit(i).alias("section")))
    heads = head.select("section", F.posexplode("lines").alias("n", "line")).withColumn("n", F.col("n").cast("long")).select(place(F.col("section"), F.lit(1), F.col("n")).alias("place"), "line")
    return heads.unionByName(rows)


def filled(form: str, values: Mapping[str, Column], none: str = "") -> Column:
    """A text with the values in place of their names in braces; NULL becomes ``none``, arrays a list in quotes. Names that there is no value for stay."""
    parts, at = [], 0
    for m in _HOLE.finditer(form):
        if m[1] not in values:
            continue
        parts += [F.lit(form[at : m.start()]), F.coalesce(values[m[1]].cast("string"), F.lit(none))]
        at = m.end()
    return F.concat(*parts, F.lit(form[at:]))


def listed(values: Column) -> Column:
    """An array as it stands in code."""
    return F.array_join(F.transform(values, lambda v: F.concat(F.lit('"'), v, F.lit('"'))), ", ")


def handed_over(form: Mapping[str, object], values: Mapping[str, Column]) -> Column:
    """JSON of a form whose texts have names in braces: a text that is nothing but a name becomes its value, of whatever type; NULL stays."""

    def of(node: object) -> Column:
        if isinstance(node, Mapping):
            return F.struct(*(of(v).alias(k) for k, v in node.items()))
        if isinstance(node, list):
            return F.array(*map(of, node))
        if isinstance(node, str):
            whole = _HOLE.fullmatch(node.strip())
            return values[whole[1]] if whole and whole[1] in values else filled(node, values)
        return F.lit(node)

    return F.to_json(of(form), {"ignoreNullFields": "false"})


def terms(html: Column) -> Column:
    """struct of allowed, licence, permission (the wording that asks for one) and reason of a page with terms of use: a licence that grants, and no wording that leaves it to a person's judgement."""

    def told(x: Column) -> Column:
        reason = F.when(x["permission"].isNotNull(), F.concat(F.lit("permission: "), x["permission"])).when(x["licence"].isNull(), x["verdict"])
        return F.struct(reason.isNull().alias("allowed"), x["licence"].alias("licence"), x["permission"].alias("permission"), reason.alias("reason"))

    return once(once(web.licence(html), lambda v: F.struct(v["licence"].alias("licence"), v["verdict"].alias("verdict"), forms.needs_permission(html).alias("permission"))), told)

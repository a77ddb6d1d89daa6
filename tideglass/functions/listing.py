"""What kind of page a page is: a list of offers, one offer, an application drawn by scripts, someone else's platform or none of these.

The pass over the HTML (``html.page_signals``) gives texts, rows and headings; all counting, scoring and deciding is done by column
expressions over them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideglass.functions.base import once
from tideglass.functions.web import PLATFORMS, host_of, split_page, under_host

# Prices and numbers of offers; words around prices of property and of other things; words of schemes, of closed offers, of columns and links; labels of an offer's fields; marks of pages drawn by scripts.
PRICE = r"\d[\d,]*\s*(?:億|万)?\s*円"
OFFER_NO = r"(?:物件番号|登録番号|管理番号|物件No|No|NO|№)\s*[.:：]?\s*[A-Za-z]?\d{1,5}|(?<![A-Za-z0-9])[A-Z]{1,3}[-‐]?\d{2,5}(?![A-Za-z0-9])"
PROPERTY = r"㎡|m2|平米|坪|築|間取|[0-9１-９]+\s*[LDKSldks]{1,4}|戸建|平屋|階建|古民家|土地|宅地|所在地|所在|地区|字|物件|売買|売却|賃貸|家賃|賃料|月額|価格|物置|庭|駐車"
OTHER = "補助|助成|上限|限度|交付|旅行代金|参加費|料金|以内|手数料|報酬|支給|奨励|給付|定額|税|保険|年収|所得|割引"
SIZED = "㎡|m2|平米|坪|築|間取|LDK"
SCHEME = "補助金|助成金|交付|申請書|様式第|要綱|対象者|対象経費|補助率|上限額|限度額|補助対象|ツアー|募集要項|旅行代金|参加費|申請期間|受付期間|申請方法|チラシ"
CLOSED = "成約済|ご成約|売約済|契約済|商談中|募集終了|掲載終了|申込済"
PRICE_COLUMN, PLACE_COLUMN = "価格|価額|賃料|家賃", "所在地|住所|地区|所在|場所|エリア"
NEXT_PAGE = r"(?i)次へ|次のページ|次ページ|次の\s*\d+\s*件|»|>>|›|next|older"
AREA = r"\d[\d,.]*\s*(?:㎡|m2|平米|坪)"
FIELDS = ["所在地|住所", "敷地面積|土地面積", "延床面積|建物面積|床面積", "築年|建築年|建築年月|築年月", "間取り|間取", "構造"]
SCRIPTED = [r"id=[\"'](?:app|root|__nuxt|__next)[\"']", r"(?i)enable\s*JavaScript|JavaScript\s*を?\s*有効", r"/(?:js|css)/chunk-|webpackJsonp|__NUXT__|data-reactroot|ng-version"]
#: Longest row, and characters around a price that tell what it is for.
ROW_CHARS, AROUND = 600, 40


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def is_offer(row: Column) -> Column:
    """Whether a row of text is an offer: a price with words of property, not one of a scheme or fee unless sizes are named."""
    return (F.length(row) <= ROW_CHARS) & row.rlike(PRICE) & row.rlike(PROPERTY) & (~row.rlike(OTHER) | row.rlike(SIZED))


def price_contexts(text: Column) -> Column:
    """struct of property and other: how many prices stand among words of property, and among words of other things, which count first."""
    # each price with what stands around it: places are found by splitting at the prices
    prices, gaps = F.regexp_extract_all(text, F.lit(PRICE), F.lit(0)), F.split(text, PRICE)

    def ends(both: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<at:int,end:int>>").alias("all"))
        step = lambda acc, i: F.struct((acc["end"] + F.length(both["gaps"][i]) + F.length(both["prices"][i])).alias("end"), F.array_append(acc["all"], F.struct((acc["end"] + F.length(both["gaps"][i])).alias("at"), (acc["end"] + F.length(both["gaps"][i]) + F.length(both["prices"][i])).alias("end"))).alias("all"))
        at = F.sequence(F.lit(0), F.size(both["prices"]) - 1)
        return F.when(F.size(both["prices"]) > 0, F.aggregate(at, start, step, lambda acc: acc["all"])).otherwise(F.array().cast("array<struct<at:int,end:int>>"))

    def around(p: Column) -> Column:
        begin = F.greatest(p["at"] - AROUND, F.lit(0))
        return F.substring(text, begin + 1, p["end"] + AROUND - begin)

    kinds = F.transform(once(F.struct(prices.alias("prices"), gaps.alias("gaps")), ends), lambda p: once(around(p), lambda w: F.when(w.rlike(OTHER), "other").when(w.rlike(PROPERTY), "property").otherwise("none")))
    n = lambda k, kind: F.size(F.filter(k, lambda x: x == kind))
    return once(kinds, lambda k: F.struct(n(k, "property").alias("property"), n(k, "other").alias("other")))


def pagination(anchors: Column, has_next: Column, url: Column) -> Column:
    """struct of is_paginated, current_page, first_page_url (of later pages) and follow_pattern (a regular expression for the URLs of further pages, whatever the scheme)."""

    def told(x: Column) -> Column:
        usable = F.filter(x["anchors"], lambda a: (a["href"] != "") & ~F.lower(a["href"]).rlike("^(#|javascript:|mailto:|tel:)"))
        later = F.filter(usable, lambda a: split_page(a["href"])["page"] > 1)
        more = x["has_next"] | F.exists(usable, lambda a: (split_page(a["href"])["page"] <= 1) & a["text"].rlike(NEXT_PAGE))
        current = x["own"]["page"]
        numbered = (F.size(later) > 0) | (current > 1)
        base = F.regexp_replace(F.regexp_replace(F.regexp_replace(x["own"]["first"], r"^[a-z]+://", ""), r"[?#].*$", ""), "/$", "")
        prefix = F.concat(F.lit("https?://"), F.regexp_replace(base, r"([.+?^${}()|\[\]\\*\-])", r"\\$1"))
        sample = F.when(F.size(later) > 0, later[0]["href"]).otherwise(x["url"])
        by_path = F.regexp_replace(sample, r"[?#].*$", "").rlike(r"/page/\d+/?$")
        pattern = F.when(by_path, F.concat(prefix, F.lit(r"/page/\d+/?$"))).otherwise(F.concat(prefix, F.lit(r"/?\?(?:.*&)?(?:page|p|pg|pagenum|page_no|pageno)=\d+")))
        return F.struct(
            (numbered | more).alias("is_paginated"), current.alias("current_page"), F.when(current > 1, x["own"]["first"]).alias("first_page_url"), F.when(numbered, pattern).alias("follow_pattern")
        )

    return once(F.struct(anchors.alias("anchors"), F.coalesce(has_next, F.lit(False)).alias("has_next"), url.alias("url"), split_page(url).alias("own")), told)


def listing_score(signals: Column, url: Column) -> Column:
    """struct of score (0 to 1), rows, property_prices, other_prices, prices, areas, offer_numbers, scheme_hits, closed_hits, price_column, place_column, scheme_dominant, is_listing, closed_ratio and paginated."""

    def counted(s: Column) -> Column:
        offers, lines = F.filter(s["rows"], is_offer), F.size(F.filter(F.split(s["text"], "\n"), is_offer))
        headings = F.array_join(s["headers"], "\n")
        return F.struct(
            F.greatest(F.size(offers), lines).alias("rows"), price_contexts(s["text"]).alias("c"), _count(s["text"], PRICE).alias("prices"), _count(s["text"], AREA).alias("areas"), _count(s["text"], OFFER_NO).alias("offer_numbers"), _count(s["text"], SCHEME).alias("scheme_hits"),
            F.greatest(F.size(F.filter(offers, lambda r: r.rlike(CLOSED))), _count(s["text"], CLOSED)).alias("closed_hits"), headings.rlike(PRICE_COLUMN).alias("price_column"), headings.rlike(PLACE_COLUMN).alias("place_column"),
        )

    def scored(n: Column) -> Column:
        rows, prop, other = n["rows"], n["c"]["property"], n["c"]["other"]
        dominant = (n["scheme_hits"] >= 4) & (rows <= 1)
        # hundredths of a hundredth, so that sums are exact
        points = F.least(rows, F.lit(10)) * 80 + F.least(prop, F.lit(10)) * 30 + F.least(n["offer_numbers"], F.lit(5)) * 20 + F.when(n["price_column"], 100).otherwise(0) + F.when(n["place_column"], 100).otherwise(0)
        weight = F.when(dominant, 0.3).when((other > prop) & (rows <= 1), 0.5).otherwise(1.0)
        base = F.greatest(rows, prop, F.lit(1))
        return F.struct(
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(points / 1000 * weight, 3))).alias("score"), rows.alias("rows"), prop.alias("property_prices"), other.alias("other_prices"), n["prices"].alias("prices"), n["areas"].alias("areas"), n["offer_numbers"].alias("offer_numbers"),
            n["scheme_hits"].alias("scheme_hits"), n["closed_hits"].alias("closed_hits"), n["price_column"].alias("price_column"), n["place_column"].alias("place_column"), dominant.alias("scheme_dominant"),
            (~dominant & ((rows >= 2) | ((prop >= 3) & (rows >= 1)))).alias("is_listing"), F.least(F.lit(1.0), n["closed_hits"] / base).alias("closed_ratio"),
        )

    return once(once(signals, counted), scored)


def _clip(x: Column) -> Column:
    return F.greatest(F.lit(0.05), F.least(F.lit(0.99), F.round(x, 2)))


def classify(signals: Column, html: Column, url: Column, platforms: list[str] = PLATFORMS) -> Column:
    """struct of page_class and confidence: third_party, spa, not_listing, listing_index or listing_detail, decided in this order."""
    platform = under_host(host_of(url), platforms)
    marks = F.lit(0)
    for p in SCRIPTED:
        marks = marks + F.when(html.rlike(p), 1).otherwise(0)
    of = lambda kind, confidence: F.struct(F.lit(kind).alias("page_class"), _clip(confidence).alias("confidence"))

    def decided(x: Column) -> Column:
        n, fields = x["n"], x["fields"]
        index = F.when(n["is_listing"], 0.55 + F.least(n["rows"], F.lit(20)) * 0.02).when((n["property_prices"] >= 1) & (n["offer_numbers"] >= 2), 0.5 + n["offer_numbers"] * 0.02).otherwise(0.0)
        detail = F.when((fields >= 3) & n["prices"].between(1, 3) & (n["offer_numbers"] <= 3), 0.5 + fields * 0.08).otherwise(0.0)

        def settled(s: Column) -> Column:
            detail = F.when((s["index"] > 0) & (n["prices"] >= 6), s["detail"] * 0.5).otherwise(s["detail"])
            index = F.when((detail > 0) & (fields >= 5) & (n["prices"] <= 2), s["index"] * 0.6).otherwise(s["index"])
            return once(F.struct(index.alias("i"), detail.alias("d")), lambda b: F.when((b["i"] >= b["d"]) & (b["i"] > 0), of("listing_index", b["i"] - b["d"] * 0.3)).when(b["d"] > 0, of("listing_detail", b["d"] - b["i"] * 0.3)).otherwise(of("not_listing", 0.55 + F.when(n["prices"] == 0, 0.1).otherwise(0.0))))

        return (
            F.when(x["platform"].isNotNull(), of("third_party", F.lit(0.99)))
            .when((x["body"] < 400) & (x["marks"] >= 1) & (x["scripts"] >= 3), of("spa", 0.6 + 0.15 * x["marks"]))
            .when(n["scheme_dominant"], of("not_listing", 0.6 + F.least(n["scheme_hits"], F.lit(20)) * 0.015))
            .otherwise(once(F.struct(index.alias("index"), detail.alias("detail")), settled))
        )

    def measured(s: Column) -> Column:
        fields = F.lit(0)
        for p in FIELDS:
            fields = fields + F.when(s["text"].rlike(p), 1).otherwise(0)
        return F.struct(listing_score(s, url).alias("n"), fields.alias("fields"), platform.alias("platform"), F.length(s["text"]).alias("body"), marks.alias("marks"), s["n_scripts"].alias("scripts"))

    return once(once(signals, measured), decided)

"""Building a site: pages of all languages rendered from rows, gates that keep bad pages from being published, its map, and all of it as files."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.functions import web
from tideglass.functions.templates import Templates
from tideglass.operators import site
from tideglass.session import cut
from tideglass.sources import site_sink


class BuildError(RuntimeError):
    """What must not be published."""


@dataclass
class Site:
    """What all pages share. languages: code and language tag of each, in the order in which they are named; the first is the default one. one_map: the map is one file however many pages it has, else it is cut into parts beyond ``site_sink.MAP_PAGES``."""

    base: str
    languages: Sequence[tuple[str, str]]
    templates: Templates
    redirects: list[tuple[str, str, int]] = field(default_factory=list)
    one_map: bool = False

    @property
    def default(self) -> str:
        return self.languages[0][0]


def hreflangs(alternates: Column, languages: Sequence[tuple[str, str]], base: str) -> Column:
    """Array of hreflang and href: the versions of a page by the order of the languages, then the default one as x-default; none for a site of one language. alternates: a map from code to path."""
    kind = "array<struct<hreflang:string,href:string>>"
    if len(languages) < 2:
        return F.array().cast(kind)
    names = [*languages, (languages[0][0], "x-default")]
    of = lambda code: F.try_element_at(alternates, F.lit(code))
    links = [F.when(of(code).isNotNull(), F.struct(F.lit(tag).alias("hreflang"), F.concat(F.lit(base), of(code)).alias("href"))) for code, tag in names]
    return F.coalesce(F.array_compact(F.array(*links)), F.array().cast(kind))


def rendered(pages: DataFrame, of: Site, names: list[str]) -> DataFrame:
    """pages with hreflangs and body. pages: path, url_path, template, locale, alternates, noindex, and whatever their templates name; a template that isn't among the names gives no body.

    One projection: pages are made where their rows are.
    """
    full = pages.withColumn("hreflangs", hreflangs(F.col("alternates"), of.languages, of.base)).withColumn("base_url", F.lit(of.base))
    return full.withColumn("body", of.templates.render(F.col("template"), names, full.schema))


def faults(made: DataFrame, of: Site, assets: DataFrame | None = None, people: Column | None = None) -> DataFrame:
    """path, fault of rendered pages: no template, what their heads lack, pictures that aren't registered (assets: asset_id), alternates that don't fit together, personal data (``people``: an array of what a text holds, by default by ``web.personal_data``)."""
    shown = F.coalesce("noindex", F.lit(False))
    lacks = site.markup_faults(F.col("body"), shown, F.size("hreflangs") > 0)
    each = made.select("path", F.explode(F.when(F.col("body").isNull(), F.array(F.lit("no_template"))).otherwise(lacks)).alias("fault"))
    found = people if people is not None else F.transform(web.personal_data(F.regexp_replace("body", "(?s)<[^>]*>", " ")), lambda p: p["value"])
    each = each.unionByName(made.filter(F.size(found) > 0).select("path", F.lit("personal_data").alias("fault")))
    codes = [code for code, _ in of.languages]
    named = site.alternate_faults(made.select("path", "url_path", "locale", "alternates", shown.alias("noindex")), codes, of.default)
    each = each.unionByName(named.select("path", "fault"))
    if assets is not None:
        images = made.select("path", F.explode(F.regexp_extract_all("body", F.lit(r"(?i)(<img\b[^>]*>)"), F.lit(1))).alias("tag"))
        part = lambda name: F.nullif(F.regexp_extract("tag", rf'(?i)\b{name}="([^"]*)"', 1), F.lit(""))
        each = each.unionByName(site.image_faults(images.select("path", part("src").alias("src"), part("data-asset").alias("asset")), assets).select("path", F.concat(F.lit("image_"), "fault").alias("fault")))
    return each


def build(pages: DataFrame, of: Site, names: list[str], target: str, assets: DataFrame | None = None, more: DataFrame | None = None, gates: bool = True) -> int:
    """Renders pages, checks them, and writes them with their map, the rules for robots, redirects and headers, and ``more`` files (path, body) as the site at ``target``; the number of pages.

    A fault is an error, and the site stays as it was. pages: as for ``rendered``, with lastmod, changefreq and priority.
    """
    made = cut(rendered(pages, of, names))
    if gates:
        wrong = faults(made, of, assets).orderBy("path", "fault").limit(5).collect()
        if wrong:
            raise BuildError("; ".join(f"{r.path}: {r.fault}" for r in wrong))
    listed = made.filter(~F.coalesce("noindex", F.lit(False)) & F.col("path").endswith(".html"))
    links = listed.select("path", F.explode("hreflangs").alias("l")).select("path", "l.hreflang", "l.href")
    entries = cut(site.sitemap_rows(listed.select("path", "url_path", "lastmod", "changefreq", "priority", F.lit(False).alias("noindex")), links, of.base))
    files = made.select("path", "body").unionByName(site_sink.fixed_files(pages.sparkSession, of.base, of.redirects))
    pieces = site_sink.map_pieces(entries, len(of.languages) > 1) if of.one_map else None
    if pieces is None:
        files = files.unionByName(site_sink.map_files(entries, of.base, len(of.languages) > 1))
    if more is not None:
        files = files.unionByName(more.select("path", "body"))
    site_sink.write_site(files, target, pieces)
    return made.count()

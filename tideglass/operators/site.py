"""Robots rules, the crawl frontier, discovery of pages, and the gates of a built site.

Rows of robots files, links, pages and images go in, decisions come out; live fetching is left to whoever fills these tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.functions.base import once
from tideglass.functions.web import host_of

# What a site must have; what its page about itself must name; the tag of an analytics beacon; what pages must carry for sharing; wording and freshness keys of records; kinds of pictures.
REQUIRED_FILES = ["robots.txt", "sitemap.xml", "404.html", "about/index.html"]
ABOUT = {"operator": "運営者", "disclaimer": "免責"}
BEACON = "static.cloudflareinsights.com/beacon.min.js"
OPEN_GRAPH = ["og:title", "og:type", "og:url"]
PICTURES = ["image/jpeg", "image/png", "image/webp", "image/svg+xml"]
#: Bytes of a picture.
SMALLEST, LARGEST = 1_000, 5_000_000
#: Hits in sitemaps that are taken for a source, sitemaps inside a sitemap that are followed.
SITEMAP_HITS, SITEMAP_DEPTH = 50, 1
RULES = "array<struct<agent:string,kind:string,value:string>>"


def robots_rules(body: Column) -> Column:
    """array of agent, kind (allow, disallow, crawl-delay) and value: what a robots file says to each agent. Agents named one after the other share what follows."""
    lines = F.transform(F.split(body, r"\r\n|\r|\n"), lambda x: once(F.trim(F.regexp_replace(x, "#.*$", "")), lambda t: F.struct(F.lower(F.trim(F.regexp_extract(t, "^([^:]*):", 1))).alias("key"), F.trim(F.regexp_extract(t, "^[^:]*:(.*)$", 1)).alias("value"))))
    start = F.struct(F.expr("cast(array() as array<string>)").alias("agents"), F.lit(False).alias("ruled"), F.expr(f"cast(array() as {RULES})").alias("rules"))

    def step(acc: Column, x: Column) -> Column:
        agent, rule = x["key"] == "user-agent", x["key"].isin("allow", "disallow", "crawl-delay")
        agents = F.when(agent & acc["ruled"], F.array(F.lower(x["value"]))).when(agent, F.array_append(acc["agents"], F.lower(x["value"]))).otherwise(acc["agents"])
        more = F.transform(acc["agents"], lambda a: F.struct(a.alias("agent"), x["key"].alias("kind"), x["value"].alias("value")))
        return F.struct(agents.alias("agents"), F.when(agent, False).otherwise(acc["ruled"] | rule).alias("ruled"), F.when(rule, F.concat(acc["rules"], more)).otherwise(acc["rules"]).alias("rules"))

    return F.aggregate(lines, start, step, lambda acc: acc["rules"])


def robots_sitemaps(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(r"(?im)^\s*sitemap\s*:\s*(\S+)"), F.lit(1))


def robots_verdict(rules: Column, status: Column, path: Column, token: str) -> Column:
    """struct of allowed and crawl_delay for a path (with its query).

    A file that was read rules; 4xx means that everything is allowed; anything else, or no answer (NULL), that nothing is. Of the agents that the product's name begins with the longest
    counts, else "*". Of the rules that fit the path the longest counts, and allow before disallow; "*" stands for anything, "$" for the end.
    """
    name = F.lit(token.lower())

    def told(mine: Column) -> Column:
        paths = F.filter(mine, lambda r: r["kind"].isin("allow", "disallow") & (r["value"] != ""))
        as_regex = lambda v: F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"([.+?^{}()|\[\]\\])", r"\\$1"), r"\*", ".*"), r"\$(?!$)", r"\\\$"))
        fitting = F.filter(paths, lambda r: F.rlike(path, as_regex(r["value"])))
        ranked = F.array_sort(F.transform(fitting, lambda r: F.struct((-F.length(r["value"])).alias("l"), F.when(r["kind"] == "allow", 0).otherwise(1).alias("k"))))
        allowed = F.coalesce(F.try_element_at(ranked, F.lit(1))["k"] == 0, F.lit(True))
        delay = F.try_element_at(F.filter(mine, lambda r: r["kind"] == "crawl-delay"), F.lit(1))["value"].try_cast("double")
        return F.struct(allowed.alias("allowed"), delay.alias("crawl_delay"))

    def named(all_rules: Column) -> Column:
        agents = F.filter(F.array_distinct(F.transform(all_rules, lambda r: r["agent"])), lambda a: (a != "*") & F.startswith(name, a))
        best = F.coalesce(F.try_element_at(F.array_sort(F.transform(agents, lambda a: F.struct((-F.length(a)).alias("l"), a.alias("a")))), F.lit(1))["a"], F.lit("*"))
        return once(best, lambda b: once(F.filter(all_rules, lambda r: r["agent"] == b), told))

    everything = lambda v: F.struct(F.lit(v).alias("allowed"), F.lit(None).cast("double").alias("crawl_delay"))
    return F.when(status == 200, once(F.coalesce(rules, F.expr(f"cast(array() as {RULES})")), named)).when(status.between(400, 499), everything(True)).otherwise(everything(False))


def frontier(seeds: DataFrame, links: DataFrame, follows: DataFrame, max_pages: DataFrame) -> DataFrame:
    """source_id, url, kind, place: what a crawl goes to, in order.

    seeds: source_id, url, kind, place. follows: source_id, seed_url, pattern, kind, max_links, rule (its order). links: url (of the page), place, target. max_pages: source_id, limit, hosts. Seeds come first,
    then the targets of their links that a follow rule's pattern fits, by seed, rule and place on the page; pages found that way are followed no further. Each page comes once, pages on other hosts not at all, and no more than
    a source's limit.
    """
    started = seeds.select("source_id", "url", "kind", F.struct(F.lit(0).alias("hop"), F.col("place").alias("seed"), F.lit(0).alias("rule"), F.lit(0).alias("at")).alias("order"))
    met = follows.join(seeds.select("source_id", F.col("url").alias("seed_url"), F.col("place").alias("seed")), ["source_id", "seed_url"]).join(links.select(F.col("url").alias("seed_url"), F.col("place").alias("at"), "target"), "seed_url")
    fit = met.filter(F.rlike("target", F.col("pattern")))
    rank = F.row_number().over(Window.partitionBy("source_id", "seed_url", "rule").orderBy("at", "target"))
    fit = fit.withColumn("n", rank).filter(F.col("max_links").isNull() | (F.col("n") <= F.col("max_links")))
    found = fit.select("source_id", F.col("target").alias("url"), "kind", F.struct(F.lit(1).alias("hop"), "seed", "rule", "at").alias("order"))
    once_each = started.unionByName(found).groupBy("source_id", "url").agg(F.min_by("kind", "order").alias("kind"), F.min("order").alias("order"))
    here = once_each.join(max_pages, "source_id").withColumn("host", host_of(F.col("url")))
    here = here.filter(F.exists("hosts", lambda h: (F.col("host") == h) | F.endswith(F.col("host"), F.concat(F.lit("."), h))))
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("order", "url"))
    return here.withColumn("place", place).filter(F.col("place") <= F.col("limit")).select("source_id", "url", "kind", "place")


def crawl_counts(fetches: DataFrame) -> DataFrame:
    """source_id with fetched, changed, unchanged, not_modified, errors and stale_cache; fetches: source_id, status, changed, not_modified, error, stale."""
    n = F.count_if
    return fetches.groupBy("source_id").agg(
        n(F.col("status") == 200).alias("fetched"), n("changed").alias("changed"), n(F.col("status").isin(200, 304) & ~F.col("changed")).alias("unchanged"), n("not_modified").alias("not_modified"),
        n(F.col("error").isNotNull() & ~F.col("not_modified")).alias("errors"), n("stale").alias("stale_cache"),
    )


def sitemap_hits(sitemaps: DataFrame, roots: DataFrame, keywords: str) -> DataFrame:
    """source_id, root, url: pages that sitemaps name and whose address has a keyword, SITEMAP_HITS for each root, which is how many a source's review takes.

    sitemaps: url, body. roots: source_id, root. Sitemaps named in a sitemap are read SITEMAP_DEPTH levels deep.
    """
    locs = sitemaps.select(F.col("url").alias("sitemap"), F.posexplode(F.regexp_extract_all("body", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("at", "loc"))
    nested = F.col("loc").endswith(".xml") & F.lower("loc").contains("sitemap")
    level, hits = roots.select("source_id", "root", F.col("root").alias("sitemap"), F.array().cast("array<int>").alias("path")), []
    for depth in range(SITEMAP_DEPTH + 1):
        read = level.join(locs, "sitemap").withColumn("path", F.array_append("path", F.col("at")))
        hits.append(read.filter(~nested & F.col("loc").rlike(f"(?i){keywords}")).select("source_id", "root", F.col("loc").alias("url"), "path"))
        level = read.filter(nested).select("source_id", "root", F.col("loc").alias("sitemap"), "path")
    place = F.row_number().over(Window.partitionBy("source_id", "root").orderBy("path", "url"))
    return reduce(DataFrame.unionByName, hits).withColumn("n", place).filter(F.col("n") <= SITEMAP_HITS).select("source_id", "root", "url")


def discover(sources: DataFrame, links: DataFrame, hits: DataFrame, keywords: str) -> DataFrame:
    """source_id, url, text, found_on, score, by falling score: 2 for a keyword in the link's text, 1 for one in its address, 1 for the source's own host; the best place of each address counts, the first of equals.

    sources: source_id, official_url. links: source_id, found_on, at (its place, over all pages), url, text. hits: as ``sitemap_hits``.
    """
    given = links.select("source_id", "url", F.coalesce("text", F.lit("")).alias("text"), "found_on", F.col("at").cast("long").alias("at")).unionByName(hits.select("source_id", "url", F.lit("").alias("text"), F.col("root").alias("found_on"), F.lit(2**62).alias("at")))
    text_hit, url_hit = F.col("text").rlike(f"(?i){keywords}"), F.col("url").rlike(f"(?i){keywords}")
    near = given.join(sources.select("source_id", host_of(F.col("official_url")).alias("home")), "source_id").filter(text_hit | url_hit)
    score = F.when(text_hit, 2).otherwise(0) + F.when(url_hit, 1).otherwise(0) + F.when(host_of(F.col("url")) == F.col("home"), 1).otherwise(0)
    scored = near.withColumn("score", score)
    best = scored.groupBy("source_id", "url").agg(F.min_by(F.struct(F.substring("text", 1, 80).alias("text"), "found_on", "score"), F.struct(-F.col("score"), "at", "found_on")).alias("b")).select("source_id", "url", "b.*")
    return best.orderBy("source_id", F.desc("score"), "url")


def image_faults(images: DataFrame, assets: DataFrame) -> DataFrame:
    """path, src, asset, fault (unmarked, unregistered): pictures that a page may not show. images: path, src, asset. assets: asset_id of what is registered and usable."""
    known = assets.select(F.col("asset_id").alias("asset")).distinct().withColumn("known", F.lit(True))
    joined = images.join(known, "asset", "left")
    fault = F.when(F.coalesce("asset", F.lit("")) == "", "unmarked").when(F.col("known").isNull(), "unregistered")
    return joined.select("path", "src", "asset", fault.alias("fault")).filter("fault IS NOT NULL")


def registered_assets(assets: DataFrame) -> DataFrame:
    """asset_id of the pictures whose licence allows their use."""
    return assets.filter("usable").select("asset_id").distinct()


def markup_faults(html: Column, noindex: Column, expect_hreflang: Column) -> Column:
    """What the head of a page lacks: canonical, og:title, og:type, og:url, hreflang, json_ld, and broken_json_ld for blocks that don't parse."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    shown = ~noindex
    of = lambda condition, name: F.when(condition, F.lit(name))
    graph = [of(shown & ~html.contains(f'property="{p}"') & ~html.contains(f"property='{p}'"), p) for p in OPEN_GRAPH]
    return F.array_compact(F.array(of(shown & ~html.rlike(r"(?i)<link[^>]+rel=[\"']canonical[\"']"), "canonical"), *graph, of(expect_hreflang & ~html.rlike(r"(?i)<link[^>]+hreflang=[\"']"), "hreflang"), of(shown & (F.size(blocks) == 0), "json_ld"), of(F.exists(blocks, lambda b: F.try_parse_json(F.trim(b)).isNull()), "broken_json_ld")))


def alternate_faults(pages: DataFrame, locales: list[str], default: str) -> DataFrame:
    """path, fault, code: what is wrong with pages' names for their versions in other languages.

    pages: path, url_path, locale (NULL for the default), alternates (map from locale to url_path), noindex. Faults: unknown_locale, no_alternates (where there are several languages), not_itself, unknown_alternate, missing, one_way (the other page doesn't name the same).
    """
    code = F.coalesce("locale", F.lit(default))
    named = pages.withColumn("code", code).withColumn("names", F.array_sort(F.map_entries(F.coalesce("alternates", F.create_map().cast("map<string,string>")))))
    known = named.filter(F.col("code").isin(locales))
    fault = lambda df, name, of="code": df.select("path", F.lit(name).alias("fault"), F.col(of).alias("code"))
    out = [fault(named.filter(~F.col("code").isin(locales)), "unknown_locale")]
    none = F.size("names") == 0
    if len(locales) > 1:
        out.append(fault(known.filter(none & ~F.col("noindex")), "no_alternates"))
    some = known.filter(~none)
    out.append(fault(some.filter(~F.coalesce(F.try_element_at("alternates", F.col("code")) == F.col("url_path"), F.lit(False))), "not_itself"))
    each = some.select("path", "names", F.explode("names").alias("n")).select("path", "names", F.col("n.key").alias("other"), F.col("n.value").alias("other_path"))
    out.append(fault(each.filter(~F.col("other").isin(locales)), "unknown_alternate", "other"))
    target = known.groupBy(F.col("code").alias("other"), F.col("url_path").alias("other_path")).agg(F.max_by("names", "path").alias("theirs"))
    met = each.filter(F.col("other").isin(locales)).join(target, ["other", "other_path"], "left")
    out.append(fault(met.filter(F.col("theirs").isNull()), "missing", "other"))
    out.append(fault(met.filter(F.col("theirs") != F.col("names")), "one_way", "other"))
    return reduce(DataFrame.unionByName, out)


def site_faults(files: DataFrame, token: bool) -> DataFrame:
    """fault, path of a whole site: missing files, no_sitemap_line, no_operator and no_disclaimer on the page about itself, no_beacon or stray_beacon. files: path, text."""
    spark = files.sparkSession
    needed = spark.createDataFrame([(p,) for p in REQUIRED_FILES], "path string")
    out = [needed.join(files.select("path"), "path", "left_anti").select(F.lit("missing").alias("fault"), "path")]
    out.append(files.filter((F.col("path") == "robots.txt") & ~F.col("text").contains("Sitemap:")).select(F.lit("no_sitemap_line").alias("fault"), "path"))
    for name, word in ABOUT.items():
        out.append(files.filter((F.col("path") == "about/index.html") & ~F.col("text").contains(word)).select(F.lit(f"no_{name}").alias("fault"), "path"))
    beacon = files.filter(F.col("path").endswith(".html") & F.col("text").contains(BEACON))
    if token:
        out.append(beacon.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit("no_beacon").alias("fault"), F.lit("").alias("path")))
    else:
        out.append(beacon.select(F.lit("stray_beacon").alias("fault"), "path"))
    return reduce(DataFrame.unionByName, out)


def asset_verdict(allowed: Column, url: Column, ok: Column, content_type: Column, content: Column, excluded: list[str] = ()) -> Column:
    """struct of asset_id (the digest's first 16 characters) and reason: licence, excluded, fetch, type, large or small for pictures that aren't taken, tried in this order; NULL for those that are."""
    kind = F.lower(F.trim(F.split(F.coalesce(content_type, F.lit("")), ";")[0]))
    size = F.octet_length(content)
    left_out = F.lit(False)
    for part in excluded:
        left_out = left_out | url.contains(part)
    reason = F.when(~F.coalesce(allowed, F.lit(False)), "licence").when(left_out, "excluded").when(~F.coalesce(ok, F.lit(False)), "fetch").when(~kind.isin(PICTURES), "type").when(size > LARGEST, "large").when(size < SMALLEST, "small")
    return F.struct(F.when(reason.isNull(), F.substring(F.sha2(content, 256), 1, 16)).alias("asset_id"), reason.alias("reason"))


def hreflang_links(pages: DataFrame, languages: DataFrame, default: str, base: str) -> DataFrame:
    """path, hreflang, href: the versions of each page in the order of the languages, with x-default for the one in the default language. languages: code, lang, place. Where there is one language only, there are none."""
    langs = F.broadcast(languages.withColumn("n", F.count("*").over(Window.partitionBy(F.lit(0)))).filter("n > 1").drop("n"))
    each = pages.select("path", F.explode("alternates").alias("code", "target"))
    own = each.join(langs, "code").select("path", F.col("lang").alias("hreflang"), F.concat(F.lit(base), "target").alias("href"), "place")
    fallback = each.filter(F.col("code") == default).join(langs.select("code"), "code").select("path", F.lit("x-default").alias("hreflang"), F.concat(F.lit(base), "target").alias("href"), F.lit(2**31 - 1).alias("place"))
    return own.unionByName(fallback).orderBy("path", "place").drop("place")


def sitemap_rows(pages: DataFrame, links: DataFrame, base: str) -> DataFrame:
    """path, row: the entry of each page in the site's map. pages: path, url_path, lastmod, changefreq, priority, noindex; links: as ``hreflang_links``."""
    others = links.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('<xhtml:link rel="alternate" hreflang="'), "hreflang", F.lit('" href="'), "href", F.lit('"/>')))), "").alias("alts"))
    row = F.concat(F.lit("  <url><loc>"), F.lit(base), F.col("url_path"), F.lit("</loc><lastmod>"), F.date_format("lastmod", "yyyy-MM-dd"), F.lit("</lastmod><changefreq>"), F.col("changefreq"), F.lit("</changefreq><priority>"), F.format_number("priority", 1), F.lit("</priority>"), F.coalesce("alts", F.lit("")), F.lit("</url>"))
    return pages.filter("NOT noindex").join(others, "path", "left").select("path", row.alias("row"))


def translations(keys: DataFrame, catalog: DataFrame, default: str) -> DataFrame:
    """locale, key, text, missed: the wording of each key in each locale, from the default locale where it isn't translated (missed); text is NULL where no one has it. keys: locale, key. catalog: locale, key, text."""
    base = catalog.filter(F.col("locale") == default).select("key", F.col("text").alias("fallback"))
    met = keys.join(catalog.select("locale", "key", "text"), ["locale", "key"], "left").join(base, "key", "left")
    return met.select("locale", "key", F.coalesce("text", "fallback").alias("text"), (F.col("text").isNull() & F.col("fallback").isNotNull()).alias("missed"))


def source_status(sources: DataFrame, records: DataFrame, states: DataFrame) -> DataFrame:
    """source_id, policy, records, active, urls, pending: what each source has. sources: source_id, policy. records: source_id, status. states: source_id, url, pending_extract, error."""
    r = records.groupBy("source_id").agg(F.count("*").alias("records"), F.count_if(F.col("status") == "active").alias("active"))
    s = states.groupBy("source_id").agg(F.count("*").alias("urls"), F.count_if(F.coalesce("pending_extract", F.lit(False))).alias("pending"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return sources.join(r, "source_id", "left").join(s, "source_id", "left").select("source_id", "policy", zero("records"), zero("active"), zero("urls"), zero("pending"))


def recheck_summary(log: DataFrame, since: Column) -> DataFrame:
    """One row: ok, fail, skip, unreachable and reselect entries of the log since then. log: at, key, result."""
    return log.filter(F.col("at") >= since).agg(*(F.count_if(F.col("result") == r).alias(r) for r in ("ok", "fail", "skip", "unreachable", "reselect")))


def recheck_open(state: DataFrame, targets: DataFrame) -> DataFrame:
    """key, label, kind (failing or waiting), since, nights, reason: what isn't confirmed, failing ones first. state: key, failures, failed_since, reason, waiting_since, waiting_reason. targets: key, label."""
    met = state.join(targets.select("key", "label"), "key")
    failing = met.filter("failures > 0").select("key", "label", F.lit("failing").alias("kind"), F.col("failed_since").alias("since"), F.col("failures").alias("nights"), "reason")
    waiting = met.filter("waiting_since IS NOT NULL").select("key", "label", F.lit("waiting").alias("kind"), F.col("waiting_since").alias("since"), F.lit(None).cast("long").alias("nights"), F.col("waiting_reason").alias("reason"))
    return failing.unionByName(waiting).orderBy("kind", "key")


def queue(states: DataFrame, budget: int) -> DataFrame:
    """source_id, url: pages that wait for extraction, by url, no more than the budget of a run."""
    return states.filter(F.coalesce("pending_extract", F.lit(False)) & F.col("content_hash").isNotNull()).select("source_id", "url").orderBy("url", "source_id").limit(budget)


def cached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests with response and hit: what the cache (key, response) has for a request's key; the newest of several (at)."""
    newest = cache.groupBy("key").agg(F.max_by("response", "at").alias("response"))
    return requests.join(newest, "key", "left").withColumn("hit", F.col("response").isNotNull())


def review_pending(candidates: DataFrame) -> DataFrame:
    return candidates.filter("policy = 'pending'")


def forget(states: DataFrame, alive: DataFrame) -> DataFrame:
    """states of the urls that are still alive."""
    return states.join(alive.select("url").distinct(), "url", "left_semi")


def freeze_wording(records: DataFrame, wording: list[str], freshness: list[str], columns: list[str]) -> DataFrame:
    """key and the new columns, with the old wording where the facts are the same. records: key, old and new, structs with ``columns``.

    Facts are all columns but those of wording and freshness. A column in which only freshness or wording differs keeps its old wording and takes the new freshness.
    """
    facts = [c for c in columns if c not in wording and c not in freshness]
    equal = reduce(lambda a, b: a & b, [F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in facts], F.col("old").isNotNull())
    return records.select("key", *(F.when(equal, F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")).alias(c) if c in wording else F.col(f"new.{c}").alias(c) for c in columns), equal.alias("frozen"))


def usage_total(reports: DataFrame) -> DataFrame:
    """calls, cached_calls, input_tokens, output_tokens over all reports; reports: llm, a struct of these."""
    return reports.agg(*(F.coalesce(F.sum(f"llm.{c}"), F.lit(0)).alias(c) for c in ("calls", "cached_calls", "input_tokens", "output_tokens")))


def bump(reports: DataFrame) -> DataFrame:
    """stage, key, n: counters of all reports added up. reports: stages, a map from stage to a map from key to a number."""
    stages = reports.select(F.explode("stages").alias("stage", "counts"))
    return stages.select("stage", F.explode("counts").alias("key", "v")).groupBy("stage", "key").agg(F.sum("v").alias("n"))


#: Bytes of a file and files of a site that can be deployed.
FILE_BYTES, FILES = 25 * 1024 * 1024, 20_000


def dist_faults(files: DataFrame) -> DataFrame:
    """fault, path of a built site that can't be deployed: no_index, large (a file), many (files), redirect (a line of _redirects that isn't two parts from a path on). files: path, size, text."""
    spark = files.sparkSession
    index = spark.createDataFrame([("index.html",)], "path string").join(files.select("path"), "path", "left_anti").select(F.lit("no_index").alias("fault"), "path")
    large = files.filter(F.col("size") > FILE_BYTES).select(F.lit("large").alias("fault"), "path")
    many = files.agg(F.count("*").alias("n")).filter(F.col("n") > FILES).select(F.lit("many").alias("fault"), F.col("n").cast("string").alias("path"))
    lines = files.filter("path = '_redirects'").select(F.explode(F.split("text", r"\r?\n")).alias("line")).filter("trim(line) <> '' AND NOT startswith(line, '#')")
    broken = lines.filter(~F.col("line").rlike(r"^\s*/\S*\s+\S")).select(F.lit("redirect").alias("fault"), F.col("line").alias("path"))
    return reduce(DataFrame.unionByName, [index, large, many, broken])


def _query(**parts: Column) -> Column:
    return F.concat_ws("&", *[F.concat(F.lit(f"{k}="), F.url_encode(v.cast("string"))) for k, v in parts.items()])


def map_links(query: Column, key: Column) -> Column:
    """struct of link (a search on the map) and src (an embedded map, NULL without a key) for a place by its name."""
    return F.struct(
        F.concat(F.lit("https://www.google.com/maps/search/?"), _query(api=F.lit(1), query=query)).alias("link"),
        F.concat(F.lit("https://www.google.com/maps/embed/v1/place?"), F.replace(_query(key=key, q=query, language=F.lit("ja"), region=F.lit("JP")), F.lit("+"), F.lit("%20"))).alias("src"),
    )


def street_links(lat: Column, lng: Column, key: Column) -> Column:
    """struct of link and src for a view of the street at a place."""
    place = F.concat_ws(",", lat.cast("string"), lng.cast("string"))
    return F.struct(
        F.concat(F.lit("https://www.google.com/maps/@?"), _query(api=F.lit(1), map_action=F.lit("pano"), viewpoint=place)).alias("link"), F.concat(F.lit("https://www.google.com/maps/embed/v1/streetview?"), _query(key=key, location=place)).alias("src")
    )


def review_table(candidates: DataFrame) -> DataFrame:
    """row: the waiting candidates as rows of a table in Markdown, by id."""
    cell = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("|"), F.lit("\\|"))
    return review_pending(candidates).orderBy("id").select(F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in ("id", "title", "url", "note"))), F.lit(" |")).alias("row"))

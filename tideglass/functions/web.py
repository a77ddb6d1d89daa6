"""Expressions over URLs, hashes, quotes, licence wording, personal data and page markup."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideglass.functions.base import nfkc, once

# Hosts of third-party platforms; ordered patterns of licences that allow reuse; patterns that forbid it.
PLATFORMS = ["akiya-athome.jp", "athome.co.jp", "homes.co.jp", "rakuen-akiya.jp", "akiyabank-all.com", "hatomarksite.com", "sumai.biz", "fudousan.co.jp", "purehouse.jp", "athome-tochi.jp"]
_EDGE, _END = r"(?:^|[^\w-])", r"(?:$|[^\w.-]|\.(?:\D|$))"
ALLOWED = [
    (r"(?i)creativecommons\.org/licenses/by/4\.0", "CC-BY-4.0"),
    (r"(?i)creativecommons\.org/licenses/by/3\.0", "CC-BY-3.0"),
    (r"(?i)creativecommons\.org/licenses/by/2\.1/jp", "CC-BY-2.1-JP"),
    (r"(?i)creativecommons\.org/licenses/by-sa/4\.0", "CC-BY-SA-4.0"),
    (r"(?i)creativecommons\.org/licenses/by-sa/3\.0", "CC-BY-SA-3.0"),
    (r"(?i)creativecommons\.org/licenses/by-sa/2\.5", "CC-BY-SA-2.5"),
    (r"(?i)creativecommons\.org/licenses/by-sa/2\.1/jp", "CC-BY-SA-2.1-JP"),
    (r"(?i)creativecommons\.org/licenses/by-sa/2\.0", "CC-BY-SA-2.0"),
    (rf"(?i){_EDGE}CC[\s\-]?BY[\s\-]?SA[\s\-]?4\.0{_END}", "CC-BY-SA-4.0"),
    (rf"(?i){_EDGE}CC[\s\-]?BY[\s\-]?SA[\s\-]?3\.0{_END}", "CC-BY-SA-3.0"),
    (r"クリエイティブ・?コモンズ[・\s]*表示[-‐−ー]?継承\s*4\.0", "CC-BY-SA-4.0"),
    (r"クリエイティブ・?コモンズ[・\s]*表示[-‐−ー]?継承\s*3\.0", "CC-BY-SA-3.0"),
    (r"(?i)creativecommons\.org/publicdomain/zero/1\.0", "CC0-1.0"),
    (r"政府標準利用規約\s*[（(]\s*第\s*2\.0\s*版\s*[）)]", "GSTU-2.0"),
    (rf"(?i){_EDGE}CC[\s\-]?BY[\s\-]?4\.0{_END}", "CC-BY-4.0"),
    (r"クリエイティブ・?コモンズ[・\s]*表示\s*4\.0", "CC-BY-4.0"),
    (rf"{_EDGE}CC0(?:\s*1\.0)?{_END}", "CC0-1.0"),
    (r"(?i)creativecommons\.org/licenses/by/2\.5", "CC-BY-2.5"),
    (r"(?i)creativecommons\.org/licenses/by/2\.0", "CC-BY-2.0"),
    (r"(?i)creativecommons\.org/publicdomain/mark/1\.0", "PD-mark-1.0"),
    (rf"(?i){_EDGE}CC[\s\-]?BY[\s\-]?3\.0{_END}", "CC-BY-3.0"),
    (rf"(?i)public\s+domain|パブリックドメイン|{_EDGE}PD-(?:old|Japan|self|art|scan|US)", "public-domain"),
]
DENIED = [
    r"(?i)creativecommons\.org/licenses/by-(nc|nd)",
    rf"(?i){_EDGE}CC[\s\-]?BY[\s\-]?(?:NC|ND)(?:$|[^\w-])",
    r"(?i)非営利|改変禁止|転載を?禁|無断転載|All Rights Reserved",
    r"(?i)not\s+(?:be\s+)?in\s+the\s+public\s+domain|may\s+not\s+be\s+in\s+the\s+public|パブリックドメインではない|保護期間(?:内|満了していない)|著作権が存続",
]
#: Every pattern above holds one of these.
CLUE = r"creativecommons|cc[\s\-]?(?:by|0)|コモンズ|public|利用規約|パブリックドメイン|pd-|非営利|改変禁止|転載|rights reserved|保護期間|著作権"
# E-mail addresses; keys of queries that number pages.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PAGE_KEYS = ["page", "paged", "p", "pg", "pageno", "page_no"]
#: Characters of a fragment of a joined quote, and of a window that counts as verbatim.
FRAGMENT, VERBATIM = 4, 30


def host_of(url: Column) -> Column:
    """Lower-cased host, empty if there is none."""
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def under_host(host: Column, hosts: list[str]) -> Column:
    """The listed host that is the host or that it lies under; the first of several, NULL for none."""
    clean = [h.lower().lstrip(".") for h in hosts]
    return F.coalesce(*[F.when((host == h) | host.endswith("." + h), F.lit(h)) for h in clean])


def split_page(url: Column) -> Column:
    """struct of first (the URL of the first page) and page: from /page/N, or else a page key of the query; 1 if there is neither."""
    path, query = r"^([^?#]*?)/page/(\d+)/?(?=$|[?#])", rf"(?i)([?&])({'|'.join(PAGE_KEYS)})=(\d+)(?=&|#|$)"
    by_path, by_query = url.rlike(path), url.rlike(query)
    plain = F.regexp_replace(F.regexp_replace(url, query, "$1"), r"[?&]+$", "")
    first = F.when(by_path, F.regexp_replace(url, path, "$1/")).when(by_query, F.regexp_replace(plain, r"([?&])&+", "$1")).otherwise(url)
    page = F.when(by_path, F.regexp_extract(url, path, 2)).when(by_query, F.regexp_extract(url, query, 3)).try_cast("int")
    return F.struct(first.alias("first"), F.coalesce(page, F.lit(1)).alias("page"))


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def url_key(url: Column) -> Column:
    return F.substring(F.sha1(url.cast("binary")), 1, 16)


def squash(text: Column) -> Column:
    """NFKC, without any white space."""
    return F.regexp_replace(nfkc(text), r"(?U)\s+", "")


def quote_status(quote: Column, source: Column) -> Column:
    """quote, joined or missing: whether the source holds the quote, or all of two or more fragments that an ellipsis or line break joins, each of FRAGMENT characters."""
    body = squash(source)
    whole = squash(quote)
    parts = F.filter(F.transform(F.split(quote, r"…+|\.{3}|[\r\n]+"), squash), lambda p: p != "")
    joined = (F.size(parts) >= 2) & F.forall(parts, lambda p: (F.length(p) >= FRAGMENT) & F.contains(body, p))
    return F.when((whole != "") & F.contains(body, whole), "quote").when(joined, "joined").otherwise("missing")


def _runs(text: Column, n: int) -> Column:
    """All runs of n characters of a text, one at each place."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def windows(text: Column, n: int = VERBATIM) -> Column:
    """Hashes of all runs of n characters of a text, each once."""
    return F.array_distinct(F.transform(_runs(text, n), lambda w: F.xxhash64(w)))


def verbatim(text: Column, source: Column, n: int = VERBATIM) -> Column:
    """Whether any n characters of the text stand in the source. The source's runs are hashed once; equal hashes are looked at again."""

    def found(x: Column) -> Column:
        same = F.filter(x["runs"], lambda w: F.array_contains(x["hashes"], F.xxhash64(w)))
        overlap = F.arrays_overlap(F.transform(x["runs"], lambda w: F.xxhash64(w)), x["hashes"])
        return F.when(overlap, F.exists(same, lambda w: F.contains(source, w))).otherwise(F.lit(False))

    return once(F.struct(_runs(text, n).alias("runs"), windows(source, n).alias("hashes")), found)


def licence(text: Column) -> Column:
    """struct of licence (NULL unless granted) and verdict: granted, mixed, denied or none; the first allowing pattern of the list counts, any forbidding one vetoes."""
    # texts with none of the words that every pattern needs are left out early
    clue = F.lower(text).rlike(CLUE)
    deny = F.lit(False)
    for p in DENIED:
        deny = deny | text.rlike(p)
    found = F.when(clue, F.struct(F.coalesce(*[F.when(text.rlike(p), F.lit(name)) for p, name in ALLOWED]).alias("allow"), deny.alias("deny"))).otherwise(F.struct(F.lit(None).cast("string").alias("allow"), F.lit(False).alias("deny")))

    def decided(x: Column) -> Column:
        verdict = F.when(x["allow"].isNotNull() & ~x["deny"], "granted").when(x["allow"].isNotNull(), "mixed").when(x["deny"], "denied").otherwise("none")
        return F.struct(F.when(verdict == "granted", x["allow"]).alias("licence"), verdict.alias("verdict"))

    return once(found, decided)


def licence_of_page(html: Column, text: Column, around: int = 80) -> Column:
    """licence, verdict and evidence (what stands around the allowing pattern, without tags, 300 characters at most) of a page: its HTML is looked at before its text."""
    page, body = F.coalesce(html, F.lit("")), F.coalesce(text, F.lit(""))

    def both(x: Column) -> Column:
        source = F.when(x["h"]["allow"].isNotNull(), page).otherwise(body)
        pattern = F.coalesce(x["h"]["allow"], x["t"]["allow"])
        tagless = lambda t: F.regexp_replace(t, "<[^>]+>", " ")
        parts = lambda p: [F.regexp_extract(source, f"(?s)(.{{0,{around}}})((?:{p}))(.{{0,{around}}})", i) for i in (1, 2, 3)]
        found = F.coalesce(*[F.when(pattern == p, F.concat(tagless(a), m, tagless(z))) for p, _ in ALLOWED for a, m, z in [parts(p)]])
        name = F.create_map(*[F.lit(v) for pair in ALLOWED for v in pair])[pattern]
        deny = x["h"]["deny"] | x["t"]["deny"]
        verdict = F.when(name.isNotNull() & ~deny, "granted").when(name.isNotNull(), "mixed").when(deny, "denied").otherwise("none")
        evidence = F.trim(F.regexp_replace(found, r"\s+", " "))
        return F.struct(F.when(verdict == "granted", name).alias("licence"), verdict.alias("verdict"), F.when(verdict == "granted", F.substring(evidence, 1, 300)).alias("evidence"))

    def looked(t: Column) -> Column:
        deny = F.lit(False)
        for p in DENIED:
            deny = deny | t.rlike(p)
        return F.when(F.lower(t).rlike(CLUE), F.struct(F.coalesce(*[F.when(t.rlike(p), F.lit(p)) for p, _ in ALLOWED]).alias("allow"), deny.alias("deny"))).otherwise(F.struct(F.lit(None).cast("string").alias("allow"), F.lit(False).alias("deny")))

    return once(F.struct(looked(page).alias("h"), looked(body).alias("t")), both)


def emails(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))


def is_government(email: Column) -> Column:
    domain = F.lower(F.regexp_replace(F.element_at(F.split(email, "@"), -1), r"\.+$", ""))
    return domain.endswith(".lg.jp") | domain.endswith(".go.jp") | domain.rlike(MUNICIPAL)


def page_faults(html: Column) -> Column:
    """What a published page lacks, in a fixed order: title, lang, canonical, og:title, json_ld."""
    needs = {
        "title": r"(?is)<title[^>]*>\s*[^<\s]", "lang": r"(?i)<html[^>]*\slang=", "canonical": r"(?i)<link[^>]*rel=[\"']?canonical", "og:title": r"(?i)<meta[^>]*property=[\"']og:title", "json_ld": r"(?i)application/ld\+json",
    }
    return F.array_compact(F.array(*[F.when(~html.rlike(p), F.lit(n)) for n, p in needs.items()]))


# Patterns of phone numbers, of names with a form of address and of labelled names; names and endings that are none.
PHONE = r"(?<![\d-])(?:0\d{1,4}-\d{1,4}-\d{4}|\(0\d{1,4}\)\s?\d{1,4}-\d{4})(?![\d-])"
ADDRESSED = r"([一-龥]{2,4})(?:様(?!式)|さん|氏(?!名))"
LABELLED = r"(?:氏名|お名前|ご担当者?|担当者|所有者|売主|貸主|貸主氏名|代表者|世帯主)\s*[:：]\s*([^\s、。,.<>「」【】\r\n]{1,24})"
NO_NAMES = ["皆様", "皆さん", "お客様", "各位", "関係者", "利用者", "訪問者", "来訪者", "神様", "王様", "殿様", "奥様", "旦那様", "地域", "個人", "法人", "未定", "非公開"]
ORGANISATIONS = "財団|法人|会社|協会|組合|機構|連盟|協議会|委員会|学校|大学|高校|病院|医院|神社|寺院|教会|役所|役場|支店|本店|本社|支部|事務所|事業団|公社|公団|商会|組|会|社|団|局|部|課|店|館|園|寺|宮"
ROLES = "新婚|大家|業者|事業者|所有者|入居者|申請者|相談員|管理人"
NO_NAME_ENDINGS = f"(?:{ORGANISATIONS})$|(?:{ROLES})$"
NO_NAME_PARTS = "[0-9０-９]|円|割|%|％|分の"
# Wide digits and marks, dashes of phone numbers, and what they become; domains of public bodies.
WIDE_DIGITS, NARROW_DIGITS = "０１２３４５６７８９＠．（）－ー―‐‑–—−", "0123456789@.()--------"
MUNICIPAL = r"(?:^|\.)(?:city|town|vill|village|pref|metro|city-office)\.[a-z0-9.\-]+\.jp$"


def personal_data(text: Column) -> Column:
    """Array of kind and value: e-mail addresses that aren't a public body's, phone numbers, and names with a form of address or a label."""
    scan = F.translate(text, WIDE_DIGITS[:14], NARROW_DIGITS[:14])
    dashed = F.translate(text, WIDE_DIGITS, NARROW_DIGITS)
    of = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    mails = F.filter(emails(scan), lambda e: ~is_government(e))
    phones = F.regexp_extract_all(dashed, F.lit(PHONE), F.lit(0))
    addressed = F.filter(F.regexp_extract_all(scan, F.lit(ADDRESSED), F.lit(1)), lambda n: ~n.isin(NO_NAMES) & ~n.rlike(NO_NAME_ENDINGS))
    labelled = F.filter(F.regexp_extract_all(scan, F.lit(LABELLED), F.lit(1)), lambda n: ~n.isin(NO_NAMES) & ~n.rlike(NO_NAME_PARTS))
    return F.concat(of("email", mails), of("phone", phones), of("name", addressed), of("name", labelled))


def normalise_for_hash(text: Column, ignore: list[str] = ()) -> Column:
    """A page's text without what the patterns fit, one after the other, and without white space."""
    for pattern in ignore:
        text = F.regexp_replace(text, pattern, "")
    return squash(text)


ITEM = "(?:li|tr|dt|dd|p|div|section|article)"


def fingerprint(main: Column) -> Column:
    """A digest of the main part's HTML that doesn't hang on the order of its items: lines are cut around items, sorted and hashed."""
    cut = F.regexp_replace(F.regexp_replace(main, rf"(?i)(<{ITEM}\b[^>]*>)", "\n$1"), rf"(?i)(</{ITEM}>)", "$1\n")
    lines = F.filter(F.transform(F.split(cut, r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.coalesce(main, F.lit("")) == "", "").otherwise(F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.array_sort(lines), "\n"), 256)))


def normalise_phone(phone: Column) -> Column:
    return F.regexp_replace(F.translate(phone, WIDE_DIGITS, NARROW_DIGITS), "[^0-9]", "")


def personal_findings(text: Column, emails: list[str] = (), phones: list[str] = (), government: bool = True, around: int = 16) -> Column:
    """Array of kind, value and snippet (what stands around it) of personal data, but for the allowed addresses and numbers and, with ``government``, addresses of public bodies."""
    scan, dashed = F.translate(text, WIDE_DIGITS[:14], NARROW_DIGITS[:14]), F.translate(text, WIDE_DIGITS, NARROW_DIGITS)
    digits = [re.sub("[^0-9]", "", p.translate(str.maketrans(WIDE_DIGITS, NARROW_DIGITS))) for p in phones]

    def shown(kind: str, source: Column, values: Column) -> Column:
        quoted = lambda v: F.concat(F.lit(rf"(?s).{{0,{around}}}\Q"), v, F.lit(rf"\E.{{0,{around}}}"))
        snippet = lambda v: F.trim(F.regexp_replace(F.call_function("regexp_extract", source, quoted(v), F.lit(0)), r"\s+", " "))
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), snippet(v).alias("snippet")))

    of = lambda source, pattern, group=0: F.regexp_extract_all(source, F.lit(pattern), F.lit(group))
    mails = F.filter(of(scan, EMAIL), lambda e: ~F.lower(e).isin([x.lower() for x in emails]) & (~is_government(e) if government else F.lit(True)))
    numbers = F.filter(of(dashed, PHONE), lambda n: ~normalise_phone(n).isin(digits))
    name = lambda w: F.regexp_extract(w, ADDRESSED, 1)
    addressed = F.filter(of(scan, ADDRESSED), lambda w: ~name(w).isin(NO_NAMES) & ~w.isin(NO_NAMES) & ~name(w).rlike(NO_NAME_ENDINGS))
    labelled = F.filter(of(scan, LABELLED), lambda w: ~F.regexp_extract(w, LABELLED, 1).isin(NO_NAMES) & ~F.regexp_extract(w, LABELLED, 1).rlike(NO_NAME_PARTS))
    return F.concat(shown("email", scan, mails), shown("phone", dashed, numbers), shown("name", scan, addressed), shown("name", scan, labelled))

"""Small expressions: numbers and days as they are shown, addresses of pages and files, reasons, keys and street numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideglass.functions.base import once

NONE = "—"
# Wordings by which terms ask for a permission; labels of licence boxes; names of character sets; statuses of a refusal; models that take a temperature.
PERMISSION = "申請|許可を得|承認を得|要相談|お問い合わせのうえ|事前に連絡|使用許可|利用許可|届出|審査|個別に契約"
BOX_LABELS = [
    (r"(?i)licenses/by-sa|BY[\s-]?SA|ShareAlike|継承", "CC BY-SA（継承）"),
    (r"(?i)licenses/by-nc|BY[\s-]?NC|NonCommercial|非営利", "CC BY-NC（非営利）"),
    (r"(?i)licenses/by-nd|BY[\s-]?ND|NoDerivatives|改変禁止", "CC BY-ND（改変禁止）"),
    (r"(?i)GNU Free Documentation|GFDL", "GFDL"),
    (r"(?i)public domain|パブリックドメイン|PD-", "パブリックドメイン表示"),
    (r"(?i)fair use|フェアユース", "フェアユース主張"),
]
NO_LABEL = "判定できない表記"
CHARSETS = {"shift_jis": "cp932", "shift-jis": "cp932", "sjis": "cp932", "x-sjis": "cp932", "windows-31j": "cp932", "ms932": "cp932", "cp932": "cp932", "euc-jp": "euc_jp", "eucjp": "euc_jp", "x-euc-jp": "euc_jp", "euc_jp": "euc_jp", "utf8": "utf-8", "utf-8": "utf-8", "iso-2022-jp": "iso2022_jp", "iso2022_jp": "iso2022_jp", "iso-8859-1": "iso8859-1", "latin-1": "iso8859-1", "latin1": "iso8859-1", "windows-1252": "cp1252", "cp1252": "cp1252", "us-ascii": "ascii", "ascii": "ascii", "utf-16": "utf-16"}
REFUSED = [403, 429]
SAMPLING = ["haiku-4-5", "sonnet-4-5", "opus-4-5", "opus-4-1", "-3-"]
FILE_PATH = r"^(https?://.*?/(?:commons|[a-z]+))/([0-9a-f])/([0-9a-f]{2})/([^/]+)$"
KANJI = "〇一二三四五六七八九十百千"


def _shown(value: Column, text: Column) -> Column:
    return F.when(value.isNull(), NONE).otherwise(text)


def _grouped(value: Column) -> Column:
    return F.format_number(value.cast("long"), 0)


def format_yen(value: Column) -> Column:
    """Whole yen below 10,000; else 億 and 万, the rest below 万 as one decimal of it; a dash for NULL. Halves are rounded to even yen."""

    def text(v: Column) -> Column:
        oku, below = F.floor(v / 100_000_000), v % 100_000_000
        man, tail = F.floor(below / 10_000), below % 10_000
        hundreds = F.when(oku > 0, F.concat(_grouped(oku), F.lit("億"))).otherwise("")
        part = F.when(tail > 0, F.concat(F.format_number(F.bround((below / F.lit(10_000)).cast("decimal(20,4)"), 1), 1), F.lit("万"))).when(man > 0, F.concat(_grouped(man), F.lit("万"))).otherwise("")
        return F.when(v < 10_000, F.concat(_grouped(v), F.lit("円"))).otherwise(F.concat(hundreds, part, F.lit("円")))

    return _shown(value, once(F.bround(value, 0).cast("long"), text))


def format_m2(value: Column) -> Column:
    """Square metres with one decimal unless they are whole."""
    return _shown(value, F.concat(F.when(value == F.floor(value), _grouped(value)).otherwise(F.format_number(F.bround(value.cast("double"), 1), 1)), F.lit("㎡")))


def format_number(value: Column) -> Column:
    return _shown(value, _grouped(value))


def format_date(at: Column) -> Column:
    """The day in Japan of a moment in UTC."""
    return _shown(at, F.date_format(F.from_utc_timestamp(at, "Asia/Tokyo"), "y年M月d日"))


def format_datetime(at: Column) -> Column:
    return _shown(at, F.date_format(F.from_utc_timestamp(at, "Asia/Tokyo"), "y年M月d日 HH:mm"))


def suggest_id(name: Column) -> Column:
    """The Latin words and numbers of a name with hyphens between, 40 characters at most; empty if it has none."""
    return F.regexp_replace(F.substring(F.array_join(F.transform(F.regexp_extract_all(name, F.lit("[0-9A-Za-z]+"), F.lit(0)), F.lower), "-"), 1, 40), "^-+|-+$", "")


def strip_query(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)[?#].*$", "")


def thumbnail_url(url: Column, width: int = 640) -> Column:
    """The address of a smaller picture of a file stored by its digest; SVG files come as PNG. NULL for other addresses."""

    def of(u: Column) -> Column:
        part = lambda i: F.regexp_extract(u, FILE_PATH, i)
        small = F.concat(F.lit(f"{width}px-"), part(4), F.when(F.lower(part(4)).endswith(".svg"), ".png").otherwise(""))
        return F.when(u.rlike(FILE_PATH), F.concat_ws("/", part(1), F.lit("thumb"), part(2), part(3), part(4), small))

    return once(strip_query(url), of)


def _title(url: Column) -> Column:
    return F.replace(F.regexp_replace(F.url_decode(F.regexp_replace(F.element_at(F.split(url, "/"), -1), r"\+", "%2B")), r"^[^:]*:", ""), F.lit("_"), F.lit(" "))


def file_title(url: Column) -> Column:
    """What stands behind the name space of a file's page, with spaces."""
    return _title(url)


def category_name(url: Column) -> Column:
    return _title(F.regexp_replace(url, "/+$", ""))


def url_path(path: Column) -> Column:
    """The path that a page is served at: without index.html."""
    return F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+", "")), r"index\.html$", "")


def host_variants(base_url: Column) -> Column:
    """The three other forms of a site's first page: by http, and with or without www."""

    def of(host: Column) -> Column:
        other = F.when(host.startswith("www."), F.substring(host, F.lit(5), F.length(host))).otherwise(F.concat(F.lit("www."), host))
        return F.array(F.concat(F.lit("http://"), host, F.lit("/")), F.concat(F.lit("https://"), other, F.lit("/")), F.concat(F.lit("http://"), other, F.lit("/")))

    return once(F.regexp_extract(base_url, r"^(?:[^/]*//)?([^/]*)", 1), of)


def robots_reason(error: Column) -> Column:
    """Why a fetch was left out: refused, answered (with the status) or unreachable."""
    return F.when(error.contains("拒否"), "refused").when(error.rlike(r"robots\.txt \d{3}"), F.concat(F.lit("status "), F.regexp_extract(error, r"robots\.txt (\d{3})", 1))).otherwise("unreachable")


def unreachable(status: Column, error: Column, blocked: Column) -> Column:
    """Whether a fetch says nothing of the page: no connection (but not for robots rules), or a refusal."""
    return ((status == 0) & (F.coalesce(error, F.lit("")) != "") & ~F.coalesce(blocked, F.lit(False))) | status.isin(REFUSED)


def supports_sampling(model: Column) -> Column:
    """Whether a model's name has one of the tags of those that take a temperature."""
    name, out = F.lower(model), F.lit(False)
    for tag in SAMPLING:
        out = out | name.contains(tag)
    return out


def needs_permission(text: Column) -> Column:
    """The first wording that asks for a permission, NULL for none."""
    return F.nullif(F.regexp_extract(text, PERMISSION, 0), F.lit(""))


def box_label(html: Column, licence_id: Column) -> Column:
    """A short name for a licence box: the licence if there is one, else the first label that fits."""
    return F.coalesce(licence_id, *[F.when(html.rlike(p), label) for p, label in BOX_LABELS], F.lit(NO_LABEL))


def canonical_encoding(name: Column) -> Column:
    """One name for each character set; NULL for names that aren't known."""
    known = F.create_map(*[F.lit(x) for p in CHARSETS.items() for x in p])
    return F.try_element_at(known, F.lower(F.trim(name)))


def origin_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)


def agent_token(user_agent: Column) -> Column:
    """The product's name, by which robots rules know a client."""
    return F.coalesce(F.nullif(F.regexp_extract(user_agent, r"^([^/ ]*)", 1), F.lit("")), F.lit("*"))


def nice_ticks(largest: Column, target: int = 4) -> Column:
    """Marks of an axis from 0 on, in steps of 1, 2 or 5 times a power of ten, until the largest value is reached."""

    def of(m: Column) -> Column:
        raw = m / target
        power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
        step = F.coalesce(*[F.when(power * k >= raw, power * k) for k in (1, 2, 5)], power * 10)
        return once(step, lambda s: F.transform(F.sequence(F.lit(0), F.ceil(m / s + 0.999).cast("int") - 1), lambda i: i * s))

    return F.when(largest > 0, once(largest.cast("double"), of)).otherwise(F.array(F.lit(0.0), F.lit(1.0)))


def request_key(provider: Column, model: Column, system: Column, user: Column, schema_json: Column) -> Column:
    """The key of a model request; equal requests have equal keys. ``schema_json`` is JSON with sorted keys."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    body = F.concat(F.lit('{"model": '), quoted(model), F.lit(', "provider": '), quoted(provider), F.lit(', "schema": '), schema_json, F.lit(', "system": '), quoted(system), F.lit(', "user": '), quoted(user), F.lit("}"))
    return F.substring(F.sha2(body, 256), 1, 24)


def prepare_input(text: Column, most: int = 60_000) -> Column:
    """struct of text, cut to ``most`` characters, and truncated. That is the size that a model takes, so longer pages are told apart by the flag."""
    return F.struct(F.substring(text, 1, most).alias("text"), (F.length(text) > most).alias("truncated"))


STREET = rf"[\s　]*(?:字\s*)?(?:[甲乙丙丁戊]\s*)?(?:\d|[{KANJI}]+(?:番地|号))"


def _masked(text: Column) -> Column:
    """With the numbers of districts (丁目, 条) as marks, character for character."""
    return F.regexp_replace(text, rf"\d(?=\d*(?:丁目|条))|[{KANJI}](?=[{KANJI}]*(?:丁目|条))", "〓")


def _address(text: Column) -> Column:
    return F.trim(F.translate(F.translate(text, "０１２３４５６７８９　－", "0123456789 -"), "‐‑−", "---"))


def has_street_number(text: Column) -> Column:
    """Whether an address goes on below the district: a number, or a number in words with 番地 or 号."""
    return _masked(_address(text)).rlike(STREET)


def strip_street_number(text: Column) -> Column:
    """struct of kept (down to the district) and removed (NULL if there is nothing below it); where nothing could be kept, all is removed."""

    def cut(t: Column) -> Column:
        at = F.regexp_instr(_masked(t), F.lit(STREET))
        kept = F.trim(F.regexp_replace(F.when(at > 0, F.substring(t, F.lit(1), at - 1)).otherwise(t), r"[\s　\-‐‑–—ー・,、。／/]+$", ""))
        removed = F.nullif(F.trim(F.when(at > 0, F.substring(t, at, F.length(t))).otherwise("")), F.lit(""))
        return F.when((kept == "") & (t != ""), F.struct(F.lit("").alias("kept"), t.alias("removed"))).otherwise(F.struct(kept.alias("kept"), removed.alias("removed")))

    return once(_address(text), cut)

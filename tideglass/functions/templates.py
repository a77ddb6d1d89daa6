"""Page templates that become column expressions.

A template is text with ``{{ value | form }}``, ``{% if value %} … {% else %} … {% endif %}``, ``{% for x in values %} … {% endfor %}`` and ``{% include name %}``. It is compiled once, into one
expression over the columns of the rows that it renders: text becomes literals, a value a field of a struct, a loop a ``transform`` of an array. So pages are rendered where their rows are,
by generated code, and a name that the rows don't have is an error before any page is made.

Values are escaped unless their form is ``raw`` or they are JSON; NULL is empty text. A condition holds for what isn't NULL, false, zero, or empty; ``not`` turns it round.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, NumericType, StringType, StructType

from tideglass.functions import forms, locales
from tideglass.functions.base import once

_PIECE = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
_VALUE = re.compile(r"""^\s*(?P<what>'[^']*'|"[^"]*"|[A-Za-z_]\w*(?:\.\w+)*)\s*(?P<forms>(?:\|\s*\w+\s*)*)$""")

#: Forms of a value; those that depend on the page's locale get its code.
FORMS: dict[str, Callable[[Column], Column]] = {"yen": forms.format_yen, "m2": forms.format_m2, "number": forms.format_number, "date_ja": forms.format_date, "datetime_ja": forms.format_datetime, "json": lambda c: F.replace(F.to_json(c), F.lit("</"), F.lit("<\\/"))}
LOCAL_FORMS: dict[str, Callable[[Column, Column], Column]] = {
    "day": locales.format_day, "short_day": lambda c, code: locales.format_day(c, code, locales.SHORT), "moment": lambda c, code: locales.format_day(c, code, locales.TIME), "money": locales.format_money,
}


class TemplateError(ValueError):
    """A template that can't be compiled."""


def escaped(text: Column) -> Column:
    """Text as it stands in HTML, in attributes too."""
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def wording(catalogs: Mapping[str, Mapping[str, str]], default: str) -> Callable[[Column, Column], Column]:
    """A function of (locale, key): the text in the locale, or else in the default one; a key that neither has stands for itself."""
    flat = [F.lit(x) for code, texts in catalogs.items() for key, text in texts.items() for x in (f"{code}\x00{key}", text)]
    known = F.create_map(*flat) if flat else F.create_map().cast("map<string,string>")
    at = lambda code, key: F.try_element_at(known, F.concat(code, F.lit("\x00"), key))
    return lambda code, key: F.coalesce(at(code, key), at(F.lit(default), key), key)


class Templates:
    """Named templates, and what they may use: wordings by locale and key (form ``t``)."""

    def __init__(self, texts: Mapping[str, str], translate: Callable[[Column, Column], Column] | None = None, locale: str = "locale"):
        self.texts, self.translate, self.locale = {**PARTS, **texts}, translate, locale

    def column(self, name: str, schema: StructType) -> Column:
        """The page that a template makes of a row with this schema."""
        scope = {f.name: (F.col(f"`{f.name}`"), f.dataType) for f in schema.fields}
        nodes, rest = self._parsed(self._pieces(name), ())
        return self._joined(nodes, scope)

    def render(self, which: Column, names: list[str], schema: StructType) -> Column:
        """By the template that a row names; NULL for a name that isn't among ``names``."""
        out = F.lit(None).cast("string")
        for name in names:
            out = F.when(which == name, self.column(name, schema)).otherwise(out)
        return out

    # -- text to nodes

    def _pieces(self, name: str, inside: tuple[str, ...] = ()) -> list[str]:
        if name not in self.texts:
            raise TemplateError(f"there is no template {name!r}")
        if name in inside:
            raise TemplateError(f"{name!r} includes itself")
        out = []
        for piece in _PIECE.split(self.texts[name]):
            if piece.startswith("{%") and piece[2:-2].split()[:1] == ["include"]:
                out += self._pieces(piece[2:-2].split()[1], (*inside, name))
            else:
                out.append(piece)
        return out

    def _parsed(self, pieces: list[str], ends: tuple[str, ...]) -> tuple[list, str]:
        """Nodes up to one of the ends, which is given too. Takes what it reads from the pieces."""
        nodes: list = []
        while pieces:
            piece = pieces.pop(0)
            if piece.startswith("{{"):
                nodes.append(("value", piece[2:-2]))
            elif piece.startswith("{%"):
                words = piece[2:-2].split()
                if words[0] in ends:
                    return nodes, words[0]
                if words[0] == "if":
                    then, end = self._parsed(pieces, ("else", "endif"))
                    other = self._parsed(pieces, ("endif",))[0] if end == "else" else []
                    nodes.append(("if", words[1:], then, other))
                elif words[0] == "for" and len(words) == 4 and words[2] == "in":
                    nodes.append(("for", words[1], words[3], self._parsed(pieces, ("endfor",))[0]))
                else:
                    raise TemplateError(f"what is {piece!r}?")
            elif piece:
                nodes.append(("text", piece))
        if ends:
            raise TemplateError(f"there is no {' or '.join(ends)}")
        return nodes, ""

    # -- nodes to columns

    def _joined(self, nodes: list, scope: dict) -> Column:
        parts = [self._made(n, scope) for n in nodes]
        return F.concat(*parts) if parts else F.lit("")

    def _made(self, node: tuple, scope: dict) -> Column:
        kind = node[0]
        if kind == "text":
            return F.lit(node[1])
        if kind == "value":
            return self._value(node[1], scope)
        if kind == "if":
            turned = node[1][0] == "not"
            holds = self._holds(*self._found(node[1][-1], scope))
            return F.when(~holds if turned else holds, self._joined(node[2], scope)).otherwise(self._joined(node[3], scope))
        values, of = self._found(node[2], scope)
        if not isinstance(of, ArrayType):
            raise TemplateError(f"{node[2]} has no elements")
        each = F.transform(values, lambda x: self._joined(node[3], {**scope, node[1]: (x, of.elementType)}))
        return F.coalesce(F.array_join(each, ""), F.lit(""))

    def _value(self, text: str, scope: dict) -> Column:
        m = _VALUE.match(text)
        if not m:
            raise TemplateError(f"what is {text.strip()!r}?")
        what, applied = m["what"], m["forms"].replace("|", " ").split()
        value, of = (F.lit(what[1:-1]), StringType()) if what[0] in "'\"" else self._found(what, scope)
        raw = False
        for form in applied:
            if form == "raw":
                raw = True
            elif form == "t" and self.translate:
                value, of = self.translate(self._code(scope), value), StringType()
            elif form in LOCAL_FORMS:
                value, of = LOCAL_FORMS[form](value, self._code(scope)), StringType()
            elif form in FORMS:
                value, of, raw = FORMS[form](value), StringType(), raw or form == "json"
            else:
                raise TemplateError(f"there is no form {form!r}")
        if isinstance(of, StructType | ArrayType | MapType):
            raise TemplateError(f"{what} is no single value")
        value = F.coalesce(value.cast("string"), F.lit(""))
        return value if raw else escaped(value)

    def _code(self, scope: dict) -> Column:
        return self._found(self.locale, scope)[0]

    def _found(self, path: str, scope: dict) -> tuple[Column, DataType]:
        first, *rest = path.split(".")
        if first not in scope:
            raise TemplateError(f"there is no {first!r}; there are {', '.join(sorted(scope))}")
        value, of = scope[first]
        for name in rest:
            if isinstance(of, MapType):
                value, of = F.try_element_at(value, F.lit(name)), of.valueType
                continue
            if not isinstance(of, StructType) or name not in of.names:
                raise TemplateError(f"{path} has no {name!r}")
            value, of = value[name], of[name].dataType
        return value, of

    @staticmethod
    def _holds(value: Column, of: DataType) -> Column:
        if isinstance(of, BooleanType):
            return F.coalesce(value, F.lit(False))
        if isinstance(of, StringType):
            return F.coalesce(value != "", F.lit(False))
        if isinstance(of, ArrayType | MapType):
            return F.coalesce(F.size(value) > 0, F.lit(False))
        return F.coalesce(value != 0, F.lit(False)) if isinstance(of, NumericType) else value.isNotNull()


def beacon(provider: str, token: str | None) -> str:
    """The tag that counts visits; none without a token or for a provider that isn't known."""
    if not token or provider != "cloudflare":
        return ""
    safe = token.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#x27;")
    return f"<script defer src=\"https://static.cloudflareinsights.com/beacon.min.js\" data-cf-beacon='{{\"token\": \"{safe}\"}}'></script>"


def shown_field(value: Column, quote: Column, missing: str = "記載なし") -> Column:
    """A field with what it says in the source, where that is written otherwise; ``missing`` for NULL."""
    said = lambda q: F.concat(F.lit("（原文: "), escaped(q), F.lit("）"))
    beside = F.when(quote.isNotNull() & (quote != "") & (quote != value), F.concat(F.lit(' <span class="quote">'), said(quote), F.lit("</span>"))).otherwise("")
    gone = F.concat(F.lit(f'<span class="missing">{missing}'), F.when(quote.isNotNull() & (quote != ""), said(quote)).otherwise(""), F.lit("</span>"))
    return once(value.cast("string"), lambda v: F.when(v.isNull(), gone).otherwise(F.concat(escaped(v), beside)))


#: Parts that templates may include. They need: trust (updated_at, record_count, sources with url, label and fetched_at, operator with name, url, contact and label), locale; for the head: base_url, url_path, title, description,
#: og_type, og_locale, noindex, site_name, hreflangs (hreflang, href), structured_data (JSON texts), beacon; for a photo: asset (asset_id, alt, credit, page_url, fetched_at) and src. Wordings: trust.* and asset.*.
PARTS = {
    "trust": """<section class="trust" data-trust aria-label="{{ 'trust.title' | t }}"><h2>{{ 'trust.title' | t }}</h2><dl>
<dt>{{ 'trust.updated' | t }}</dt><dd><time>{{ trust.updated_at | moment }}</time> {{ 'trust.timezone' | t }}</dd>
{% if trust.record_count %}<dt>{{ 'trust.count' | t }}</dt><dd>{{ trust.record_count | number }}</dd>
{% endif %}<dt>{{ 'trust.sources' | t }}</dt><dd>{% if trust.sources %}<ul>{% for s in trust.sources %}<li><a href="{{ s.url }}" rel="noopener">{{ s.label }}</a>{% if s.fetched_at %} ({{ s.fetched_at | moment }}){% endif %}</li>{% endfor %}</ul>{% else %}{{ 'trust.sources_default' | t }}{% endif %}</dd>
<dt>{{ 'trust.operator' | t }}</dt><dd>{{ trust.operator.name }}{% if trust.operator.url %} (<a href="{{ trust.operator.url }}">{{ 'trust.details' | t }}</a>){% endif %}</dd>
<dt>{{ 'trust.contact' | t }}</dt><dd>{% if trust.operator.label %}<a href="{{ trust.operator.contact }}" rel="noopener">{{ trust.operator.label }}</a>{% else %}{{ trust.operator.contact }}{% endif %}</dd>
</dl></section>""",
    "head": """<link rel="canonical" href="{{ base_url }}{{ url_path }}">
{% if noindex %}<meta name="robots" content="noindex">
{% endif %}{% for l in hreflangs %}<link rel="alternate" hreflang="{{ l.hreflang }}" href="{{ l.href }}">
{% endfor %}<meta property="og:type" content="{{ og_type }}"><meta property="og:title" content="{{ title }}"><meta property="og:description" content="{{ description }}"><meta property="og:url" content="{{ base_url }}{{ url_path }}"><meta property="og:site_name" content="{{ site_name }}"><meta property="og:locale" content="{{ og_locale }}">
{% for node in structured_data %}<script type="application/ld+json">{{ node | raw }}</script>
{% endfor %}{{ beacon | raw }}""",
    "photo": """<figure class="photo"><img src="{{ src }}" alt="{{ asset.alt }}" data-asset="{{ asset.asset_id }}" loading="lazy"><figcaption>{{ asset.credit }}{% if asset.page_url %} <a href="{{ asset.page_url }}" rel="noopener nofollow">{{ 'asset.source' | t }}</a>{% endif %} <span>{{ asset.fetched_at | day }}</span></figcaption></figure>""",
}

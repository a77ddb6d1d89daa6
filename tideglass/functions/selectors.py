"""Selectors over pages as flat tables of nodes.

``page_nodes`` reads a page once and gives its elements and texts in the order of the page, each with its parent and the last node inside it. A selector is compiled into an expression over that array: an element lies in another one if its
place is within that one's, and is its child if it names it as its parent. So what is asked of a page is stated in columns, and yields only that.

Selectors: ``tag``, ``*``, ``#id``, ``.class`` (several), ``[attribute]`` with ``=``, ``^=``, ``$=``, ``*=`` or ``~=``, put together with white space (anywhere inside), ``>`` (a child) and commas (any of several).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructField, StructType

from tideglass.functions.base import once
from tideglass.functions.html import BLOCK, CLOSES, VOID, Node, parse

NODE = StructType([StructField("at", IntegerType()), StructField("tag", StringType()), StructField("parent", IntegerType()), StructField("last", IntegerType()), StructField("attrs", MapType(StringType(), StringType())), StructField("text", StringType())])
#: Characters of pages whose nodes a worker holds at once (or one longer page).
PART = 500_000
#: The tag of a text.
TEXT = "#text"

_STEP = re.compile(r"\s*(>|\s|)\s*((?:[\w-]+|\*)?(?:#[\w-]+|\.[\w-]+|\[[^\]]*\])*)")
_PART = re.compile(r"#(?P<id>[\w-]+)|\.(?P<class>[\w-]+)|\[\s*(?P<name>[\w:-]+)\s*(?:(?P<how>[~^$*]?=)\s*(?P<value>\"[^\"]*\"|'[^']*'|[^\]\s]+)\s*)?\]")


# Pages that are nothing but such tags and texts, as composed ones often are, are read without a tree; attributes have quoted values, texts no references.
_PLAIN = re.compile(r'''<([a-z][a-z0-9]*)(?: ([a-z][a-z0-9_-]*)="([^"<>&]*)"((?: [a-z][a-z0-9_-]*="[^"<>&]*")*))?>|</([a-z][a-z0-9]*)>|([^<&]+)''', re.ASCII)
_PLAIN_ATTRIBUTE = re.compile(r''' ([a-z][a-z0-9_-]*)="([^"]*)"''', re.ASCII)
#: Elements whose inside isn't read as tags.
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}
_ENDS = {t: frozenset(CLOSES.get(t, set()) | ({"p"} if t in BLOCK else set())) for t in {*CLOSES, *BLOCK}}


class SelectorError(ValueError):
    """A selector that can't be compiled."""


class Step(NamedTuple):
    """What one element has to be: inside or a child of the one before (``child``), of a kind, with these attributes as (name, how, value)."""

    child: bool
    tag: str | None
    attributes: tuple[tuple[str, str | None, str], ...]

    def fits(self, node: Column) -> Column:
        of = lambda name: F.try_element_at(node["attrs"], F.lit(name))
        tests = [node["tag"] == self.tag if self.tag else node["tag"] != TEXT]
        for name, how, value in self.attributes:
            had = of(name)
            test = {
                None: had.isNotNull(), "=": had == value, "^=": F.startswith(had, F.lit(value)) & F.lit(value != ""), "$=": F.endswith(had, F.lit(value)) & F.lit(value != ""), "*=": F.contains(had, F.lit(value)) & F.lit(value != ""),
                "~=": F.array_contains(F.split(F.trim(had), r"\s+"), value),
            }[how]
            tests.append(F.coalesce(test, F.lit(False)))
        return reduce(lambda a, b: a & b, tests)


def compiled(selector: str) -> list[list[Step]]:
    """The ways in which an element can fit, each a list of steps from the outside in."""
    ways = []
    for one in _split(selector):
        steps, at, one = [], 0, one.strip()
        while at < len(one):
            m = _STEP.match(one, at)
            if not m or not m[2] or (not steps and m[1] == ">"):
                raise SelectorError(f"what is {one!r}?")
            tag = re.match(r"[\w-]+|\*", m[2])
            if _PART.sub("", m[2][len(tag[0]) if tag else 0 :]):
                raise SelectorError(f"what is {m[2]!r}?")
            attributes = []
            for p in _PART.finditer(m[2], len(tag[0]) if tag else 0):
                if p["id"]:
                    attributes.append(("id", "=", p["id"]))
                elif p["class"]:
                    attributes.append(("class", "~=", p["class"]))
                else:
                    attributes.append((p["name"].lower(), p["how"], (p["value"] or "").strip("\"'")))
            steps.append(Step(m[1] == ">", tag[0].lower() if tag and tag[0] != "*" else None, tuple(attributes)))
            at = m.end()
        if not steps:
            raise SelectorError("an empty selector")
        ways.append(steps)
    return ways


def _split(selector: str) -> list[str]:
    """At commas that aren't inside brackets."""
    return re.split(r",(?![^\[]*\])", selector)


def _flat(root: Node) -> list[dict]:
    out: list[dict] = []
    stack: list[tuple[object, int]] = [(c, -1) for c in reversed(root.children)]
    while stack:
        n, parent = stack.pop()
        if n is None:
            out[parent]["last"] = len(out) - 1
            continue
        at = len(out)
        if isinstance(n, str):
            if n:
                out.append({"at": at, "tag": TEXT, "parent": parent, "last": at, "attrs": None, "text": n})
            continue
        out.append({"at": at, "tag": n.tag, "parent": parent, "last": at, "attrs": list(n.attrs.items()), "text": None})
        stack.append((None, at))
        stack += [(c, at) for c in reversed(n.children)]
    return out


class _Columns:
    """The nodes of some pages as columns."""

    def __init__(self):
        self.ends, self.at, self.tags, self.parents, self.lasts, self.texts, self.starts, self.keys, self.values = [0], [], [], [], [], [], [], [], []

    def add(self, html: str | None) -> None:
        first, pairs = len(self.tags), len(self.keys)
        if html and not self._plain(html, first):
            for column in (self.tags, self.parents, self.lasts, self.texts, self.starts):
                del column[first:]
            del self.keys[pairs:], self.values[pairs:]
            for n in _flat(parse(html)):
                self.tags.append(n["tag"])
                self.parents.append(n["parent"])
                self.lasts.append(n["last"])
                self.texts.append(n["text"])
                self.starts.append(None if n["attrs"] is None else len(self.keys))
                for k, v in n["attrs"] or ():
                    self.keys.append(k)
                    self.values.append(v)
        self.at += range(len(self.tags) - first)
        self.ends.append(len(self.tags))

    def _plain(self, html: str, first: int) -> bool:
        """The nodes as the parser and its tree would give them; False if the page has anything else."""
        tags, parents, lasts, texts, starts, keys, values = self.tags, self.parents, self.lasts, self.texts, self.starts, self.keys, self.values
        opened: list[int] = []  # places within the page
        at = chars = 0
        up = -1
        for tag, key, value, more, end, text in _PLAIN.findall(html):
            if tag:
                if tag in _RAW:
                    return False
                if opened and tag in _ENDS:
                    while opened and tags[first + opened[-1]] in _ENDS[tag]:
                        lasts[first + opened.pop()] = at - 1
                    up = opened[-1] if opened else -1
                tags.append(tag)
                texts.append(None)
                starts.append(len(keys))
                chars += len(tag) + 2
                if key:
                    chars += len(key) + len(value) + len(more) + 4
                    if more:
                        pairs = {key: value} | dict(_PLAIN_ATTRIBUTE.findall(more))
                        keys += pairs
                        values += pairs.values()
                    else:
                        keys.append(key)
                        values.append(value)
                parents.append(up)
                lasts.append(at)
                if tag not in VOID:
                    opened.append(at)
                    up = at
                at += 1
            elif end:
                chars += len(end) + 3
                for i in range(len(opened) - 1, -1, -1):
                    if tags[first + opened[i]] == end:
                        for o in opened[i:]:
                            lasts[first + o] = at - 1
                        del opened[i:]
                        up = opened[-1] if opened else -1
                        break
            else:
                chars += len(text)
                tags.append(TEXT)
                texts.append(text)
                starts.append(None)
                parents.append(up)
                lasts.append(at)
                at += 1
        for o in opened:
            lasts[first + o] = at - 1
        return chars == len(html)

    def array(self) -> pa.Array:
        maps = pa.MapArray.from_arrays(pa.array([*self.starts, len(self.keys)], pa.int32()), pa.array(self.keys, pa.string()), pa.array(self.values, pa.string()))
        columns = [pa.array(self.at, pa.int32()), pa.array(self.tags, pa.string()), pa.array(self.parents, pa.int32()), pa.array(self.lasts, pa.int32()), maps, pa.array(self.texts, pa.string())]
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), pa.StructArray.from_arrays(columns, [f.name for f in NODE]))


@F.arrow_udf(ArrayType(NODE))
def page_nodes(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The nodes of a page; none of an empty or null one. A batch of pages is read in parts, as the nodes of a page take many times its size."""
    for htmls in pages:
        part, size = _Columns(), 0
        for html in htmls:
            given = html.as_py()
            part.add(given)
            size += len(given or "")
            if size >= PART:
                yield part.array()
                part, size = _Columns(), 0
        yield part.array()


def _inside(nodes: Column, outer: Column, step: Step) -> Column:
    """The nodes that fit a step and lie in one of the outer ones, or are a child of it."""
    near = lambda n: F.exists(outer, lambda o: (n["parent"] == o["at"]) if step.child else (n["at"] > o["at"]) & (n["at"] <= o["last"]))
    return F.filter(nodes, lambda n: step.fits(n) & near(n))


def _way(nodes: Column, steps: list[Step]) -> Column:
    found = F.filter(nodes, steps[0].fits)
    for step in steps[1:]:
        found = once(found, lambda outer: _inside(nodes, outer, step))  # noqa: B023  (called at once)
    return found


def select(nodes: Column, selector: str, within: Column | None = None) -> Column:
    """The elements that fit, in the order of the page; only those inside the node ``within``, if it is given and not NULL."""

    ways = [_way(nodes, steps) for steps in compiled(selector)]
    # (maps can't be compared, so several ways are put together by the places that they find)
    if len(ways) == 1:
        found = ways[0]
    else:
        places = F.concat(*(F.transform(w, lambda n: n["at"]) for w in ways))
        found = once(places, lambda ps: F.filter(nodes, lambda n: F.array_contains(ps, n["at"])))
    if within is not None:
        found = F.filter(found, lambda n: within.isNull() | ((n["at"] > within["at"]) & (n["at"] <= within["last"])))
    return found


def first(nodes: Column, *selectors: str, within: Column | None = None) -> Column:
    """The first element that fits the first selector that any element fits; NULL if there is none."""
    return F.coalesce(*(F.get(select(nodes, s, within), F.lit(0)) for s in selectors))


def attribute(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))


def text(nodes: Column, node: Column) -> Column:
    """All texts inside a node, each trimmed, with single spaces between; NULL for no node."""
    inner = F.filter(nodes, lambda n: (n["tag"] == TEXT) & (n["at"] >= node["at"]) & (n["at"] <= node["last"]))
    parts = F.filter(F.transform(inner, lambda n: F.trim(F.regexp_replace(n["text"], r"(?U)\s+", " "))), lambda t: t != "")
    return F.when(node.isNotNull(), F.array_join(parts, " "))


def following(nodes: Column, node: Column) -> Column:
    """The next element beside a node; NULL if it is the last."""
    beside = F.filter(nodes, lambda n: (n["tag"] != TEXT) & (n["parent"] == node["parent"]) & (n["at"] > node["last"]))
    return F.get(beside, F.lit(0))


def markup(nodes: Column, node: Column) -> Column:
    """A node as HTML again: tags with their attributes, texts as they are; elements are ended where the next node is outside of them."""
    void = sorted(VOID)
    inner = F.filter(nodes, lambda n: (n["at"] >= node["at"]) & (n["at"] <= node["last"]))

    def written(n: Column) -> Column:
        attrs = F.array_join(F.transform(F.map_entries(n["attrs"]), lambda a: F.concat(F.lit(" "), a["key"], F.lit('="'), a["value"], F.lit('"'))), "")
        begin = F.when(n["tag"] == TEXT, n["text"]).otherwise(F.concat(F.lit("<"), n["tag"], F.coalesce(attrs, F.lit("")), F.lit(">")))
        ended = F.filter(inner, lambda e: (e["last"] == n["at"]) & (e["tag"] != TEXT) & ~e["tag"].isin(void))
        return F.concat(begin, F.array_join(F.reverse(F.transform(ended, lambda e: F.concat(F.lit("</"), e["tag"], F.lit(">")))), ""))

    return F.when(node.isNotNull(), F.array_join(F.transform(inner, written), ""))

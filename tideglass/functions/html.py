"""One pass over HTML that gives every signal of a page at once.

The tree is built from the standard library's tokenizer, with the implied ends of p, li, tr, td, th, dt, dd and option
and with void elements; each page is parsed once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import functions as F

# Elements without an end; elements that end another of their kind; elements on lines of their own; elements without text of the page; where the main part of a page is looked for.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
BLOCK = {"address", "article", "blockquote", "body", "caption", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"}
NOISE = {"script", "style", "noscript", "template", "iframe", "svg", "canvas", "form", "nav", "header", "footer", "aside"}
MAIN = ["main", "[role=main]", "#main", "#contents", "#content", "#main-content", ".main-content", "#mainContents", "#container .contents"]
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROWS = {"tr", "li", "article", "section", "dl", "div", "p"}
LINK_ROWS = {"tr", "li", "dd", "dt", "p", "td", "div"}
SKIPPED = ("mailto:", "tel:", "javascript:", "data:", "#")
#: Longest text of a row, of a link's row and of a heading; levels that a link's row is looked for upwards.
ROW_CHARS, CONTEXT_CHARS, HEADING_CHARS, LEVELS = 600, 120, 80, 6


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def all(self, *tags: str) -> Iterator[Node]:
        """Elements of these kinds below (or here), in the order of the page; of any kind if none is named."""
        stack = [self]
        while stack:
            n = stack.pop()
            if not tags or n.tag in tags:
                yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def text(self) -> str:
        """All texts below, each trimmed, with spaces between."""
        found, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                found.append(n.strip())
            else:
                stack += reversed(n.children)
        return " ".join(t for t in found if t)

    def is_(self, selector: str) -> bool:
        """One of: tag, #id, .class, [attribute], [attribute=value], or a tag with one of these."""
        tag, mark, rest = re.match(r"([\w-]*)([#.\[]?)(.*)", selector).groups()
        if tag and self.tag != tag:
            return False
        if mark == "#":
            return self.attrs.get("id") == rest
        if mark == ".":
            return rest in self.attrs.get("class", "").split()
        name, _, value = rest.rstrip("]").partition("=")
        return not mark or (name in self.attrs and (not value or self.attrs[name] == value.strip("\"'")))

    def first(self, selector: str) -> Node | None:
        """The first element that fits, of a list of selectors, each of steps with white space between."""
        for n in self.all():
            for one in selector.split(","):
                *above, last = one.split()
                if n is not self and n.is_(last):
                    up = n.parent
                    while above and up is not None:
                        if up.is_(above[-1]):
                            above.pop()
                        up = up.parent
                    if not above:
                        return n
        return None


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        ends = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCK else set())
        while len(self.open) > 1 and self.open[-1].tag in ends:
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs}, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def text_of(node: Node, drop: set[int] = frozenset()) -> str:
    """Lines of text: blocks and breaks end lines, cells are parted by bars, no two empty lines in a row; NFKC. ``drop`` has the ids of elements that are left out."""
    out: list[str] = []
    stack: list[tuple[object, str]] = [(c, "") for c in reversed(node.children)]
    while stack:
        n, end = stack.pop()
        if n is None:
            out.append(end)
        elif isinstance(n, str):
            out.append(n)
        elif id(n) in drop:
            continue
        elif n.tag == "br":
            out.append("\n")
        else:
            block = n.tag in BLOCK
            out.append("\n" if block else "")
            stack.append((None, " | " if n.tag in ("td", "th") else "\n" if block else ""))
            stack += [(c, "") for c in reversed(n.children)]
    lines = [re.sub(r"(?:\s*\|)+$", "", re.sub(r"[ \t\u3000]+", " ", line).strip()) for line in "".join(out).split("\n")]
    return unicodedata.normalize("NFKC", re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip())


def noise_of(node: Node) -> set[int]:
    """The elements below that hold no text of the page. A form that holds half of the text or more is the page itself."""
    gone = [n for n in node.all(*NOISE) if n is not node]
    forms = [n for n in gone if n.tag == "form"]
    if forms:
        others = {id(n) for n in gone if n.tag != "form"}
        whole = len(_text_without(node, others))
        gone = [n for n in gone if n.tag != "form" or len(_text_without(n, others)) < 0.5 * whole]
    return {id(n) for n in gone}


def _text_without(node: Node, drop: set[int]) -> str:
    found, stack = [], [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            found.append(n.strip())
        elif id(n) not in drop:
            stack += reversed(n.children)
    return " ".join(t for t in found if t)


def main_of(root: Node, selector: str | None = None) -> Node:
    """The first of the selector, the usual places and the only article that has three tenths of the body's text; else the body."""
    body = next(root.all("body"), root)
    whole = len(body.text())
    articles = list(root.all("article"))
    candidates = [root.first(x) for x in ([selector] if selector else []) + MAIN] + (articles if len(articles) == 1 else [])
    return next((n for n in candidates if n is not None and (not whole or len(n.text()) >= 0.3 * whole)), body)


def page_text(root: Node, selector: str | None = None) -> str:
    main = main_of(root, selector)
    return text_of(main, noise_of(main))


def rows_of(root: Node) -> list[str]:
    """Distinct texts of up to ROW_CHARS characters of the elements that make up rows, in the order of the page."""
    texts: dict[int, str | None] = {}
    order = list(root.all())
    for n in reversed(order):  # children come before their parents
        parts = [" ".join(c.split()) if isinstance(c, str) else texts[id(c)] for c in n.children]
        joined = None if None in parts else " ".join(p for p in parts if p)
        texts[id(n)] = joined if joined is not None and len(joined) <= ROW_CHARS else None
    return list(dict.fromkeys(t for n in order if n.tag in ROWS and (t := texts[id(n)])))


def headers_of(root: Node) -> list[str]:
    """Of each table the headings with bars between: its th, or the cells of its first row."""
    out = []
    for table in root.all("table"):
        cells = list(table.all("th")) or list(next(table.all("tr"), Node("", {})).all("td"))
        out.append(" | ".join(" ".join(c.text().split()) for c in cells))
    return out


def _label(a: Node) -> str:
    text = a.text()
    return text or next((i.attrs["alt"].strip() for i in a.all("img") if i.attrs.get("alt", "").strip()), "") or a.attrs.get("title", "").strip()


def _target(base: str, href: str) -> str | None:
    """The absolute http address without its fragment, None for other links."""
    href = href.strip()
    if not href or href.lower().startswith(SKIPPED):
        return None
    try:
        url = urldefrag(urljoin(base, href)).url
        return url if urlsplit(url).scheme in ("http", "https") else None
    except ValueError:
        return None


def link_rows_of(root: Node, base: str) -> list[dict]:
    """url, text, context and heading of each link's first place: the longest text of a row around it of up to CONTEXT_CHARS characters, and the last heading before it."""
    base = _base(root, base)
    found: dict[str, dict] = {}
    heading = ""
    for n in root.all("a", *HEADINGS):
        if n.tag != "a":
            heading = n.text()[:HEADING_CHARS]
            continue
        url = _target(base, n.attrs.get("href", ""))
        if not url or url in found:
            continue
        around, up = [], n.parent
        for _ in range(LEVELS):
            if up is None:
                break
            if up.tag in LINK_ROWS:
                around.append(up.text())
            up = up.parent
        found[url] = {"url": url, "text": _label(n), "context": max((t for t in around if t and len(t) <= CONTEXT_CHARS), key=len, default=""), "heading": heading}
    return list(found.values())


def _base(root: Node, base: str) -> str:
    return urljoin(base, next((n.attrs["href"] for n in root.all("base") if n.attrs.get("href")), ""))


def links_of(root: Node, base: str) -> list[dict]:
    """url and labels of each http link: absolute, without fragments, once each, with every distinct label in order."""
    base = _base(root, base)
    found: dict[str, list[str]] = {}
    for a in root.all("a"):
        url = _target(base, a.attrs.get("href", ""))
        if url:
            labels, label = found.setdefault(url, []), _label(a)
            if label and label not in labels:
                labels.append(label)
    return [{"url": u, "labels": ls} for u, ls in found.items()]


def contacts_of(root: Node) -> str:
    """The visible text and where mailto and tel links go, for scans for personal data."""
    body = next(root.all("body"), root)
    hidden = {id(n) for n in body.all("script", "style")}
    goes = [a.attrs["href"].split(":", 1)[1] for a in root.all("a") if a.attrs.get("href", "").startswith(("mailto:", "tel:"))]
    return " ".join([_text_without(body, hidden), *goes])


def serialised(node: Node, drop: set[int]) -> str:
    """HTML of an element, without those in ``drop``; attributes in the order of the page."""
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif isinstance(n, tuple):
            out.append(f"</{n[0]}>")
        elif id(n) not in drop:
            out.append("<" + n.tag + "".join(f' {k}="{v}"' for k, v in n.attrs.items()) + ">")
            if n.tag not in VOID:
                stack.append((n.tag,))
                stack += reversed(n.children)
    return "".join(out)


_STRING = pa.string()
_ARROW = {"string": _STRING, "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(_STRING)}
_ARROW |= {f"array<struct<{','.join(n + ':string' for n in names)}>>": pa.list_(pa.struct([(n, _STRING) for n in names])) for names in (("url", "text", "context", "heading"), ("href", "text"), ("src", "asset"))}
_ARROW["array<struct<url:string,labels:array<string>>>"] = pa.list_(pa.struct([("url", _STRING), ("labels", pa.list_(_STRING))]))

LINKS = "array<struct<url:string,labels:array<string>>>"
SIGNALS = (
    f"title string, text string, n_links int, n_scripts int, n_images int, links {LINKS}, link_rows array<struct<url:string,text:string,context:string,heading:string>>, rows array<string>, headers array<string>, "
    "anchors array<struct<href:string,text:string>>, has_next boolean, images array<struct<src:string,asset:string>>, contacts string, main string"
)


def _main(root: Node) -> Node:
    return next(root.all("main"), None) or next(root.all("body"), root)


#: How each signal is made of a tree, the page's address, a selector of its main part and an attribute of what isn't part of it.
MAKERS = {
    "title": lambda r, u, s, v: next((" ".join(t.text().split()) for t in r.all("title")), ""),
    "text": lambda r, u, s, v: page_text(r, s),
    "n_links": lambda r, u, s, v: len(links_of(r, u)),
    "n_scripts": lambda r, u, s, v: sum(1 for _ in r.all("script")),
    "n_images": lambda r, u, s, v: sum(1 for _ in r.all("img")),
    "links": lambda r, u, s, v: links_of(r, u),
    "link_rows": lambda r, u, s, v: link_rows_of(r, u),
    "rows": lambda r, u, s, v: rows_of(r),
    "headers": lambda r, u, s, v: headers_of(r),
    "anchors": lambda r, u, s, v: [{"href": a.attrs["href"].strip(), "text": " ".join(a.text().split())} for a in r.all("a") if "href" in a.attrs],
    "has_next": lambda r, u, s, v: any(n.attrs.get("rel") == "next" for n in r.all("a", "link")),
    "images": lambda r, u, s, v: [{"src": i.attrs.get("src", "").strip(), "asset": i.attrs.get("data-asset", "").strip()} for i in r.all("img")],
    "contacts": lambda r, u, s, v: contacts_of(r),
    "main": lambda r, u, s, v: serialised(m := _main(r), {id(n) for n in m.all() if v in n.attrs}),
}


def signals_of(html: str, url: str, selector: str | None = None, volatile: str = "data-volatile", fields: tuple[str, ...] = tuple(MAKERS)) -> dict:
    """The wanted signals of one page, from one tree."""
    root = parse(html)
    return {f: MAKERS[f](root, url, selector, volatile) for f in fields}


def page_signals(selector: str | None = None, volatile: str = "data-volatile", fields: tuple[str, ...] = tuple(MAKERS)) -> object:
    """A function of html and url: struct of the wanted signals, all by default; a null page has empty ones. Elements with the attribute ``volatile`` aren't part of ``main``."""
    types = {n: t for n, t in re.findall(r"(\w+) (array<struct<[^>]*(?:<\w+>)?>>|array<string>|\w+)(?:, |$)", SIGNALS)}
    kind = pa.struct([(f, _ARROW[types[f]]) for f in fields])

    @F.arrow_udf(", ".join(f"{f} {types[f]}" for f in fields))
    def signals(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for htmls, urls in batches:
            yield pa.array([signals_of(h or "", u or "", selector, volatile, fields) for h, u in zip(htmls.to_pylist(), urls.to_pylist(), strict=True)], kind)

    return signals

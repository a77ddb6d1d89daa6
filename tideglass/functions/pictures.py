"""Pages of an archive of pictures: the files of a category, links to categories, and what the page of a file says of its licence, author and picture. All are selectors and expressions over the nodes of a page (``selectors.page_nodes``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideglass.functions import forms, selectors, web
from tideglass.functions.base import once

# Where the archive is and keeps its files; links to files and categories; where the files of a category, licences, authors and pictures stand on a page.
ARCHIVE, UPLOADS = "https://commons.wikimedia.org", "https://upload.wikimedia.org/"
FILE_LINK = r"(?i)^/wiki/(File|%E3%83%95%E3%82%A1%E3%82%A4%E3%83%AB):"
CATEGORY_LINK = r"(?i)^(https?:)?//commons\.wikimedia\.org/wiki/(Category|%E3%82%AB%E3%83%86%E3%82%B4%E3%83%AA):"
MEDIA = ("#mw-category-media", ".mw-category-media", "#mw-category-generated .gallery")
LICENCES = ("#mw-imagepage-content-license", ".licensetpl", "table.licensetpl", ".layouttemplate.licensetpl", "#wpl-content-license", ".fileinfotpl-license")
AUTHORS = ("#fileinfotpl_aut", ".fileinfotpl_aut", "#fileinfotpl_src")
PICTURES = ("#file > a", ".fullImageLink > a", "#file a.internal")
#: Files of a category, and categories of a page, that are taken by default; characters of an author.
FILES, CATEGORIES, AUTHOR_CHARS = 40, 10, 160


def _hrefs(nodes: Column, pattern: str, within: Column | None = None) -> Column:
    hrefs = F.transform(selectors.select(nodes, "a[href]", within), lambda n: F.trim(selectors.attribute(n, "href")))
    return F.filter(hrefs, lambda h: h.rlike(pattern))


def category_files(nodes: Column, base: str = ARCHIVE, limit: int = FILES) -> Column:
    """Addresses of the files of a category, each once, in the order of the page: only those in its list of files, or of the whole page where there is no such list."""

    def of(root: Column) -> Column:
        urls = F.transform(_hrefs(nodes, FILE_LINK, root), lambda h: F.concat(F.lit(base), F.regexp_replace(h, r"(?s)\?.*$", "")))
        return F.slice(F.array_distinct(urls), 1, limit)

    return once(selectors.first(nodes, *MEDIA), of)


def category_links(nodes: Column, limit: int = CATEGORIES) -> Column:
    """Addresses of the archive's categories that a page links to, each once, without queries. Names of categories are never guessed."""
    urls = F.transform(_hrefs(nodes, CATEGORY_LINK), lambda h: forms.strip_query(F.when(F.startswith(h, F.lit("//")), F.concat(F.lit("https:"), h)).otherwise(h)))
    return F.slice(F.array_distinct(urls), 1, limit)


def _value_beside(nodes: Column, node: Column) -> Column:
    """The node with the value that a label stands beside: the last cell of a row, the next element, or else the node itself."""
    cells = selectors.select(nodes, "td", node)
    row = F.when((node["tag"] == "tr") & (F.size(cells) >= 2), F.element_at(cells, -1))
    return F.coalesce(row, selectors.following(nodes, node), node)


def author(nodes: Column) -> Column:
    """What stands beside the label of the author, or else of the source; NULL if there is none."""
    labels = F.concat(*(selectors.select(nodes, s) for s in AUTHORS))
    texts = F.transform(labels, lambda n: selectors.text(nodes, _value_beside(nodes, n)))
    return F.nullif(F.trim(F.substring(F.coalesce(F.get(F.filter(texts, lambda t: t != ""), F.lit(0)), F.lit("")), 1, AUTHOR_CHARS)), F.lit(""))


def picture_url(nodes: Column) -> Column:
    """Where the file itself is, without a query; NULL for what isn't kept with the archive's uploads."""

    def of(selector: str) -> Column:
        hrefs = F.transform(selectors.select(nodes, selector), lambda n: F.coalesce(selectors.attribute(n, "href"), F.lit("")))
        whole = F.transform(hrefs, lambda h: F.when(F.startswith(h, F.lit("//")), F.concat(F.lit("https:"), h)).otherwise(h))
        return F.get(F.filter(whole, lambda h: F.startswith(h, F.lit(UPLOADS))), F.lit(0))

    return forms.strip_query(F.coalesce(*(of(s) for s in PICTURES)))


def file_page(nodes: Column, url: Column) -> Column:
    """struct of title, picture (address), author, licence (NULL if the file may not be used), found (the label of each licence box) and reason.

    Each box is judged by itself, as the terms of one don't take back what another grants; of several that grant, one that doesn't ask for the same terms in turn counts first. A page without a box may not be used.
    """
    places = F.array_distinct(F.concat(*(F.transform(selectors.select(nodes, s), lambda n: n["at"]) for s in LICENCES)))
    boxes = F.array_distinct(F.transform(places, lambda at: selectors.markup(nodes, F.get(nodes, at))))

    def judged(given: Column) -> Column:
        each = F.transform(given, lambda b: once(web.licence(b), lambda v: F.struct(v["licence"].alias("licence"), forms.box_label(b, v["licence"]).alias("label"))))

        def told(all_: Column) -> Column:
            granted = F.filter(F.transform(all_, lambda b: b["licence"]), lambda x: x.isNotNull())
            best = F.coalesce(F.get(F.filter(granted, lambda x: ~F.contains(x, F.lit("-SA"))), F.lit(0)), F.get(granted, F.lit(0)))
            labels = F.transform(all_, lambda b: b["label"])
            reason = F.when(F.size(all_) == 0, F.lit("no_licence")).when(best.isNull(), F.concat(F.lit("not_allowed: "), F.array_join(F.array_distinct(labels), ", ")))
            return F.struct(forms.file_title(url).alias("title"), picture_url(nodes).alias("picture"), author(nodes).alias("author"), best.alias("licence"), labels.alias("found"), reason.alias("reason"))

        return once(each, told)

    return once(boxes, judged)


def credit(page: Column) -> Column:
    """The line below a picture: title, author, licence."""
    return F.concat(page["title"], F.lit(" by "), F.coalesce(page["author"], F.lit("作者表示なし")), F.lit("（"), F.coalesce(page["licence"], F.lit("")), F.lit("）"))

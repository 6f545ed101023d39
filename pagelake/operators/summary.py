"""Structural page summary.

Every part is a Column over the element arrays of one page, so summarizing a corpus adds no
shuffle to the scan: parse, project, done.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions.css import attr, node_text
from pagelake.functions.text import let, strip
from pagelake.sources.html import PARSED, ancestors

NODES, TEXTS = "nodes", "texts"

# What the summary looks at and how much of it is kept.
HEADING_TAGS = ["h1", "h2", "h3"]
COUNTED_TAGS = ["div", "article", "section", "li", "img", "a", "table"]
HINT_TAGS = ["article", "div", "section", "main"]
HINT_KEYWORDS = ["content", "article", "post", "body", "detail", "news", "main"]
IMAGE_CONTAINERS = ["article", "main", "section"]
MAX_TEXT_NODES = 150
MAX_LINKS = 100
MAX_LISTS = 20
MAX_LIST_ITEMS = 10
MAX_HINTS = 10
MAX_IMAGES = 15
MAX_CHAIN = 5
HINT_SNIPPET = 100
HINT_MIN_TEXT = 20
SRC_PREVIEW = 120
IMAGE_CONTEXT = 80


def tagged(nodes: Column, tags: list[str]) -> Column:
    """Nodes with one of the tags, outside noise subtrees."""
    return F.filter(nodes, lambda n: n.tag.isin(tags) & ~n.noise)


def below(nodes: Column, node: Column) -> Column:
    """All descendants of a node: the positions right after it."""
    return F.slice(nodes, node.i + 2, node["last"] - node.i)


def _text(node: Column) -> Column:
    return node_text(F.col(TEXTS), node, clean=True)


def _texts_of(nodes: Column, limit: int) -> Column:
    return F.slice(F.filter(F.transform(nodes, _text), lambda t: t != ""), 1, limit)


def title() -> Column:
    first = F.get(tagged(F.col(NODES), ["title"]), 0)
    return F.coalesce(F.when(first.isNotNull(), _text(first)), F.lit(""))


def meta() -> Column:
    def content(key: str) -> Column:
        named = F.filter(tagged(F.col(NODES), ["meta"]), lambda n: attr(n, "name") == key)
        return F.coalesce(strip(attr(F.get(named, 0), "content")), F.lit(""))

    return F.struct(content("description").alias("description"), content("keywords").alias("keywords"))


def headings(max_text_nodes: int = MAX_TEXT_NODES) -> Column:
    return _texts_of(tagged(F.col(NODES), HEADING_TAGS), max_text_nodes // 3 or 1)


def paragraphs(max_text_nodes: int = MAX_TEXT_NODES) -> Column:
    return _texts_of(tagged(F.col(NODES), ["p"]), max_text_nodes)


def links(max_links: int = MAX_LINKS) -> Column:
    every = F.transform(
        tagged(F.col(NODES), ["a"]),
        lambda n: F.struct(F.coalesce(attr(n, "href"), F.lit("")).alias("href"), _text(n).alias("text")),
    )
    return F.slice(F.filter(every, lambda a: (a.href != "") | (a.text != "")), 1, max_links)


def lists(max_lists: int = MAX_LISTS) -> Column:
    nodes = F.col(NODES)
    every = F.transform(
        tagged(nodes, ["ul", "ol"]),
        lambda n: F.struct(
            n.tag.alias("type"),
            _texts_of(tagged(below(nodes, n), ["li"]), MAX_LIST_ITEMS).alias("items"),
        ),
    )
    return F.slice(F.filter(every, lambda item: F.size(item["items"]) > 0), 1, max_lists)


def tag_counts() -> Column:
    names = F.array(*[F.lit(tag) for tag in COUNTED_TAGS])
    seen = F.transform(tagged(F.col(NODES), COUNTED_TAGS), lambda n: n.tag)
    return let(
        seen,
        lambda tags: F.map_from_entries(
            F.filter(
                F.transform(
                    names,
                    lambda name: F.struct(
                        name.alias("key"), F.size(F.filter(tags, lambda t: t == name)).alias("value")
                    ),
                ),
                lambda entry: entry["value"] > 0,
            )
        ),
    )


def structure_hints() -> Column:
    def described(node: Column) -> Column:
        return F.struct(
            node.tag.alias("tag"),
            F.coalesce(node.cls, F.lit("")).alias("class"),
            F.coalesce(attr(node, "id"), F.lit("")).alias("id"),
            F.substring(_text(node), 1, HINT_SNIPPET).alias("text_snippet"),
        )

    def promising(node: Column) -> Column:
        marks = F.concat_ws(" ", F.coalesce(node.cls, F.lit("")), attr(node, "id"))
        return F.lower(marks).rlike("|".join(HINT_KEYWORDS))

    chosen = F.filter(tagged(F.col(NODES), HINT_TAGS), promising)
    hints = F.filter(F.transform(chosen, described), lambda h: F.length(h.text_snippet) > HINT_MIN_TEXT)
    return F.slice(hints, 1, MAX_HINTS)


def ancestor_chain(node: Column) -> Column:
    """Nearest ancestors first, html and body left out."""
    names = F.transform(F.reverse(ancestors(F.col(NODES), node)), lambda i: F.get(F.col(NODES), i).tag)
    return F.slice(F.filter(names, lambda tag: ~tag.isin("html", "body")), 1, MAX_CHAIN)


def image_hints() -> Column:
    nodes = F.col(NODES)
    source = lambda img: F.coalesce(attr(img, "src"), F.lit(""))

    def found(images: Column, parent_of) -> Column:
        return F.transform(
            F.filter(images, lambda img: source(img) != ""),
            lambda img: F.struct(
                source(img).alias("src"), img.i.alias("img"), parent_of(img).cast("int").alias("parent")
            ),
        )

    inside = F.flatten(
        F.transform(
            tagged(nodes, IMAGE_CONTAINERS),
            lambda c: found(tagged(below(nodes, c), ["img"]), lambda img: c.i),
        )
    )
    anywhere = found(tagged(nodes, ["img"]), lambda img: F.element_at(ancestors(nodes, img), -1))
    none = F.array().cast("array<struct<src:string,img:int,parent:int>>")
    candidates = let(inside, lambda xs: F.when(F.size(xs) > 0, xs).otherwise(anywhere))
    first_per_src = F.aggregate(
        candidates,
        none,
        lambda kept, x: F.when(
            (F.size(kept) >= MAX_IMAGES) | F.exists(kept, lambda k: k.src == x.src), kept
        ).otherwise(F.concat(kept, F.array(x))),
    )

    def described(entry: Column, position: Column) -> Column:
        parent, img = F.get(nodes, entry.parent), F.get(nodes, entry.img)
        return F.struct(
            (position + 1).alias("order"),
            F.substring(entry.src, 1, SRC_PREVIEW).alias("src_preview"),
            parent.tag.alias("parent_tag"),
            F.coalesce(parent.cls, F.lit("")).alias("parent_class"),
            ancestor_chain(img).alias("ancestor_chain"),
            F.substring(_text(parent), 1, IMAGE_CONTEXT).alias("context_text"),
        )

    return F.transform(first_per_src, described)


def summarize(
    doms: DataFrame,
    max_text_nodes: int = MAX_TEXT_NODES,
    max_links: int = MAX_LINKS,
    max_lists: int = MAX_LISTS,
) -> DataFrame:
    """Typed summary columns next to the page columns; the element arrays are dropped."""
    kept = [name for name in doms.columns if name not in PARSED]
    return doms.select(
        *kept,
        title().alias("title"),
        meta().alias("meta"),
        structure_hints().alias("structure_hints"),
        headings(max_text_nodes).alias("headings"),
        paragraphs(max_text_nodes).alias("paragraphs"),
        links(max_links).alias("links"),
        lists(max_lists).alias("lists"),
        tag_counts().alias("tag_counts"),
        image_hints().alias("image_hints"),
    )


# Key order of the summary document.
SUMMARY_KEYS = [
    "title", "meta", "structure_hints", "headings", "paragraphs", "links", "lists", "tag_counts", "image_hints",
]


def summary_json() -> Column:
    """The summary columns as one JSON document, for the prompts."""
    return F.to_json(F.struct(*SUMMARY_KEYS), {"ignoreNullFields": "false"})

"""Field extraction from one page, as Columns over its element arrays.

A *field* is a struct (field, selector, method, field_limit, fallback); a *cell* is a struct
(field, kind, s, xs) with kind ``str``, ``list`` or ``null``; a record is an array of cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions.css import PARSED_SELECTOR, attr, literal_selectors, node_text, parse_selector, sanitize_selector, select_nodes
from pagelake.functions.text import empty_to_null, let, strip
from pagelake.functions.urls import is_script_url, resolve_or_keep, resolve_url
from pagelake.operators.summary import below
from pagelake.sources.html import PARSED

CELL = "struct<field:string,kind:string,s:string,xs:array<string>>"
#: ``parsed`` and ``fallback_parsed`` may be NULL; the selectors are then parsed where they are needed.
FIELD = (
    "struct<field:string,selector:string,method:string,field_limit:int,fallback:string,"
    f"parsed:{PARSED_SELECTOR},fallback_parsed:{PARSED_SELECTOR}>"
)

# Field names with their own rules, and attributes that hold several tokens.
HREF_LIST_FIELDS = ["sub_comments", "links"]
MEDIA_LIST_FIELDS = ["sub_comments", "links", "image", "img", "src", "video"]
IMAGE_FIELDS = ["image", "img", "src"]
INLINE_LINK_FIELDS = ["links", "link", "url", "urls"]
TOKEN_LIST_ATTRS = ["class", "rel", "rev", "accept-charset", "headers", "accesskey", "dropzone"]


class Page:
    """The columns an extraction reads: element arrays and the URL links are resolved against."""

    def __init__(self, base_url: Column | str = "url", nodes: str = "nodes", texts: str = "texts", places: str = "places") -> None:
        self.base = F.col(base_url) if isinstance(base_url, str) else base_url
        self.nodes, self.texts, self.places = F.col(nodes), F.col(texts), F.col(places)

    def select(self, parsed: Column) -> Column:
        return select_nodes(self.nodes, self.texts, self.places, parsed)

    def first(self, parsed: Column) -> Column:
        return F.get(self.select(parsed), 0)

    def text(self, node: Column) -> Column:
        return node_text(self.texts, node)

    def link(self, href: Column) -> Column:
        return resolve_or_keep(self.base, href)


def stripped_attr(node: Column, name: Column | str) -> Column:
    return F.coalesce(strip(attr(node, name)), F.lit(""))


def effective_limit(field_limit: Column, max_items: Column) -> Column:
    """Zero means no limit; the smaller of both otherwise."""
    return F.least(F.when(field_limit != 0, field_limit), F.when(max_items != 0, max_items))


def _limited(values: Column, limit: Column) -> Column:
    return F.slice(values, 1, F.coalesce(limit, F.size(values)))


def cell(field: Column, kind: str | Column, s: Column | None = None, xs: Column | None = None) -> Column:
    return F.struct(
        field.alias("field"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
        (F.lit(None) if s is None else s).cast("string").alias("s"),
        (F.lit(None) if xs is None else xs).cast("array<string>").alias("xs"),
    )


# A raw value is a struct (v, url): url says that v is still to be resolved against the page.
RAW = "array<struct<v:string,url:boolean>>"
FOUND = f"struct<kind:string,raws:{RAW}>"

# Methods of the two fields a strategy adds by itself.
PRIMARY_IMAGE, ALL_IMAGES = "primary image", "all images"


def _raw(value: Column, url: bool | Column = False) -> Column:
    return F.struct(value.alias("v"), (F.lit(url) if isinstance(url, bool) else url).alias("url"))


def _attr_raw(node: Column, method: Column) -> Column:
    """``attr:NAME`` of a node; attributes that hold several tokens read as empty."""
    return let(
        F.regexp_extract(method, r"(?s)^attr:(.*)$", 1),
        lambda name: _raw(
            F.when(name.isin(TOKEN_LIST_ATTRS), "").otherwise(stripped_attr(node, name)),
            name.isin("href", "src"),
        ),
    )


def _video_source(page: Page, node: Column) -> Column:
    nested = F.get(F.filter(below(page.nodes, node), lambda n: n.tag == "source"), 0)
    return F.coalesce(
        empty_to_null(stripped_attr(node, "src")), empty_to_null(stripped_attr(nested, "src"))
    )


def _media_raw(page: Page, field: Column, node: Column) -> Column:
    href = stripped_attr(node, "href")
    is_link = (field == "links") & (node.tag == "a") & (href != "") & ~is_script_url(href)
    is_image = field.isin(IMAGE_FIELDS) & (node.tag == "img") & attr(node, "src").isNotNull()
    is_video = (field == "video") & (node.tag == "video")
    url = (
        F.when(is_link, href)
        .when(is_image, stripped_attr(node, "src"))
        .when(is_video, _video_source(page, node))
    )
    return let(
        url, lambda u: F.when(u.isNotNull(), _raw(u, True)).otherwise(_raw(page.text(node)))
    )


def _found(kind: str | Column, raws: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("kind"), raws.alias("raws")).cast(FOUND)


def _usable_urls(matched: Column, name: str) -> Column:
    values = F.filter(
        F.transform(matched, lambda n: stripped_attr(n, name)), lambda v: (v != "") & ~is_script_url(v)
    )
    return F.transform(values, lambda v: _raw(v, True))


def _sources(matched: Column) -> Column:
    values = F.filter(F.transform(matched, lambda n: stripped_attr(n, "src")), lambda v: v != "")
    return F.transform(values, lambda v: _raw(v, True))


def _field_values(page: Page, f: Column, method: Column, matched: Column, max_items: Column) -> Column:
    limit = effective_limit(f.field_limit, max_items)
    hrefs = f.field.isin(HREF_LIST_FIELDS) & method.startswith("attr:href")
    media = f.field.isin(MEDIA_LIST_FIELDS) & (method == "css")
    first = F.slice(matched, 1, 1)
    attr_method = method.startswith("attr:")
    single = F.transform(
        first, lambda n: F.when(attr_method, _attr_raw(n, method)).otherwise(_raw(page.text(n)))
    )
    return (
        F.when(hrefs, _found("list", _limited(_usable_urls(matched, "href"), limit)))
        .when(
            media,
            _found(
                F.when(limit == 1, "str").otherwise("list"),
                F.transform(_limited(matched, limit), lambda n: _media_raw(page, f.field, n)),
            ),
        )
        .when(method == PRIMARY_IMAGE, _found("str or null", _sources(first)))
        .when(method == ALL_IMAGES, _found("list", _sources(matched)))
        .otherwise(_found("str", single))
    )


def _field_cell(page: Page, f: Column, max_items: Column) -> Column:
    """Values by the field's selector, or by its fallback selector when that finds nothing."""
    attempts = F.array(
        F.struct(f.selector.alias("selector"), f.method.alias("method"), f.parsed.alias("parsed")),
        F.struct(f.fallback.alias("selector"), F.lit("text").alias("method"), f.fallback_parsed.alias("parsed")),
    )
    nothing = F.lit(None).cast(FOUND)

    def attempt(found: Column, x: Column) -> Column:
        filled = F.exists(found.raws, lambda r: (r.v != "") | (found.kind == "list"))
        settled = found.isNotNull() & (F.coalesce(filled, F.lit(False)) | x.selector.isNull())
        evaluated = let(
            page.select(F.coalesce(x.parsed, parse_selector(x.selector))),
            lambda matched: _field_values(page, f, x.method, matched, max_items),
        )
        return F.when(settled, found).otherwise(evaluated)

    def finish(found: Column) -> Column:
        values = F.transform(found.raws, lambda r: F.when(r.url, page.link(r.v)).otherwise(r.v))
        empty = F.size(found.raws) == 0
        return let(
            values,
            lambda xs: F.when(found.kind == "list", cell(f.field, "list", xs=xs))
            .when((found.kind == "str or null") & empty, cell(f.field, "null"))
            .otherwise(cell(f.field, "str", F.coalesce(F.get(xs, 0), F.lit("")))),
        )

    return let(F.aggregate(attempts, nothing, attempt), finish)


def extract_record(page: Page, fields: Column, max_items: Column) -> Column:
    """One record of the page: a cell per field that has a selector."""
    usable = F.filter(
        fields, lambda f: (sanitize_selector(f.selector) != "") | (f.method == PRIMARY_IMAGE)
    )
    return F.transform(usable, lambda f: _field_cell(page, f, max_items))


def _inline_raw(page: Page, f: Column, node: Column) -> Column:
    """Value of one match in a list column; NULL for a script link that is left out."""
    href = stripped_attr(node, "href")
    is_link = (
        f.field.isin(INLINE_LINK_FIELDS)
        & (node.tag == "a")
        & attr(node, "href").isNotNull()
        & ~is_script_url(href)
    )
    is_image = f.field.isin(IMAGE_FIELDS) & (node.tag == "img") & attr(node, "src").isNotNull()
    return (
        F.when((f.method == "attr:href") & is_script_url(href), F.lit(None))
        .when(f.method.startswith("attr:"), _attr_raw(node, f.method))
        .when((f.method != "text") & is_link, _raw(href, True))
        .when((f.method != "text") & is_image, _raw(stripped_attr(node, "src"), True))
        .otherwise(_raw(page.text(node)))
    )


def inline_records(page: Page, fields: Column, max_items: Column) -> Column:
    """Records read from the list page itself: one column per field, zipped by position."""
    usable = F.filter(fields, lambda f: sanitize_selector(f.selector) != "")

    def column(f: Column) -> Column:
        found = F.transform(page.select(F.coalesce(f.parsed, parse_selector(f.selector))), lambda n: _inline_raw(page, f, n))
        kept = _limited(F.filter(found, lambda r: r.isNotNull()), effective_limit(f.field_limit, max_items))
        return F.struct(
            f.field.alias("field"),
            F.transform(kept, lambda r: F.when(r.url, page.link(r.v)).otherwise(r.v)).alias("values"),
        )

    def zipped(columns: Column) -> Column:
        longest = F.coalesce(F.array_max(F.transform(columns, lambda c: F.size(c["values"]))), F.lit(0))
        rows = F.when(longest > 0, F.sequence(F.lit(0), longest - 1)).otherwise(F.array().cast("array<int>"))
        positional = F.transform(
            rows,
            lambda r: F.transform(
                columns, lambda c: cell(c.field, "str", F.coalesce(F.get(c["values"], r), F.lit("")))
            ),
        )
        only = F.get(columns, 0)
        one_list = (F.size(columns) == 1) & only.field.isin(HREF_LIST_FIELDS)
        return F.when(one_list, F.array(F.array(cell(only.field, "list", xs=only["values"])))).otherwise(positional)

    return let(F.transform(usable, column), zipped)


def added_field(field: Column, selector: Column, method: str) -> Column:
    """A field struct for the primary image or the image list of a gallery."""
    return F.struct(
        field.alias("field"),
        F.coalesce(selector, F.lit("")).alias("selector"),
        F.lit(method).alias("method"),
        F.lit(None).cast("int").alias("field_limit"),
        F.lit(None).cast("string").alias("fallback"),
        *_unparsed(),
    )


def _unparsed() -> list[Column]:
    return [F.lit(None).cast(PARSED_SELECTOR).alias(name) for name in ("parsed", "fallback_parsed")]


def with_parsed(fields: Column) -> Column:
    """The same field structs with their selectors parsed, for a plan that many pages are read by."""
    return F.transform(
        fields.cast(f"array<{FIELD}>"),
        lambda f: f.withField("parsed", parse_selector(f.selector)).withField("fallback_parsed", F.when(f.fallback.isNotNull(), parse_selector(f.fallback))),
    )


def fields_of(strategy: Column) -> Column:
    """Field structs of a strategy, in selector order."""
    return F.transform(
        F.map_entries(strategy.field_selectors),
        lambda e: F.struct(
            e.key.alias("field"),
            e["value"].alias("selector"),
            F.coalesce(F.try_element_at(strategy.field_methods, e.key), F.lit("css")).alias("method"),
            F.try_element_at(strategy.field_limits, e.key).alias("field_limit"),
            F.try_element_at(strategy.fallback_selectors, e.key).alias("fallback"),
            *_unparsed(),
        ),
    )


def literal_fields(fields: list[tuple]) -> Column:
    """Field structs from (field, selector, method, limit, fallback) tuples."""
    names = ["field", "selector", "method", "field_limit", "fallback"]
    types = ["string", "string", "string", "int", "string"]
    rows = [(*row, None, None)[:5] for row in fields]
    parsed = iter(literal_selectors([row[k] or "" for row in rows for k in (1, 4)]))
    structs = [
        F.struct(
            *[F.lit(v).cast(t).alias(n) for n, t, v in zip(names, types, row, strict=True)],
            next(parsed).alias("parsed"), next(parsed).alias("fallback_parsed"),
        )
        for row in rows
    ]
    return F.array(*structs).cast(f"array<{FIELD}>")


def extract_fields(doms: DataFrame, fields: list[tuple], max_items: int | None = None, base: str = "url") -> DataFrame:
    """Fixed fields from every page; adds the ``record`` column and drops the element arrays."""
    kept = [c for c in doms.columns if c not in PARSED]
    record = extract_record(Page(base), literal_fields(fields), F.lit(max_items).cast("int"))
    return doms.select(*kept, record.alias("record"))


def to_long(records: DataFrame, record: str = "record") -> DataFrame:
    """One row per cell: the other columns, field_no, field, kind, s, xs."""
    kept = [c for c in records.columns if c != record]
    return records.select(*kept, F.posexplode(record).alias("field_no", "cell")).select(
        *kept, "field_no", "cell.field", "cell.kind", "cell.s", "cell.xs"
    )


def pick(record: Column, field: str) -> Column:
    """The cell of one field, NULL when the record lacks it."""
    return F.get(F.filter(record, lambda c: c.field == field), 0)

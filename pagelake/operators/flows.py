"""Page flows: single pages, galleries, lists, linked detail pages and pagination.

Live fetching is replaced by equi-joins on the requested URL against stored snapshots
(``keyed_snapshots``, or parsed beforehand, ``parsed_snapshots``). Single-page flows are projections of the page's own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.functions.css import attr, parse_selector, sanitize_selector
from pagelake.functions.text import empty_to_null
from pagelake.functions.urls import final_or_requested, request_url, resolve_url
from pagelake.operators.extract import (
    ALL_IMAGES, FIELD, PRIMARY_IMAGE, Page, added_field, extract_record, fields_of, inline_records, with_parsed,
)
from pagelake.session import narrow_side, write_through
from pagelake.sources.html import PARSED, parse_html
from pagelake.sources.snapshots import one_per_request

# List pages visited per start, and the gallery selector when a strategy has none.
MAX_PAGE_VISITS = 5
ANY_IMAGE = "img"
# Keys of a hundred bytes or so, and plans of a few kilobytes, that are broadcast to the pages.
FEW_PAIRS, FEW_WAYS = 1_000_000, 5_000
RECORD = "array<struct<field:string,kind:string,s:string,xs:array<string>>>"


def keyed_snapshots(snapshots: DataFrame) -> DataFrame:
    """Snapshots as (url_key, base_url, has_html, html), unparsed. Where flows join against them, they parse the pages they meet."""
    return one_per_request(snapshots).select(
        F.col("request_url").alias("url_key"),
        final_or_requested(F.col("final_url"), F.col("requested_url")).alias("base_url"),
        (F.coalesce(F.length("html"), F.lit(0)) > 0).alias("has_html"),
        "html",
    )


def parsed_snapshots(snapshots: DataFrame) -> DataFrame:
    """Snapshots as (url_key, base_url, has_html, texts, nodes, places): for flows that read nearly all pages."""
    return parse_html(keyed_snapshots(snapshots))


def _parsed(rows: DataFrame) -> DataFrame:
    """Rows with their pages parsed; rows of stored parsed pages as they are."""
    return parse_html(rows) if "html" in rows.columns else rows


def planned_fields(strategy: Column, with_images: bool = True) -> Column:
    """All fields one page is read for: selectors, lead image, and the image list of a gallery."""
    fields = fields_of(strategy)
    primary = added_field(strategy.primary_image_field, strategy.primary_image_selector, PRIMARY_IMAGE)
    fields = F.when(
        strategy.primary_image_field.isNotNull(),
        F.concat(F.filter(fields, lambda f: f.field != strategy.primary_image_field), F.array(primary)),
    ).otherwise(fields)
    if not with_images:
        return fields
    chosen = F.coalesce(empty_to_null(strategy.image_selector), F.lit(ANY_IMAGE))
    images = added_field(F.lit("images"), chosen, ALL_IMAGES)
    return F.when(
        strategy.page_type == "gallery",
        F.concat(F.filter(fields, lambda f: f.field != "images"), F.array(images)),
    ).otherwise(fields)


def page_record(strategy: Column, base_url: str = "base_url") -> Column:
    """Record of the row's own page: news, default and gallery flow in one expression."""
    fields = planned_fields(strategy).cast(f"array<{FIELD}>")
    return extract_record(Page(base_url), fields, strategy.max_items)


def single_page_records(rows: DataFrame) -> DataFrame:
    """One record per row that has a page; rows carry base_url, has_html, texts, nodes, strategy."""
    kept = [c for c in rows.columns if c not in (*PARSED, "has_html", "strategy", "base_url", "url_key", "page_type")]
    return rows.filter(F.col("has_html")).select(
        *kept, F.lit(0).alias("record_no"), F.col("base_url").alias("page_url"),
        page_record(F.col("strategy")).alias("record"),
    )


def follows_links(strategy: Column) -> Column:
    return sanitize_selector(strategy.item_link_selector) != ""


def detail_targets(page: Page, links: Column, max_depth: Column) -> Column:
    """Resolved targets of the first ``max_depth`` item links (a parsed selector); a link without href uses up its place."""
    quota = F.greatest(F.lit(1), F.coalesce(max_depth, F.lit(1)))
    found = F.slice(page.select(links), 1, quota)
    hrefs = F.filter(F.transform(found, lambda n: attr(n, "href")), lambda h: h.isNotNull() & (h != ""))
    return F.transform(hrefs, lambda href: resolve_url(page.base, href))


def _positive(value: Column) -> Column:
    return F.when(value > 0, value)


def _key(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def walk_plans(starts: DataFrame) -> DataFrame:
    """What a walk needs of its strategy, one narrow row per walk.

    Walks that read list pages alike share ``reading_key``, those that read detail pages alike ``detail_key``; what
    a key stands for is in the row's ``strategy``, and is worked out once per key (``_plan_of_each``).
    """
    strategy = F.col("strategy")
    plans = starts.select(
        "walk_id", "url", "strategy", request_url("url").alias("start_key"), sanitize_selector(strategy.pagination_selector).alias("next_selector"),
        F.least(F.coalesce(_positive(strategy.max_pages), F.lit(1)), F.lit(MAX_PAGE_VISITS)).alias("max_pages"), strategy.max_items.alias("max_items"),
    )
    selectors = [F.map_entries(strategy[name]).alias(name) for name in ("field_selectors", "field_methods", "field_limits", "fallback_selectors")]
    limits = [strategy.max_items.alias("max_items"), strategy.max_depth.alias("max_depth")]
    return plans.withColumns({
        "reading_key": _key(sanitize_selector(strategy.item_link_selector).alias("links"), *limits, *selectors),
        "detail_key": _key(strategy.primary_image_field.alias("field"), strategy.primary_image_selector.alias("image"), limits[0], *selectors),
    })


def _plan_of_each(plans: DataFrame, key: str, *columns: Column) -> DataFrame:
    """The columns worked out for one strategy of each key; there are as many rows as different plans."""
    one = plans.groupBy(key).agg(F.min_by("strategy", "walk_id").alias("strategy"))
    return one.select(key, *columns)


def page_links(plans: DataFrame, doms: DataFrame, folders: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Next links of the pages that walks can meet, as edges (next_selector, url_key, next_key), and these pages, parsed.

    All walks take a step at a time. Walks that meet on a page with one selector go on as one, as far as any of them may
    go, so a page is parsed once and read once for each selector. An action.
    """
    page, few = Page("base_url"), lambda keys: narrow_side(keys, keys.count(), FEW_PAIRS)
    ways = write_through(plans.select("next_selector").distinct().withColumn("selector", parse_selector("next_selector")), "selectors", folders)
    ways = narrow_side(ways, ways.count(), FEW_WAYS)
    next_url = resolve_url(page.base, attr(page.first(F.col("selector")), "href"))
    none = F.lit(None).cast("string")
    links = doms.sparkSession.range(0).select(none.alias("next_selector"), none.alias("url_key"), none.alias("next_key"))
    pages = None if "html" in doms.columns else doms
    at = plans.groupBy(F.col("start_key").alias("url_key"), "next_selector").agg((F.max("max_pages") - 1).alias("left"))
    for _ in range(MAX_PAGE_VISITS):
        at = write_through(at, "at", folders)
        if at.isEmpty():
            break
        if "html" in doms.columns:
            fresh = at.select("url_key").distinct()
            fresh = fresh if pages is None else fresh.join(pages.select("url_key"), "url_key", "left_anti")
            fresh = write_through(fresh, "fresh", folders)
            met = write_through(parse_html(doms.join(few(fresh), "url_key")), "pages", folders)
            pages = met if pages is None else pages.unionByName(met)
        asked = write_through(at.where("left > 0").drop("left").join(links, ["next_selector", "url_key"], "left_anti"), "asked", folders)
        if not asked.isEmpty():
            read = pages.join(few(asked), "url_key").join(ways, "next_selector").select("next_selector", "url_key", request_url(next_url).alias("next_key"))
            links = links.unionByName(write_through(read.where("next_key is not null"), "links", folders))
        onward = at.where("left > 0").join(links, ["next_selector", "url_key"])
        at = onward.groupBy(F.col("next_key").alias("url_key"), "next_selector").agg((F.max("left") - 1).alias("left"))
    return links, pages


def _paths(links: DataFrame, doms: DataFrame) -> DataFrame:
    """(next_selector, url_key, path): the stored pages that next links lead to, up to the most that a walk visits.

    By pointer doubling: paths of one page are joined to paths of two, and these to paths of four.
    """
    target = doms.select(F.col("url_key").alias("next_key"), F.struct("url_key", "base_url").alias("page"))
    paths, reach = links.join(target, "next_key").select("next_selector", "url_key", F.array("page").alias("path")), 1
    while reach < MAX_PAGE_VISITS - 1:
        onward = paths.select("next_selector", F.col("url_key").alias("last"), F.col("path").alias("rest"))
        paths = paths.withColumn("last", F.element_at("path", -1).url_key).join(onward, ["next_selector", "last"], "left").select(
            "next_selector", "url_key", F.coalesce(F.concat("path", "rest"), "path").alias("path"),
        )
        reach *= 2
    return paths


def visited_pages(plans: DataFrame, doms: DataFrame, folders: list[str] | None = None) -> DataFrame:
    """The stored pages each walk would visit if it had no ``max_items``, as (walk_id, page_no, url_key, base_url) with the
    walk's reading_key and max_items. An action."""
    return _visited(plans, doms, page_links(plans, doms, folders)[0])


def _visited(plans: DataFrame, doms: DataFrame, links: DataFrame) -> DataFrame:
    start = doms.select(F.col("url_key").alias("start_key"), F.array(F.struct("url_key", "base_url")).alias("start"))
    onward = _paths(links, doms).withColumnRenamed("url_key", "start_key")
    pages = plans.drop("url", "strategy", "detail_key").join(start, "start_key").join(onward, ["next_selector", "start_key"], "left").select(
        "walk_id", "reading_key", "max_items", "max_pages", F.coalesce(F.concat("start", "path"), "start").alias("pages"),
    )
    # A walk ends before a page it has seen.
    bases = F.transform("pages", lambda p: p.base_url)
    again = F.array_position(F.transform(bases, lambda b, n: F.array_position(bases, b) == n + 1), False)
    until = F.least(F.when(again > 0, again - 1).otherwise(F.size("pages")), F.col("max_pages"))
    kept = ["walk_id", "reading_key", "max_items"]
    return pages.select(*kept, F.posexplode(F.slice("pages", 1, until.cast("int"))).alias("page_no", "page")).select(*kept, "page_no", "page.*")


def _pages_of(pairs: DataFrame, ways: DataFrame, doms: DataFrame, folders: list[str] | None = None) -> DataFrame:
    """Parsed pages of (page, way of reading) pairs with the way's columns; only keys and ways are moved, as long as they are few.

    Both are counted as they are, not by the walks behind them: many walks of a few ways must not deal their pages out by way.
    """
    key = next(c for c in pairs.columns if c != "url_key")
    pairs, ways = write_through(pairs, "pairs", folders), write_through(ways, "ways", folders)
    pages = _parsed(doms.drop("has_html").join(narrow_side(pairs, pairs.count(), FEW_PAIRS), "url_key"))
    return pages.join(narrow_side(ways, ways.count(), FEW_WAYS), key)


def read_lists(visits: DataFrame, plans: DataFrame, doms: DataFrame, pages: DataFrame | None = None, folders: list[str] | None = None) -> DataFrame:
    """What the visited pages say: (url_key, reading_key, stored, missed, inline), one row per page and way of reading it.

    ``pages`` has the visited ones of ``doms`` parsed, if they are. ``stored`` and ``missed`` are the targets of the item links, by whether their page is among the snapshots.
    """
    page, strategy = Page("base_url"), F.col("strategy")
    ways = _plan_of_each(
        plans, "reading_key", follows_links(strategy).alias("follows"), parse_selector(strategy.item_link_selector).alias("links"),
        strategy.max_depth.alias("max_depth"), strategy.max_items.alias("max_items"), with_parsed(fields_of(strategy)).alias("inline_fields"),
    )
    pairs = visits.select("url_key", "reading_key").distinct()
    read = _pages_of(pairs, ways, doms if pages is None else pages, folders).select(
        "url_key", "reading_key", F.when(F.col("follows"), detail_targets(page, F.col("links"), F.col("max_depth"))).alias("targets"),
        F.when(~F.col("follows"), inline_records(page, F.col("inline_fields"), F.col("max_items"))).cast(f"array<{RECORD}>").alias("inline"),
    )
    links = read.select("url_key", "reading_key", "inline", F.posexplode_outer("targets").alias("pos", "target")).withColumn("target_key", request_url("target"))
    marked = links.join(doms.select(F.col("url_key").alias("target_key"), F.lit(True).alias("known")), "target_key", "left")
    entry = F.struct("pos", "target")
    # A page has at most max_depth targets.
    split = marked.groupBy("url_key", "reading_key").agg(
        F.first("inline").alias("inline"), F.array_sort(F.collect_list(F.when(F.col("known"), entry))).alias("stored"),
        F.array_sort(F.collect_list(F.when(F.col("known").isNull() & F.col("target").isNotNull(), entry))).alias("missed"),
    )
    return split.select("url_key", "reading_key", F.col("stored.target").alias("stored"), F.col("missed.target").alias("missed"), "inline")


def walk_lists(plans: DataFrame, doms: DataFrame, folders: list[str] | None = None) -> DataFrame:
    """Visit list pages along their next links, at most five per start, never one URL twice. An action.

    Which pages a walk meets is worked out on links alone; each page is read once for every way of reading it, and sums
    over a walk's pages decide where ``max_items`` ends it. Only targets whose page is stored count, since only they
    give records. ``plans`` and ``doms`` should be stored. Result: one row per visited page.
    """
    return _walked(plans, doms, folders)[0]


def _walked(plans: DataFrame, doms: DataFrame, folders: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """The visits of ``walk_lists``, and the pages that walks can meet, parsed."""
    links, pages = page_links(plans, doms, folders)
    met = write_through(_visited(plans, doms, links), "met", folders)
    read = write_through(read_lists(met, plans, doms, pages, folders), "read", folders)
    visits = met.join(read, ["url_key", "reading_key"])
    found = F.size("stored") + F.coalesce(F.when(F.size("inline") > 0, F.size("inline")), F.lit(0))
    # At most five rows a walk.
    so_far = F.sum("found").over(Window.partitionBy("walk_id").orderBy("page_no")).cast("int")
    counted = visits.withColumn("found", found).withColumn("n_after", so_far).withColumn("n_before", F.col("n_after") - F.col("found"))
    going_on = (F.col("page_no") == 0) | F.coalesce(F.col("n_before") < _positive(F.col("max_items")), F.lit(True))
    return counted.where(going_on).select("walk_id", "page_no", "base_url", "max_items", "n_before", "n_after", "stored", "missed", "inline"), pages


def _within_max_items(df: DataFrame) -> DataFrame:
    return df.filter(F.coalesce(F.col("record_no") < _positive(F.col("max_items")), F.lit(True)))


def detail_links(visits: DataFrame) -> DataFrame:
    """One row per item link to follow: walk_id, record_no, target."""
    exploded = visits.select("walk_id", "max_items", "n_before", F.posexplode("stored").alias("pos", "target"))
    return _within_max_items(exploded.withColumn("record_no", F.col("n_before") + F.col("pos"))).select("walk_id", "record_no", "target")


def follow_details(links: DataFrame, plans: DataFrame, doms: DataFrame, folders: list[str] | None = None) -> DataFrame:
    """Records of the linked pages.

    Many links may lead to one page, so each (page, plan) pair is reduced to one row before the
    page is joined and read; the link rows are then matched with the finished records.
    """
    fields = with_parsed(planned_fields(F.col("strategy"), with_images=False))
    ways = _plan_of_each(plans, "detail_key", fields.alias("fields"), F.col("strategy").max_items.alias("max_items"))
    keyed = links.select("walk_id", "record_no", request_url("target").alias("url_key")).join(plans.select("walk_id", "detail_key"), "walk_id")
    read = _pages_of(keyed.select("url_key", "detail_key").distinct(), ways, doms, folders).select(
        "url_key", "detail_key", F.col("base_url").alias("page_url"), extract_record(Page("base_url"), F.col("fields"), F.col("max_items")).alias("record"),
    )
    return keyed.join(read, ["url_key", "detail_key"]).select("walk_id", "record_no", "page_url", "record")


def missed_links(visits: DataFrame) -> DataFrame:
    """Item links whose page is not among the snapshots: walk_id, the list page and the target."""
    return visits.select("walk_id", F.col("base_url").alias("page_url"), F.explode("missed").alias("target"))


def rejected_starts(starts: DataFrame, doms: DataFrame) -> DataFrame:
    """Starts that give no record because no page with content is stored for them (walk_id, url)."""
    stored = doms.filter("has_html").select("url_key")
    return starts.withColumn("url_key", request_url("url")).join(stored, "url_key", "left_anti").select("walk_id", "url")


def list_records(starts: DataFrame, doms: DataFrame, folders: list[str] | None = None) -> DataFrame:
    """Records of list starts: detail pages or inline rows; the page itself when a walk gives none."""
    plans = write_through(walk_plans(starts), "plans", folders)
    visits, pages = _walked(plans, doms, folders)
    details = follow_details(detail_links(visits), plans, doms, folders)
    inline = _within_max_items(
        visits.select(
            "walk_id", "max_items", "n_before", F.col("base_url").alias("page_url"),
            F.posexplode("inline").alias("pos", "record"),
        ).withColumn("record_no", F.col("n_before") + F.col("pos"))
    ).select("walk_id", "record_no", "page_url", "record")
    fruitful = visits.filter(F.col("n_after") > 0).select("walk_id").distinct()
    barren = plans.select("walk_id", F.col("start_key").alias("url_key"), "strategy").join(fruitful, "walk_id", "left_anti")
    own = (
        pages.join(narrow_side(barren, plans.count(), FEW_WAYS), "url_key")
        .filter("has_html")
        .select("walk_id", F.lit(0).alias("record_no"), F.col("base_url").alias("page_url"),
                page_record(F.col("strategy")).alias("record"))
    )
    return details.unionByName(inline).unionByName(own)


def run_flows(starts: DataFrame, doms: DataFrame, folders: list[str] | None = None) -> DataFrame:
    """Records (walk_id, record_no, page_url, record) of every start (walk_id, url, page_type, strategy).

    ``starts`` and ``doms`` (parsed or unparsed snapshots) should be stored. The page type is a column of its own: a filter on a part of a computed
    strategy would be pushed below it and compute the strategy again.
    """
    is_list = F.col("page_type") == "list"
    single = starts.filter(~is_list).withColumn("url_key", request_url("url")).join(doms, "url_key")
    single = single_page_records(_parsed(single)).select("walk_id", "record_no", "page_url", "record")
    return single.unionByName(list_records(starts.filter(is_list), doms, folders))


def snapshot_records(strategy: Column, base_url: str = "base_url") -> Column:
    """Records when every fetch answers with the row's own page, as offline experiment runs do.

    A list then has one page (the next one is the same URL), and each item link leads back to it.
    """
    page = Page(base_url)
    cap = _positive(strategy.max_items)
    record = page_record(strategy, base_url)
    inline = inline_records(page, fields_of(strategy).cast(f"array<{FIELD}>"), strategy.max_items)
    listed = F.when(
        follows_links(strategy), F.array_repeat(record, F.size(detail_targets(page, parse_selector(strategy.item_link_selector), strategy.max_depth)))
    ).otherwise(inline.cast(f"array<{RECORD}>"))
    capped = F.slice(listed, 1, F.coalesce(cap, F.size(listed)))
    return F.when(
        strategy.page_type == "list", F.when(F.size(capped) > 0, capped).otherwise(F.array(record))
    ).otherwise(F.array(record))

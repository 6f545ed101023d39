"""Extraction strategies: keyword defaults overridden by a checked model reply, all as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions.lenient_json import (
    boolean_value, int_map, json_object, kind_of, member, member_object, natural_int, string_map,
    string_value, text_of,
)
from pagelake.functions.text import empty_to_null, let, map_lookup, strip
from pagelake.operators.intents import non_empty

# Selectors used when the model gives none.
DEFAULT_SELECTORS = {
    "title": "article h1, h1, h2, .title",
    "content": "article, .article, #content",
    "date": "time, .date, .pub-date",
    "author": ".author, [itemprop='author']",
    "price": ".price, [itemprop='price']",
    "images": ".gallery img, img",
    "links": "a",
    "name": ".name, .username, h1",
    "follows": ".follows, .follow-count, .fans",
    "sub_comments": ".sub-comment, .lzl_content, .subcomment",
    "answer": ".answer, .post-content, article",
}
FALLBACK_SELECTORS = {
    "title": "meta[property='og:title'], meta[name='title'], title",
    "content": "meta[property='og:description'], .article-content",
    "date": "meta[property='article:published_time'], meta[name='pubdate']",
}
DEFAULT_FIELDS = ["title", "content"]
ITEM_LINK_SELECTOR = ".list a, .post a, a"
PAGINATION_SELECTOR = ".pagination a.next, a.next, a[rel='next']"
GALLERY_SELECTOR = ".gallery img, img"
PRIMARY_IMAGE_FALLBACK = "article img, main img, section img, #content img, .article img, img"
PRIMARY_IMAGE_NAMES = ["image", "image_url", "imageurl", "cover", "first_image", "hero_image", "thumbnail"]
# Thresholds and page counts.
LIST_ITEMS_OVER = 10
GALLERY_IMAGES_OVER = 5
DEFAULT_MAX_PAGES = 3
SMALL_MAX_ITEMS = 20
IMAGE_ATTEMPTS = 3


def _text_map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(part) for pair in table.items() for part in pair])


def _override(base: Column, other: Column) -> Column:
    """Union of two maps; entries of ``other`` win, keys of ``base`` come first."""
    return F.map_zip_with(base, other, lambda _, a, b: F.coalesce(b, a))


def primary_image_field(fields: Column) -> Column:
    """First requested field that names a lead image, NULL if none."""
    named = F.filter(
        fields, lambda f: F.lower(F.replace(f, F.lit("-"), F.lit("_"))).isin(PRIMARY_IMAGE_NAMES)
    )
    return F.get(named, 0)


def primary_image_selector(replies: Column) -> Column:
    """Selector from the first valid of up to three replies, else the built-in list.

    ``replies`` is an array of (attempt, content). A reply is valid when its JSON object has a
    ``selector`` that is a string or null; null or blank means the page has no lead image.
    """

    def verdict(reply: Column) -> Column:
        return let(
            member(json_object(reply.content), "selector"),
            lambda v: F.struct(
                kind_of(v).isin("string", "null").alias("valid"),
                empty_to_null(strip(string_value(v))).alias("selector"),
            ),
        )

    tried = F.filter(F.array_sort(replies), lambda r: r.attempt <= IMAGE_ATTEMPTS)
    return let(
        F.get(F.filter(F.transform(tried, verdict), lambda v: v.valid), 0),
        lambda v: F.when(v.isNotNull(), v.selector).otherwise(PRIMARY_IMAGE_FALLBACK),
    )


def _model_selector(payload: Column, key: str, default: Column) -> Column:
    value = member(payload, key)
    return F.when(kind_of(value) == "string", empty_to_null(strip(text_of(value)))).otherwise(default)


def strategy_of(
    page_type: Column,
    suggested_fields: Column,
    requested_fields: Column,
    max_items: Column,
    tag_counts: Column,
    reply: Column,
    image_replies: Column,
) -> Column:
    requested = non_empty(requested_fields)
    default_fields = F.array(*[F.lit(f) for f in DEFAULT_FIELDS])
    wanted = F.coalesce(requested, non_empty(suggested_fields), default_fields)
    known = F.filter(F.array_distinct(wanted), lambda f: f.isin(list(DEFAULT_SELECTORS)))
    count = lambda tag: F.coalesce(F.try_element_at(tag_counts, F.lit(tag)), F.lit(0))
    is_list = (page_type == "list") | (count("li") > LIST_ITEMS_OVER)
    is_gallery = (page_type == "gallery") | (count("img") > GALLERY_IMAGES_OVER)
    image_field = primary_image_field(requested)

    def allowed(entries: Column) -> Column:
        """Requested fields only, without the lead image field."""
        return F.map_filter(
            entries,
            lambda k, _: F.coalesce(F.array_contains(requested, k), F.lit(True))
            & ~F.coalesce(k == image_field, F.lit(False)),
        )

    def merged(p: Column) -> Column:
        selectors = F.map_from_arrays(known, F.transform(known, lambda f: map_lookup(DEFAULT_SELECTORS, f)))
        methods = F.map_from_arrays(
            known, F.transform(known, lambda f: F.when(f == "links", "attr:href").otherwise("css"))
        )
        nested = member_object(p, "fallbacks")
        fallbacks = F.when(
            (kind_of(nested.value) == "object") & member(nested, "field_selectors").isNotNull(),
            string_map(nested, "field_selectors"),
        ).otherwise(_text_map(FALLBACK_SELECTORS))
        limits = int_map(p, "field_limits")
        max_pages = F.coalesce(natural_int(member(p, "max_pages")), F.lit(DEFAULT_MAX_PAGES))
        small = (max_items > 0) & (max_items <= SMALL_MAX_ITEMS)
        return F.struct(
            page_type.alias("page_type"),
            allowed(_override(selectors, string_map(p, "field_selectors"))).alias("field_selectors"),
            allowed(_override(methods, string_map(p, "field_methods"))).alias("field_methods"),
            F.map_filter(limits, lambda k, _: ~F.coalesce(k == image_field, F.lit(False))).alias("field_limits"),
            F.coalesce(boolean_value(member(p, "is_list")), is_list).alias("is_list"),
            _model_selector(
                p,
                "item_link_selector",
                F.when(is_list & ~F.array_contains(wanted, "links"), ITEM_LINK_SELECTOR),
            ).alias("item_link_selector"),
            F.coalesce(natural_int(member(p, "max_depth")), F.when(is_list, 2).otherwise(1)).alias("max_depth"),
            _model_selector(p, "pagination_selector", F.when(is_list, PAGINATION_SELECTOR)).alias(
                "pagination_selector"
            ),
            F.when(small, 1).otherwise(max_pages).alias("max_pages"),
            max_items.cast("int").alias("max_items"),
            _model_selector(p, "image_selector", F.when(is_gallery, GALLERY_SELECTOR)).alias("image_selector"),
            image_field.alias("primary_image_field"),
            F.when(image_field.isNotNull(), primary_image_selector(image_replies)).alias(
                "primary_image_selector"
            ),
            fallbacks.alias("fallback_selectors"),
        )

    return let(json_object(reply), merged)


def build_strategies(
    work: DataFrame, reply: str | None = None, image_replies: str | None = None
) -> DataFrame:
    """Add ``strategy`` to rows with page_type, suggested_fields, requested_fields, max_items, tag_counts."""
    no_replies = F.array().cast("array<struct<attempt:int,content:string>>")
    images = F.coalesce(F.col(image_replies), no_replies) if image_replies else no_replies
    kept = [c for c in work.columns if c not in (reply, image_replies)]
    strategy = strategy_of(
        F.col("page_type"),
        F.col("suggested_fields"),
        F.col("requested_fields"),
        F.col("max_items"),
        F.col("tag_counts"),
        F.col(reply) if reply else F.lit(None).cast("string"),
        images,
    )
    return work.select(*kept, strategy.alias("strategy"))

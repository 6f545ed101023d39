"""Queries over model prompts and replies: JSON reading, typing, intents and strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.functions.lenient_json import (
    boolean_value, int_map, json_object, json_payload, member, natural_int, string_list, string_map, unit_float,
)
from pagelake.operators import prompts
from pagelake.operators.intents import FIELD_KEYWORDS, INTENT_KEYWORDS, INTENT_TYPES, parse_intents, valid_intent
from pagelake.operators.strategies import (
    DEFAULT_SELECTORS, FALLBACK_SELECTORS, GALLERY_SELECTOR, ITEM_LINK_SELECTOR, PAGINATION_SELECTOR,
    PRIMARY_IMAGE_FALLBACK, build_strategies, primary_image_field, primary_image_selector,
)
from pagelake.operators.summary import tag_counts
from pagelake.operators.typing import PAGE_TYPES, classify, valid_page_type
from pagelake.plans import corpora, site
from pagelake.plans.registry import query
from pagelake.sources.html import parse_html

text = corpora.text


def sql_literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_render(template: str, **slots: str) -> str:
    """The template as a SQL concatenation."""
    expression = sql_literal(template)
    for name, value in slots.items():
        expression = f"replace({expression}, '{{{name}}}', {value})"
    return expression


# --- prompts ---------------------------------------------------------------------------------


@query(
    "intent_prompts",
    f"""SELECT conv_id, turn, {sql_render(prompts.INTENT_TEMPLATE, user_text='text')} AS content FROM conversations""",
)
def intent_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = corpora.table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", prompts.intent_prompt(F.col("text")).alias("content"))


@query(
    "page_type_prompts",
    f"""SELECT page_id, md5({sql_render(prompts.PAGE_TYPE_TEMPLATE, dom_summary='document')}) AS content_md5
    FROM (SELECT page_id, 'S' || page_id || html AS document FROM pages)""",
)
def page_type_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    document = text("S", F.col("page_id"), F.col("html"))
    return corpora.pages(spark, sf_dir).select(
        "page_id", F.md5(prompts.page_type_prompt(document)).alias("content_md5")
    )


_PLAN_WORK = """SELECT conv_id, turn, text AS task, 'Summary {' || turn || '}' AS dom_summary,
  ['news', 'list', 'gallery'][1 + turn % 3] AS page_type, 'extract_info' AS intent_type,
  CASE conv_id % 3 WHEN 0 THEN ['title', 'Hero-Image'] WHEN 1 THEN ['links'] END AS fields FROM conversations"""
_STRATEGY_SQL = sql_render(
    prompts.STRATEGY_TEMPLATE, page_type="page_type", intent_type="intent_type",
    requested_fields="('[' || coalesce(array_to_string(fields, ', '), '') || ']')", dom_summary="dom_summary",
)
_IMAGE_SQL = sql_render(
    prompts.FIRST_IMAGE_TEMPLATE, page_type="page_type", field_name="'Hero-Image'", dom_summary="dom_summary",
    task="task",
)


@query(
    "planning_prompts",
    f"""WITH w AS ({_PLAN_WORK})
    SELECT conv_id, turn, 'strategy' AS prompt_kind, {_STRATEGY_SQL} AS content FROM w
    UNION ALL SELECT conv_id, turn, 'first_image', {_IMAGE_SQL} FROM w WHERE conv_id % 3 = 0""",
)
def planning_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    kinds = F.array(*[F.lit(k) for k in ("news", "list", "gallery")])
    work = corpora.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.col("text").alias("task"), text("Summary {", turn, "}").alias("dom_summary"),
        F.get(kinds, (turn % 3).cast("int")).alias("page_type"), F.lit("extract_info").alias("intent_type"),
        F.when(conv % 3 == 0, F.array(F.lit("title"), F.lit("Hero-Image")))
        .when(conv % 3 == 1, F.array(F.lit("links")))
        .alias("requested_fields"),
    )
    return site.planning_prompts(work, ["conv_id", "turn"])


@query(
    "reply_join",
    """SELECT d.doc_id, CASE WHEN d.doc_id % 4 < 3 THEN 'reply ' || d.doc_id || ' 1' END AS content,
      CASE WHEN d.doc_id % 4 < 3 THEN least(d.doc_id % 5 + 1, 3) ELSE 0 END AS n_tries FROM documents d""",
)
def reply_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc_id = F.col("doc_id")
    documents = corpora.table(spark, sf_dir, "documents").select("doc_id")
    replies = documents.filter(doc_id % 4 < 3).select(
        "doc_id", F.lit("intent").alias("prompt_kind"),
        F.explode(F.sequence(F.lit(1), (doc_id % 5 + 1).cast("int"))).alias("attempt"),
    ).withColumn("content", text("reply ", doc_id, " ", F.col("attempt")))
    joined = prompts.with_replies(documents, replies, "intent", ["doc_id"])
    listed = prompts.with_reply_list(joined, replies, "intent", ["doc_id"], 3, "tries")
    return listed.select("doc_id", "content", F.coalesce(F.size("tries"), F.lit(0)).cast("bigint").alias("n_tries"))


# --- reading replies -------------------------------------------------------------------------


@query(
    "json_payloads",
    """SELECT event_id, CASE event_id % 9 WHEN 4 THEN '{}' WHEN 5 THEN '[' || event_id || ', 2]' WHEN 6 THEN '{}'
      WHEN 7 THEN event_id::VARCHAR ELSE props END AS payload, event_id % 9 NOT IN (4, 5, 6, 7) AS is_object FROM events""",
)
def json_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    props, n = F.col("props"), F.col("event_id")
    kind = n % 9
    reply = (
        F.when(kind == 0, props)
        .when(kind == 1, text("```json\n", props, "\n```  "))
        .when(kind == 2, text("Sure, here it is:\n", props, "\nAnything else?"))
        .when(kind == 3, text("\u3000```", props, "```\n"))
        .when(kind == 4, text("nothing {", n, "} here"))
        .when(kind == 5, text("as list [", n, ", 2]."))
        .when(kind == 6, text("two ", props, ",", props))
        .when(kind == 7, n.cast("string"))
        .otherwise(text("object in a list [", props, "]"))
    )
    return corpora.table(spark, sf_dir, "events").select(
        "event_id", json_payload(reply).alias("payload"), (json_object(reply).text != "{}").alias("is_object")
    )


_REPLY = """SELECT event_id, event_id % 5 AS k, event_type, value FROM events"""


@query(
    "reply_coercions",
    f"""WITH r AS ({_REPLY})
    SELECT event_id, 'a=' || event_type || '|b=' || event_id AS selectors,
      CASE WHEN k < 2 THEN 'n=' || event_id ELSE '' END AS limits,
      CASE WHEN k = 4 THEN '' ELSE event_type || '|x' END AS fields,
      CASE k WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN event_id <> 0 WHEN 3 THEN false END AS flag,
      CASE k WHEN 0 THEN event_id WHEN 1 THEN event_id WHEN 4 THEN NULL ELSE 0 END AS depth,
      CASE WHEN k < 2 THEN least(1.0, event_id / 1000.0) ELSE 0.0 END::DOUBLE AS confidence FROM r""",
)
def reply_coercions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, kind, event_type = F.col("event_id"), F.col("event_id") % 5, F.col("event_type")
    limit = F.when(kind == 0, n.cast("string")).when(kind == 1, text('" ', n, ' "')).when(kind == 2, text("-", n + 1)).when(
        kind == 3, text('"', n, '.5"')).otherwise("null")
    flag = F.when(kind == 0, '" YES "').when(kind == 1, "true").when(kind == 2, n.cast("string")).when(kind == 3, '"no"')
    depth = F.when(kind == 0, text(n, ".9")).when(kind == 1, text('"', n, '"')).when(kind == 2, "-3").when(kind == 3, '"x"')
    score = F.when(kind == 0, (n / 1000).cast("decimal(20,3)").cast("string")).when(
        kind == 1, text('" ', (n / 1000).cast("decimal(20,3)"), ' "')).when(kind == 2, '"NaN"').when(kind == 3, "-1").otherwise("[1]")
    listed = F.when(kind == 4, text('"', event_type, '"')).otherwise(text('["', event_type, '", 5, " ", null, " x "]'))
    reply = text(
        '{"field_selectors": {"a": " ', event_type, ' ", "b": ', n, ', "c": null}, "field_limits": {"n": ', limit, '}, "fields": ',
        listed, F.when(flag.isNull(), "").otherwise(text(', "flag": ', flag)),
        F.when(depth.isNull(), "").otherwise(text(', "depth": ', depth)), ', "confidence": ', score, "}",
    )
    payloads = corpora.table(spark, sf_dir, "events").select("event_id", json_object(reply).alias("p"))
    p = F.col("p")
    shown = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: text(e.key, "=", e["value"])), "|")
    return payloads.select(
        "event_id", shown(string_map(p, "field_selectors")).alias("selectors"), shown(int_map(p, "field_limits")).alias("limits"),
        F.array_join(string_list(member(p, "fields")), "|").alias("fields"), boolean_value(member(p, "flag")).alias("flag"),
        natural_int(member(p, "depth")).cast("bigint").alias("depth"), unit_float(member(p, "confidence")).alias("confidence"),
    )


# --- page typing -----------------------------------------------------------------------------

_TYPE_NAMES = ["News", "detail", "profile", "THREAD", "list", "gallery", " news", "single_page_app", "", "blog"]
_TYPE_RESULTS = ["news", "news", "news", "forum", "list", "gallery", "unknown", "single_page_app", "unknown", "unknown"]


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(sql_literal(v) for v in values) + "]"


@query(
    "page_typing",
    f"""SELECT event_id, CASE WHEN event_id % 11 = 10 THEN 'unknown' ELSE {_sql_list(_TYPE_RESULTS)}[1 + event_id % 10] END AS page_type,
      CASE WHEN event_id % 11 = 10 THEN 0.0 ELSE least(1.0, greatest(0.0, round(value / 100, 4))) END::DOUBLE AS confidence,
      CASE WHEN event_id % 11 = 10 THEN '' ELSE event_type || '|date' END AS suggested_fields FROM events""",
)
def page_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    names = F.array(*[F.lit(v) for v in _TYPE_NAMES])
    reply = text(
        'Here: {"page_type": "', F.get(names, (n % 10).cast("int")), '", "confidence": ',
        F.round(F.col("value") / 100, 4).cast("decimal(20,4)"), ', "suggested_fields": ["', F.col("event_type"), '", "", "date"]}',
    )
    replies = corpora.table(spark, sf_dir, "events").select("event_id", F.when(n % 11 != 10, reply).alias("content"))
    return classify(replies).withColumn("suggested_fields", F.array_join("suggested_fields", "|"))


@query(
    "name_validation",
    f"""WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN upper(lang) ELSE {_sql_list(PAGE_TYPES + ['detail', 'thread'] + INTENT_TYPES)}[1 + doc_id % 16] END AS name
      FROM documents)
    SELECT doc_id, CASE WHEN name IN ('detail', 'profile') THEN 'news' WHEN name = 'thread' THEN 'forum'
        WHEN name IN {tuple(PAGE_TYPES)} THEN name ELSE 'unknown' END AS page_type,
      CASE WHEN name IN {tuple(INTENT_TYPES)} THEN name ELSE 'other' END AS intent_type FROM d""",
)
def name_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(v) for v in PAGE_TYPES + ["detail", "thread"] + INTENT_TYPES])
    doc_id = F.col("doc_id")
    name = F.when(doc_id % 3 == 0, F.upper("lang")).otherwise(F.upper(F.get(names, (doc_id % 16).cast("int"))))
    return corpora.table(spark, sf_dir, "documents").select(
        "doc_id", valid_page_type(name).alias("page_type"), valid_intent(name).alias("intent_type")
    )


# --- intents ---------------------------------------------------------------------------------

_PHRASES = [
    "抓取前 {n} 条列表标题和图片", "Top {n} articles with links", "download every photo", "get price and author",
    "{n} links please", "详情 正文 递归", "compare", "replies of fans", "前１２条 日期",
]
_LIMITS = ["n", "n", "NULL", "NULL", "n", "NULL", "NULL", "NULL", "12"]


def _sql_any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(t, {sql_literal(w)})" for w in words) + ")"


_TASKS = f"""SELECT conv_id, turn, conv_id % 40 AS n, (conv_id + turn) % 9 AS k,
  lower(replace({_sql_list(_PHRASES)}[1 + (conv_id + turn) % 9], '{{n}}', (conv_id % 40)::VARCHAR) || ' # ' || text) AS t, text FROM conversations"""
_KEYWORD_INTENT = (
    "CASE " + " ".join(f"WHEN {_sql_any(words)} THEN '{intent}'" for intent, words in INTENT_KEYWORDS.items())
    + " ELSE 'extract_info' END"
)
_KEYWORD_FIELDS = (
    "list_filter([" + ", ".join(f"CASE WHEN {_sql_any(words)} THEN '{field}' END" for field, words in FIELD_KEYWORDS.items())
    + "], lambda x: x IS NOT NULL)"
)


@query(
    "intents",
    f"""WITH tasks AS ({_TASKS}), parsed AS (
      SELECT *, {_KEYWORD_INTENT} AS by_words, {_KEYWORD_FIELDS} AS words,
        CASE WHEN conv_id % 4 < 2 THEN ['date', 'extra'] ELSE []::VARCHAR[] END AS named FROM tasks)
    SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'compare_price' ELSE by_words END AS intent_type,
      nullif(array_to_string(list_concat(named, list_filter(words, lambda w: NOT list_contains(named, w))), '|'), '') AS requested_fields,
      CASE k {' '.join(f'WHEN {i} THEN {v}' for i, v in enumerate(_LIMITS))} END AS max_items FROM parsed""",
)
def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    phrase = F.get(F.array(*[F.lit(p) for p in _PHRASES]), ((conv + turn) % 9).cast("int"))
    task = F.concat(F.replace(phrase, F.lit("{n}"), (conv % 40).cast("string")), F.lit(" # "), F.col("text"))
    model = text(
        '```json\n{"intent_type": "', F.when(conv % 4 == 0, "Compare_Price").otherwise("other"),
        '", "requested_fields": ["date", "", "extra", "date"]}\n```',
    )
    tasks = corpora.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", task.alias("task"), F.when(conv % 4 < 2, model).alias("reply")
    )
    parsed = parse_intents(tasks, reply="reply")
    return parsed.select(
        "conv_id", "turn", "intent_type", F.array_join("requested_fields", "|").alias("requested_fields"),
        F.col("max_items").cast("bigint").alias("max_items"),
    )


# --- strategies ------------------------------------------------------------------------------

_FIELD_SETS = [["title", "links"], ["content", "date", "cover"], None, ["price", "unheard_of"], ["images", "Hero-Image", "title"]]


def _sql_map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{sql_literal(k)}: {sql_literal(v)}" for k, v in table.items()) + "}"


_FIELD_SQL = "CASE page_id % 5 " + " ".join(
    f"WHEN {i} THEN {_sql_list(fs) if fs else 'NULL'}" for i, fs in enumerate(_FIELD_SETS)
) + " END"
_STRATEGY_BASE = f"""
work AS (
  SELECT page_id, ['news', 'list', 'gallery', 'forum'][1 + page_id % 4] AS page_type, {_FIELD_SQL} AS requested,
    page_id % 3 = 0 AS has_reply, page_id % 40 AS max_items, len(regexp_extract_all(html, '<li>')) AS li FROM pages),
w AS (SELECT *, coalesce(requested, CASE WHEN page_id % 2 = 0 THEN ['author', 'name'] ELSE ['title', 'content'] END) AS wanted,
  page_type = 'list' OR li > 10 AS is_list_rule,
  list_filter(coalesce(requested, []), lambda f: replace(lower(f), '-', '_') IN ('cover', 'hero_image'))[1] AS image_field FROM work),
f AS (SELECT *, {_sql_map(DEFAULT_SELECTORS)} AS defaults FROM w),
s AS (SELECT *, list_concat(
    list_transform(list_filter(wanted, lambda x: defaults[x] IS NOT NULL AND (NOT has_reply OR x <> 'title')), lambda x: {{'k': x, 'v': defaults[x], 'm': CASE WHEN x = 'links' THEN 'attr:href' ELSE 'css' END}}),
    CASE WHEN has_reply AND (requested IS NULL OR list_contains(requested, 'title')) THEN [{{'k': 'title', 'v': '.headline', 'm': 'text'}}] ELSE [] END) AS entries FROM f)
"""


@query(
    "strategies",
    f"""WITH {_STRATEGY_BASE}
    SELECT page_id, page_type,
      array_to_string(list_sort(list_transform(entries, lambda e: e.k || '=' || e.v || '@' || e.m)), ';') AS fields,
      CASE WHEN has_reply THEN 'links=7' ELSE '' END AS limits,
      CASE WHEN has_reply THEN false ELSE is_list_rule END AS is_list,
      CASE WHEN is_list_rule AND NOT list_contains(wanted, 'links') THEN {sql_literal(ITEM_LINK_SELECTOR)} END AS item_link_selector,
      CASE WHEN is_list_rule AND NOT has_reply THEN {sql_literal(PAGINATION_SELECTOR)} END AS pagination_selector,
      CASE WHEN is_list_rule THEN 2 ELSE 1 END AS max_depth,
      CASE WHEN max_items BETWEEN 1 AND 20 THEN 1 WHEN has_reply THEN 9 ELSE 3 END AS max_pages, max_items,
      CASE WHEN page_type = 'gallery' THEN {sql_literal(GALLERY_SELECTOR)} END AS image_selector, image_field,
      CASE WHEN image_field IS NOT NULL THEN {sql_literal(PRIMARY_IMAGE_FALLBACK)} END AS image_field_selector,
      CASE WHEN has_reply THEN 'title=h3' ELSE {sql_literal(';'.join(f'{k}={v}' for k, v in FALLBACK_SELECTORS.items()))} END AS fallbacks
    FROM s""",
)
def strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    page_id = F.col("page_id")
    kinds = F.array(*[F.lit(k) for k in ("news", "list", "gallery", "forum")])
    requested = F.lit(None).cast("array<string>")
    for i, fields in enumerate(_FIELD_SETS):
        if fields:
            requested = F.when(page_id % 5 == i, F.array(*[F.lit(f) for f in fields])).otherwise(requested)
    reply = (
        '{"field_selectors": {"title": " .headline "}, "field_methods": {"title": "text"}, "field_limits": {"links": "7", "bad": -1},'
        ' "is_list": "no", "pagination_selector": "  ", "item_link_selector": null, "max_pages": 9,'
        ' "fallbacks": {"field_selectors": {"title": "h3"}}}'
    )
    work = parse_html(corpora.pages(spark, sf_dir)).select(
        "page_id", F.get(kinds, (page_id % 4).cast("int")).alias("page_type"), requested.alias("requested_fields"),
        F.when(page_id % 2 == 0, F.array(F.lit("author"), F.lit("name"))).alias("suggested_fields"),
        (page_id % 40).cast("int").alias("max_items"), tag_counts().alias("tag_counts"),
        F.when(page_id % 3 == 0, reply).alias("reply"),
    )
    s = F.col("strategy")
    shown = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: text(e.key, "=", e["value"])), ";")
    fields = F.array_sort(
        F.transform(
            F.map_entries(s.field_selectors),
            lambda e: text(e.key, "=", e["value"], "@", F.try_element_at(s.field_methods, e.key)),
        )
    )
    return build_strategies(work, "reply").select(
        "page_id", s.page_type.alias("page_type"), F.array_join(fields, ";").alias("fields"),
        shown(s.field_limits).alias("limits"), s.is_list.alias("is_list"), s.item_link_selector.alias("item_link_selector"),
        s.pagination_selector.alias("pagination_selector"), s.max_depth.cast("bigint").alias("max_depth"),
        s.max_pages.cast("bigint").alias("max_pages"), s.max_items.cast("bigint").alias("max_items"),
        s.image_selector.alias("image_selector"), s.primary_image_field.alias("image_field"),
        s.primary_image_selector.alias("image_field_selector"), shown(s.fallback_selectors).alias("fallbacks"),
    )


@query(
    "primary_image_plans",
    f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Cover' WHEN 1 THEN 'first-image' WHEN 2 THEN 'thumbnail' END AS image_field,
      CASE doc_id % 6 WHEN 0 THEN 'img.d' || doc_id WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 'img.third' ELSE {sql_literal(PRIMARY_IMAGE_FALLBACK)} END AS selector
    FROM documents""",
)
def primary_image_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc_id, kind = F.col("doc_id"), F.col("doc_id") % 6
    attempt = lambda n, content: F.struct(F.lit(n).alias("attempt"), content.alias("content"))
    bad, late = F.lit("no json"), F.lit('{"selector": "img.fourth"}')
    none = F.array().cast("array<struct<attempt:int,content:string>>")
    replies = (
        F.when(kind == 0, F.array(attempt(2, F.lit('{"selector": "img.x"}')), attempt(1, text('{"selector": " img.d', doc_id, ' "}'))))
        .when(kind == 1, F.array(attempt(1, F.lit('{"selector": null}')), attempt(2, late)))
        .when(kind == 2, F.array(attempt(1, bad), attempt(2, F.lit('{"selector": "  "}'))))
        .when(kind == 3, F.array(attempt(1, bad), attempt(2, F.lit('{"selector": 5}')), attempt(3, F.lit('{"selector": "img.third"}'))))
        .when(kind == 4, F.array(attempt(1, bad), attempt(4, late)))
        .otherwise(none)
    )
    names = F.array(*[F.lit(f) for f in ("Cover", "first-image", "thumbnail", "images")])
    wanted = F.array(F.lit("title"), F.get(names, (doc_id % 4).cast("int")), F.lit("date"))
    return corpora.table(spark, sf_dir, "documents").select(
        "doc_id", primary_image_field(wanted).alias("image_field"), primary_image_selector(replies).alias("selector")
    )

"""Task intents: model reply first, keyword rules where it says nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions.lenient_json import json_object, member, string_list, string_value
from pagelake.functions.text import as_col, empty_to_null, let

# Intent types, and the keywords that hint at intents and fields.
INTENT_TYPES = ["extract_info", "crawl_list", "download_images", "crawl_detail", "compare_price", "other"]
INTENT_KEYWORDS = {
    "crawl_list": ["list", "列表", "多条", "分页", "top"],
    "download_images": ["image", "图片", "图集", "下载图"],
    "crawl_detail": ["detail", "详情", "递归", "深度"],
}
FIELD_KEYWORDS = {
    "title": ["title", "标题", "题目"],
    "content": ["content", "正文", "内容", "详情", "description"],
    "date": ["date", "time", "时间", "日期"],
    "author": ["author", "作者", "发布者"],
    "price": ["price", "价格", "价钱"],
    "images": ["image", "photo", "图片", "配图"],
    "links": ["link", "url", "链接", "跳转"],
    "name": ["name", "用户名", "昵称"],
    "follows": ["followers", "fans", "粉丝", "关注"],
    "answer": ["answer", "回答", "回复"],
    "sub_comments": ["sub comment", "reply", "楼中楼", "评论"],
}
LIMIT_PATTERNS = [r"(?iU)(?:前|top)\s*(\d+)", r"(?iU)(\d+)\s*(?:个|条|篇|章|项|links?)"]


def keyword_intent(task: Column) -> Column:
    lowered = F.lower(task)
    rule = F.lit(None).cast("string")
    for intent, words in reversed(INTENT_KEYWORDS.items()):
        rule = F.when(lowered.rlike("|".join(words)), intent).otherwise(rule)
    return F.coalesce(rule, F.lit("extract_info"))


def keyword_fields(task: Column) -> Column:
    """Fields whose keywords occur, in fixed order; NULL when there are none."""
    lowered = F.lower(task)
    hits = [F.when(lowered.rlike("|".join(words)), field) for field, words in FIELD_KEYWORDS.items()]
    return non_empty(F.array_compact(F.array(*hits)))


def non_empty(values: Column) -> Column:
    return F.when(F.size(values) > 0, values)


def item_limit(task: Column) -> Column:
    """Requested number of items, NULL when the task names none."""
    found = [empty_to_null(F.regexp_extract(task, pattern, 1)) for pattern in LIMIT_PATTERNS]
    digits = F.translate(F.coalesce(*found), "０１２３４５６７８９", "0123456789")
    return digits.try_cast("int")


def valid_intent(value: Column) -> Column:
    lowered = F.lower(value)
    return F.when(lowered.isin(INTENT_TYPES), lowered).otherwise("other")


def merge_fields(first: Column, second: Column) -> Column:
    """Both lists in order, first occurrence kept; NULL when nothing is left."""
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce(first, none), F.coalesce(second, none))
    return non_empty(F.array_distinct(F.filter(both, lambda f: f.isNotNull() & (f != ""))))


def intent_of(task: Column | str, reply: Column | None = None) -> Column:
    """Struct (intent_type, requested_fields, raw_text, max_items)."""
    task = as_col(task)
    reply = F.lit(None).cast("string") if reply is None else reply

    def combine(payload: Column) -> Column:
        model = valid_intent(string_value(member(payload, "intent_type")))
        return F.struct(
            F.coalesce(F.when(model != "other", model), keyword_intent(task)).alias("intent_type"),
            merge_fields(string_list(member(payload, "requested_fields")), keyword_fields(task)).alias(
                "requested_fields"
            ),
            task.alias("raw_text"),
            item_limit(task).alias("max_items"),
        )

    return let(json_object(reply), combine)


def parse_intents(tasks: DataFrame, task: str = "task", reply: str | None = None) -> DataFrame:
    kept = [c for c in tasks.columns if c not in (task, reply)]
    intent = intent_of(F.col(task), F.col(reply) if reply else None)
    return tasks.select(*kept, intent.alias("intent")).select(*kept, "intent.*")

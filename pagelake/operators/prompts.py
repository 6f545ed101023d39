"""Prompts out, replies in: model calls as two tables.

The prompt texts are defaults; every function takes another template with the same ``{slots}``.
No executor calls a model: a batch system reads the prompts table and writes the replies table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.operators.intents import INTENT_TYPES
from pagelake.operators.typing import PAGE_TYPES


def _names(values: list[str]) -> str:
    return ", ".join(values)


PAGE_TYPE_TEMPLATE = f"""Classify one web page from its structural summary.
Answer with one JSON object and nothing around it:
  page_type: one of {_names(PAGE_TYPES)}
  confidence: number from 0 to 1
  suggested_fields: list of field names worth extracting
Summary: {{dom_summary}}"""

INTENT_TEMPLATE = f"""Read the request below and say what it wants.
Answer with one JSON object and nothing around it:
  intent_type: one of {_names(INTENT_TYPES)}
  requested_fields: list of the field names it asks for, empty if it names none
Request: {{user_text}}"""

STRATEGY_TEMPLATE = """Plan the extraction of fields from one web page with CSS selectors.
Page type: {page_type}. Intent: {intent_type}. Fields: {requested_fields}.
Answer with one JSON object and nothing around it. Keys that may appear:
  field_selectors and field_methods (field to text; attr:href for links, attr:src for images)
  field_limits (field to whole number), is_list (true or false)
  item_link_selector, pagination_selector, image_selector (text or null)
  max_depth and max_pages (whole numbers), fallbacks (object with field_selectors)
Use the containers named under structure_hints, not body or a bare div.
Summary: {dom_summary}"""

FIRST_IMAGE_TEMPLATE = """Find the lead image of the main content of one {page_type} page.
Task: {task}. Field: {field_name}.
Answer with one JSON object and nothing around it: selector, a CSS selector for exactly one img, or null.
Ignore navigation, header, footer and advertising images; start from a content container.
Summary: {dom_summary}"""


def render(template: str, **slots: Column) -> Column:
    """Template with its ``{slots}`` filled by Columns; text of the columns is never re-scanned."""
    pieces = re.split(r"\{(\w+)\}", template)
    parts = [
        F.coalesce(slots[piece].cast("string"), F.lit("")) if n % 2 else F.lit(piece)
        for n, piece in enumerate(pieces)
    ]
    return F.concat(*parts)


def field_list(fields: Column) -> Column:
    return F.concat(F.lit("["), F.coalesce(F.array_join(fields, ", "), F.lit("")), F.lit("]"))


def page_type_prompt(dom_summary: Column, template: str = PAGE_TYPE_TEMPLATE) -> Column:
    return render(template, dom_summary=dom_summary)


def intent_prompt(task: Column, template: str = INTENT_TEMPLATE) -> Column:
    return render(template, user_text=task)


def strategy_prompt(
    page_type: Column, intent_type: Column, fields: Column, dom_summary: Column, template: str = STRATEGY_TEMPLATE
) -> Column:
    return render(
        template,
        page_type=page_type,
        intent_type=intent_type,
        requested_fields=field_list(fields),
        dom_summary=dom_summary,
    )


def first_image_prompt(
    page_type: Column, task: Column, field: Column, dom_summary: Column, template: str = FIRST_IMAGE_TEMPLATE
) -> Column:
    return render(template, page_type=page_type, task=task, field_name=field, dom_summary=dom_summary)


def with_replies(work: DataFrame, replies: DataFrame, kind: str, keys: list[str], out: str = "content") -> DataFrame:
    """Attach the first-attempt reply of one prompt kind; NULL where the model gave none."""
    first = (
        replies.filter((F.col("prompt_kind") == kind) & (F.coalesce(F.col("attempt"), F.lit(1)) == 1))
        .groupBy(*keys)
        .agg(F.min("content").alias(out))
    )
    return work.join(first, keys, "left")


def with_reply_list(work: DataFrame, replies: DataFrame, kind: str, keys: list[str], attempts: int, out: str) -> DataFrame:
    """Attach the replies of up to ``attempts`` tries, one slot per try, combined before the shuffle."""
    slots = [
        F.min(F.when(F.col("attempt") == n, F.col("content"))).alias(f"_{n}") for n in range(1, attempts + 1)
    ]
    tries = replies.filter((F.col("prompt_kind") == kind) & (F.col("attempt") <= attempts)).groupBy(*keys).agg(*slots)
    entries = F.array(
        *[F.struct(F.lit(n).alias("attempt"), F.col(f"_{n}").alias("content")) for n in range(1, attempts + 1)]
    )
    packed = tries.select(*keys, F.filter(entries, lambda e: e.content.isNotNull()).alias(out))
    return work.join(packed, keys, "left")

"""Page typing from a model reply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions.lenient_json import json_object, member, string_list, string_value, unit_float
from pagelake.functions.text import let, map_lookup

# Page types and the names read as another one.
PAGE_TYPES = ["news", "list", "product", "gallery", "forum", "profile", "single_page_app", "unknown"]
PAGE_TYPE_ALIASES = {"detail": "news", "profile": "news", "thread": "forum"}


def valid_page_type(value: Column) -> Column:
    """Lower-cased page type with aliases applied; ``unknown`` for anything else."""
    lowered = F.lower(value)
    named = F.coalesce(map_lookup(PAGE_TYPE_ALIASES, lowered), lowered)
    return F.when(named.isin(PAGE_TYPES), named).otherwise("unknown")


def typing_of(reply: Column) -> Column:
    """Struct (page_type, confidence, suggested_fields) read from a reply; a missing reply counts as empty."""
    return let(
        json_object(reply),
        lambda p: F.struct(
            valid_page_type(string_value(member(p, "page_type"))).alias("page_type"),
            unit_float(member(p, "confidence")).alias("confidence"),
            string_list(member(p, "suggested_fields")).alias("suggested_fields"),
        ),
    )


def classify(pages: DataFrame, reply: str = "content") -> DataFrame:
    """Replace the reply column by page_type, confidence and suggested_fields."""
    kept = [c for c in pages.columns if c != reply]
    return pages.select(*kept, typing_of(F.col(reply)).alias("typing")).select(*kept, "typing.*")

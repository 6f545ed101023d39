"""Batch experiments: cases times models through every stage, with correctness per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions.text import empty_to_null, strip
from pagelake.operators.flows import snapshot_records
from pagelake.operators.intents import intent_of, non_empty, valid_intent
from pagelake.operators.metrics import coverage, exact_match, non_empty_fields
from pagelake.operators.strategies import IMAGE_ATTEMPTS, build_strategies
from pagelake.operators.summary import tag_counts
from pagelake.operators.typing import typing_of, valid_page_type
from pagelake.session import write_through
from pagelake.sources.html import parse_html

RECORDS = "array<array<struct<field:string,kind:string,s:string,xs:array<string>>>>"

# Columns of a run, in the order they are written.
RUN_COLUMNS = [
    "case_id", "model", "site", "url", "task", "html_used", "error", "page_type", "intent_type", "requested_fields",
    "strategy_fields", "records_returned", "timings", "page_type_correct", "intent_type_correct",
    "intent_field_hit_rate", "strategy_field_hit_rate", "non_empty_fields", "extraction_exact_match", "records",
]


def cases_by_model(cases: DataFrame, models: list[str]) -> DataFrame:
    """Every case for every model: a row generator over the given names, not a join."""
    return cases.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))


def _given(value: Column, result: Column) -> Column:
    """Result only where an expectation is given."""
    return F.when(empty_to_null(value).isNotNull(), result)


def _failed(work: DataFrame) -> DataFrame:
    """Fixed outcome of cases without a page."""
    no_text = F.array().cast("array<string>")
    return work.select(
        "case_id", "model", "site", "url", "task", "html_used",
        F.lit("fetch_failed").alias("error"),
        F.lit("unknown").alias("page_type"),
        F.lit("other").alias("intent_type"),
        F.coalesce("expected_fields", no_text).alias("requested_fields"),
        no_text.alias("strategy_fields"),
        F.lit(0).alias("records_returned"),
        "timings",
        F.lit(False).alias("page_type_correct"),
        F.lit(False).alias("intent_type_correct"),
        F.lit(0.0).alias("intent_field_hit_rate"),
        F.lit(0.0).alias("strategy_field_hit_rate"),
        F.lit(0).alias("non_empty_fields"),
        F.lit(False).alias("extraction_exact_match"),
        F.array().cast(RECORDS).alias("records"),
    )


def run_cases(work: DataFrame) -> DataFrame:
    """Runs of cases that already carry their page and the model's replies.

    ``work``: case_id, model, site, url, task, html (NULL if not fetched), html_path, timings,
    expected_page_type, expected_intent_type, expected_fields, expected_records (cells),
    typing_reply, intent_reply, strategy_reply, image_replies. Everything happens in the row of
    the case, so apart from the joins that built ``work`` there is no shuffle. An action: plans are written once.
    """
    work = work.withColumn("html_used", F.coalesce(empty_to_null(F.col("html_path")), F.col("url")))
    has_page = F.coalesce(strip("html") != "", F.lit(False))
    failed = _failed(work.filter(~has_page))

    parsed = parse_html(work.filter(has_page)).withColumns(
        {
            "typing": typing_of(F.col("typing_reply")),
            "intent": intent_of(F.col("task"), F.col("intent_reply")),
            "tag_counts": tag_counts(),
            "base_url": F.col("url"),
        }
    )
    expected_fields = non_empty(F.col("expected_fields"))
    staged = parsed.withColumns(
        {
            "page_type": F.col("typing.page_type"),
            "suggested_fields": F.col("typing.suggested_fields"),
            "intent_type": F.coalesce(
                _given(F.col("expected_intent_type"), valid_intent(F.col("expected_intent_type"))),
                F.col("intent.intent_type"),
            ),
            "requested_fields": F.coalesce(expected_fields, F.col("intent.requested_fields")),
            "max_items": F.col("intent.max_items"),
        }
    )
    # Written once: every part of a strategy is read several times below.
    planned = write_through(build_strategies(staged, "strategy_reply", "image_replies"), "planned")
    executed = planned.withColumn("records", snapshot_records(F.col("strategy")).cast(RECORDS))
    strategy_fields = F.map_keys("strategy.field_selectors")
    done = executed.select(
        "case_id", "model", "site", "url", "task", "html_used",
        F.lit(None).cast("string").alias("error"),
        "page_type", "intent_type", "requested_fields",
        strategy_fields.alias("strategy_fields"),
        F.size("records").alias("records_returned"),
        "timings",
        _given(
            F.col("expected_page_type"), F.col("page_type") == valid_page_type(F.col("expected_page_type"))
        ).alias("page_type_correct"),
        _given(
            F.col("expected_intent_type"), F.col("intent_type") == valid_intent(F.col("expected_intent_type"))
        ).alias("intent_type_correct"),
        F.when(expected_fields.isNotNull(), coverage(expected_fields, F.col("requested_fields"))).alias(
            "intent_field_hit_rate"
        ),
        F.when(expected_fields.isNotNull(), coverage(expected_fields, strategy_fields)).alias(
            "strategy_field_hit_rate"
        ),
        F.when(expected_fields.isNotNull(), non_empty_fields(F.col("records"), expected_fields)).alias(
            "non_empty_fields"
        ),
        F.when(F.size("expected_records") > 0, exact_match(F.col("expected_records"), F.col("records"))).alias(
            "extraction_exact_match"
        ),
        "records",
    )
    return done.unionByName(failed).select(*RUN_COLUMNS)


def attach_replies(cases: DataFrame, replies: DataFrame) -> DataFrame:
    """Cases (case_id, model, …) with the replies of each stage, NULL or empty where none came."""
    stages = {"page_type": "typing_reply", "intent": "intent_reply", "strategy": "strategy_reply"}
    first = F.coalesce(F.col("attempt"), F.lit(1)) == 1
    slots = [
        F.min(F.when((F.col("prompt_kind") == kind) & first, F.col("content"))).alias(out)
        for kind, out in stages.items()
    ]
    tries = [
        F.min(F.when((F.col("prompt_kind") == "first_image") & (F.col("attempt") == n), F.col("content"))).alias(f"_{n}")
        for n in range(1, IMAGE_ATTEMPTS + 1)
    ]
    entries = F.array(
        *[F.struct(F.lit(n).alias("attempt"), F.col(f"_{n}").alias("content")) for n in range(1, IMAGE_ATTEMPTS + 1)]
    )
    packed = replies.groupBy("case_id", "model").agg(*slots, *tries).select(
        "case_id", "model", *stages.values(),
        F.filter(entries, lambda e: e.content.isNotNull()).alias("image_replies"),
    )
    return cases.join(packed, ["case_id", "model"], "left")

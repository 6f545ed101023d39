"""End-to-end plan: pages and tasks in, records out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.functions.urls import request_url
from pagelake.operators.flows import parsed_snapshots, run_flows
from pagelake.operators.intents import intent_of
from pagelake.operators.prompts import first_image_prompt, intent_prompt, page_type_prompt, strategy_prompt
from pagelake.operators.strategies import build_strategies, primary_image_field
from pagelake.operators.summary import summarize, summary_json, tag_counts
from pagelake.operators.typing import typing_of
from pagelake.session import write_through


def page_prompts(doms: DataFrame, key: str = "page_id") -> DataFrame:
    """Page type prompts (prompt_kind, key, content) of parsed pages."""
    return summarize(doms).select(
        F.lit("page_type").alias("prompt_kind"), key, page_type_prompt(summary_json()).alias("content")
    )


def task_prompts(tasks: DataFrame, key: str = "task_id") -> DataFrame:
    return tasks.select(F.lit("intent").alias("prompt_kind"), key, intent_prompt(F.col("task")).alias("content"))


def planning_prompts(work: DataFrame, keys: list[str]) -> DataFrame:
    """Strategy prompts, and lead image prompts where one is wanted.

    ``work``: keys, page_type, intent_type, requested_fields, task, dom_summary.
    """
    image_field = primary_image_field(F.col("requested_fields"))
    shared = [F.col("page_type"), F.col("dom_summary")]
    prompts = F.array(
        F.struct(
            F.lit("strategy").alias("prompt_kind"),
            strategy_prompt(shared[0], F.col("intent_type"), F.col("requested_fields"), shared[1]).alias("content"),
        ),
        F.struct(
            F.lit("first_image").alias("prompt_kind"),
            F.when(
                image_field.isNotNull(), first_image_prompt(shared[0], F.col("task"), image_field, shared[1])
            ).alias("content"),
        ),
    )
    return work.select(*keys, F.inline(prompts)).filter(F.col("content").isNotNull())


def plan_pages(
    doms: DataFrame, assignments: DataFrame, typing_reply: str | None = None,
    intent_reply: str | None = None, strategy_reply: str | None = None, image_replies: str | None = None,
) -> DataFrame:
    """Starts (walk_id, url, page_type, strategy) of assignments (walk_id, url, task and optional reply columns).

    ``doms`` are stored parsed snapshots. Of a page only its tag counts are needed here, so rows stay narrow, and
    typing and intent are columns of their own before the strategy reads them.
    """
    reply = lambda name: F.col(name) if name else F.lit(None).cast("string")
    counts = doms.select("url_key", tag_counts().alias("tag_counts"))
    work = assignments.withColumns({"url_key": request_url("url"), "typing": typing_of(reply(typing_reply)), "intent": intent_of("task", reply(intent_reply))})
    planned = work.join(counts, "url_key").select("*", "typing.page_type", "typing.suggested_fields", "intent.requested_fields", "intent.max_items")
    return build_strategies(planned, strategy_reply, image_replies).select("walk_id", "url", "page_type", "strategy")


def extract_site(snapshots: DataFrame, assignments: DataFrame, **replies: str) -> DataFrame:
    """Records (walk_id, record_no, page_url, record) of assignments over snapshots: pages are parsed and planned once.

    An action: parsed pages, plans and list rounds are written below the shared folder.
    """
    doms = write_through(parsed_snapshots(snapshots), "doms")
    return run_flows(write_through(plan_pages(doms, assignments, **replies), "starts"), doms)

"""The choice of snapshots on a stream of captures: the best capture of every request so far, in state.

The state of a request is its best rank and the capture that has it, a few bytes; HTML only passes through. A capture that
beats the state comes out, with the number of times the choice has changed, so of a request's rows the one with the largest
``version`` is what the batch would choose from all captures seen, whatever batches they came in. Captures that lose come
out of nothing and leave nothing behind. A request that no capture came for in ``forget_after`` loses its state.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagelake.functions.urls import final_or_requested, request_url
from pagelake.sources.snapshots import RENDER_BACKENDS, apply_status, capture_rank

STATE = "rank int, capture_id long, version int"
OUT = "request_key string, capture_id long, requested_url string, final_url string, html string, renderer string, rank int, version int"


class BestCapture(StatefulProcessor):
    def __init__(self, forget_after: timedelta | None = None) -> None:
        self.forget_after = forget_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = int(self.forget_after.total_seconds() * 1000) if self.forget_after else None
        self.best = handle.getValueState("best", STATE, ttl)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self.best.get() if self.best.exists() else None
        # The lower rank wins; of equal captures the newest, which has the largest id.
        worth, version = ((state[0], -state[1]), state[2]) if state else (None, 0)
        winner = None
        for row in rows:
            own = (row.rank, -row.capture_id)
            if worth is None or own < worth:
                worth, winner = own, row
        if winner is not None:
            self.best.update((winner.rank, winner.capture_id, version + 1))
            yield Row(
                request_key=key[0], capture_id=winner.capture_id, requested_url=winner.requested_url, final_url=winner.final_url, html=winner.html,
                renderer=winner.renderer, rank=winner.rank, version=version + 1,
            )

    def close(self) -> None:
        pass


def choose_on_stream(captures: DataFrame, backends: list[str] | None = None, auto_render: bool = True, forget_after: timedelta | None = None) -> DataFrame:
    """Improved choices (``OUT``) of a stream of captures (capture_id, requested_url, final_url, html, renderer and, if known, status).

    The session needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    if "status" in captures.columns:
        captures = apply_status(captures).where(~F.col("rejected"))
    ranked = captures.select(
        request_url("requested_url").alias("request_key"), F.col("capture_id").cast("long").alias("capture_id"), "requested_url", "final_url",
        F.coalesce("html", F.lit("")).alias("html"), "renderer",
        capture_rank(F.coalesce("html", F.lit("")), F.col("renderer"), backends, auto_render).cast("int").alias("rank"),
    ).where("rank is not null")
    return ranked.groupBy("request_key").transformWithState(
        statefulProcessor=BestCapture(forget_after), outputStructType=OUT, outputMode="Update", timeMode="ProcessingTime" if forget_after else "None",
    )


def settled(choices: DataFrame, backends: list[str] | None = None) -> DataFrame:
    """What ``choose_snapshots`` gives, from all that came out of the stream: the last choice of every request."""
    last_static = len(RENDER_BACKENDS if backends is None else backends) + 1
    last = choices.groupBy("request_key").agg(F.max("version").alias("version"))
    return choices.join(last, ["request_key", "version"]).select(
        "capture_id", "requested_url",
        F.when(F.col("rank") > last_static, F.col("requested_url")).otherwise(final_or_requested(F.col("final_url"), F.col("requested_url"))).alias("final_url"),
        "html", "renderer", (F.col("rank") >= last_static).alias("degraded"),
    )

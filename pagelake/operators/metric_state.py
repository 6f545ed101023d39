"""Metrics kept as states that add up: each batch of runs is summed once, and a report merges what is stored.

A state says of the values of one metric how many there are, their mean, the sum of squared distances from it (``m2``),
and the smallest and the largest. States of disjoint sets merge to the state of their union, in any order and grouping:

    n = sum of n_i,  mean = sum of n_i mean_i / n,  m2 = sum of m2_i + n_i (mean_i - mean)^2

The distances are taken from the merged mean, so nothing large cancels out. A batch is written under its own name
and overwrites only itself, so a batch that is run again counts once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.operators.metrics import MATCH_THRESHOLD, run_scores

STATE = ["n", "mean", "m2", "low", "high"]
#: Names of the scores in a report, and the columns of ``run_scores`` they come from.
SCORES = {"field_precision": "precision", "field_recall": "recall", "field_f1": "f1", "page_type_accuracy": "hit", "tp": "tp", "fp": "fp", "fn": "fn"}


def run_observations(aligned: DataFrame, keys: list[str], timings: str = "timings", threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """(metric, value) of every run: its scores and counts, and its seconds per stage as ``timing.<stage>``."""
    scores = run_scores(aligned, keys, threshold)
    named = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(c).cast("double").alias("value")) for name, c in SCORES.items()])
    times = aligned.select(F.explode(timings).alias("stage", "seconds")).select(F.concat(F.lit("timing."), "stage").alias("metric"), F.col("seconds").cast("double").alias("value"))
    return scores.select(F.inline(named)).unionByName(times)


def states_of(observations: DataFrame, by: list[str] | None = None) -> DataFrame:
    """States of observations (metric, value and the columns ``by``); NULL values are left out."""
    value = F.col("value")
    return observations.where("value is not null").groupBy(*(by or []), "metric").agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2"), F.min(value).alias("low"), F.max(value).alias("high"),
    )


def merged_states(states: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One state per metric, from any number of states of disjoint sets; the result may be merged again."""
    keys = [*(by or []), "metric"]
    total = states.groupBy(*[F.col(k).alias(f"of_{k}") for k in keys]).agg(F.sum("n").alias("all"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("centre"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys])
    apart = F.col("m2") + F.col("n") * (F.col("mean") - F.col("centre")) * (F.col("mean") - F.col("centre"))
    return states.join(total, same).groupBy(*keys).agg(
        F.first("all").alias("n"), F.first("centre").alias("mean"), F.sum(apart).alias("m2"), F.min("low").alias("low"), F.max("high").alias("high"),
    )


def summary_of(states: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(metric, n, mean, std, min, max) with the population deviation."""
    return states.select(*(by or []), "metric", "n", "mean", F.sqrt(F.col("m2") / F.col("n")).alias("std"), F.col("low").alias("min"), F.col("high").alias("max"))


def store_batch(observations: DataFrame, path: str, batch: str, by: list[str] | None = None) -> None:
    """Write a batch's states below ``path``; the same batch written again replaces itself."""
    states_of(observations, by).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def stored_states(spark: SparkSession, path: str, by: list[str] | None = None) -> DataFrame:
    """All stored batches merged."""
    return merged_states(spark.read.parquet(path), by)


def report_of(states: DataFrame) -> DataFrame:
    """The report as rows (metric, value): mean scores, and per stage the mean, deviation, smallest and largest."""
    summary = summary_of(states)
    timing = F.col("metric").startswith("timing.")
    shown = [name for name in SCORES if name not in ("tp", "fp", "fn")]
    scores = summary.where(F.col("metric").isin(shown)).select("metric", F.col("mean").alias("value"))
    parts = F.array(*[F.struct(F.concat_ws(".", "metric", F.lit(c)).alias("metric"), F.col(c).alias("value")) for c in ("mean", "std", "min", "max")])
    return scores.unionByName(summary.where(timing).select(F.inline(parts)))

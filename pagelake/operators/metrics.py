"""Quality and latency metrics of runs against gold data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions.similarity import best_match_mean, string_ratio
from pagelake.functions.text import strip
from pagelake.functions.urls import comparable_url
from pagelake.operators.extract import CELL, pick

# Similarity that counts as a hit, and the fields of the fuzzy score.
MATCH_THRESHOLD = 0.7
FUZZY_FIELDS = ["content", "title", "sub_comments"]


def latest_gold(gold: DataFrame) -> DataFrame:
    """One gold run (site, url, page_type, fields) per (site, url): the last loaded one, by file where there are several.

    One aggregate on the key that the join with the runs uses too, so the rows are dealt out once.
    """
    order = F.struct(*[c for c in ("file", "load_no") if c in gold.columns])
    last = gold.groupBy("site", "url").agg(F.max_by(F.struct("page_type", "fields"), order).alias("gold"))
    return last.select("site", "url", "gold.page_type", "gold.fields")


def align_with_gold(runs: DataFrame, gold: DataFrame) -> DataFrame:
    """Runs that have a gold run, with ``gold_page_type``, ``gold_fields`` and ``pred_fields``.

    The prediction is the first record of the run, an empty one if it has none.
    """
    keyed = latest_gold(gold).select(
        "site", "url", F.col("page_type").alias("gold_page_type"), F.col("fields").alias("gold_fields")
    )
    first = F.coalesce(F.get("records", F.lit(0)), F.array().cast(f"array<{CELL}>"))
    return runs.join(keyed, ["site", "url"]).withColumn("pred_fields", first)


def _list_counts(gold: Column, pred: Column) -> Column:
    """tp, fp, fn of two value sets; a gold set fully found counts every predicted value as right."""
    def counted(sets: Column) -> Column:
        shared = F.size(F.array_intersect(sets.g, sets.p))
        n_gold, n_pred = F.size(sets.g), F.size(sets.p)
        covered = (n_gold > 0) & (shared == n_gold)
        return F.struct(
            F.when(covered, n_pred).otherwise(shared).alias("tp"),
            F.when(covered, 0).otherwise(n_pred - shared).alias("fp"),
            F.when(covered, 0).otherwise(n_gold - shared).alias("fn"),
        )

    as_set = lambda xs: F.array_distinct(F.transform(xs, comparable_url))
    none = F.array().cast("array<string>")
    sets = F.struct(as_set(gold).alias("g"), as_set(F.coalesce(pred, none)).alias("p"))
    return F.get(F.transform(F.array(sets), counted), 0)


def _as_values(pred: Column) -> Column:
    """Values of a predicted cell to set against a gold list; a text counts by its characters."""
    return F.when(pred.kind == "list", pred.xs).when(pred.s != "", F.split(pred.s, ""))


def _outcome(tp: int | Column, fp: int | Column, fn: int | Column) -> Column:
    as_int = lambda v: (F.lit(v) if isinstance(v, int) else v).cast("int")
    return F.struct(as_int(tp).alias("tp"), as_int(fp).alias("fp"), as_int(fn).alias("fn"))


def field_outcomes(aligned: DataFrame, keys: list[str], threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """One row per run and gold field: keys, field, tp, fp, fn.

    Equality, emptiness, containment and lengths too different for the threshold are decided by Columns; only pairs
    they leave open carry text to the similarity function.
    """
    return _judged_pairs(aligned, keys, threshold).where(F.col("field").isNotNull()).select(*keys, "field", "o.*")


def _judged_pairs(aligned: DataFrame, keys: list[str], threshold: float, carried: list[str] = ()) -> DataFrame:
    """keys, carried columns, field and outcome; a run whose gold has no fields keeps one row without a field."""
    keys = [*keys, *carried]
    pairs = aligned.select(*keys, "pred_fields", F.explode_outer("gold_fields").alias("gold")).select(
        *keys, "gold", F.get(F.filter("pred_fields", lambda c: c.field == F.col("gold.field")), 0).alias("pred")
    )
    textual = F.col("gold.kind") == "str"
    trimmed = lambda name: F.when(textual, strip(F.col(f"{name}.s"))).otherwise(F.col(f"{name}.s"))
    pairs = pairs.select(
        *keys, "gold", "pred",
        F.coalesce(trimmed("gold"), F.when(F.col("gold.kind") == "null", "None"), F.lit("")).alias("g"),
        F.coalesce(trimmed("pred"), F.lit("")).alias("p"),
    )
    listed = F.col("gold.kind") == "list"
    contained = textual & (F.col("p").contains(F.col("g")) | F.col("g").contains(F.col("p")))
    is_open = ~listed & (F.col("p") != "") & ~contained & (F.col("g") != F.col("p"))
    # A ratio is at most twice the shorter length by both lengths.
    a, b = F.length("g"), F.length("p")
    undecided = is_open & (2.0 * F.least(a, b) / (a + b) >= threshold)
    scored = pairs.withColumn(
        "ratio", string_ratio(F.when(undecided, F.col("g")), F.when(undecided, F.col("p")))
    )
    outcome = (
        F.when(listed, _list_counts(F.col("gold.xs"), _as_values(F.col("pred"))))
        .when(textual & (F.col("g") == ""), _outcome(0, 0, 0))
        .when(F.col("p") == "", _outcome(0, 0, 1))
        .when(~is_open | F.coalesce(F.col("ratio") >= threshold, F.lit(False)), _outcome(1, 0, 0))
        .otherwise(_outcome(0, 1, 1))
    )
    outcome = F.when(F.col("gold").isNull(), _outcome(0, 0, 0)).otherwise(outcome)
    return scored.select(*keys, F.col("gold.field").alias("field"), outcome.alias("o"))


def precision_recall(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    precision = tp / F.greatest(tp + fp, F.lit(1))
    recall = tp / F.greatest(tp + fn, F.lit(1))
    f1 = F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
    return precision, recall, f1


def field_scores(aligned: DataFrame, keys: list[str], threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """Per run: tp, fp, fn, precision, recall, f1. Runs whose gold has no fields score zero."""
    sums = _judged_pairs(aligned, keys, threshold).groupBy(*keys).agg(*[F.sum(f"o.{c}").alias(c) for c in ("tp", "fp", "fn")])
    return _with_rates(sums)


def _with_rates(sums: DataFrame) -> DataFrame:
    precision, recall, f1 = precision_recall(F.col("tp"), F.col("fp"), F.col("fn"))
    return sums.withColumns({"precision": precision, "recall": recall}).withColumn("f1", f1)


def _items(c: Column, usable: Column) -> Column:
    """A list's values, or one trimmed text; NULL when the cell is not to be compared."""
    return F.when(usable & (c.kind == "list"), c.xs).when(usable & (c.kind == "str"), F.array(strip(c.s)))


def fuzzy_scores(aligned: DataFrame, keys: list[str]) -> DataFrame:
    """Per run the mean similarity over the fuzzy fields; 0.0 where none applies. No shuffle."""
    scores = []
    for field in FUZZY_FIELDS:
        gold, pred = pick(F.col("gold_fields"), field), pick(F.col("pred_fields"), field)
        same_kind = gold.kind == pred.kind
        scores.append(best_match_mean(_items(gold, same_kind), _items(pred, same_kind)))
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)
    scored = aligned.select(*keys, F.array(*scores).alias("scores"))
    applied = F.array_compact("scores")
    return scored.select(*keys, F.when(F.size(applied) > 0, mean(applied)).otherwise(0.0).alias("fuzzy"))


def page_type_accuracy(aligned: DataFrame, gold: str = "gold_page_type", pred: str = "page_type") -> DataFrame:
    hit = F.coalesce((F.col(gold) == F.col(pred)).cast("double"), F.lit(0.0))
    return aligned.agg(F.coalesce(F.avg(hit), F.lit(0.0)).alias("page_type_accuracy"))


def timing_summary(runs: DataFrame, timings: str = "timings") -> DataFrame:
    """Mean, population deviation, minimum and maximum per stage."""
    return runs.select(F.explode(timings).alias("stage", "seconds")).groupBy("stage").agg(
        F.avg("seconds").alias("mean"),
        F.stddev_pop("seconds").alias("std"),
        F.min("seconds").alias("min"),
        F.max("seconds").alias("max"),
    )


def run_scores(aligned: DataFrame, keys: list[str], threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """Per run its counts tp, fp and fn over all fields, the rates they give, and ``hit``: 1.0 where the page type is right."""
    hit = F.coalesce((F.col("gold_page_type") == F.col("page_type")).cast("double"), F.lit(0.0))
    pairs = _judged_pairs(aligned.withColumn("hit", hit), keys, threshold, ["hit"])
    per_run = pairs.groupBy(*keys).agg(*[F.sum(f"o.{c}").alias(c) for c in ("tp", "fp", "fn")], F.max("hit").alias("hit"))
    return _with_rates(per_run)


def macro_report(aligned: DataFrame, keys: list[str], threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """One row: mean field precision, recall and F1, and page type accuracy; 0.0 if empty. One pass over the runs."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return run_scores(aligned, keys, threshold).agg(
        mean("precision").alias("field_precision"), mean("recall").alias("field_recall"), mean("f1").alias("field_f1"),
        mean("hit").alias("page_type_accuracy"),
    )


def report_rows(aligned: DataFrame, keys: list[str], timings: str = "timings") -> DataFrame:
    """The whole report as rows (metric, value): scores, page type accuracy, and per stage the timing statistics."""
    macro = macro_report(aligned, keys)
    scores = macro.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in macro.columns])))
    stages = timing_summary(aligned, timings)
    times = stages.select(F.inline(F.array(*[
        F.struct(F.concat_ws(".", F.lit("timing"), F.col("stage"), F.lit(c)).alias("metric"), F.col(c).cast("double").alias("value")) for c in ("mean", "std", "min", "max")
    ])))
    return scores.unionByName(times)


def coverage(expected: Column, observed: Column) -> Column:
    """Share of expected fields that were observed, 0.0 when none is expected."""
    hits = F.size(F.filter(expected, lambda f: F.array_contains(observed, f)))
    return F.when(F.size(expected) > 0, hits / F.size(expected)).otherwise(0.0)


def _filled(c: Column) -> Column:
    return F.coalesce(F.when(c.kind == "list", F.size(c.xs) > 0).otherwise(c.s != ""), F.lit(False))


def non_empty_fields(records: Column, expected: Column) -> Column:
    """Number of expected fields with a value in the first record."""
    first = F.get(records, 0)
    has = lambda f: F.exists(first, lambda c: (c.field == f) & _filled(c))
    return F.coalesce(F.size(F.filter(expected, lambda f: F.coalesce(has(f), F.lit(False)))), F.lit(0))


def exact_match(expected_records: Column, records: Column) -> Column:
    """Whether the first expected record is met; a list is compared with the column of values."""

    def column_of(field: Column) -> Column:
        cells = F.flatten(F.transform(records, lambda r: F.filter(r, lambda c: (c.field == field) & _filled(c))))
        single_list = (F.size(cells) == 1) & (F.get(cells, 0).kind == "list")
        plain = F.when(F.forall(cells, lambda c: c.kind != "list"), F.transform(cells, lambda c: c.s))
        return F.when(single_list, F.get(cells, 0).xs).otherwise(plain)

    def met(want: Column) -> Column:
        got = F.get(F.filter(F.get(records, 0), lambda c: c.field == want.field), 0)
        return F.coalesce(
            F.when(want.kind == "list", column_of(want.field) == want.xs)
            .when(want.kind == "null", got.isNull() | (got.kind == "null"))
            .otherwise((got.kind == want.kind) & (got.s == want.s)),
            F.lit(False),
        )

    present = (F.size(expected_records) > 0) & (F.size(records) > 0)
    return F.when(F.coalesce(present, F.lit(False)), F.forall(F.get(expected_records, 0), met)).otherwise(False)


def run_summary(runs: DataFrame) -> DataFrame:
    """Total runs and the mean of each rate over the runs that carry it; NULL where none does."""
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return runs.agg(
        F.count("*").alias("total_runs"),
        rate("page_type_correct").alias("page_type_accuracy"),
        rate("intent_type_correct").alias("intent_type_accuracy"),
        rate("strategy_field_hit_rate").alias("strategy_field_hit_rate"),
        rate("extraction_exact_match").alias("extraction_exact_match_rate"),
    )

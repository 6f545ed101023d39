"""Queries over runs and gold data: field scores, similarity, accuracy, timings, experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.operators import metric_state, metrics
from pagelake.operators.experiments import attach_replies, cases_by_model, run_cases
from pagelake.operators.extract import CELL, cell
from pagelake.plans import corpora
from pagelake.plans.registry import query, sql_strip, sql_text
from pagelake.session import shared_folder

text = corpora.text


def _cell(field: str, kind: str, s: Column | None = None, xs: Column | None = None) -> Column:
    return cell(F.lit(field), kind, s, xs)


@query(
    "timing_summary",
    """SELECT event_type AS stage, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max
    FROM events GROUP BY 1""",
)
def timing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = corpora.table(spark, sf_dir, "events").select(F.create_map("event_type", "value").alias("timings"))
    summary = metrics.timing_summary(runs)
    return summary.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


def _gold_and_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Runs of documents and gold loaded twice: list and text fields, all decidable without similarity."""
    n = F.col("doc_id")
    title = text("Title ", n, " of ", F.col("lang"))
    url = lambda k: text("http://h/", n + k, "/")
    secure = lambda k: text("https://h/", n + k)
    documents = corpora.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    fields = F.array(
        _cell("title", "str", title), _cell("content", "str", F.when(n % 4 == 0, "").otherwise(F.col("text"))),
        _cell("links", "list", xs=F.array(url(0), url(1))), _cell("sub_comments", "list", xs=F.array(text("x", n), text("y", n))),
    )
    old = F.array(_cell("title", "str", F.lit("outdated")))
    gold = documents.filter(n % 7 != 0).select(
        F.col("source").alias("site"), text("u", n).alias("url"),
        F.inline(F.array(
            F.struct(n.alias("load_no"), F.lit("forum").alias("page_type"), old.alias("fields")),
            F.struct((n + 1_000_000_000).alias("load_no"), F.when(n % 3 == 0, "news").otherwise("list").alias("page_type"), fields.alias("fields")),
        )),
    )
    predicted = F.array(
        _cell("title", "str", F.when(n % 2 == 0, text(title, " | Site")).otherwise("%%%%")),
        _cell("content", "str", F.col("text")),
        _cell("links", "list", xs=F.when(n % 3 == 0, F.array(secure(1), secure(0), secure(2))).otherwise(F.array(secure(1), secure(5)))),
        _cell("sub_comments", "list", xs=F.array(text("x", n))),
    )
    none = F.array().cast(f"array<array<{CELL}>>")
    runs = documents.select(
        "doc_id", F.col("source").alias("site"), text("u", n).alias("url"), F.when(n % 5 == 0, "unknown").otherwise("news").alias("page_type"),
        F.when(n % 11 == 0, none).otherwise(F.array(predicted)).alias("records"),
    )
    return gold, runs


_GOLD = f"""
d AS (SELECT doc_id AS n, doc_id % 11 <> 0 AS has, {sql_strip('text')} AS body FROM documents WHERE doc_id % 7 <> 0),
o AS (SELECT n, CASE WHEN has AND n % 2 = 0 THEN [1, 0, 0] WHEN has THEN [0, 1, 1] ELSE [0, 0, 1] END AS title,
    CASE WHEN n % 4 = 0 OR body = '' THEN [0, 0, 0] WHEN has THEN [1, 0, 0] ELSE [0, 0, 1] END AS content,
    CASE WHEN NOT has THEN [0, 0, 2] WHEN n % 3 = 0 THEN [3, 0, 0] ELSE [1, 1, 1] END AS links,
    CASE WHEN has THEN [1, 0, 1] ELSE [0, 0, 2] END AS comments FROM d),
t AS (SELECT n, title[1] + content[1] + links[1] + comments[1] AS tp, title[2] + content[2] + links[2] + comments[2] AS fp,
    title[3] + content[3] + links[3] + comments[3] AS fn FROM o),
scores AS (SELECT n, tp, fp, fn, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r FROM t)"""


@query(
    "field_scores",
    f"""WITH {_GOLD} SELECT n AS doc_id, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(p, 6) AS precision,
      round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM scores""",
)
def field_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, runs = _gold_and_runs(spark, sf_dir)
    scores = metrics.field_scores(metrics.align_with_gold(runs, gold), ["doc_id"])
    return scores.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(
    "page_type_accuracy",
    """SELECT round(avg(CASE WHEN doc_id % 5 <> 0 AND doc_id % 3 = 0 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS page_type_accuracy
    FROM documents WHERE doc_id % 7 <> 0""",
)
def page_type_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, runs = _gold_and_runs(spark, sf_dir)
    accuracy = metrics.page_type_accuracy(metrics.align_with_gold(runs, gold))
    return accuracy.withColumn("page_type_accuracy", F.round("page_type_accuracy", 6))


@query(
    "label_accuracy",
    """SELECT round(avg(CASE WHEN (l.quality = 1) = (d.n_chars > 500) THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS page_type_accuracy
    FROM labels l JOIN documents d USING (doc_id)""",
)
def label_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, documents = (corpora.table(spark, sf_dir, t) for t in ("labels", "documents"))
    judged = labels.join(documents, "doc_id").select(
        F.when(F.col("quality") == 1, "good").otherwise("bad").alias("gold_page_type"),
        F.when(F.col("n_chars") > 500, "good").otherwise("bad").alias("page_type"),
    )
    return metrics.page_type_accuracy(judged).withColumn("page_type_accuracy", F.round("page_type_accuracy", 6))


_PAIRS_SQL = """WITH q AS (SELECT conv_id, turn, turn % 3 AS k FROM conversations)
  SELECT conv_id, turn, CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 0.25 ELSE 0.0 END::DOUBLE AS fuzzy FROM q"""


@query("fuzzy_exact", _PAIRS_SQL)
def fuzzy_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarities known without computing them: equal texts, and texts without a common character."""
    k, body = F.col("turn") % 3, text("a", F.col("text"))
    other = F.lit("☃")
    gold = F.array(_cell("title", "str", F.concat(body, F.lit(" "))), _cell("sub_comments", "list", xs=F.array(F.lit("ab"), F.lit("cd"))))
    pred = F.when(
        k == 0, F.array(_cell("title", "str", body), _cell("sub_comments", "list", xs=F.array(F.lit("cd"), F.lit("ab"))))
    ).when(k == 1, F.array(_cell("title", "str", other), _cell("sub_comments", "list", xs=F.array(F.lit("ab"), other)))).otherwise(
        F.array(_cell("sub_comments", "str", F.lit("ab")), _cell("title", "str", other)))
    turns = corpora.table(spark, sf_dir, "conversations")
    return metrics.fuzzy_scores(turns.select("conv_id", "turn", gold.alias("gold_fields"), pred.alias("pred_fields")), ["conv_id", "turn"])


@query("fuzzy_similarity")
def fuzzy_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against the next one of its conversation; DuckDB has no equal measure."""
    turns = corpora.table(spark, sf_dir, "conversations")
    later = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    pairs = turns.join(later, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.array(_cell("content", "str", F.col("text"))).alias("gold_fields"),
        F.array(_cell("content", "str", F.col("reply"))).alias("pred_fields"),
    )
    return metrics.fuzzy_scores(pairs, ["conv_id", "turn"])


@query(
    "macro_report",
    f"""WITH {_GOLD} SELECT round(avg(p), 6) AS field_precision, round(avg(r), 6) AS field_recall,
      round(avg(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END), 6) AS field_f1,
      round(avg(CASE WHEN n % 5 <> 0 AND n % 3 = 0 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS page_type_accuracy FROM scores""",
)
def macro_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, runs = _gold_and_runs(spark, sf_dir)
    report = metrics.macro_report(metrics.align_with_gold(runs, gold), ["doc_id"])
    names = ("field_precision", "field_recall", "field_f1", "page_type_accuracy")
    return report.select(*[F.round(c, 6).alias(c) for c in names])


_REPORT_SQL = f"""WITH {_GOLD}, m AS (SELECT round(avg(p), 6) AS field_precision, round(avg(r), 6) AS field_recall,
      round(avg(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END), 6) AS field_f1,
      round(avg(CASE WHEN n % 5 <> 0 AND n % 3 = 0 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS page_type_accuracy FROM scores),
    s AS (SELECT n % 3 AS k, (n % 17)::DOUBLE AS v FROM d)
    SELECT metric, value FROM (UNPIVOT m ON COLUMNS(*) INTO NAME metric VALUE value)
    UNION ALL SELECT 'timing.stage' || k || '.mean', round(avg(v), 6) FROM s GROUP BY k
    UNION ALL SELECT 'timing.stage' || k || '.std', round(stddev_pop(v), 6) FROM s GROUP BY k
    UNION ALL SELECT 'timing.stage' || k || '.min', min(v) FROM s GROUP BY k
    UNION ALL SELECT 'timing.stage' || k || '.max', max(v) FROM s GROUP BY k"""


def _timed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs next to their gold record, each with the seconds of one stage."""
    gold, runs = _gold_and_runs(spark, sf_dir)
    n = F.col("doc_id")
    return metrics.align_with_gold(runs.withColumn("timings", F.create_map(text("stage", n % 3), (n % 17).cast("double"))), gold)


@query("report_rows", _REPORT_SQL)
def whole_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.report_rows(_timed_runs(spark, sf_dir), ["doc_id"])
    return rows.withColumn("value", F.round("value", 6))


@query("merged_report", _REPORT_SQL)
def merged_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same report from states of four batches of runs, one of them written twice."""
    path, aligned = shared_folder(spark, "states"), _timed_runs(spark, sf_dir)
    for batch in (0, 1, 2, 3, 1):
        metric_state.store_batch(metric_state.run_observations(aligned.where(F.col("doc_id") % 4 == batch), ["doc_id"]), path, str(batch))
    return metric_state.report_of(metric_state.stored_states(spark, path)).withColumn("value", F.round("value", 6))


@query(
    "merged_timings",
    """SELECT event_type AS metric, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max
    FROM events GROUP BY 1""",
)
def merged_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds per stage from a state for each user and stage, merged in seven parts, and these again."""
    seen = corpora.table(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), "value", "user_id")
    by_user = metric_state.states_of(seen, ["user_id"]).withColumn("part", F.col("user_id") % 7).drop("user_id")
    summary = metric_state.summary_of(metric_state.merged_states(metric_state.merged_states(by_user, ["part"])))
    return summary.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


_H1 = sql_text("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")
_RUNS = f"""
r AS (SELECT page_id, m.model, page_id % 6 <> 0 AS ok, {_H1} AS h1, page_id % 4 = 0 AS expects, page_id % 3 = 0 AS right_title
  FROM pages, (SELECT unnest(['m1', 'm2']) AS model) m),
runs AS (SELECT page_id AS case_id, model, CASE WHEN ok THEN NULL ELSE 'fetch_failed' END AS error,
    CASE WHEN NOT ok THEN 'unknown' WHEN model = 'm1' THEN 'news' ELSE 'product' END AS page_type,
    CASE WHEN ok THEN 'extract_info' ELSE 'other' END AS intent_type, CASE WHEN ok THEN 1 ELSE 0 END AS records_returned,
    CASE WHEN ok THEN model = 'm1' ELSE false END AS page_type_correct,
    CASE WHEN NOT ok THEN 0.0 WHEN expects THEN 0.5 END AS strategy_field_hit_rate,
    CASE WHEN NOT ok THEN 0 WHEN expects THEN CASE WHEN h1 = '' THEN 0 ELSE 1 END END AS non_empty_fields,
    CASE WHEN NOT ok THEN false WHEN expects THEN right_title END AS extraction_exact_match FROM r)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("case_id")
    h1 = F.regexp_replace(F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1), "&amp;", "&")
    wanted = F.when(n % 3 == 0, h1).otherwise("something else")
    cases = corpora.pages(spark, sf_dir).withColumnRenamed("page_id", "case_id").select(
        "case_id", F.lit("site").alias("site"), "url", F.lit("get the title").alias("task"),
        F.when(n % 6 != 0, F.col("html")).alias("html"), F.lit(None).cast("string").alias("html_path"),
        F.create_map(F.lit("fetch"), F.lit(0.0)).alias("timings"), F.lit("detail").alias("expected_page_type"),
        F.lit(None).cast("string").alias("expected_intent_type"),
        F.when(n % 4 == 0, F.array(F.lit("title"), F.lit("unheard_of"))).alias("expected_fields"),
        F.when(n % 4 == 0, F.array(F.array(_cell("title", "str", wanted)))).alias("expected_records"),
    )
    by_model = cases_by_model(cases, ["m1", "m2"])
    replies = by_model.select(
        "case_id", "model", F.lit("page_type").alias("prompt_kind"), F.lit(1).alias("attempt"),
        F.when(F.col("model") == "m1", '{"page_type": "news", "confidence": 1}').otherwise('{"page_type": "product"}').alias("content"),
    )
    return run_cases(attach_replies(by_model, replies))


_EXPERIMENT_SQL = f"""WITH {_RUNS} SELECT case_id, model, error, page_type, intent_type, records_returned::BIGINT AS records_returned, page_type_correct,
      strategy_field_hit_rate::DOUBLE AS strategy_field_hit_rate, non_empty_fields::BIGINT AS non_empty_fields, extraction_exact_match FROM runs"""


@query("experiment_runs", _EXPERIMENT_SQL)
def experiment_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select(
        "case_id", "model", "error", "page_type", "intent_type", F.col("records_returned").cast("bigint").alias("records_returned"),
        "page_type_correct", "strategy_field_hit_rate", F.col("non_empty_fields").cast("bigint").alias("non_empty_fields"),
        "extraction_exact_match",
    )


@query(
    "expected_intents",
    """SELECT page_id AS case_id, CASE page_id % 4 WHEN 0 THEN 'crawl_list' WHEN 1 THEN 'other'
        ELSE CASE WHEN page_id % 3 = 0 THEN 'compare_price' WHEN page_id % 2 = 0 THEN 'crawl_list' ELSE 'extract_info' END END AS intent_type,
      CASE WHEN page_id % 4 < 2 THEN true END AS intent_type_correct, CASE WHEN page_id % 5 = 0 THEN 'title|price' ELSE 'title' END AS requested_fields
    FROM pages""",
)
def expected_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case's expected intent and fields override what its task and the model's reply say; empty and missing ones do not."""
    n = F.col("case_id")
    work = corpora.pages(spark, sf_dir).withColumnRenamed("page_id", "case_id").select(
        "case_id", F.lit("m").alias("model"), F.lit("site").alias("site"), "url", F.when(n % 2 == 0, "get the list of titles").otherwise("get the title").alias("task"),
        "html", F.lit(None).cast("string").alias("html_path"), F.create_map(F.lit("fetch"), F.lit(0.0)).alias("timings"), F.lit(None).cast("string").alias("expected_page_type"),
        F.when(n % 4 == 0, "CRAWL_LIST").when(n % 4 == 1, "nonsense").when(n % 4 == 2, "").alias("expected_intent_type"),
        F.when(n % 5 == 0, F.array(F.lit("title"), F.lit("price"))).when(n % 5 == 1, F.array().cast("array<string>")).alias("expected_fields"),
        F.lit(None).cast(f"array<array<{CELL}>>").alias("expected_records"),
        F.lit('{"page_type": "news"}').alias("typing_reply"), F.when(n % 3 == 0, '{"intent_type": "compare_price"}').alias("intent_reply"),
        F.lit(None).cast("string").alias("strategy_reply"), F.array().cast("array<struct<attempt:int,content:string>>").alias("image_replies"),
    )
    return run_cases(work).select("case_id", "intent_type", "intent_type_correct", F.array_join("requested_fields", "|").alias("requested_fields"))


_SUMMARY_SQL = f"""WITH {_RUNS} SELECT count(*) AS total_runs, round(avg(page_type_correct::INT), 6) AS page_type_accuracy,
      round(avg(CASE WHEN error IS NULL THEN NULL ELSE 0.0 END), 6) AS intent_type_accuracy,
      round(avg(strategy_field_hit_rate), 6)::DOUBLE AS strategy_field_hit_rate,
      round(avg(extraction_exact_match::INT), 6) AS extraction_exact_match_rate FROM runs"""


@query("run_summary", _SUMMARY_SQL)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = metrics.run_summary(_runs(spark, sf_dir))
    return summary.select("total_runs", *[F.round(c, 6).alias(c) for c in summary.columns if c != "total_runs"])


_RATES = f"""
w AS (SELECT doc_id AS n, {sql_strip('text')} = '' AS blank FROM documents),
rates AS (SELECT n, CASE WHEN n % 7 = 0 THEN 0.0 ELSE 2.0 / 3 END AS hit_rate,
    CASE WHEN n % 5 = 0 THEN 0 ELSE 1 + CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END END AS filled,
    n % 5 <> 0 AND n % 3 = 0 AS matched FROM w)"""


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    record = F.array(
        _cell("title", "str", text("T", n)), _cell("links", "list", xs=F.when(n % 2 == 0, F.array(text("l", n))).otherwise(F.array())),
    )
    records = F.when(n % 5 != 0, F.array(record)).otherwise(F.array().cast(f"array<array<{CELL}>>"))
    links = F.when(n % 2 == 0, F.array(text("l", n))).otherwise(F.array().cast("array<string>"))
    expected = F.array(F.array(
        _cell("title", "str", F.when(n % 3 == 0, text("T", n)).otherwise("other")), _cell("links", "list", xs=links),
    ))
    fields = [F.lit(f) for f in ("title", "links", "price")]
    wanted = F.when(n % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(*fields))
    return corpora.table(spark, sf_dir, "documents").select(
        "doc_id", metrics.coverage(wanted, F.array(*fields[:2])).alias("strategy_field_hit_rate"),
        metrics.non_empty_fields(records, F.array(*fields)).alias("non_empty_fields"),
        metrics.exact_match(expected, records).alias("extraction_exact_match"),
        F.when(n % 4 == 0, n % 8 == 0).alias("page_type_correct"), F.lit(None).cast("boolean").alias("intent_type_correct"),
    )


@query(
    "run_rates",
    f"""WITH {_RATES} SELECT n AS doc_id, round(hit_rate, 6)::DOUBLE AS strategy_field_hit_rate, filled::BIGINT AS non_empty_fields,
      matched AS extraction_exact_match FROM rates""",
)
def run_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir).select(
        "doc_id", F.round("strategy_field_hit_rate", 6).alias("strategy_field_hit_rate"),
        F.col("non_empty_fields").cast("bigint").alias("non_empty_fields"), "extraction_exact_match",
    )


@query(
    "rate_summary",
    f"""WITH {_RATES} SELECT count(*) AS total_runs, round(avg(CASE WHEN n % 4 = 0 THEN (n % 8 = 0)::INT END), 6) AS page_type_accuracy,
      NULL::DOUBLE AS intent_type_accuracy, round(avg(hit_rate), 6)::DOUBLE AS strategy_field_hit_rate,
      round(avg(matched::INT), 6) AS extraction_exact_match_rate FROM rates""",
)
def rate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = metrics.run_summary(_measured(spark, sf_dir))
    return summary.select("total_runs", *[F.round(c, 6).alias(c) for c in summary.columns if c != "total_runs"])

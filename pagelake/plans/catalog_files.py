"""Queries that write files and read them back: case, gold and run files, published records, run documents and replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.operators import metrics, prompt_store
from pagelake.operators.extract import extract_fields
from pagelake.operators.publish import publish_csv, publish_json, publish_run_document, publish_text, published
from pagelake.plans import corpora
from pagelake.plans.catalog_metrics import _RATES, _measured
from pagelake.plans.catalog_pages import _EXTRACTED, _FIELDS
from pagelake.plans.registry import query
from pagelake.session import shared_folder
from pagelake.sources.cases import load_cases, load_gold, load_runs
from pagelake.sources.html import parse_html

#: Entries of a file, so that each stays small whatever the table.
PER_FILE = 100


def _written(spark: SparkSession, sf_dir: str, entry: Column, document) -> str:
    """JSON files of documents' entries, each made by ``document`` from an array of them; a folder a file."""
    part = F.expr(f"doc_id div {PER_FILE}").alias("part")
    rows = corpora.table(spark, sf_dir, "documents").select(part, F.struct("doc_id", entry.alias("entry")).alias("e"))
    files = rows.groupBy("part").agg(F.array_sort(F.collect_list("e")).alias("es")).select("part", document(F.col("es.entry")).alias("value"))
    path = shared_folder(spark, "files")
    files.write.partitionBy("part").text(path)
    return path


@query(
    "loaded_cases",
    """SELECT 'http://c/' || doc_id AS url, source AS site, substr(text, 1, 40) AS task, 'title|lang' AS expected_fields,
      CASE doc_id % 3 WHEN 0 THEN 'pages/' || doc_id || '.html' WHEN 1 THEN '/abs/' || doc_id || '.html' END AS html_path FROM documents""",
)
def loaded_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case files; a relative page path comes back below the file's folder."""
    n = F.col("doc_id")
    entry = F.struct(
        F.col("source").alias("site"), corpora.text("http://c/", n).alias("url"), F.substring("text", 1, 40).alias("task"),
        F.array(F.lit("title"), F.lit("lang")).alias("expected_fields"),
        F.when(n % 3 == 0, corpora.text("pages/", n, ".html")).when(n % 3 == 1, corpora.text("/abs/", n, ".html")).alias("html_path"),
    )
    path = _written(spark, sf_dir, entry, F.to_json)
    below = F.regexp_extract("html_path", r"/part=\d+/(pages/.*)$", 1)
    return load_cases(spark, path).select("url", "site", "task", F.array_join("expected_fields", "|").alias("expected_fields"), F.when(below != "", below).otherwise(F.col("html_path")).alias("html_path"))


@query(
    "loaded_gold",
    """WITH d AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'news' ELSE 'forum' END AS page_type FROM documents)
    SELECT 'http://g/' || doc_id AS url, page_type, 'title' AS field, 'str' AS kind, substr(text, 1, 30) AS value FROM d
    UNION ALL SELECT 'http://g/' || doc_id, page_type, 'links', 'list', 'l' || doc_id || '|' || lang FROM d
    UNION ALL SELECT 'http://g/' || doc_id, page_type, 'count', 'other', doc_id::VARCHAR FROM d""",
)
def loaded_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    fields = F.struct(F.substring("text", 1, 30).alias("title"), F.array(corpora.text("l", n), F.col("lang")).alias("links"), n.alias("count"))
    entry = F.struct(F.col("source").alias("site"), corpora.text("http://g/", n).alias("url"), F.when(n % 2 == 0, "news").otherwise("forum").alias("page_type"), fields.alias("fields"))
    path = _written(spark, sf_dir, entry, lambda entries: F.to_json(F.struct(entries.alias("runs"))))
    cells = load_gold(spark, path).select("url", "page_type", F.explode("fields").alias("c"))
    return cells.select("url", "page_type", "c.field", "c.kind", F.coalesce(F.array_join("c.xs", "|"), F.col("c.s")).alias("value"))


@query(
    "loaded_runs",
    """SELECT 'http://r/' || doc_id AS url, 'm' || doc_id % 2 AS model, 'news' AS page_type, (doc_id % 7)::DOUBLE / 2 AS seconds, substr(text, 1, 30) AS title FROM documents""",
)
def loaded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    measured = F.struct(F.lit("news").alias("page_type"), F.lit("list").alias("intent_type"), F.struct(((n % 7) / F.lit(2.0)).alias("fetch")).alias("timings"))
    entry = F.struct(
        F.col("source").alias("site"), corpora.text("http://r/", n).alias("url"), F.lit("t").alias("task"), corpora.text("m", n % 2).alias("model"), measured.alias("metrics"),
        F.array(F.struct(F.substring("text", 1, 30).alias("title"))).alias("records"),
    )
    path = _written(spark, sf_dir, entry, lambda entries: F.to_json(F.struct(entries.alias("runs"))))
    return load_runs(spark, path).select("url", "model", "page_type", F.col("timings")["fetch"].alias("seconds"), F.col("records")[0][0].s.alias("title"))


@query(
    "published_records",
    f"""WITH x AS ({_EXTRACTED}) SELECT 'json' AS kind, title, array_to_string(links, '|') AS links, lang FROM x
    UNION ALL SELECT 'text', title, array_to_string(links, '|'), lang FROM x UNION ALL SELECT 'csv', title, to_json(links)::VARCHAR, lang FROM x""",
)
def published_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as JSON, as JSON lines and as CSV, each published and read back; a second attempt for the run changes nothing."""
    names = ["title", "links", "lang"]
    records = extract_fields(parse_html(corpora.pages(spark, sf_dir)), [f for f in _FIELDS if f[0] in names])
    folder = shared_folder(spark, "published")
    for _ in range(2):
        publish_json(records, f"{folder}/json", "run", names)
        publish_text(records, f"{folder}/text", "run")
        publish_csv(records, f"{folder}/csv", "run", ["page_id"], names)
    schema = "title string, links array<string>, lang string"
    read = [spark.read.schema(schema).json(published(spark, f"{folder}/{kind}")).select(F.lit(kind).alias("kind"), "title", F.array_join("links", "|").alias("links"), "lang") for kind in ("json", "text")]
    csv = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(published(spark, f"{folder}/csv"))
    return read[0].unionAll(read[1]).unionAll(csv.select(F.lit("csv").alias("kind"), *[F.coalesce(n, F.lit("")).alias(n) for n in names]))


@query(
    "published_run_document",
    f"""WITH {_RATES} SELECT n AS doc_id, round(hit_rate, 6)::DOUBLE AS hit_rate, (SELECT count(*) FROM rates) AS total_runs,
      (SELECT round(avg(hit_rate), 6) FROM rates)::DOUBLE AS mean_hit_rate FROM rates""",
)
def published_run_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs next to the summary that was published with them."""
    runs, folder = _measured(spark, sf_dir), shared_folder(spark, "document")
    publish_run_document(runs, metrics.run_summary(runs), folder, "run")
    path = published(spark, folder)
    summary = spark.read.schema("total_runs long, strategy_field_hit_rate double").json(f"{path}/summary")
    read = spark.read.schema("doc_id long, strategy_field_hit_rate double").json(f"{path}/runs")
    whole = summary.select("total_runs", F.round("strategy_field_hit_rate", 6).alias("mean_hit_rate")).first()
    return read.select("doc_id", F.round("strategy_field_hit_rate", 6).alias("hit_rate"), F.lit(whole.total_runs).alias("total_runs"), F.lit(whole.mean_hit_rate).alias("mean_hit_rate"))


_PROMPTS = """prompts AS (SELECT doc_id, 'Kind of ' || source || ' in ' || lang || ' of ' || (length(text) // 500) AS content FROM documents),
keyed AS (SELECT *, sha256('9' || chr(10) || 'page_type' || chr(10) || content) AS prompt_key FROM prompts)"""


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts that many documents share, as their text depends on source, language and size alone."""
    content = corpora.text("Kind of ", F.col("source"), " in ", F.col("lang"), " of ", F.expr("length(text) div 500"))
    return corpora.table(spark, sf_dir, "documents").select("doc_id", F.lit("page_type").alias("prompt_kind"), content.alias("content"))


@query("prompt_worklist", f"WITH {_PROMPTS} SELECT DISTINCT prompt_key, content, 1 AS attempt FROM keyed WHERE content NOT LIKE '% in en %'")
def prompt_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct prompts without a stored reply, after a batch for one language was stored twice."""
    path, prompts = shared_folder(spark, "replies"), _prompts(spark, sf_dir)
    work = prompt_store.to_ask(prompts, prompt_store.stored_replies(spark, path)).where(F.col("content").contains(" in en "))
    for _ in range(2):
        prompt_store.store_replies(work.withColumn("content", F.concat(F.lit("reply: "), "content")), path, "en")
    return prompt_store.to_ask(prompts, prompt_store.stored_replies(spark, path)).select("prompt_key", "content", "attempt")


@query(
    "prompt_answers",
    f"""WITH {_PROMPTS}
    SELECT doc_id, prompt_key, CASE WHEN ascii(prompt_key) % 2 = 0 THEN 'reply: ' || content END AS reply FROM keyed""",
)
def prompt_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the reply to its prompt, which was asked once for all that share it."""
    path, prompts = shared_folder(spark, "replies"), _prompts(spark, sf_dir)
    work = prompt_store.to_ask(prompts, prompt_store.stored_replies(spark, path))
    said = F.when(F.ascii("prompt_key") % 2 == 0, F.concat(F.lit("reply: "), "content")).otherwise(" ")
    prompt_store.store_replies(work.withColumn("content", said), path, "all")
    return prompt_store.answered(prompts, prompt_store.stored_replies(spark, path)).select("doc_id", "prompt_key", "reply")

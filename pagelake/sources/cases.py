"""Experiment cases, gold runs and predicted runs from JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.functions.lenient_json import kind_of, text_of
from pagelake.operators.extract import cell

CASE_SCHEMA = (
    "site string, url string, task string, expected_page_type string, expected_intent_type string, "
    "expected_fields array<string>, expected_records array<variant>, html_path string"
)
GOLD_SCHEMA = "runs array<struct<site:string,url:string,page_type:string,fields:variant>>"
RUN_SCHEMA = (
    "runs array<struct<site:string,url:string,task:string,model:string,"
    "metrics:struct<page_type:string,intent_type:string,timings:map<string,double>>,records:array<variant>>>"
)


def cells_of(fields: Column) -> Column:
    """JSON object of fields as an array of cells; scalars other than text become kind ``other``."""

    def one(entry: Column) -> Column:
        value = entry["value"]
        kind = kind_of(value)
        # A null in a list is compared as its Python text.
        items = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v: F.coalesce(text_of(v), F.lit("None")))
        return (
            F.when(kind == "array", cell(entry.key, "list", xs=items))
            .when(kind == "null", cell(entry.key, "null"))
            .when(kind == "string", cell(entry.key, "str", text_of(value)))
            .otherwise(cell(entry.key, "other", F.coalesce(text_of(value), F.to_json(value))))
        )

    return F.transform(F.map_entries(F.try_variant_get(fields, "$", "map<string,variant>")), one)


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases from a JSON array; a relative ``html_path`` is taken from the file's folder."""
    cases = spark.read.schema(CASE_SCHEMA).option("multiLine", True).json(path)
    folder = F.regexp_replace(F.col("_metadata.file_path"), r"^file:(?=/)|[^/]*$", "")
    absolute = F.when(
        F.col("html_path").isNull() | F.col("html_path").rlike(r"^(/|\w+:/)"), F.col("html_path")
    ).otherwise(F.concat(folder, F.col("html_path")))
    return cases.select("*", absolute.alias("_path")).drop("html_path").withColumnRenamed("_path", "html_path")


def load_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold runs (file, load_no, site, url, page_type, fields); load_no keeps the order within a file."""
    document = spark.read.schema(GOLD_SCHEMA).option("multiLine", True).json(path)
    runs = document.select(F.col("_metadata.file_path").alias("file"), F.posexplode("runs").alias("load_no", "r"))
    return runs.select("file", "load_no", "r.site", "r.url", "r.page_type", cells_of(F.col("r.fields")).alias("fields"))


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    """Predicted runs (run_no, site, url, task, model, page_type, timings, records)."""
    document = spark.read.schema(RUN_SCHEMA).option("multiLine", True).json(path)
    runs = document.select(F.posexplode("runs").alias("run_no", "r"))
    return runs.select(
        "run_no", "r.site", "r.url", "r.task", "r.model", "r.metrics.page_type", "r.metrics.timings",
        F.transform("r.records", cells_of).alias("records"),
    )

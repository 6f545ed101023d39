"""op7: licenses named in every document."""

from pyspark.sql import functions as F

from pagelake.llm.license_scan import CONFIDENCE, scanned
from pagelake.llm.registry import query, table


@query("op7_license_scan")
def license_scan(spark, sf_dir):
    rows = scanned(table(spark, sf_dir, "documents"))
    best = F.array_max(F.transform("detections", lambda d: d["priority"]))
    confidence = F.lit(0.0)
    for priority, value in CONFIDENCE.items():
        confidence = F.when(best == priority, value).otherwise(confidence)
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    base = F.transform("base", lambda b: b["label"])
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["start"])).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.transform("detections", lambda d: d["label"]))).alias("labels"),
        confidence.alias("score"),
    )

"""op4: the quality of every document."""

from pyspark.sql import functions as F

from pagelake.llm.holdout import held_out
from pagelake.llm.line_quality import THRESHOLD, learned_line_model, scored
from pagelake.llm.registry import query, table


@query("op4_quality_classifier")
def quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = scored(docs, learned_line_model(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))

"""op2: personal data in every document."""

from pyspark.sql import functions as F

from pagelake.llm.personal_data import BASE_KINDS, found_personal_data
from pagelake.llm.registry import query, table


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counted(spans, kind):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


@query("op2_personal_data")
def personal_data(spark, sf_dir):
    rows = found_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    return rows.select(
        "doc_id", *[counted(base, k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )

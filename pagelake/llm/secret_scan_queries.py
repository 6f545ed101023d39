"""op8: secrets in every document."""

from pyspark.sql import functions as F

from pagelake.llm.registry import query, table
from pagelake.llm.secret_scan import found_secrets, learned_network


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counted(spans, kind):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


@query("op8_secret_scan")
def secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = found_secrets(docs, learned_network(docs))
    base = F.filter("spans", lambda s: s["base"])
    return rows.select(
        "doc_id", *[counted(base, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )

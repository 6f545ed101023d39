"""op6: the language of every document."""

from pagelake.llm.holdout import held_out
from pagelake.llm.language import identified, learned_model
from pagelake.llm.registry import query, table


@query("op6_language_id")
def language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return identified(docs, learned_model(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages")

"""op3: quality rules over every document."""

from pagelake.llm.quality_rules import judged
from pagelake.llm.registry import query, table


@query("op3_quality_rules")
def quality_rules(spark, sf_dir):
    rows = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "bound")

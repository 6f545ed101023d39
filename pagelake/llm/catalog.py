"""All queries of this subpackage."""

from pagelake.llm import (  # noqa: F401
    collocations_queries,
    decontamination_queries,
    exact_copies_queries,
    language_queries,
    license_scan_queries,
    line_quality_queries,
    mixing_queries,
    ngram_join_queries,
    personal_data_queries,
    quality_rules_queries,
    ranked_search_queries,
    secret_scan_queries,
    token_files_queries,
)
from pagelake.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

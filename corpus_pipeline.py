"""Training corpus from ``documents``: stages that each take all rows the one before kept.

``run`` writes each stage's result below the shared folder and reads it again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm.decontamination import clean_documents
from pagelake.llm.language import UNKNOWN, identified, learned_model
from pagelake.llm.mixing import mixed_single_source
from pagelake.llm.ngram_join import one_per_component
from pagelake.llm.registry import table
from pagelake.llm.token_files import token_digest
from pagelake.session import remove_folder, write_through

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes where not even this share of its words is of its main language.
MIN_LANGUAGE_SHARE = 0.3
TOKENIZER = "word_bpe_49k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those of no main language. ``lang`` stays as it came."""
    rows = identified(docs, learned_model(docs), keep=[c for c in COLUMNS if c not in ("doc_id", "text")], keep_text=True)
    return rows.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SHARE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of similar documents the one with the smallest id; texts without words all stay."""
    return one_per_component(docs).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item of ``benchmark``."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: twice, once, or not at all."""
    taken = mixed_single_source(docs, keep=[c for c in COLUMNS if c != "doc_id"])
    return taken.where("repeats > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token-id files and describes every document as read back from them."""
    return token_digest(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language ID", language_id), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed), ("token-ID / binary output", token_ids),
]

#: Language identification is a learned model and token files are binary: SQL cannot say either.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, used = table(spark, sf_dir, "documents"), []
    for position, (_, stage) in enumerate(STAGES[:-1]):
        docs = write_through(stage(spark, docs, sf_dir), f"stage{position}", written := [])
        for folder in used:
            remove_folder(spark, folder)
        used = written
    return STAGES[-1][1](spark, docs, sf_dir)

"""Exact duplicates by a tree-merge of sorted digest runs, in DataFrame functions only.

Texts are equal when they are identical without the characters 0x20 and 0x09-0x0D. Of equal texts the row with
the most code points in its own text stays, then the one with the smallest id.

1. Every row becomes a narrow entry: 64-bit sort key, SHA-256 and byte count of its normalised text, length, id. The
   entries are written once with the number of the scan partition, which is the number of their *run*.
2. Rounds merge runs whose numbers agree without their lowest ``bits`` bits, so a binomial tree folds ``bits`` of its
   levels into one multiway merge. A round is one sort-based aggregation: a task sorts what it holds by (run, sort
   key, digest) and merges equal neighbours before anything is exchanged, and again after. Entries with one sort key
   are equal only if digest and byte count say so; of those the best row and the number of rows go on. After
   ``log(runs) / bits`` rounds one entry is left for every text.
3. The way back goes through the runs: the texts that occur twice or more meet each run's entry of them, and
   these meet the rows. A text that a third of all rows share is one entry per run in the first of these joins and a
   third of one run in the second.

Texts are never shuffled, and no step holds more than one entry of a group at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.session import write_through

WHITE = r"[\x20\x09-\x0D]"
BITS = 3
ENTRY = ["head", "digest", "bytes"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def sha256(text: Column) -> Column:
    """Lowercase hex SHA-256 of the normalised text in UTF-8."""
    return F.sha2(normalised(text).cast("binary"), 256)


def _entries(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    normal = F.col("normal")
    return (
        docs.select(F.col(doc_id).alias("id"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("chars"), normalised(F.col(text)).alias("normal"))
        .select(
            "id", "chars", F.xxhash64(normal).alias("head"), F.unhex(F.sha2(normal.cast("binary"), 256)).alias("digest"),
            F.octet_length(normal).alias("bytes"), F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("row"),
        )
    )


def _best() -> Column:
    """Smaller is better: more code points, then the smaller id (rows without one last), then the row read first."""
    return F.struct((-F.col("chars")).alias("rank"), F.col("id").isNull().alias("no_id"), "id", "row")


def merged_runs(rows: DataFrame, runs: int, bits: int = BITS) -> DataFrame:
    """(head, digest, bytes, best, n): one entry for every text, from rows of ``runs`` runs."""
    level = rows.select("run", *ENTRY, _best().alias("best"), F.lit(1).cast("long").alias("n"))
    while True:
        level = level.groupBy(F.shiftright("run", bits).alias("run"), *ENTRY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        runs = -(-runs >> bits) if runs > 1 else 1
        if runs <= 1:
            return level.drop("run")


def exact_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """One row per input row: doc_id, keep_id (id of the row that stays), group_size, kept, text_sha256.

    A null text counts as empty; texts of white space alone equal the empty text. Of repeated rows (same id, same text)
    exactly one stays. A row without an id stays only where no row of its group has one, or it is longer; keep_id
    is then null. Texts of any length are read whole. An empty table gives no rows; columns other than the two named are
    not read, whatever their names. An action: the narrow entries are written below the shared folder.
    """
    rows = write_through(_entries(docs, doc_id, text), "digests")
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    repeated = merged_runs(rows, runs, bits).where("n > 1")
    # A run holds a text once, however many of its rows do.
    of_run = rows.groupBy("run", *ENTRY).agg(F.count("*").alias("in_run")).drop("in_run")
    settled = of_run.join(repeated, ENTRY)
    best = F.col("best")
    return rows.join(settled, ["run", *ENTRY], "left").select(
        F.col("id").alias("doc_id"),
        F.when(best.isNull(), F.col("id")).otherwise(best.id).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(best.row == F.col("row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def one_per_text(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """The rows that stay, with the columns they came with."""
    kept = write_through(exact_copies(docs, doc_id=doc_id, text=text, bits=bits).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")), "kept")
    held = F.struct(*[docs[c] for c in docs.columns])
    found = docs.select(held.alias("__row"), docs[doc_id].alias("__doc"), sha256(docs[text]).alias("__of"), F.length(docs[text]).alias("__chars")).join(
        kept, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__of") == F.col("__sha")), "left_semi"
    )
    # Rows of one id and one text may come several times; the longest of them stays.
    chosen = found.groupBy("__doc", "__of").agg(F.max_by("__row", F.coalesce("__chars", F.lit(0))).alias("__row"))
    return chosen.select("__row.*")

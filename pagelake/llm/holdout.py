"""The held-out fold of documents, and bounded seeded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS, HELD_OUT = 4, 2


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32(doc_id as text) mod 4 is 2; a row without an id is not held out, but never learned from either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def bounded_sample(rows: DataFrame, label: str, per_label: int, total: int, doc_id: str = "doc_id", seed: int = 11) -> DataFrame:
    """About ``per_label`` rows of each label, at most about ``total`` in all, drawn by a seeded hash of the id.

    Only the labels' counts reach the driver; the draw is a filter on the scan.
    """
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return rows.limit(0)
    wanted = min(per_label, max(1, total // len(counts)))
    place = F.pmod(F.xxhash64(F.col(doc_id), F.lit(seed)), F.lit(1_000_000))
    share = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(int(min(1.0, wanted / n) * 1_000_000)))))
    return rows.where(place < share[F.col(label)])

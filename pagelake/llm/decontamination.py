"""Benchmark decontamination: short test items found inside documents of any length.

Containment of an item in a document is the share of the item's distinct word shingles that the document
has too. An item is found where that share reaches ``threshold``.

* The items are partitioned by size, their number of distinct shingles. Each item keeps a bottom-k MinHash
  sketch: its k smallest shingle hashes, k set per size partition.
* Every shingle of every document is looked up among the sketches (the containment form of MinHash: the share
  of an item's sketch that a document has estimates the item's containment). An item of n shingles that is
  contained lacks at most ``n - ceil(threshold * n)`` of them, so a document that holds it has at least
  ``k - lacking`` of its sketch. k is above ``lacking`` in every partition, so no item is missed.
* Candidates are verified by exact shingle containment with the item's whole set.

Items are taken in blocks of a bounded number of shingles; only one block at a time is sent to the executors,
so memory stays bounded however many test items there are. The documents are read once per block, and nothing
is shuffled. Items of fewer words than ``size`` are one shingle made of all their words, looked up among the
documents' word runs of the same length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.shingles import hashed_words, shingled
from pagelake.session import write_through

SIZE, PERCENT = 5, 75
BLOCK_SHINGLES = 2_000_000
#: Item sizes up to which a partition reaches, and the sketch's share of the items in it.
PARTITIONS = ((8, 1.0), (32, 0.75), (128, 0.5))
BEYOND = 0.35


def sketch_size(n: int, percent: int) -> int:
    """k of the size partition of an item of ``n`` shingles; always above the number that may be lacking."""
    lacking = n - -(-percent * n // 100)
    share = next((s for most, s in PARTITIONS if n <= most), BEYOND)
    return min(n, max(lacking + 1, int(np.ceil(share * n))))


class ItemIndex:
    """Sketches and whole sets of one block of items, as sorted arrays."""

    def __init__(self, ids: list, texts: list, size: int, percent: int):
        self.ids, self.size, self.percent = ids, size, percent
        lengths, hashes, owners, in_sketch = [], [], [], []
        self.counts = np.zeros(len(ids), np.int64)
        self.word_counts = np.zeros(len(ids), np.int64)
        for first, stop, words, bounds in hashed_words(pa.array(texts, pa.string())):
            grams, edges = shingled(words, bounds, size)
            for row in range(first, stop):
                n_words = int(bounds[row - first + 1] - bounds[row - first])
                own = np.unique(grams[edges[row - first] : edges[row - first + 1]])
                self.word_counts[row] = n_words
                self.counts[row] = len(own)
                if len(own):
                    hashes.append(own)
                    owners.append(np.full(len(own), row))
                    lengths.append(np.full(len(own), min(n_words, size)))
                    in_sketch.append(np.arange(len(own)) < sketch_size(len(own), percent))
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        hash_, owner, length, sketch = join(hashes, np.uint64), join(owners, np.int64), join(lengths, np.int64), join(in_sketch, bool)
        self.lacking = self.counts - -(-percent * self.counts // 100)
        self.needed = np.array([sketch_size(int(n), percent) if n else 1 for n in self.counts]) - self.lacking
        self.by_length = {}
        for k in np.unique(length):
            of = length == k
            tables = []
            for part in (of & sketch, of):
                order = np.lexsort((owner[part], hash_[part]))
                tables.append((hash_[part][order], owner[part][order]))
            # A bit per hash prefix turns away nearly all document shingles before the search.
            bits = max(16, int(np.ceil(np.log2(len(tables[0][0]) + 1))) + 6)
            seen = np.zeros(1 << bits, bool)
            seen[(tables[0][0] >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.by_length[int(k)] = (seen, np.uint64(64 - bits), *tables)


def _matches(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, item) of every equal hash."""
    keys, owners = table
    low, high = np.searchsorted(keys, hashes, "left"), np.searchsorted(keys, hashes, "right")
    times = high - low
    at = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
    return np.repeat(rows, times), owners[at]


def _counted(rows: np.ndarray, items: np.ndarray, n_items: int) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.unique(rows * n_items + items, return_counts=True)
    return keys, counts


def find_items(index: ItemIndex, texts: pa.Array) -> Iterator[tuple[int, int, int]]:
    """(row, item, shared shingles) of the items contained in the texts."""
    n_items = len(index.ids)
    for first, stop, words, bounds in hashed_words(texts):
        for length, (seen, shift, sketches, whole) in index.by_length.items():
            if length == index.size:
                grams, edges = shingled(words, bounds, index.size)
                counts = np.diff(edges)
                if len(grams):
                    # Texts shorter than a shingle have one of their own kind, which only short items can equal.
                    long_enough = np.repeat(np.diff(bounds) >= index.size, counts)
                    rows = np.repeat(np.arange(stop - first), counts)[long_enough]
                    grams = grams[long_enough]
            else:
                grams, rows = _short_runs(words, bounds, length, index.size)
            if not len(grams):
                continue
            hit = np.flatnonzero(seen[(grams >> shift).astype(np.int64)])
            row, item = _matches(sketches, grams[hit], rows[hit])
            if not len(row):
                continue
            # Distinct shingles: a document that repeats one counts it once.
            pair_rows, hashes = _distinct(rows[hit], grams[hit])
            row, item = _matches(sketches, hashes, pair_rows)
            keys, found = _counted(row, item, n_items)
            keys = keys[found >= index.needed[keys % n_items]]
            if not len(keys):
                continue
            candidates = np.unique(keys // n_items)
            of = np.isin(rows, candidates)
            pair_rows, hashes = _distinct(rows[of], grams[of])
            row, item = _matches(whole, hashes, pair_rows)
            exact, shared = _counted(row, item, n_items)
            ok = np.isin(exact, keys) & (100 * shared >= index.percent * index.counts[exact % n_items])
            for key, count in zip(exact[ok].tolist(), shared[ok].tolist()):
                yield first + key // n_items, key % n_items, count


def _distinct(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


def _short_runs(words: np.ndarray, bounds: np.ndarray, length: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``length`` < ``size`` words, hashed as ``shingled`` hashes a text of that many words."""
    counts = np.diff(bounds)
    runs = np.maximum(counts - length + 1, 0)
    rows = np.repeat(np.arange(len(counts)), runs)
    starts = np.arange(runs.sum()) - np.repeat(np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + bounds[rows]
    if not len(starts):
        return np.zeros(0, np.uint64), rows
    flat = words[starts[:, None] + np.arange(length)].reshape(-1)
    return shingled(flat, np.arange(0, len(flat) + 1, length), size)[0], rows


def _item_blocks(items: DataFrame, id_column: str, text_column: str, block_shingles: int) -> Iterator[list]:
    """Blocks of items of at most about ``block_shingles`` words, streamed to the driver one at a time."""
    block, words = [], 0
    for item in items.select(F.col(id_column), F.coalesce(F.col(text_column), F.lit(""))).toLocalIterator():
        block.append((item[0], item[1]))
        words += item[1].count(" ") + item[1].count("\n") + 1
        if words >= block_shingles:
            yield block
            block, words = [], 0
    if block:
        yield block


def contained_items(
    docs: DataFrame, items: DataFrame, *, size: int = SIZE, percent: int = PERCENT, block_shingles: int = BLOCK_SHINGLES,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item) of every item whose shingles are contained to ``percent`` in a document.

    Null and empty texts contain nothing, items without words are contained in nothing, repeated rows give
    repeated results, and columns other than those named are not read.
    """
    spark = docs.sparkSession
    schema = f"row_id {docs.schema[doc_id].dataType.simpleString()}, item {items.schema[item_id].dataType.simpleString()}, n_shared long, n_item long"
    source = docs.select(F.col(doc_id).alias("row_id"), F.col(text).alias("body"))
    id_type = items.schema[item_id].dataType
    parts = []
    for block in _item_blocks(items, item_id, item_text, block_shingles):
        shared = spark.sparkContext.broadcast(ItemIndex([i for i, _ in block], [t for _, t in block], size, percent))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                found = list(find_items(index, batch.column(1)))
                if found:
                    rows = pa.array([r for r, _, _ in found], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), pa.array([index.ids[i] for _, i, _ in found], to_arrow(id_type)),
                         pa.array([n for _, _, n in found], pa.int64()), pa.array([int(index.counts[i]) for _, i, _ in found], pa.int64())],
                        names=["row_id", "item", "n_shared", "n_item"],
                    )

        parts.append(source.mapInArrow(search, schema))
    found = reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)
    return found.select(F.col("row_id").alias("doc_id"), F.col("item").alias("item_id"), "n_shared", "n_item")


def to_arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def clean_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that contain no item, with the columns they came with.

    Whether a row goes is decided by its text alone, named by a hash, so rows without an id and rows that share one are
    judged each on its own. An action: the hashes to drop are written first, so that the planner knows their real size. It
    broadcasts them only below the session's threshold and joins by shuffles beyond it.
    """
    options.pop("doc_id", None)
    text = options.pop("text", "text")
    hashed = F.xxhash64(docs[text])
    named = docs.select(hashed.alias("doc_id"), docs[text].alias("text"))
    leaked = write_through(contained_items(named, items, **options).select(F.col("doc_id").alias("__leaked")).distinct(), "leaked")
    return docs.join(leaked, hashed == F.col("__leaked"), "left_anti")

"""Ranked lexical search with geometrically blocked posting lists, exact to the last place.

A document's score for an item sums, over the item's distinct terms, the term's weight (its rarity) times its
*impact* in the document (a saturated frequency, damped by the document's length), all in integers.

1. The documents become forward rows, the index's raw form: length and the item terms they hold with their
   frequencies. They are written once; document frequencies and lengths are summed from them.
2. A task takes its documents in segments of bounded size and builds, for every term, a posting list that is
   *blocked geometrically*: documents are points (their weighted impacts projected to a few dimensions), a list's documents
   go to the nearest of some centres drawn from the list itself, and every such cluster is a block.
3. Every block stores a *summary*: for each term the largest impact among its documents. It is dense for the most
   frequent terms and sparse for all others; nothing is hashed or rounded.
4. An item visits its lists from the rarest term on. What a block can still add is bounded by the summary's
   coordinates of this term and the later ones, as documents with an earlier term were met in its list. Blocks
   come by descending bound, and one is skipped only if its bound is below the score that the item's last place has
   already. Documents of all others are scored whole.
5. Last places are known from the start: a bounded sample of documents is searched first. The sample changes what is
   skipped, never what is found. The best of all tasks are ranked per item by Spark.

Items are taken in blocks of a bounded number of words, each broadcast on its own; documents are read once for each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelake.llm.decontamination import to_arrow
from pagelake.llm.shingles import hashed_words, mixed
from pagelake.session import write_through

TOP = 50
BLOCK_WORDS = 200_000
SEGMENT_DOCS, SEGMENT_POSTINGS = 4096, 1_000_000
BLOCK_DOCS = 32
DENSE_TERMS, DIMENSIONS = 128, 32
SAMPLE_DOCS = 4096
#: Fixed values of the score: impact scale, saturation, and the shares of fixed and relative length.
IMPACT, SATURATION, DAMPING, LENGTH_SHARE = 1_000_000_000, 1000, 20, 50
IMPACT_BITS = 20  # an impact is below IMPACT / SATURATION

_AS_WORDS = np.full(256, 0x20, np.uint8)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _AS_WORDS[_low:_high] = np.arange(_low, _high)


def term_blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Like ``hashed_words``, for terms: maximal runs of ASCII letters, digits and non-ASCII characters."""
    texts = texts.fill_null("").cast(pa.string())
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    if data is None:
        return
    cleaned = pa.py_buffer(_AS_WORDS[np.frombuffer(data, np.uint8)])
    yield from hashed_words(pa.StringArray.from_buffers(len(texts), offsets, cleaned, offset=texts.offset))


def impacts(tf: np.ndarray, length: np.ndarray, docs: int, words: int) -> np.ndarray:
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * length * docs) // words
    return (IMPACT * tf) // (SATURATION * tf + DAMPING * m)


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


class Items:
    """A block of items: their ids, and each one's distinct terms as positions in the block's vocabulary."""

    def __init__(self, first: int, ids: list, texts: list):
        self.first, self.ids = first, ids
        own: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(ids)
        for low, high, words, bounds in term_blocks(pa.array(texts, pa.string())):
            for row in range(low, high):
                own[row] = np.unique(words[bounds[row - low] : bounds[row - low + 1]])
        self.vocabulary = np.unique(np.concatenate([*own, np.zeros(0, np.uint64)]))
        self.terms = [np.searchsorted(self.vocabulary, o) for o in own]
        # A bit per hash prefix turns most other words away before the search.
        self.shift = np.uint64(64 - max(16, int(np.ceil(np.log2(len(self.vocabulary) + 1))) + 6))
        self.seen = np.zeros(1 << (64 - int(self.shift)), bool)
        self.seen[(self.vocabulary >> self.shift).astype(np.int64)] = True


class Weighted:
    """The block's items once document frequencies are known. Terms are numbered from the rarest to the most frequent."""

    def __init__(self, items: Items, df: np.ndarray, docs: int, words: int):
        self.first, self.ids, self.docs, self.words = items.first, items.ids, docs, words
        order = np.lexsort((np.arange(len(df)), df))
        self.number = np.empty(len(df), np.int64)
        self.number[order] = np.arange(len(df))
        self.weights = np.array([weight(docs, int(d)) for d in df[order]], np.int64)
        self.terms = [np.sort(self.number[t]) for t in items.terms]
        self.dense = max(0, len(df) - DENSE_TERMS)  # the first term with a dense coordinate
        noise = mixed(np.arange(1, len(df) * DIMENSIONS + 1, dtype=np.uint64)).reshape(len(df), DIMENSIONS)
        self.directions = np.where(noise >> np.uint64(63), 1, -1).astype(np.float32)
        self.least = np.zeros(len(self.ids), np.int64)  # score of the last place among documents seen before


def _forward(shared):
    """Per document with a term at all: length, and its terms among the items' with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        v = max(1, len(items.vocabulary))
        for batch in batches:
            for first, stop, words, bounds in term_blocks(batch.column(1)):
                length = np.diff(bounds)
                hit = np.flatnonzero(items.seen[(words >> items.shift).astype(np.int64)])
                place = np.minimum(np.searchsorted(items.vocabulary, words[hit]), v - 1)
                same = items.vocabulary[place] == words[hit] if len(items.vocabulary) else np.zeros(0, bool)
                row = np.searchsorted(bounds, hit[same], side="right") - 1
                key, tf = np.unique(row * v + place[same], return_counts=True)
                edges = np.searchsorted(key // v, np.arange(stop - first + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(x, pa.int32())) for x in (key % v, tf)]
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(first, stop - first), pa.array(length, pa.int64()), *lists], names=["id", "n", "terms", "tfs"])
                yield out.filter(pa.array(length > 0))

    return run


def _sums(terms: int):
    """Document frequencies of a task's rows, its documents (term -1) and their lengths (term -2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, words = np.zeros(terms, np.int64), 0, 0
        for batch in batches:
            df += np.bincount(np.asarray(batch.column(1).flatten()), minlength=terms)
            docs += batch.num_rows
            words += int(np.asarray(batch.column(0)).sum())
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-1, -2], found]), pa.int32()), pa.array(np.concatenate([[docs, words], df[found]]), pa.int64())], names=["term", "value"]
        )

    return run


class Segment:
    """Blocked posting lists of some documents, with summaries."""

    def __init__(self, query: Weighted, ids: np.ndarray, no_id: np.ndarray, length: np.ndarray, edges: np.ndarray, terms: np.ndarray, tfs: np.ndarray):
        self.query, self.ids, self.no_id, self.edges = query, ids, no_id, edges
        owner = np.repeat(np.arange(len(ids)), np.diff(edges))
        self.terms = query.number[terms]
        self.impacts = impacts(tfs.astype(np.int64), length[owner], query.docs, query.words)
        order = np.lexsort((owner, self.terms))
        self.lists, at = np.unique(self.terms[order], return_index=True)
        list_edges = np.append(at, len(order)).tolist()
        docs, starts = owner[order], [np.zeros(0, np.int64)]
        points = self._points(owner)
        for low, high in zip(list_edges[:-1], list_edges[1:]):
            docs[low:high], sizes = _clustered(docs[low:high], points)
            starts.append(low + np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        #: Documents of the lists' blocks, where each block starts, and the first block of each list.
        self.docs, self.starts = docs, np.append(np.concatenate(starts), len(docs)).astype(np.int64)
        self.first_block = np.searchsorted(self.starts[:-1], list_edges)
        self._summarize(owner)

    def _points(self, owner: np.ndarray) -> np.ndarray:
        """Unit vectors of the documents: their weighted impacts, projected."""
        points = np.zeros((len(self.ids), DIMENSIONS), np.float32)
        size = (self.impacts * self.query.weights[self.terms]).astype(np.float32)
        for d in range(DIMENSIONS):
            points[:, d] = np.bincount(owner, weights=size * self.query.directions[self.terms, d], minlength=len(self.ids))
        return points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)

    def _summarize(self, owner: np.ndarray) -> None:
        first, v = self.query.dense, len(self.query.weights)
        rows = np.zeros((len(self.ids), v - first))
        often = self.terms >= first
        rows[owner[often], self.terms[often] - first] = self.impacts[often]
        n = len(self.starts) - 1
        self.dense = np.zeros((n, v - first))
        for low in range(0, n, 1024):
            high = min(low + 1024, n)
            at = self.starts[low : high + 1]
            self.dense[low:high] = np.maximum.reduceat(rows[self.docs[at[0] : at[-1]]], at[:-1] - at[0], axis=0) if at[-1] > at[0] else 0
        # All other terms: the largest impact per (block, term), kept as sorted keys. Only a rare term's lists need them.
        rare_edges = np.concatenate([[0], np.cumsum(np.bincount(owner[~often], minlength=len(self.ids)))])
        rare_terms, rare_impacts = self.terms[~often], self.impacts[~often]
        rare_blocks = int(self.first_block[np.searchsorted(self.lists, first)])
        keys, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        low = 0
        while low < rare_blocks:
            # So many blocks that their documents' terms stay a bounded array.
            docs = self.docs[self.starts[low] : self.starts[rare_blocks]]
            reach = np.cumsum(rare_edges[docs + 1] - rare_edges[docs])
            high = int(np.searchsorted(self.starts, self.starts[low] + np.searchsorted(reach, 1 << 20), side="right")) - 1
            high = min(max(high, low + 1), rare_blocks)
            docs = self.docs[self.starts[low] : self.starts[high]]
            # Of a list only the coordinates of its own term and later ones are asked for.
            block = np.repeat(np.arange(low, high), np.diff(self.starts[low : high + 1]))
            own = self.lists[np.searchsorted(self.first_block, block, side="right") - 1]
            times = rare_edges[docs + 1] - rare_edges[docs]
            at = np.repeat(rare_edges[docs] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
            later = rare_terms[at] >= np.repeat(own, times)
            # Key and impact in one number each, so that one plain sort puts the largest impact of a key last.
            entry = ((np.repeat(block, times)[later] * v + rare_terms[at][later]) << IMPACT_BITS) | rare_impacts[at][later]
            entry.sort()
            key = entry >> IMPACT_BITS
            last = np.append(key[1:] != key[:-1], True) if len(key) else np.zeros(0, bool)
            keys.append(key[last])
            values.append(entry[last] & ((1 << IMPACT_BITS) - 1))
            low = high
        self.rare_keys, self.rare_values = np.concatenate(keys), np.concatenate(values)

    def bounds(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Blocks of the item's lists, each with the most that a document first met there can score."""
        first, v, weights = self.query.dense, len(self.query.weights), self.query.weights
        often = terms[terms >= first]
        dense_weights = np.zeros(v - first)
        dense_weights[often - first] = weights[often]
        blocks, most = [np.zeros(0, np.int64)], [np.zeros(0)]
        place = np.searchsorted(self.lists, terms)
        for k, (term, at) in enumerate(zip(terms.tolist(), place.tolist())):
            if at == len(self.lists) or self.lists[at] != term:
                continue
            own = np.arange(self.first_block[at], self.first_block[at + 1])
            skip = max(0, term - first)
            bound = self.dense[own[0] : own[-1] + 1, skip:] @ dense_weights[skip:]
            if term < first:
                later = terms[k:][terms[k:] < first]
                keys = own[:, None] * v + later
                found = np.minimum(np.searchsorted(self.rare_keys, keys), len(self.rare_keys) - 1)
                bound = bound + np.where(self.rare_keys[found] == keys, self.rare_values[found], 0) @ weights[later]
            blocks.append(own)
            most.append(bound)
        return np.concatenate(blocks), np.concatenate(most)

    def scores(self, docs: np.ndarray, item_weights: np.ndarray) -> np.ndarray:
        times = np.diff(self.edges)[docs]
        begin = np.concatenate([[0], np.cumsum(times)])
        at = np.repeat(self.edges[docs] - begin[:-1], times) + np.arange(begin[-1])
        sums = np.concatenate([[0], np.cumsum(self.impacts[at] * item_weights[self.terms[at]])])
        return sums[begin[1:]] - sums[begin[:-1]]


def _clustered(docs: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A list's documents, cluster by cluster, and the clusters' sizes; none is above twice ``BLOCK_DOCS``."""
    n = len(docs)
    if n <= BLOCK_DOCS:
        return docs, np.array([n])
    centres = docs[:: BLOCK_DOCS]
    nearest = np.argmax(points[docs] @ points[centres].T, axis=1)
    order = np.argsort(nearest, kind="stable")
    sizes = np.bincount(nearest, minlength=len(centres))
    pieces = -(-sizes // (2 * BLOCK_DOCS))
    cut = [np.full(p, 2 * BLOCK_DOCS) for p in pieces]
    for c, size, p in zip(cut, sizes, pieces):
        if p:
            c[-1] = size - (p - 1) * 2 * BLOCK_DOCS
    return docs[order], np.concatenate(cut)


class Best:
    """The best documents of every item so far: score descending, then id ascending, rows without an id last."""

    def __init__(self, query: Weighted, top: int):
        self.query, self.top = query, top
        self.rows = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in query.ids]

    def least(self, item: int) -> int:
        scores = self.rows[item][0]
        return max(1, int(self.query.least[item]), int(scores[-1]) if len(scores) == self.top else 0)

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        scores, ids, no_id = (np.concatenate(pair) for pair in zip(self.rows[item], (scores, ids, no_id)))
        order = np.lexsort((ids, no_id, -scores))[: self.top]
        self.rows[item] = scores[order], ids[order], no_id[order]


def search(segment: Segment, best: Best) -> tuple[int, int]:
    """Adds the segment's documents to the best; returns how many blocks were scored, and how many there were."""
    query = segment.query
    item_weights = np.zeros(len(query.weights), np.int64)
    scored = total = 0
    for item, terms in enumerate(query.terms):
        blocks, most = segment.bounds(terms)
        total += len(blocks)
        alive = most >= best.least(item)
        blocks, most = blocks[alive], most[alive]
        order = np.argsort(-most, kind="stable")
        blocks, most = blocks[order], most[order]
        item_weights[terms] = query.weights[terms]
        met, step = np.zeros(len(segment.ids), bool), 8
        while len(blocks):
            some, blocks, most = blocks[:step], blocks[step:], most[step:]
            scored += len(some)
            docs = np.unique(np.concatenate([segment.docs[segment.starts[b] : segment.starts[b + 1]] for b in some.tolist()]))
            docs = docs[~met[docs]]
            met[docs] = True
            scores = segment.scores(docs, item_weights)
            good = scores >= best.least(item)
            if good.any():
                best.add(item, scores[good], segment.ids[docs[good]], segment.no_id[docs[good]])
            alive = most >= best.least(item)
            blocks, most, step = blocks[alive], most[alive], step * 2
        item_weights[terms] = 0
    return scored, total


def _segments(query: Weighted, batches: Iterator[pa.RecordBatch]) -> Iterator[Segment]:
    held, docs, postings = [], 0, 0

    def built() -> Segment:
        columns = [pa.concat_arrays([b.column(k) for b in held]) for k in range(4)]
        lists = [np.asarray(columns[k].flatten()).astype(np.int64) for k in (2, 3)]
        edges = np.concatenate([[0], np.cumsum(np.asarray(columns[2].value_lengths()).astype(np.int64))])
        return Segment(query, np.asarray(columns[0].fill_null(0)), np.asarray(columns[0].is_null()), np.asarray(columns[1]), edges, *lists)

    for batch in batches:
        sizes = np.concatenate([[0], np.cumsum(np.asarray(batch.column(2).value_lengths()).astype(np.int64))])
        at = 0
        while at < batch.num_rows:
            room = int(np.searchsorted(sizes, sizes[at] + max(SEGMENT_POSTINGS - postings, 1), side="right")) - 1
            stop = min(max(room, at + 1), at + SEGMENT_DOCS - docs, batch.num_rows)
            held.append(batch.slice(at, stop - at))
            docs += stop - at
            postings += int(sizes[stop] - sizes[at])
            at = stop
            if docs >= SEGMENT_DOCS or postings >= SEGMENT_POSTINGS:
                yield built()
                held, docs, postings = [], 0, 0
    if docs:
        yield built()


def _searched(shared, top: int, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query = shared.value
        best = Best(query, top)
        for segment in _segments(query, batches):
            search(segment, best)
        for item, (scores, ids, no_id) in enumerate(best.rows):
            if len(scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(scores), query.first + item)), pa.array([query.ids[item]] * len(scores), item_type), pa.array(ids, mask=no_id), pa.array(scores)],
                    names=["item_no", "item", "id", "score"],
                )

    return run


def _blocks_of_items(items: DataFrame, item_id: str, item_text: str, block_words: int) -> Iterator[Items]:
    """Items in blocks of about ``block_words`` words at most, streamed to the driver one block at a time."""
    ids, texts, words, first = [], [], 0, 0
    for row in items.select(F.col(item_id), F.coalesce(F.col(item_text), F.lit(""))).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        words += len(row[1]) // 4 + 1
        if words >= block_words:
            yield Items(first, ids, texts)
            ids, texts, words, first = [], [], 0, first + len(ids)
    if ids:
        yield Items(first, ids, texts)


def ranked_documents(
    docs: DataFrame, items: DataFrame, *, top: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    block_words: int = BLOCK_WORDS, sample_docs: int = SAMPLE_DOCS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` best documents with a score above 0.

    Null texts have no terms. Rows of ``docs`` are documents of their own even where they repeat, so an id may come
    twice; rows without an id come after those with one of the same score. Repeated items are ranked on their own.
    Items without a known term, and empty tables, give no rows. Texts of any length are read whole; other columns
    are not read. An action: the forward rows are written below the shared folder.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("body"))
    item_type = items.schema[item_id].dataType
    schema = f"item_no long, item {item_type.simpleString()}, id long, score long"
    found = []
    for block in _blocks_of_items(items, item_id, item_text, block_words):
        forward = write_through(source.mapInArrow(_forward(spark.sparkContext.broadcast(block)), "id long, n long, terms array<int>, tfs array<int>"), "forward")
        terms = len(block.vocabulary)
        summed = forward.select("n", "terms").mapInArrow(_sums(terms), "term int, value long").groupBy("term").agg(F.sum("value").alias("value")).collect()
        values = {r.term: r.value for r in summed}
        if not values.get(-1):
            continue
        query = Weighted(block, np.array([values.get(k, 0) for k in range(terms)], np.int64), values[-1], values[-2])
        job = lambda q, rows: rows.mapInArrow(_searched(spark.sparkContext.broadcast(q), top, to_arrow(item_type)), schema)
        # At most `top` rows an item of the block come back.
        for r in job(query, forward.limit(sample_docs)).groupBy("item_no").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == top).collect():
            query.least[r.item_no - block.first] = r.least
        found.append(job(query, forward))
    rows = reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], schema)
    order = Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score"
    )

"""Jaccard join of documents on word shingles, by adaptive multi-match prefixes.

Two documents link when their sets of distinct shingles have a Jaccard similarity of ``percent`` or more. The
join gives every document the smallest id that links can reach.

1. Documents with equal sets form a class, found by a 128-bit fingerprint; only one text of the class goes on, under the
   class's own number.
2. Prefixes. Under one order of all shingles, linked documents share a shingle among the first
   ``n - ceil(t n) + 1`` of each. Where a document's prefix would hold expensive shingles (their candidate cost,
   the number of documents that have them, is estimated by a count sketch over all documents), the prefix is
   lengthened by one for each and one more match is asked for: a match among the cheap ones is then certain, so
   only those are used as keys. That is the order "cheap first".
3. Every posting list ties its documents to one pivot, not to each other. The ties' components are the candidate
   groups: documents of different groups share no key, so they cannot link.
4. In a candidate group, each document chooses its number of matches l by estimated cost once more, now from the
   exact list lengths within the group: prefix ``n - ceil(t n) + l``, at least ``min(l_x, l_y)`` shared prefix
   shingles before the exact verification. Pairs that links connect already are not verified again, so a group
   of thousands of near copies needs about one verification per document. Groups of more than ``block`` documents
   are dealt out as pairs of blocks, each a task of bounded size; together they cover every pair of the group.

No step gathers an unbounded group, and nothing but the sketch (a fixed size) reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.components import components
from pagelake.llm.shingles import hashed_words, mixed, shingled
from pagelake.session import remove_folder, write_through

SIZE, PERCENT = 5, 75
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 1_000_000
SKETCH_BITS, SKETCH_CHUNKS = 18, 64
MATCHES = 8
SALTS = 16
PACK_BYTES = 8 << 20
#: Keys are the first 54 bits of a hash. Two shingles with one key only make a spurious tie, and the prefix is one
#: longer than it must be, so that a text which has both loses none. Sets are compared by whole hashes.
KEY_SHIFT = np.uint64(10)
SECOND = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks (first row, shingle hashes, bounds): each row's distinct shingles, ascending."""
    for first, stop, words, bounds in hashed_words(texts):
        grams, edges = shingled(words, bounds, size)
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
            grams[low:high].sort()
        new = np.ones(len(grams), bool)
        new[1:] = grams[1:] != grams[:-1]
        new[edges[:-1][edges[:-1] < len(grams)]] = True
        yield first, grams[new], np.concatenate([[0], np.cumsum(new)])[edges]


def _row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _sketch_places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), ((hashes >> np.uint64(20)) & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)


def _first_pass(size: int):
    """Per row (id, text, hash of the text) its set size and fingerprint; per task the count sketch of all its shingles, in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << SKETCH_BITS), np.int64)
        names = ["id", "h", "n", "f1", "f2", "chunk", "counts"]
        for batch in batches:
            ids, texts, own = batch.column(0), batch.column(1), batch.column(2)
            for first, sets, bounds in shingle_sets(texts, size):
                for k, places in enumerate(_sketch_places(sets)):
                    counts[k] += np.bincount(places, minlength=1 << SKETCH_BITS)
                rows = len(bounds) - 1
                yield pa.RecordBatch.from_arrays([
                    ids.slice(first, rows), own.slice(first, rows), pa.array(np.diff(bounds), pa.int64()),
                    pa.array(_row_sums(mixed(sets), bounds).view(np.int64)), pa.array(_row_sums(mixed(sets ^ SECOND), bounds).view(np.int64)),
                    pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary()),
                ], names=names)
        if counts.any():
            parts = counts.reshape(SKETCH_CHUNKS, -1).astype("<u4")
            n = len(parts)
            yield pa.RecordBatch.from_arrays([
                *[pa.nulls(n, pa.int64())] * 5, pa.array(np.arange(n), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary()),
            ], names=names)

    return run


def _summed_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the chunks that stream by; holds one sum per chunk, however many tasks sent theirs."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(data, "<u4").astype(np.int64)
            sums[chunk] = sums[chunk] + part if chunk in sums else part
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["chunk", "counts"])


def cost_classes(hashes: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """0 for shingles whose estimated number of documents is within the sketch's noise, else its logarithm."""
    one, two = _sketch_places(hashes)
    mean = sketch[0].mean()
    above = np.minimum(sketch[0][one], sketch[1][two]) - mean
    return np.where(above > 4 * np.sqrt(mean) + 8, np.log2(np.maximum(above, 1)).astype(np.int64) + 1, 0)


def prefix_length(n, percent: int):
    return n - -(-percent * n // 100) + 1


def packed(hashes: np.ndarray, rows: np.ndarray) -> bytes:
    """Sorted hashes with their rows (below 65,536) as bytes: steps of five bytes where they fit, else of six or eight."""
    steps = np.diff(hashes, prepend=hashes[:1])
    width = next(w for w in (5, 6, 8) if w == 8 or not len(steps) or steps.max() < 1 << (8 * w))
    head = np.array([width, len(hashes)], "<u8").tobytes() + hashes[:1].tobytes()
    return head + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes() + rows.astype("<u2").tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    width, n = np.frombuffer(data, "<u8", 2).tolist()
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :width] = np.frombuffer(data, np.uint8, n * width, 24).reshape(n, width)
    return np.cumsum(steps.view("<u8")[:, 0], dtype=np.uint64) + np.frombuffer(data, "<u8", 1, 16)[0], np.frombuffer(data, "<u2", n, 24 + n * width)


def _second_pass(size: int, bits: int, shared):
    """Shingles with the documents that have them: expensive ones as rows of their own, with their estimated cost;
    all others packed, one row for each batch and part of the hash space."""

    def rows_of(bucket, ids, blob, number, key, cost) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket, pa.int32()), pa.array(ids, pa.list_(pa.int64())), pa.array(blob, pa.binary()), pa.array(number, pa.int64()),
             pa.array(key, pa.int64()), pa.array(cost, pa.int64())], names=["bucket", "ids", "data", "id", "key", "cost"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = shared.value
        for whole in batches:
            # Rows by bytes of text, so that the arrays below stay small whatever the batch.
            size_before = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(whole.column(1)), 0), np.int64))])
            start = 0
            while start < whole.num_rows:
                stop = int(np.searchsorted(size_before, size_before[start] + PACK_BYTES, side="right")) - 1
                stop = min(max(stop, start + 1), start + (1 << 16), whole.num_rows)
                batch = whole.slice(start, stop - start)
                start = stop
                ids = np.asarray(batch.column(0))
                hashes, rows = [], []
                for first, sets, bounds in shingle_sets(batch.column(1), size):
                    row = np.repeat(np.arange(first, first + len(bounds) - 1), np.diff(bounds))
                    cost = cost_classes(sets, sketch)
                    hot = cost > 0
                    if hot.any():
                        number = ids[row[hot]]
                        n = len(number)
                        bucket = (mixed(number.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int32)
                        yield rows_of(bucket, [None] * n, [None] * n, number, sets[hot].view(np.int64), cost[hot])
                    hashes.append(sets[~hot])
                    rows.append(row[~hot].astype(np.uint16))
                if not hashes:
                    continue
                hashes, rows = np.concatenate(hashes), np.concatenate(rows)
                order = np.argsort(hashes, kind="stable")
                hashes, rows = hashes[order], rows[order]
                del order
                edges = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
                out = []
                for bucket, (low, high) in enumerate(zip(edges.tolist(), [*edges[1:].tolist(), len(hashes)])):
                    if low < high:
                        own, place = np.unique(rows[low:high], return_inverse=True)
                        out.append((bucket, ids[own], packed(hashes[low:high] >> KEY_SHIFT, place)))
                for at in range(0, len(out), 64):
                    part = out[at : at + 64]
                    none = [None] * len(part)
                    yield rows_of([b for b, _, _ in part], [i for _, i, _ in part], [d for _, _, d in part], none, none, none)

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that two documents or more have: (id, key, cost, whether only estimated).

    Rows come sorted by bucket; one bucket's shingles are held at a time.
    """
    hashes, numbers, current, names = [], [], None, ["id", "key", "cost", "hot"]
    for batch in batches:
        hot = np.asarray(batch.column(2).is_null())
        if hot.any():
            part = batch.filter(pa.array(hot))
            yield pa.RecordBatch.from_arrays([part.column(3), part.column(4), part.column(5), pa.array(np.ones(part.num_rows, bool))], names=names)
        for bucket, ids, data in zip(np.asarray(batch.column(0)).tolist(), batch.column(1), batch.column(2)):
            if data.is_valid:
                if bucket != current:
                    yield from _repeated_in_bucket(hashes, numbers, names)
                    current = bucket
                h, row = unpacked(data.as_buffer())
                hashes.append(h)
                numbers.append(np.asarray(ids.values)[row])
    yield from _repeated_in_bucket(hashes, numbers, names)


def _repeated_in_bucket(hashes: list[np.ndarray], numbers: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Empties the lists."""
    if not hashes:
        return
    h, number = np.concatenate(hashes), np.concatenate(numbers)
    hashes.clear()
    numbers.clear()
    order = np.argsort(h, kind="stable")
    h, number = h[order], number[order]
    del order
    edges = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])
    times = np.diff(edges)
    keep = np.repeat(times > 1, times)
    h, number, df = h[keep].view(np.int64), number[keep], np.repeat(times, times)[keep]
    for at in range(0, len(h), 1 << 18):
        part = slice(at, at + (1 << 18))
        yield pa.RecordBatch.from_arrays([pa.array(number[part]), pa.array(h[part]), pa.array(df[part], pa.int64()), pa.array(np.zeros(len(h[part]), bool))], names=names)


def _tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (key, salt, place): ties of each list's members to its first; of expensive keys also the first itself."""
    last, pivot, seen = None, None, set()
    for batch in batches:
        key, salt, hot, place, ids = (np.asarray(batch.column(k)) for k in range(5))
        if not len(key):
            continue
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
        new[0] = (key[0], salt[0]) != last
        heads = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        pivots = np.where(of >= 0, ids[heads[np.maximum(of, 0)]] if len(heads) else pivot, pivot if pivot is not None else 0)
        last, pivot = (key[-1], salt[-1]), pivots[-1]
        tie = pivots != ids
        pairs = np.unique(np.stack([ids[tie], pivots[tie]], axis=1), axis=0) if tie.any() else np.zeros((0, 2), np.int64)
        fresh = [p for p in map(tuple, pairs.tolist()) if p not in seen]
        if len(seen) > 500_000:
            seen = set()
        seen.update(fresh)
        heads = heads[hot[heads]]
        a = np.concatenate([np.array([p[0] for p in fresh], np.int64), ids[heads]])
        b = np.concatenate([np.array([p[1] for p in fresh], np.int64), ids[heads]])
        k = pa.array(np.concatenate([np.zeros(len(fresh), np.int64), key[heads]]), pa.int64(), mask=np.arange(len(a)) < len(fresh))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), k], names=["a", "b", "key"])


def group_links(ids: np.ndarray, part: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect what is connected among the sets; with two parts, only links between them are looked for."""
    m = len(ids)
    across = len(np.unique(part)) > 1
    sizes = np.array([len(s) for s in sets])
    if m == 2:
        shared = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(int(ids[0]), int(ids[1]))] if 100 * shared >= percent * (sizes.sum() - shared) else []
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes)
    _, token, df = np.unique(flat, return_inverse=True, return_counts=True)
    # Rare first within the group.
    order = np.lexsort((flat, df[token], owner))
    token, costs = token[order], np.cumsum(df[token][order])
    before = np.concatenate([[0], costs])[bounds[:-1]]
    base = prefix_length(sizes, percent)
    # Cost of l matches: lists that are read, and at most lists / l candidates that are verified.
    best, matches = None, np.ones(m, np.int64)
    verify = max(1.0, float(sizes.mean()) / 16)
    for l in range(1, MATCHES + 1):  # noqa: E741
        length = np.minimum(base + l - 1, sizes)
        read = costs[bounds[:-1] + length - 1] - before
        cost = np.where(base + l - 1 <= sizes, read * (1 + verify / l), np.inf)
        if best is None:
            best = cost
        else:
            matches = np.where(cost < best, l, matches)
            best = np.minimum(cost, best)
    length = base + matches - 1
    within = np.arange(len(token)) - np.repeat(bounds[:-1], sizes)
    in_prefix = within < np.repeat(length, sizes)
    posting_order = np.argsort(token[in_prefix], kind="stable")
    posting_docs = owner[in_prefix][posting_order]
    starts = np.searchsorted(token[in_prefix][posting_order], np.arange(len(df) + 1))
    root = np.arange(m)
    links = []
    for x in range(m):
        own = token[bounds[x] : bounds[x] + length[x]]
        low, high = starts[own], starts[own + 1]
        shared_list = high - low > 1
        if not shared_list.any():
            continue
        docs = np.concatenate([posting_docs[a:b] for a, b in zip(low[shared_list].tolist(), high[shared_list].tolist())])
        met = np.bincount(docs[docs > x], minlength=m)
        candidate = np.flatnonzero((met > 0) & (met >= np.minimum(matches, matches[x])) & (root != root[x]))
        if across:
            candidate = candidate[part[candidate] != part[x]]
        n = sizes[candidate]
        candidate = candidate[100 * np.minimum(n, sizes[x]) >= percent * np.maximum(n, sizes[x])]
        candidate = candidate[np.argsort(-met[candidate], kind="stable")]
        while len(candidate):
            some, candidate = candidate[:32], candidate[32:]
            theirs = np.concatenate([sets[y] for y in some])
            place = np.minimum(np.searchsorted(sets[x], theirs), sizes[x] - 1)
            equal = np.concatenate([[0], np.cumsum(sets[x][place] == theirs)])
            edges = np.concatenate([[0], np.cumsum(sizes[some])])
            inter = equal[edges[1:]] - equal[edges[:-1]]
            linked = some[100 * inter >= percent * (sizes[some] + sizes[x] - inter)]
            for y in linked.tolist():
                if root[y] != root[x]:
                    links.append((int(ids[x]), int(ids[y])))
                    root[root == root[y]] = root[x]
            candidate = candidate[root[candidate] != root[x]]
    return links


def _grouped_links(size: int, percent: int):
    """From rows (label, i, j, id, part, text) sorted by the first three, the links of each group."""

    def links_of(rows: list[tuple]) -> list[tuple[int, int]]:
        ids, parts, sets = [], [], []
        for number, part, own in rows:
            ids.append(number)
            parts.append(part)
            sets.append(own)
        return group_links(np.array(ids, np.int64), np.array(parts), sets, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows, found = None, [], []
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            ids, parts = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for first, sets, bounds in shingle_sets(batch.column(5), size):
                for k in range(len(bounds) - 1):
                    row = first + k
                    if keys[row] != current:
                        if len(rows) > 1:
                            found += links_of(rows)
                        current, rows = keys[row], []
                    rows.append((ids[row], parts[row], sets[bounds[k] : bounds[k + 1]].copy()))
            if len(found) > 10_000:
                yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in found])
                found = []
        if len(rows) > 1:
            found += links_of(rows)
        if found:
            yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in found])

    return run


def _text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def _classes_and_components(docs: DataFrame, size: int, percent: int, block_docs: int, block_shingles: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(id, h, n, f1, f2) of every row, and for every class (f1, f2) the row that stands for its component, as best.id and best.h.

    ``h`` is a hash of the row's text; rows of one id with different texts are told apart by it. The best row of
    a component has the smallest id, rows without an id last.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("body"), _text_hash(F.col(text)).alias("h"))
    first = write_through(source.mapInArrow(_first_pass(size), "id long, h long, n long, f1 long, f2 long, chunk int, counts binary"), "sets", trash := [])
    members = first.where("chunk is null").select("id", "h", "n", "f1", "f2")
    chunks = first.where("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(_summed_chunks, "chunk int, counts binary").collect()
    sketch = np.zeros((SKETCH_CHUNKS, 2 * (1 << SKETCH_BITS) // SKETCH_CHUNKS), np.int64)
    for row in chunks:
        sketch[row["chunk"]] = np.frombuffer(row["counts"], np.int64)
    shared = spark.sparkContext.broadcast(sketch.reshape(2, -1))

    # From here on a class goes by a number of its own, whatever ids its rows have.
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h"))
    classes = members.where("n > 0").groupBy("f1", "f2").agg(best.alias("best"), F.first("n").alias("n"))
    classes = write_through(classes.withColumn("number", F.monotonically_increasing_id()), "classes", trash)
    rep = classes.select(F.col("best.id").alias("rep"), F.col("best.h").alias("rep_h"), "number")
    texts = source.join(rep, F.col("id").eqNullSafe(F.col("rep")) & (F.col("h") == F.col("rep_h"))).select(F.col("number").alias("id"), "body")
    bits = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
    postings = (
        texts.mapInArrow(_second_pass(size, bits, shared), "bucket int, ids array<long>, data binary, id long, key long, cost long")
        .repartition(1 << bits, "bucket").sortWithinPartitions("bucket").mapInArrow(_repeated, "id long, key long, cost long, hot boolean")
    )
    # Cheapest first: shingles of one document alone, which tie nothing, then the repeated ones by their cost.
    listed = postings.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("hot", "cost", "key"))).alias("repeated"))
    sizes = classes.select(F.col("number").alias("rep"), "n")
    taken = F.col("n") - F.ceil(F.col("n") * percent / 100) + 2 - (F.col("n") - F.size("repeated"))
    keys = listed.join(sizes, F.col("id") == F.col("rep")).withColumn("taken", taken.cast("int")).where("taken > 0").select(
        "id", F.xxhash64("id").alias("place"), F.explode(F.slice("repeated", 1, F.col("taken"))).alias("k"),
    ).select(F.col("k.key").alias("key"), F.when(F.col("k.hot"), F.pmod("place", F.lit(SALTS))).otherwise(0).cast("int").alias("salt"), F.col("k.hot").alias("hot"), "place", "id")
    ties = write_through(
        keys.repartition("key", "salt").sortWithinPartitions("key", "salt", "place").mapInArrow(_tied, "a long, b long, key long"), "ties", trash
    )
    heads = ties.where("key is not null").select("key", "a")
    pivots = heads.groupBy(F.col("key").alias("of")).agg(F.min("a").alias("b"))
    across = heads.join(pivots, F.col("key") == F.col("of")).where("a <> b").select("a", "b")
    groups = write_through(components(ties.where("key is null").select("a", "b").unionAll(across)), "groups", trash)

    sized = groups.join(sizes, F.col("id") == F.col("rep")).select("id", "label", "n")
    blocks = sized.groupBy(F.col("label").alias("of")).agg(
        F.greatest(F.lit(1), F.ceil(F.count("*") / block_docs), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("blocks"), F.count("*").alias("docs"),
    )
    # One block that is not too large stays whole; more are paired, each document standing in as many pairs as there are blocks.
    dealt = sized.join(blocks, F.col("label") == F.col("of")).select(
        "id", "label", "blocks", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int").alias("part"),
    ).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.col("id").alias("rep"), "label", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    # Repeated rows of one id and one text stand for one class.
    grouped = texts.join(groups.select(F.col("id").alias("rep")), F.col("id") == F.col("rep"), "left_semi").dropDuplicates(["id"])
    gathered = grouped.join(dealt, F.col("id") == F.col("rep")).select("label", "i", "j", "id", "part", "body").repartition("label", "i", "j").sortWithinPartitions("label", "i", "j")
    links = write_through(gathered.mapInArrow(_grouped_links(size, percent), "a long, b long"), "links", trash)
    reached = write_through(components(links), "reached")
    for folder in trash[2:]:
        remove_folder(spark, folder)

    numbered = classes.join(reached, F.col("number") == reached["id"], "left").select("f1", "f2", "best", F.coalesce("label", "number").alias("label"))
    whole = numbered.groupBy(F.col("label").alias("of")).agg(F.min("best").alias("best"))
    return members, numbered.drop("best").join(whole, F.col("label") == F.col("of")).select("f1", "f2", "best")


def similar_components(
    docs: DataFrame, *, size: int = SIZE, percent: int = PERCENT, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    A null text and a text without words have an empty set and link with nothing. Rows that share an id but not the
    text link each by its own text. Rows without an id link as all do, and their component is null only where no row
    of it has an id. Repeated rows are repeated. Texts of any length are read whole. Other columns are not read.
    Actions: the intermediate tables are written below the shared folder.
    """
    members, named = _classes_and_components(docs, size, percent, block_docs, block_shingles, doc_id, text)
    return members.join(named, ["f1", "f2"], "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("best.id")).otherwise(F.col("id")).alias("component_id"),
    )


def one_per_component(
    docs: DataFrame, *, size: int = SIZE, percent: int = PERCENT, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Of each component one row, that with the smallest id, with the columns it came with; rows without words all stay.

    Where a component has no id at all, or rows are repeated, one of its rows stays all the same.
    """
    members, named = _classes_and_components(docs, size, percent, block_docs, block_shingles, doc_id, text)
    worded = members.where("n > 0").join(named, ["f1", "f2"])
    goes = ~(F.col("id").eqNullSafe(F.col("best.id")) & (F.col("h") == F.col("best.h")))
    mark = lambda rows, *more: rows.select(F.col("id").alias("__id"), F.col("h").alias("__h"), *more)
    dropped = write_through(mark(worded.where(goes)).distinct(), "dropped")
    repeated = write_through(mark(worded.where(~goes)).groupBy("__id", "__h").count().where("count > 1").drop("count"), "repeated")
    same = docs[doc_id].eqNullSafe(F.col("__id")) & (_text_hash(docs[text]) == F.col("__h"))
    kept = docs.join(dropped, same, "left_anti")
    if repeated.isEmpty():
        return kept
    one = docs.join(repeated, same).groupBy("__id", "__h").agg(F.first(F.struct(*[docs[c] for c in docs.columns])).alias("__row"))
    return kept.join(repeated, same, "left_anti").unionByName(one.select("__row.*"))

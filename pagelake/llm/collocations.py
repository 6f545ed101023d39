"""Phrase collocations by the stripes pattern.

Every prefix of zero, one or two words keys a *stripe*: an associative counter of the words that follow it. The entry
of ``next`` in the stripe of ``prefix`` is the number of occurrences of the phrase ``prefix next``, so one structure
holds everything: extensions of a phrase are the entries of its stripe, a prefix's total is its last word's entry in the
stripe of the prefix one shorter, and what subsumes a phrase is the largest entry among its extensions.

1. A task builds the stripes of a block of text in numpy: words become small integers, phrases sorted integers.
2. Stripes go to *buckets* by the hash of their prefix, packed with a dictionary of their own words. A prefix that
   holds more than a fixed share of all words is hot: its stripe is dealt out by the next word, as is that of the
   empty prefix. Hot prefixes are found by a first pass over all documents, each block naming those with
   that share of it; there cannot be more of them than the share allows.
3. A bucket's stripes are merged elementwise as they stream by. An entry is whole in its bucket, so only those that
   reach ``min_count`` leave it.
4. Cuts, scores, subsumption and ranks are joins and aggregations over these few rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.llm.shingles import PIECE, _power_tables, mixed
from pagelake.session import write_through

MIN_COUNT, COVER_PERCENT, TOP = 10, 50, 2000
NO_LANGUAGE = "und"
CHUNK = 4 << 20
#: A block names the prefixes with one in ``HOT`` of its words; those that come to one in ``HOT`` of all are hot.
HOT = 8192
#: Entries of a bucket that are merged at a time.
MERGE = 3 << 19
RANK_SALTS = 64
#: Buckets a shuffle partition: one bucket's stripes are held at a time.
BUCKETS = 4

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class Block(NamedTuple):
    words: pa.Array  # "language<tab>word", distinct
    lang: np.ndarray  # of each of the words, a position in langs
    langs: pa.Array
    ids: np.ndarray  # of each token, a position in words
    joined: np.ndarray  # whether a token follows the one before it in one piece
    fresh: int  # tokens before this one were counted by the block before


def _tokens(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and whether each follows the one before in one piece; a row begins at each of ``breaks``."""
    kind = _KIND[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind == 0
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cut = breaks[(breaks > 0) & (breaks < len(data))]
    first[cut] |= inside[cut + 1]
    last[cut - 1] |= inside[cut]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    pieces = np.zeros(len(data) + 1, np.int32)
    np.cumsum(kind == 2, out=pieces[1:])
    row = np.searchsorted(breaks, starts, side="right")
    joined = np.zeros(len(starts), bool)
    joined[1:] = (pieces[starts[1:]] == pieces[starts[:-1]]) & (row[1:] == row[:-1])
    return starts, ends, joined


def _cut(data: np.ndarray, breaks: np.ndarray, low: int, high: int) -> int:
    """Largest position up to ``high`` that no word spans; if that is not past ``low``, the smallest one after."""
    if high >= len(data):
        return len(data)
    window = np.flatnonzero(_KIND[data[low:high]])
    row = breaks[(breaks > low) & (breaks <= high)]
    end = max(low + int(window[-1]) + 1 if len(window) else low, int(row[-1]) if len(row) else low)
    if end > low:
        return end
    after, row = np.flatnonzero(_KIND[data[high:]]), breaks[breaks > high]
    return min(high + int(after[0]) + 1 if len(after) else len(data), int(row[0]) if len(row) else len(data))


def blocks(langs: pa.Array, texts: pa.Array, chunk: int = CHUNK) -> Iterator[Block]:
    """The words of a batch of rows in blocks of about ``chunk`` bytes, or one longer word.

    A text that is cut gives its last two words to the next block again, so no phrase is lost and none counted twice.
    """
    texts = texts.fill_null("").cast(pa.string())
    if not len(texts):
        return
    langs = langs.cast(pa.string()).dictionary_encode()
    row_lang = np.asarray(langs.indices).astype(np.int64)
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if offsets[-1] == offsets[0]:
        return
    data = np.frombuffer(data_buffer, np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    begin = done = 0
    while done < len(data):
        end = _cut(data, offsets, done, done + chunk)
        part = data[begin:end]
        starts, ends, joined = _tokens(part, offsets[(offsets >= begin) & (offsets <= end)] - begin)
        if len(starts):
            # The bytes of the words alone, back to back.
            before = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
            flat = _LOWER[part[_KIND[part] == 0]]
            words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(before), pa.py_buffer(flat)).dictionary_encode()
            row = np.searchsorted(offsets, starts + begin, side="right") - 1
            v = len(words.dictionary)
            pair = row_lang[row] * v + np.asarray(words.indices)
            distinct, ids = _numbered(pair, len(langs.dictionary) * v)
            named = pc.binary_join_element_wise(langs.dictionary.take(pa.array(distinct // v)), words.dictionary.take(pa.array(distinct % v)), "\t")
            yield Block(named, distinct // v, langs.dictionary, ids, joined, int(np.searchsorted(starts, done - begin)))
        done, again = end, end
        for k in (1, 2):
            if len(starts) >= k and (k == 1 or joined[-1]):
                again = begin + int(starts[-k])
        # Only a text that goes on beyond the cut needs its last words again.
        same_text = np.searchsorted(offsets, again, side="right") == np.searchsorted(offsets, end, side="right")
        begin = again if same_text else end


def _numbered(values: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and the position of each value among them."""
    if limit <= 1 << 24:
        seen = np.zeros(limit, bool)
        seen[values] = True
        return np.flatnonzero(seen), (np.cumsum(seen, dtype=np.int32) - 1)[values].astype(np.int64)
    distinct, inverse = np.unique(values, return_inverse=True)
    return distinct, inverse.astype(np.int64)


def _counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how often each occurs or the sum of its counts."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    if counts is None:
        return keys[at], np.diff(np.append(at, len(keys)))
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _phrases(block: Block, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Word numbers and counts of the block's distinct phrases of ``size`` words."""
    end = np.arange(max(block.fresh, size - 1), len(block.ids))
    for back in range(size - 1):
        end = end[block.joined[end - back]]
    u = len(block.words)
    if u ** size < 1 << 63:
        key = np.zeros(len(end), np.int64)
        for back in range(size - 1, -1, -1):
            key = key * u + block.ids[end - back]
        key, counts = _counted(key)
        parts = []
        for _ in range(size):
            parts.append((key % u).astype(np.int32))
            key = key // u
        return parts[::-1], counts
    first, inverse = np.unique(block.ids[end - 2] * u + block.ids[end - 1], return_inverse=True)
    key, counts = _counted(inverse.astype(np.int64) * u + block.ids[end])
    head = first[key // u]
    return [x.astype(np.int32) for x in (head // u, head % u, key % u)], counts


def string_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of the strings' bytes."""
    words = words.cast(pa.string())
    _, offset_buffer, data_buffer = words.buffers()
    offsets = np.frombuffer(offset_buffer, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, np.uint8)[offsets[0] : offsets[-1]] if data_buffer is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    out, low = np.zeros(len(words), np.uint64), 0
    while low < len(words):
        # In pieces, so that the tables of powers stay small.
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + PIECE, side="right")) - 1)
        edges, part = offsets[low : high + 1] - offsets[low], data[offsets[low] : offsets[high]]
        power, inverse = _power_tables(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=sums[1:])
        out[low:high] = mixed((sums[edges[1:]] - sums[edges[:-1]]) * inverse[edges[:-1]] + np.diff(edges).astype(np.uint64))
        low = high
    return out


class Stripes(NamedTuple):
    words: pa.Array
    first: np.ndarray  # of each stripe: first word of the prefix, -1 for none
    second: np.ndarray  # second word of the prefix, -1 for none
    starts: np.ndarray  # where its entries begin, and the end of the last
    nexts: np.ndarray
    counts: np.ndarray


def _striped(words: pa.Array, first: np.ndarray, second: np.ndarray, nexts: np.ndarray, counts: np.ndarray) -> Stripes:
    """Stripes of entries that come sorted by prefix."""
    new = np.ones(len(nexts), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    at = np.flatnonzero(new)
    return Stripes(words, first[at], second[at], np.append(at, len(nexts)), nexts, counts)


def _planes(values: np.ndarray) -> bytes:
    """Non-negative integers in as few bytes each as the largest needs, lowest bytes first, so that zeros lie together."""
    width = next(w for w in (1, 2, 4, 8) if not len(values) or int(values.max()) < 1 << (8 * w))
    return bytes([width]) + values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _read_planes(raw: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    width = raw[at]
    whole = np.zeros((n, 8), np.uint8)
    whole[:, :width] = np.frombuffer(raw, np.uint8, width * n, at + 1).reshape(width, n).T
    return whole.view("<i8")[:, 0], at + 1 + width * n


def packed(stripes: Stripes) -> bytes:
    """As bytes, with only the words the stripes name."""
    used, numbers = np.unique(np.concatenate([stripes.first, stripes.second, stripes.nexts, [-1]]), return_inverse=True)
    n, m = len(stripes.first), len(stripes.nexts)
    words = pa.concat_arrays([stripes.words.take(pa.array(used[1:]))]).cast(pa.string())  # -1 is always the smallest
    _, offset_buffer, data_buffer = words.buffers()
    offsets = np.frombuffer(offset_buffer, np.int32)[: len(words) + 1]
    text = data_buffer.to_pybytes()[: offsets[-1]] if data_buffer is not None else b""
    step = np.diff(numbers[:n], prepend=0)
    parts = [
        np.diff(offsets), np.where(step < 0, -2 * step - 1, 2 * step), numbers[n : 2 * n], np.diff(stripes.starts), numbers[2 * n : 2 * n + m], stripes.counts,
    ]
    head = np.array([n, m, len(words)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(_planes(p) for p in parts) + text)


def unpacked(data: bytes) -> Stripes:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, m, v = np.frombuffer(raw, "<i8", 3).tolist()
    at, parts = 24, []
    for length in (v, n, n, n, m, m):
        values, at = _read_planes(raw, at, length)
        parts.append(values)
    lengths, step, second, sizes, nexts, counts = parts
    first = np.cumsum(np.where(step & 1, -(step + 1) // 2, step // 2))
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    words = pa.StringArray.from_buffers(v, pa.py_buffer(offsets), pa.py_buffer(raw[at:]))
    return Stripes(words, first - 1, second - 1, np.concatenate([[0], np.cumsum(sizes)]), nexts - 1, counts)


def merged(parts: list[Stripes]) -> Stripes:
    """Elementwise sum of stripes over words of their own."""
    words = pa.concat_arrays([p.words for p in parts]).dictionary_encode()
    number, v, at = np.asarray(words.indices).astype(np.int64), len(words.dictionary), 0
    heads, nexts, counts = [], [], []
    for p in parts:
        own = np.append(number[at : at + len(p.words)], -1)  # position -1 stands for no word
        at += len(p.words)
        heads.append(np.repeat((own[p.first] + 1) * (v + 1) + own[p.second] + 1, np.diff(p.starts)))
        nexts.append(own[p.nexts])
        counts.append(p.counts)
    head, owner = np.unique(np.concatenate(heads), return_inverse=True)
    key, total = _counted(owner.astype(np.int64) * v + np.concatenate(nexts), np.concatenate(counts))
    head = head[key // v]
    return _striped(words.dictionary, head // (v + 1) - 1, head % (v + 1) - 1, key % v, total)


FACTS = "lang string, w1 string, w2 string, w3 string, f long"


def _split(names: list[str]) -> tuple[list[str], list[str]]:
    parts = [n.rpartition("\t") for n in names]
    return [p[0] for p in parts], [p[2] for p in parts]


def _facts(words: pa.Array, columns: list[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
    """Rows of phrases given by word numbers, -1 for none, first word first."""
    langs, texts = None, []
    for numbers in columns:
        named = words.take(pa.array(numbers, pa.int64(), mask=numbers < 0)).to_pylist()
        lang, text = _split([n or "" for n in named])
        texts.append([t if n is not None else None for t, n in zip(text, named)])
        langs = langs or lang
    texts += [[None] * len(counts)] * (3 - len(texts))
    arrays = [pa.array(x, pa.string()) for x in (langs, *texts)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(counts, pa.int64())], names=["lang", "w1", "w2", "w3", "f"])


def _frequent(share: int, chunk: int):
    """Of every block the prefixes with one in ``share`` of its words, and its words per language (a row without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0), batch.column(1), chunk):
                limit = max(64, (len(block.ids) - block.fresh) // share)
                words = np.bincount(block.lang[block.ids[block.fresh :]], minlength=len(block.langs))
                some = np.flatnonzero(words)
                none = pa.nulls(len(some), pa.string())
                yield pa.RecordBatch.from_arrays([block.langs.take(pa.array(some)), none, none, none, pa.array(words[some])], names=["lang", "w1", "w2", "w3", "f"])
                for size in (1, 2):
                    parts, counts = _phrases(block, size)
                    often = counts >= limit
                    if often.any():
                        yield _facts(block.words, [p[often] for p in parts], counts[often])

    return run


def _dealt(bits: int, chunk: int, hot):
    """Packed stripes of every block, one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = hot.value
        hot_words = pa.array(named["words"], pa.string())
        for batch in batches:
            for block in blocks(batch.column(0), batch.column(1), chunk):
                hashes = string_hashes(block.words)
                known = np.asarray(pc.index_in(block.words, hot_words).fill_null(-1)).astype(np.int64)
                columns = []
                for size in (1, 2, 3):
                    parts, counts = _phrases(block, size)
                    prefix = np.full(len(counts), size, np.uint64)
                    for p in parts[:-1]:
                        prefix = mixed(prefix * np.uint64(31) + hashes[p])
                    if size == 1:
                        spread = np.ones(len(counts), bool)
                    elif size == 2:
                        spread = np.isin(known[parts[0]], named["ones"])
                    else:
                        pair = np.where((known[parts[0]] >= 0) & (known[parts[1]] >= 0), known[parts[0]] * (len(hot_words) + 1) + known[parts[1]], -1)
                        spread = np.isin(pair, named["twos"])
                    prefix[spread] = mixed(prefix[spread] + hashes[parts[-1]][spread])
                    head = [*parts[:-1], *[np.full(len(counts), -1, np.int32)] * (3 - size)]
                    columns.append(((prefix >> np.uint64(64 - bits)).astype(np.int32), *head, parts[-1], counts))
                columns = [np.concatenate(x) for x in zip(*columns)]
                order = np.argsort(columns[0], kind="stable")
                bucket, first, second, nexts, counts = (x[order] for x in columns)
                del columns, order
                edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket)).tolist()
                numbers, data = [], []
                for low, high in zip(edges[:-1], edges[1:]):
                    numbers.append(bucket[low])
                    data.append(packed(_striped(block.words, first[low:high], second[low:high], nexts[low:high], counts[low:high])))
                    if len(data) == 256 or high == len(bucket):
                        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "data"])
                        numbers, data = [], []

    return run


def _bucket_facts(min_count: int):
    """From rows sorted by bucket, the phrases of ``min_count`` occurrences or more."""

    def flushed(parts: list[Stripes]) -> Iterator[pa.RecordBatch]:
        if parts:
            whole = merged(parts)
            often = whole.counts >= min_count
            owner = np.repeat(np.arange(len(whole.first)), np.diff(whole.starts))[often]
            first, second, last, counts = whole.first[owner], whole.second[owner], whole.nexts[often], whole.counts[often]
            size = (first >= 0).astype(int) + (second >= 0)
            for k, columns in ((0, [last]), (1, [first, last]), (2, [first, second, last])):
                of = np.flatnonzero(size == k)
                for at in range(0, len(of), 1 << 16):
                    some = of[at : at + (1 << 16)]
                    yield _facts(whole.words, [c[some] for c in columns], counts[some])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, held = None, [], 0
        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bucket != current:
                    yield from flushed(parts)
                    current, parts, held = bucket, [], 0
                parts.append(unpacked(data.as_buffer()))
                held += len(parts[-1].nexts)
                if held > MERGE and len(parts) > 1:
                    parts = [merged(parts)]
                    # What is distinct stays; the next merge is due when as much has come again.
                    held = 0
        yield from flushed(parts)

    return run


def _hot_prefixes(frequent: DataFrame, words: int, share: int) -> dict:
    """Names of the hot prefixes; fewer than ``share`` of each length."""
    rows = frequent.where("w1 is not null").groupBy("lang", "w1", "w2").agg(F.sum("f").alias("f")).where(F.col("f") * share >= words).collect()
    names = sorted({f"{r.lang}\t{w}" for r in rows for w in (r.w1, r.w2) if w is not None})
    place = {w: k for k, w in enumerate(names)}
    ones = [place[f"{r.lang}\t{r.w1}"] for r in rows if r.w2 is None]
    twos = [place[f"{r.lang}\t{r.w1}"] * (len(names) + 1) + place[f"{r.lang}\t{r.w2}"] for r in rows if r.w2 is not None]
    return {"words": names, "ones": np.array(ones, np.int64), "twos": np.array(twos, np.int64)}


def _phrase(*words: str) -> Column:
    return F.concat_ws(" ", *words)


def frequent_phrases(
    docs: DataFrame, *, min_count: int = MIN_COUNT, text: str = "text", lang: str = "lang", hot_share: int = HOT, chunk: int = CHUNK,
) -> tuple[DataFrame, DataFrame]:
    """(lang, w1, w2, w3, f) of all phrases of one to three words with ``min_count`` occurrences, and (lang, n) of all words."""
    spark = docs.sparkSession
    source = docs.select(F.coalesce(F.col(lang), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text).alias("body"))
    frequent = write_through(source.mapInArrow(_frequent(hot_share, chunk), FACTS), "frequent")
    sizes = frequent.where("w1 is null").groupBy("lang").agg(F.sum("f").alias("n"))
    words = sizes.agg(F.sum("n")).first()[0] or 0
    hot = spark.sparkContext.broadcast(_hot_prefixes(frequent, words, hot_share))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = (BUCKETS * partitions - 1).bit_length()
    stripes = source.mapInArrow(_dealt(bits, chunk, hot), "bucket int, data binary")
    facts = stripes.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(_bucket_facts(min_count), FACTS)
    return write_through(facts, "phrases"), sizes


def collocations(
    docs: DataFrame, *, min_count: int = MIN_COUNT, cover_percent: int = COVER_PERCENT, top: int = TOP, text: str = "text", lang: str = "lang",
    hot_share: int = HOT, chunk: int = CHUNK,
) -> DataFrame:
    """Each language's ``top`` phrases of two and three words: lang, rank, phrase, a, l, r, n, score.

    A null text is empty, a null language is ``und``. Texts of any length are read whole; phrases do not reach beyond
    ``.,;:!?`` and line ends. Repeated rows count as often as they come. Equal scores go by a, then by the phrase's
    bytes, so ranks are unique and reruns agree. An empty table gives no rows; other columns are not read. An action: the
    frequent phrases are written below the shared folder.
    """
    facts, sizes = frequent_phrases(docs, min_count=min_count, text=text, lang=lang, hot_share=hot_share, chunk=chunk)
    known = facts.where("w3 is null").select("lang", _phrase("w1", "w2").alias("part"), "f")
    pairs, triples = facts.where("w2 is not null and w3 is null"), facts.where("w3 is not null")
    cut = lambda k, first, rest: F.struct(F.lit(k).alias("k"), first.alias("first"), rest.alias("rest"))
    cuts = pairs.select("lang", _phrase("w1", "w2").alias("phrase"), F.col("f").alias("a"), F.array(cut(1, F.col("w1"), F.col("w2"))).alias("cuts")).unionAll(
        triples.select("lang", _phrase("w1", "w2", "w3").alias("phrase"), F.col("f").alias("a"), F.array(
            cut(1, F.col("w1"), _phrase("w2", "w3")), cut(2, _phrase("w1", "w2"), F.col("w3")),
        ).alias("cuts"))
    ).select("lang", "phrase", "a", F.inline("cuts"))
    scored = (
        cuts.join(known.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
        .join(known.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
        # Decimals of 38 digits: counts below 10^16 are exact.
        .withColumn("score", F.expr("(1000000BD * (cast(a as decimal(16, 0)) * cast(a as decimal(16, 0)))) div (cast(l as decimal(16, 0)) * cast(r as decimal(16, 0)))"))
    )
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # Of a pair's extensions by a word on either side the most frequent one decides.
    ends = triples.select("lang", "f", F.explode(F.array(_phrase("w1", "w2"), _phrase("w2", "w3"))).alias("phrase"))
    covering = ends.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = lowest.join(covering, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {cover_percent} * a")
    ranked = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First within parts of a language, so that no task sorts a whole one.
    salted = ranked.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_SALTS)))
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    final = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return final.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

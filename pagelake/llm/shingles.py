"""Word and shingle hashes of Arrow text columns, in numpy over the raw UTF-8 bytes.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. Its hash is a
polynomial over the ring of 64-bit integers, finished by a mixer; no Python object is made per word.
A text of any length is hashed whole: it is cut at white space only to bound the working memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse; both are kept for the life of the worker."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        inverse = pow(int(BASE), -1, 1 << 64)
        tables = []
        for base in (int(BASE), inverse):
            steps = np.full(max(n, PIECE + 1), base, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers = tables[0], tables[1]
    return _powers


def _hash_range(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first byte positions of the words in ``data``; a word never spans a position in ``breaks``."""
    n = len(data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~space
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    cut = breaks[(breaks > 0) & (breaks < n)]
    if len(cut):
        first[cut] |= inside[cut + 1]
        last[cut - 1] |= inside[cut]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    lower = data.astype(np.uint64)
    lower[(data >= 65) & (data <= 90)] += np.uint64(32)
    lower += np.uint64(1)
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(lower * power[:n], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * inverse[starts]
    return mixed(raw + (ends - starts).astype(np.uint64) * MIX_2), starts


def hashed_words(texts: pa.Array, piece: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks ``(first row, last row, hashes, bounds)``: row ``first + k`` has the words ``hashes[bounds[k]:bounds[k+1]]``.

    A null or empty text has no words. A block holds about ``piece`` bytes, or one longer text.
    """
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    n = len(texts)
    if not n:
        return
    _, offsets_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offsets_buffer, dtype=np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    valid = np.ones(n, bool) if texts.null_count == 0 else np.asarray(texts.is_valid())
    row = 0
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + piece, side="right")) - 1
        stop = min(max(stop, row + 1), n)
        low, high = int(offsets[row]), int(offsets[stop])
        hashes, positions, at = [], [], low
        while at < high:
            end = min(at + piece, high)
            if end < high:
                # Only a single longer text is cut, at its last white space; a longer word is taken whole.
                window = data[at:end]
                spaces = np.flatnonzero((window == 32) | ((window >= 9) & (window <= 13)))
                if len(spaces):
                    end = at + int(spaces[-1]) + 1
                else:
                    rest = data[end:high]
                    spaces = np.flatnonzero((rest == 32) | ((rest >= 9) & (rest <= 13)))
                    end = end + int(spaces[0]) + 1 if len(spaces) else high
            h, p = _hash_range(data[at:end], offsets[row : stop + 1] - at)
            hashes.append(h)
            positions.append(p + at)
            at = end
        words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        where = np.concatenate(positions) if positions else np.zeros(0, np.int64)
        bounds = np.searchsorted(where, offsets[row : stop + 1])
        if not valid[row:stop].all():
            keep = np.repeat(valid[row:stop], np.diff(bounds))
            words = words[keep]
            bounds = np.concatenate([[0], np.cumsum(np.where(valid[row:stop], np.diff(bounds), 0))])
        yield row, stop, words, bounds
        row = stop


def shingled(words: np.ndarray, bounds: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words inside each row, with their bounds.

    A row with fewer words, but at least one, gives its whole sequence as one shingle.
    """
    counts = np.diff(bounds)
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    multipliers = mixed(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(min(size, n)):
        total[: n - k] += words[k:] * multipliers[k]
    within = np.arange(n) - np.repeat(bounds[:-1], counts)
    length = np.repeat(counts, counts)
    keep = within + size <= length
    short = np.flatnonzero((counts > 0) & (counts < size))
    for row in short:
        at = bounds[row]
        run = words[at : at + counts[row]]
        with np.errstate(over="ignore"):
            total[at] = (run * multipliers[: len(run)]).sum(dtype=np.uint64) + np.uint64(len(run))
        keep[at] = True
    kept = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    return mixed(total[keep]), np.concatenate([[0], np.cumsum(kept)])

"""Token-id files: independent zstandard frames, a document index, and a trailing seek table with checksums.

Layout of a file, all numbers little-endian:

* Data frames. The ids of the file's documents, as unsigned 32-bit integers one after another, are cut into
  runs of ``FRAME_IDS`` ids; each run is a zstandard frame of its own.
* A skippable frame (magic 0x184D2A50) with the compressed document index: the count, then per document its
  id, whether the id is null, and its number of ids.
* A skippable frame (magic 0x184D2A5E) with the seek table of the public zstandard seekable format: per frame
  (index frame included) its compressed size, decompressed size and the low 32 bits of its XXH64, then the
  number of frames, a descriptor byte and the magic 0x8F92EAB1.

Any zstandard decoder reads a file as the plain stream of ids. A reader that wants some documents reads the
tail, then only the frames that hold them.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.session import shared_folder, small_batches

FRAME_IDS = 65_536
END_ID = 2
LEVEL = 3
INDEX_MAGIC, SEEK_MAGIC, FOOT_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
MEMO_WORDS = 400_000
MEMO_CHARS = 48
TEXT_CHARS = 1 << 19


#: The tokenizer's own pre-tokens, for lower-cased text of the first 256 code points, which its normalizer leaves as it is.
PRE_TOKENS = re.compile(r"[a-zªµºß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9²³¹¼½¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")

WORDS = re.compile("[a-zªµºß-öø-ÿ]+")
# The configuration that the pre-tokens above are made for. Files that differ in any of it are encoded whole.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def by_pre_tokens(tokenizer_file: str) -> bool:
    """Whether the file's tokenizer splits texts as ``PRE_TOKENS`` does, gives each piece ids of its own, and finds added tokens by ``<|``."""
    with open(tokenizer_file, encoding="utf-8") as source:
        config = json.load(source)
    return (
        config.get("normalizer") == NORMALIZER and config.get("pre_tokenizer") == PRE_TOKENIZER and not config.get("truncation") and not config.get("padding")
        and all(config["model"].get(key) == value for key, value in MODEL.items()) and all(t["content"].startswith("<|") for t in config.get("added_tokens") or [])
    )


class WordMemo:
    """Ids of whole texts, by way of the ids of their pre-tokens, which do not depend on each other.

    Words are learned by the same BPE model without the normalizer, many in one call; pieces that hold rarer
    characters go through the whole tokenizer. Known pieces are kept up to a bound, then learned afresh. Tokenizers of another
    configuration than the pre-tokens are made for encode every text whole.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Sequence
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit
        from tokenizers.pre_tokenizers import Sequence as Steps

        self.by_pieces = by_pre_tokens(tokenizer_file)
        self.whole = Tokenizer.from_file(tokenizer_file)
        # Of the same model, which is held once.
        self.ascii, self.latin = Tokenizer(self.whole.model), Tokenizer(self.whole.model)
        for plain in (self.ascii, self.latin):
            plain.normalizer = Sequence([])
        self.ascii.pre_tokenizer = WhitespaceSplit()
        self.latin.pre_tokenizer = Steps([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[str, bytes] = {}

    def _words(self, tokenizer, words: list[str]) -> None:
        for at in range(0, len(words), 500):
            some = words[at : at + 500]
            encoded = tokenizer.encode(" ".join(some), add_special_tokens=False)
            data = np.array(encoded.ids, dtype="<u4").tobytes()
            edges = (4 * np.flatnonzero(np.diff(np.array(encoded.word_ids), prepend=-1, append=len(some)))).tolist()
            self.known.update((word, data[low:high]) for word, low, high in zip(some, edges, edges[1:]))

    def _learn(self, missing: set[str]) -> None:
        plain = [piece for piece in missing if piece.isalpha() and piece.isascii() and piece.islower()]
        other = missing.difference(plain)
        latin = [piece for piece in other if WORDS.fullmatch(piece)]
        self._words(self.ascii, plain)
        self._words(self.latin, latin)
        odd = list(other.difference(latin))
        for piece, encoded in zip(odd, self.whole.encode_batch(odd, add_special_tokens=False)):
            self.known[piece] = np.array(encoded.ids, dtype="<u4").tobytes()

    def _pieces(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if " " not in text:
                return [text]
            return [piece for part in text.split(" ") if part for piece in self._pieces(part)]
        if "<|" in text:  # may spell a special token, which the whole tokenizer finds first
            return [text]
        return PRE_TOKENS.findall(text.lower())

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        if not self.by_pieces:
            for encoded in self.whole.encode_batch(texts, add_special_tokens=False):
                yield np.array(encoded.ids, dtype="<u4").tobytes()
            return
        split = [self._pieces(text) for text in texts]
        missing = set().union(*split).difference(self.known)
        self._learn(missing)
        for pieces in split:
            yield b"".join(map(self.known.__getitem__, pieces))
        for piece in missing:
            if len(piece) > MEMO_CHARS:
                del self.known[piece]
        if len(self.known) > MEMO_WORDS:
            self.known = {}


_memo: dict[str, WordMemo] = {}


def memo(tokenizer_file: str) -> WordMemo:
    """One memo per worker process, so that the tokenizer is loaded once; each task empties it when it is done."""
    if tokenizer_file not in _memo:
        _memo[tokenizer_file] = WordMemo(tokenizer_file)
    return _memo[tokenizer_file]


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class FrameWriter:
    def __init__(self, sink):
        self.sink, self.pending, self.size = sink, [], 0
        self.compress = zstandard.ZstdCompressor(level=LEVEL).compress
        self.frames: list[tuple[int, int, int]] = []
        self.documents: list[tuple[int | None, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.documents.append((doc_id, len(ids) // 4))
        self.pending.append(ids)
        self.size += len(ids)
        if self.size >= 4 * FRAME_IDS:
            data = b"".join(self.pending)
            whole = len(data) - len(data) % (4 * FRAME_IDS)
            for at in range(0, whole, 4 * FRAME_IDS):
                self._frame(data[at : at + 4 * FRAME_IDS])
            self.pending, self.size = [data[whole:]], len(data) - whole

    def _frame(self, data: bytes) -> None:
        packed = self.compress(data)
        self.sink.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self) -> tuple[int, int]:
        if self.size:
            self._frame(b"".join(self.pending))
        ids = np.array([i or 0 for i, _ in self.documents], "<i8").tobytes()
        nulls = np.array([i is None for i, _ in self.documents], "u1").tobytes()
        lengths = np.array([n for _, n in self.documents], "<u8").tobytes()
        index = struct.pack("<Q", len(self.documents)) + ids + nulls + lengths
        packed = self.compress(index)
        self.sink.write(struct.pack("<II", INDEX_MAGIC, len(packed)) + packed)
        self.frames.append((len(packed) + 8, 0, xxhash.xxh64_intdigest(index) & 0xFFFFFFFF))
        table = b"".join(struct.pack("<III", *frame) for frame in self.frames)
        foot = struct.pack("<IBI", len(self.frames), CHECKSUMS, FOOT_MAGIC)
        self.sink.write(struct.pack("<II", SEEK_MAGIC, len(table) + len(foot)) + table + foot)
        return len(self.documents), sum(n for _, n in self.documents)


class TokenFile:
    """Reads the tail of a file, then single frames as they are asked for."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        count, descriptor, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != FOOT_MAGIC or descriptor != CHECKSUMS:
            raise ValueError("no seek table at the end of the file")
        table = self._at(end - 9 - 12 * count, 12 * count)
        frames = np.frombuffer(table, "<u4").reshape(count, 3).astype(np.int64)
        self.frames, self.starts = frames, np.concatenate([[0], np.cumsum(frames[:, 0])])
        packed = self._at(int(self.starts[count - 1]) + 8, int(frames[-1, 0]) - 8)
        index = zstandard.ZstdDecompressor().decompress(packed)
        self._check(index, count - 1)
        n = struct.unpack_from("<Q", index)[0]
        ids = np.frombuffer(index, "<i8", n, 8)
        nulls = np.frombuffer(index, "u1", n, 8 + 8 * n)
        self.lengths = np.frombuffer(index, "<u8", n, 8 + 9 * n).astype(np.int64)
        self.ids = [None if null else int(i) for i, null in zip(ids, nulls)]
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.frames_read = 0
        self._last: tuple[int, bytes] = (-1, b"")

    def _at(self, position: int, size: int) -> bytes:
        self.source.seek(position)
        return self.source.read(size)

    def _check(self, data: bytes, frame: int) -> None:
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.frames[frame, 2]:
            raise ValueError(f"frame {frame} does not have its checksum")

    def _frame(self, frame: int) -> bytes:
        if self._last[0] != frame:
            packed = self._at(int(self.starts[frame]), int(self.frames[frame, 0]))
            data = zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(self.frames[frame, 1]))
            self._check(data, frame)
            self.frames_read += 1
            self._last = frame, data
        return self._last[1]

    def pieces(self, position: int) -> Iterator[bytes]:
        """The id bytes of the document at ``position``, frame by frame."""
        at, stop = 4 * int(self.offsets[position]), 4 * int(self.offsets[position + 1])
        while at < stop:
            frame, skip = divmod(at, 4 * FRAME_IDS)
            piece = self._frame(frame)[skip : skip + stop - at]
            yield piece
            at += len(piece)

    def document(self, doc_id: int | None) -> np.ndarray:
        return np.frombuffer(b"".join(self.pieces(self.ids.index(doc_id))), "<u4")


def write_token_files(docs: DataFrame, tokenizer_file: str, folder: str, end_id: int = END_ID) -> list[dict]:
    """Encode every text (null: empty), append ``end_id``, and write the ids in ascending order of doc_id.

    An action. The documents are dealt by ranges of doc_id, so file k holds smaller ids than file k + 1; null ids
    come first and equal ids stand by text. The returned list has one entry per file, as Spark itself keeps one
    entry per task; no entry grows with the rows. An attempt writes a file of its own name and only the files of
    attempts that succeeded are listed, so lost executors and repeated tasks leave no double rows.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            sizes = pc.utf8_length(texts).to_pylist()
            at = 0
            while at < len(ids):
                stop, chars = at, 0
                while stop < len(ids) and (stop == at or chars < TEXT_CHARS):
                    chars += sizes[stop]
                    stop += 1
                if writer is None:
                    context = TaskContext.get()
                    path = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}.ids"
                    system, local = filesystem(path)
                    system.create_dir(local.rsplit("/", 1)[0], recursive=True)
                    sink = system.open_output_stream(local)
                    writer = FrameWriter(sink)
                    encode = memo(tokenizer_file)
                end = struct.pack("<I", end_id)
                for doc_id, encoded in zip(ids[at:stop], encode.encode(texts.slice(at, stop - at).to_pylist())):
                    writer.add(doc_id, encoded + end)
                at = stop
        if writer is not None:
            n_docs, n_ids = writer.close()
            sink.close()
            encode.known = {}  # the worker lives on, but holds nothing for the next stage
            yield pa.RecordBatch.from_pylist([{"file": context.partitionId(), "path": path, "n_docs": n_docs, "n_ids": n_ids}])

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    )
    with small_batches(docs.sparkSession):
        files = ordered.mapInArrow(write, "file long, path string, n_docs long, n_ids long").collect()
    start, out = 0, []
    for row in sorted(files, key=lambda r: r["file"]):
        out.append({"path": row["path"], "start": start, "n_docs": row["n_docs"], "n_ids": row["n_ids"]})
        start += row["n_ids"]
    return out


def read_token_files(spark: SparkSession, files: list[dict]) -> DataFrame:
    """Per document of the files: doc_id, start among all ids, n_tokens, and the CRC-32 of its id bytes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, local = filesystem(row["path"])
                with system.open_input_file(local) as source:
                    tokens = TokenFile(source)
                    checks = []
                    for position in range(len(tokens.ids)):
                        crc = 0
                        for piece in tokens.pieces(position):
                            crc = zlib.crc32(piece, crc)
                        checks.append(crc)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(tokens.ids, pa.int64()), pa.array(tokens.offsets[:-1] + row["start"], pa.int64()),
                         pa.array(tokens.lengths, pa.int64()), pa.array(checks, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    listed = spark.createDataFrame([(f["path"], f["start"]) for f in files], "path string, start long")
    spread = listed.repartition(max(1, len(files)), "path") if files else listed
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, tokenizer_file: str, folder: str | None = None) -> DataFrame:
    """Write token files (into a new shared folder unless one is named) and describe every document read back."""
    spark = docs.sparkSession
    return read_token_files(spark, write_token_files(docs, tokenizer_file, folder or shared_folder(spark, "token-ids")))

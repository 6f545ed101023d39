"""Packed page archives: many pages in few files, read by byte ranges and URL.

An archive is a folder of pack files and a manifest. A pack holds the HTML of its pages back to back, in the order of
their URLs, and behind it an offset table (URL, start, length). The manifest, one row a pack, says which range of URLs a
pack has and where its table is. It is written last, so packs of tasks that failed or ran twice are not part of the archive.

``read_archive`` is a Python data source. It plans byte ranges of packs, leaves out packs that no wanted URL can be in, and
reads of the others only the tables and the ranges that hold wanted pages.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith,
)

MAGIC = b"PAGEPACK"
PACK_BYTES = 256 << 20
SPLIT_BYTES = 64 << 20
#: Ranges with less than this between them are fetched as one; no batch is larger than this unless a page is.
GAP, BATCH_BYTES = 1 << 16, 8 << 20
MANIFEST = "pack string, pages long, first_url string, last_url string, body long, size long"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class _PackWriter:
    def __init__(self, folder: str) -> None:
        self.files, root = _open(folder)
        self.files.create_dir(root, recursive=True)
        self.name = f"pack-{uuid.uuid4().hex}.bin"
        self.sink = self.files.open_output_stream(f"{root}/{self.name}")
        self.urls, self.lengths, self.body = [], [], 0

    def add(self, url: str, html: bytes) -> None:
        self.sink.write(html)
        self.urls.append(url)
        self.lengths.append(len(html))
        self.body += len(html)

    def close(self) -> dict:
        table = pa.RecordBatch.from_arrays([pa.array(self.urls, pa.string()), pa.array(self.lengths, pa.int64())], names=["url", "length"])
        out = pa.BufferOutputStream()
        with pa.ipc.new_file(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(table)
        data = out.getvalue().to_pybytes()
        self.sink.write(data + struct.pack("<Q", len(data)) + MAGIC)
        self.sink.close()
        return {
            "pack": self.name, "pages": len(self.urls), "first_url": self.urls[0], "last_url": self.urls[-1], "body": self.body, "size": self.body + len(data) + 16,
        }


def write_archive(pages: DataFrame, path: str, *, url: str = "url", html: str = "html", packs: int | None = None, pack_bytes: int = PACK_BYTES) -> None:
    """Pack pages (url, html) by ranges of URLs. Rows without a URL cannot be asked for and are left out; a null page is empty."""
    spark = pages.sparkSession
    rows = pages.select(F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("html")).where("url is not null")
    parts = packs or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = None
        for batch in batches:
            for one_url, body in zip(batch.column(0), batch.column(1)):
                pack = pack or _PackWriter(path)
                pack.add(one_url.as_py(), body.as_py())
                if pack.body >= pack_bytes:
                    yield pa.RecordBatch.from_pylist([pack.close()])
                    pack = None
        if pack:
            yield pa.RecordBatch.from_pylist([pack.close()])

    rows.repartitionByRange(parts, "url").sortWithinPartitions("url").mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")


def _as_test(wanted: Filter) -> tuple[Callable[[str, str], bool], Callable[[pa.Array], pa.Array]] | None:
    """A filter on the URL as a test of a pack's range and one of a column of URLs; None where it is of another kind.

    URLs are compared by their bytes, as Spark does.
    """
    if getattr(wanted, "attribute", None) != ("url",):
        return None
    raw = lambda urls: urls.cast(pa.binary())
    value = getattr(wanted, "value", None)
    key = value.encode() if isinstance(value, str) else value
    if isinstance(wanted, EqualTo):
        return lambda low, high: low <= key <= high, lambda urls: pc.equal(raw(urls), key)
    if isinstance(wanted, In):
        keys = sorted(v.encode() for v in wanted.value if v is not None)
        return lambda low, high: any(low <= k <= high for k in keys), lambda urls: pc.is_in(raw(urls), pa.array(keys, pa.binary()))
    if isinstance(wanted, StringStartsWith):
        return lambda low, high: low[: len(key)] <= key <= high[: len(key)] or low <= key <= high, lambda urls: pc.starts_with(urls, value)
    for kind, of_range, of_urls in (
        (GreaterThan, lambda low, high: high > key, pc.greater), (GreaterThanOrEqual, lambda low, high: high >= key, pc.greater_equal),
        (LessThan, lambda low, high: low < key, pc.less), (LessThanOrEqual, lambda low, high: low <= key, pc.less_equal),
    ):
        if type(wanted) is kind:
            return of_range, lambda urls, of_urls=of_urls: of_urls(raw(urls), key)
    return None


class PackRange(InputPartition):
    """Pages of a pack that begin between two byte positions."""

    def __init__(self, pack: str, low: int, high: int, body: int, size: int) -> None:
        super().__init__((pack, low, high))
        self.pack, self.low, self.high, self.body, self.size = pack, low, high, body, size


class WholeArchiveReader(DataSourceReader):
    """Reads every page. Spark refuses readers that take filters in sessions that push none, so this one takes none."""

    def __init__(self, path: str, split_bytes: int) -> None:
        self.path, self.split_bytes, self.filters = path, split_bytes, []

    def partitions(self) -> list[PackRange]:
        files, root = _open(f"{self.path}/manifest")
        # One row a pack, as many as files that a listing would name.
        manifest = pq.read_table(root, filesystem=files).to_pylist()
        tests, ranges = [_as_test(f)[0] for f in self.filters], []
        for pack in manifest:
            if all(test(pack["first_url"].encode(), pack["last_url"].encode()) for test in tests):
                for low in range(0, max(pack["body"], 1), self.split_bytes):
                    ranges.append(PackRange(pack["pack"], low, low + self.split_bytes, pack["body"], pack["size"]))
        return ranges

    def read(self, part: PackRange | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # Spark's stand-in where there is nothing to read
            return
        files, root = _open(self.path)
        with files.open_input_file(f"{root}/{part.pack}") as source:
            tail = source.read_at(part.size - part.body, part.body)
            if tail[-8:] != MAGIC:
                raise ValueError(f"{part.pack} is not whole")
            table = pa.ipc.open_file(pa.BufferReader(tail[:-16])).read_all().combine_chunks()
            urls = table.column("url").combine_chunks()
            lengths = np.asarray(table.column("length"))
            starts = np.cumsum(lengths) - lengths
            # A page that begins at the very end is empty and belongs to the last range.
            last = part.high >= part.body
            wanted = (starts >= part.low) & ((starts < part.high) | last)
            for f in self.filters:
                wanted &= np.asarray(_as_test(f)[1](urls).fill_null(False))
            for some in _runs(np.flatnonzero(wanted), starts, lengths):
                low, high = int(starts[some[0]]), int(starts[some[-1]] + lengths[some[-1]])
                data = pa.py_buffer(source.read_at(high - low, low))
                pages = [data.slice(int(starts[k]) - low, int(lengths[k])).to_pybytes() for k in some]
                yield pa.RecordBatch.from_arrays([urls.take(pa.array(some)), pa.array(pages, pa.binary()).cast(pa.string())], names=["url", "html"])


class PageArchiveReader(WholeArchiveReader):
    """Reads the pages that filters on the URL leave."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for wanted in filters:
            if _as_test(wanted):
                self.filters.append(wanted)
            else:
                yield wanted


def _runs(rows: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Rows whose pages lie close together, as much of them as a batch may hold."""
    at = 0
    while at < len(rows):
        end, base = at + 1, starts[rows[at]]
        while end < len(rows) and starts[rows[end]] - (starts[rows[end - 1]] + lengths[rows[end - 1]]) <= GAP and starts[rows[end]] + lengths[rows[end]] - base <= BATCH_BYTES:
            end += 1
        yield rows[at:end]
        at = end


class PageArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pagearchive"

    def schema(self) -> str:
        return "url string, html string"

    def reader(self, schema) -> WholeArchiveReader:
        kind = PageArchiveReader if self.options.get("takefilters") == "true" else WholeArchiveReader
        return kind(self.options["path"].rstrip("/"), int(self.options.get("splitbytes", SPLIT_BYTES)))


def read_archive(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(url, html) of an archive. Filters on ``url`` choose packs and byte ranges where
    ``spark.sql.python.filterPushdown.enabled`` is set; else Spark applies them to all pages. The session is asked here, once."""
    spark.dataSource.register(PageArchive)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower()
    return spark.read.format("pagearchive").option("splitBytes", str(split_bytes)).option("takeFilters", pushed).load(path)

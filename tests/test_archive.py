"""Packed archives give what separate files give, and read only what is asked for."""

import os

import pytest

from pagelake.sources import archive
from pagelake.sources.archive import PageArchiveReader, read_archive, write_archive
from pagelake.sources.snapshots import read_html_files

PAGES = [(f"http://h/{k:03d}", f"<p>page {k} é😀</p>" * (k % 7) if k % 7 != 3 else None) for k in range(200)] + [("http://h/ä", "x"), ("http://h/010", "twice"), (None, "lost")]


@pytest.fixture(scope="module")
def packed(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('archive')}/a"
    write_archive(spark.createDataFrame(PAGES, "url string, html string").repartition(5), path, packs=4, pack_bytes=2_000)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield path
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def rows(frame):
    return sorted((r.url, r.html) for r in frame.collect())


def test_all_pages_come_back_whatever_the_split(spark, packed):
    want = sorted((u, h or "") for u, h in PAGES if u is not None)
    for split in (700, 1 << 26):
        assert rows(read_archive(spark, packed, split)) == want


CONDITIONS = [
    "url = 'http://h/010'", "url in ('http://h/003', 'http://h/150', 'http://nowhere')", "startswith(url, 'http://h/01')", "url > 'http://h/120' and url <= 'http://h/131'",
    "url >= 'http://h/199'", "url < 'http://a'", "html like '%page 5%' and url < 'http://h/060'", "url like '%7%'",
]


@pytest.mark.parametrize("condition", CONDITIONS)
def test_filters_give_what_filtering_all_pages_gives(spark, packed, condition):
    every = spark.createDataFrame([(u, h or "") for u, h in PAGES], "url string, html string")
    assert rows(read_archive(spark, packed, 3000).where(condition)) == rows(every.where(condition))


def test_only_packs_and_ranges_that_can_hold_the_pages_are_read(packed, monkeypatch):
    reader = PageArchiveReader(packed, 1 << 26)
    every = reader.partitions()
    assert len(every) > 6
    assert list(reader.pushFilters([archive.EqualTo(("url",), "http://h/100"), archive.EqualTo(("html",), "x")])) == [archive.EqualTo(("html",), "x")]
    some = reader.partitions()
    assert len(some) == 1
    (batch,) = reader.read(some[0])
    assert batch.column(0).to_pylist() == ["http://h/100"]


def test_packs_that_are_not_in_the_manifest_do_not_count(spark, packed):
    before = rows(read_archive(spark, packed))
    stray = archive._PackWriter(packed)
    stray.add("http://h/000", b"stray")
    stray.close()
    assert rows(read_archive(spark, packed)) == before


def test_an_archive_of_files_equals_the_files(spark, tmp_path):
    os.mkdir(tmp_path / "in")
    for k in range(12):
        (tmp_path / "in" / f"{k}.html").write_bytes(f"<h1>é {k}</h1>".encode() + (b"\xff" if k % 2 else b""))
    files = read_html_files(spark, str(tmp_path / "in"))
    write_archive(files, f"file://{tmp_path}/a", url="path")
    assert rows(read_archive(spark, f"file://{tmp_path}/a")) == sorted((r.path, r.html) for r in files.collect())


def test_an_empty_archive(spark, tmp_path):
    write_archive(spark.createDataFrame([], "url string, html string"), f"file://{tmp_path}/a")
    assert read_archive(spark, f"file://{tmp_path}/a").collect() == []


@pytest.mark.parametrize("condition", CONDITIONS)
def test_sessions_that_push_no_filters_read_the_same(spark, packed, condition):
    every = spark.createDataFrame([(u, h or "") for u, h in PAGES], "url string, html string")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    try:
        assert rows(read_archive(spark, packed, 3000).where(condition)) == rows(every.where(condition))
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

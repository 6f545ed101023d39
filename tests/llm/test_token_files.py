"""Round trips of token-id files against the tokenizer itself."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagelake.llm import token_files
from pagelake.llm.token_files import TokenFile, WordMemo, filesystem, token_digest, write_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Hello, wörld it's 12.5%\nnew line", None, "", "  \n ", "İX ΑΣ. <|endoftext|>y 日本語。 I'LL", "a\xa0b ½ é́ don't", "same same same", "same same same",
    "word " * 3000,
]


def brute(text):
    ids = Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, 2], "<u4")


def test_memo_equals_the_tokenizer_for_every_first_character():
    memo, whole = WordMemo(PATH), Tokenizer.from_file(PATH)
    texts = [shape % chr(c) for c in range(0x250) for shape in ("a%sb", "a %s b", "%sA", "!%s1", "%s's")]
    assert [np.frombuffer(b, "<u4").tolist() for b in memo.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_round_trip_with_small_frames(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(k, t, 7) for k, t in enumerate(TEXTS)] + [(None, "null id", 7), (3, "again", 7)], "doc_id long, text string, start long")
    rows = token_digest(docs, PATH, f"file://{tmp_path}/t").collect()
    expected = sorted([(k, t) for k, t in enumerate(TEXTS)] + [(3, "again")], key=lambda x: (x[0], x[1] or ""))
    expected = [(None, "null id"), *expected]
    start, want = 0, []
    for k, t in expected:
        ids = brute(t)
        want.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    key = lambda r: (r[1],)
    assert sorted(map(tuple, rows), key=key) == want


def test_a_reader_opens_only_the_frames_it_needs_and_checks_them(spark, tmp_path):
    docs = spark.range(400).selectExpr("id as doc_id", "repeat('alpha beta ', 1000) as text").coalesce(1)
    files = write_token_files(docs, PATH, f"file://{tmp_path}/t")
    system, local = filesystem(files[0]["path"])
    with system.open_input_file(local) as source:
        tokens = TokenFile(source)
        assert len(tokens.frames) > 5
        assert tokens.document(tokens.ids[100]).tolist() == brute("alpha beta " * 1000).tolist()
        assert tokens.frames_read <= 2
    data = bytearray(open(local, "rb").read())
    data[int(tokens.frames[0, 0]) // 2] ^= 1
    open(local, "wb").write(data)
    with system.open_input_file(local) as source, pytest.raises(Exception):
        TokenFile(source).document(0)


def test_no_documents(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_digest(empty, PATH, f"file://{tmp_path}/t").collect() == []


def test_memo_stays_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "MEMO_WORDS", 10)
    memo = WordMemo(PATH)
    for k in range(5):
        list(memo.encode([f"{a}{k}" for a in ("one", "two", "three", "four")] + ["x" * 100]))
    assert len(memo.known) <= 10 + 8


def test_other_tokenizers_encode_whole_texts():
    assert token_files.by_pre_tokens(PATH)
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert not token_files.by_pre_tokens(other)
    memo, whole = WordMemo(other), Tokenizer.from_file(other)
    texts = [t for t in TEXTS if t] + ["Tabs\tand  runs   of spaces", "UPPER lower's 123"]
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in memo.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_writers_hold_few_texts_and_one_model(spark, tmp_path, monkeypatch):
    """A writer is given 512 documents at most at once, also in sessions of larger batches, which keep their bound."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        docs = spark.range(3000).selectExpr("id as doc_id", "'alpha beta ' || id as text").coalesce(1)
        seen = spark.sparkContext.accumulator(0)

        class Counted(token_files.WordMemo):
            def encode(self, texts):
                seen.add(len(texts) > 512)
                return super().encode(texts)

        monkeypatch.setattr(token_files, "memo", Counted)
        rows = token_digest(docs, PATH, f"file://{tmp_path}/t").collect()
        assert len(rows) == 3000 and seen.value == 0 and spark.conf.get(key) == "10000"
    finally:
        spark.conf.set(key, before)
    memo = WordMemo(PATH)
    memo.whole.model.dropout = 0.5
    assert memo.ascii.model.dropout == memo.latin.model.dropout == 0.5

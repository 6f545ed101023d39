"""Every stage of the pipeline against a plain version of it, on the smallest tables."""

import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from corpus_pipeline import COLUMNS, STAGES

SF = "/root/testdata/sf0.001"


def grams(text):
    words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs.collect())
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, SF).write.parquet(f"file://{folder}/{k}")
        docs = spark.read.parquet(f"file://{folder}/{k}")
        out.append(docs.collect())
        if k < len(STAGES) - 1:
            assert tuple(docs.columns) == COLUMNS
    return out


def test_language_keeps_clean_documents(stages):
    kept = {r.doc_id for r in stages[1]}
    assert len(kept) >= 0.98 * len(stages[0])
    assert all(any(map(str.isalpha, r.text)) for r in stages[1])


def test_one_of_each_group_stays(stages):
    sets = {r.doc_id: grams(r.text) for r in stages[1]}
    low = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and low[a] != low[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
                    changed = True
    assert sorted(r.doc_id for r in stages[2]) == sorted(d for d in sets if low[d] == d)


def test_leaks_go(stages):
    items = [grams(t) for (t,) in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()]
    clean = [r.doc_id for r in stages[2] if not any(i and 100 * len(i & grams(r.text)) >= 75 * len(i) for i in items)]
    assert sorted(r.doc_id for r in stages[3]) == sorted(clean)


def test_mix_repeats_at_most_twice(stages):
    before = {r.doc_id: r for r in stages[3]}
    times = {}
    for r in stages[4]:
        assert tuple(r) == tuple(before[r.doc_id])
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) == 2
    words = lambda rows: sum(len(r.text.split()) for r in rows)
    assert 0.9 <= words(stages[4]) / (1.5 * words(stages[3])) <= 1.0


def test_tokens(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at, want = 0, []
    for r in sorted(stages[4], key=lambda r: r.doc_id):
        ids = np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, stages[5]), key=lambda r: r[1]) == want


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[5]))

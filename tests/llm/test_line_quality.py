"""The chain's marginals against enumeration, and quality on held-out documents."""

import itertools

import numpy as np

from pagelake.llm.crf import expectations, marginals
from pagelake.llm.line_quality import learned_line_model, scored, text_lines


def enumerated(emit, trans, start):
    n, size = emit.shape
    total, out, moves = 0.0, np.zeros((n, size)), np.zeros((size, size))
    for path in itertools.product(range(size), repeat=n):
        weight = np.exp(start[path[0]] + sum(emit[k, y] for k, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
        total += weight
        for k, y in enumerate(path):
            out[k, y] += weight
        for a, b in zip(path, path[1:]):
            moves[a, b] += weight
    return out / total, moves / total


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    lengths = [1, 0, 5, 7, 2, 3]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    emit, trans, start = rng.normal(0, 2, (bounds[-1], 3)), rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3)
    want = [enumerated(emit[a:b], trans, start) for a, b in zip(bounds, bounds[1:]) if b > a]
    gamma, moves, _ = expectations(emit, bounds, trans, start)
    assert np.allclose(gamma, np.concatenate([g for g, _ in want]))
    assert np.allclose(moves, sum(m for _, m in want))
    for chunk in (1, 2, 3, 64):
        assert np.allclose(marginals(emit, bounds, trans, start, chunk), gamma)


def test_long_sequences_do_not_underflow():
    rng = np.random.default_rng(1)
    emit = rng.normal(0, 30, (5000, 4))
    got = marginals(emit, np.array([0, 5000]), np.zeros((4, 4)), np.zeros(4))
    assert np.isfinite(got).all() and np.allclose(got.sum(1), 1)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumnRenamed("n_chars", "score")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = scored(docs, learned_line_model(docs, labels)).join(labels, "doc_id").selectExpr("quality", "score", "crc32(cast(doc_id as string)) % 4 = 2 as held").where("held").collect()
    assert len(rows) > 50
    assert np.mean([(r.score >= 0.7) == (r.quality == 1) for r in rows]) >= 0.95


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "\n \n"), (4, "word " * 50_000), (None, "A line."), (5, "A line.\nA line."), (5, "A line.\nA line.")], "doc_id long, text string")
    labels = spark.createDataFrame([(5, 1), (5, None), (None, 0), (9, 0)], "doc_id long, quality int")
    got = scored(docs, learned_line_model(docs, labels)).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    none = scored(docs, learned_line_model(docs.limit(0), labels.limit(0))).collect()
    assert all(r.score == 0.5 for r in none)
    assert text_lines(None) == ([], [])

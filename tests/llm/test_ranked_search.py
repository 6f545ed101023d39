"""Ranked search against scoring every document for every item in Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from pagelake.llm import ranked_search as rs

SCHEMA = "doc_id long, text string, item_id string, rank int, score string"


def terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return Counter(re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low))


def plain(docs, items, top):
    counted = [(d, terms(t)) for d, t, *_ in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, n_words = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text, *_ in items:
        rows = []
        for d, c in counted:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms(text) if t in c)
            if score > 0:
                rows.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -score) for rank, (score, _, _, d) in enumerate(sorted(rows, key=lambda r: r[:3])[:top], 1)]
    return sorted(out, key=repr)


def made(seed=2, n=700):
    rng = random.Random(seed)
    zipf = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    topic = [rng.sample(zipf, 30) for _ in range(12)]
    marks = [" ", " ", ", ", "-", "\n", "\x00", "_", " É", "'"]
    docs = []
    for k in range(n):
        source = rng.choice(topic) if rng.random() < 0.7 else zipf
        docs.append((k, "".join(rng.choice(source).upper() + rng.choice(marks) if rng.random() < 0.1 else rng.choice(source) + rng.choice(marks) for _ in range(rng.randrange(0, 90))), "i", 0, "s"))
    docs += [docs[5]] * 3 + [(None, docs[7][1], "i", 0, ""), (None, None, "", 0, ""), (9001, "", "", 0, ""), (9002, "?!", "", 0, ""), (9003, " ".join(zipf * 40), "", 0, "")]
    items = [(k, " ".join(rng.sample(rng.choice(topic), 8) + rng.sample(zipf, rng.randrange(25))), "x", 1, "y") for k in range(25)]
    items += [(100, None, "", 0, ""), (101, "", "", 0, ""), (102, "nowhere else", "", 0, ""), (103, "É é ÉÉ", "", 0, ""), items[3]]
    return docs, items


def frames(spark, docs, items, parts=3):
    return spark.createDataFrame(docs, SCHEMA).repartition(parts), spark.createDataFrame(items, "item_id long, text string, doc_id string, rank int, score string")


def test_equals_scoring_everything(spark):
    docs, items = made()
    for options in ({"top": 50}, {"top": 4, "sample_docs": 300}, {"top": 7, "block_words": 40}):
        frame, tests = frames(spark, docs, items)
        got = rs.ranked_documents(frame, tests, **options).select("item_id", "rank", "doc_id", "score").collect()
        want = plain(docs, items, options["top"])
        assert len(want) > 80
        assert sorted(map(tuple, got), key=repr) == want


def test_small_segments_and_few_dense_terms_find_the_same_and_skip(monkeypatch):
    docs, items = made(6, 900)
    for segment, dense, block in ((50, 5, 4), (10_000, 40, 8), (300, 100_000, 3)):
        monkeypatch.setattr(rs, "SEGMENT_DOCS", segment)
        monkeypatch.setattr(rs, "DENSE_TERMS", dense)
        monkeypatch.setattr(rs, "BLOCK_DOCS", block)
        index = rs.Items(0, [i[0] for i in items], [i[1] or "" for i in items])
        shared = type("Shared", (), {"value": index})
        source = pa.RecordBatch.from_arrays([pa.array([d[0] for d in docs], pa.int64()), pa.array([d[1] for d in docs], pa.string())], names=["id", "body"])
        forward = list(rs._forward(shared)(iter([source])))
        sums = next(rs._sums(len(index.vocabulary))(b.select(["n", "terms"]) for b in forward)).to_pydict()
        value = dict(zip(sums["term"], sums["value"]))
        df = np.array([value.get(k, 0) for k in range(len(index.vocabulary))])
        query = rs.Weighted(index, df, value[-1], value[-2])
        best, scored, total = rs.Best(query, 5), 0, 0
        for part in rs._segments(query, iter(forward)):
            assert sorted(part.docs.tolist()) == sorted(np.repeat(np.arange(len(part.ids)), np.diff(part.edges)).tolist())
            some, of = rs.search(part, best)
            scored, total = scored + some, total + of
        assert 0 < scored < total
        got = [(items[k][0], rank, None if no else int(d), int(s)) for k, (ss, ds, nos) in enumerate(best.rows) for rank, (s, d, no) in enumerate(zip(ss, ds, nos), 1)]
        assert sorted(got, key=repr) == plain(docs, items, 5)


def test_summaries_bound_every_document_first_met(monkeypatch):
    monkeypatch.setattr(rs, "BLOCK_DOCS", 4)
    monkeypatch.setattr(rs, "DENSE_TERMS", 30)
    docs, items = made(8, 300)
    index = rs.Items(0, [i[0] for i in items], [i[1] or "" for i in items])
    source = pa.RecordBatch.from_arrays([pa.array([d[0] for d in docs], pa.int64()), pa.array([d[1] for d in docs], pa.string())], names=["id", "body"])
    forward = list(rs._forward(type("Shared", (), {"value": index}))(iter([source])))
    sums = next(rs._sums(len(index.vocabulary))(b.select(["n", "terms"]) for b in forward)).to_pydict()
    value = dict(zip(sums["term"], sums["value"]))
    query = rs.Weighted(index, np.array([value.get(k, 0) for k in range(len(index.vocabulary))]), value[-1], value[-2])
    (segment,) = rs._segments(query, iter(forward))
    for terms_ in query.terms:
        weights = np.zeros(len(query.weights), np.int64)
        weights[terms_] = query.weights[terms_]
        scores, met = segment.scores(np.arange(len(segment.ids)), weights), set()
        for b, most in zip(*segment.bounds(terms_)):
            for d in segment.docs[segment.starts[b] : segment.starts[b + 1]].tolist():
                if d not in met:
                    assert scores[d] <= most
                    met.add(d)
        assert met == set(np.flatnonzero([np.isin(segment.terms[a:b], terms_).any() for a, b in zip(segment.edges, segment.edges[1:])]).tolist())


def test_empty_tables(spark):
    docs, items = made(1, 20)
    assert rs.ranked_documents(*frames(spark, [], items)).collect() == []
    assert rs.ranked_documents(*frames(spark, docs, [])).collect() == []

"""Exact copies against a plain grouping in Python."""

import hashlib
import random
import re
from collections import defaultdict

from pagelake.llm.exact_copies import exact_copies, one_per_text

SCHEMA = "doc_id long, text string, keep_id string, run int, digest string"


def plain(rows):
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        groups[re.sub(r"[ \t-\r]", "", text or "")].append((-len(text or ""), doc is None, doc or 0, doc))
    out = []
    for doc, text, *_ in rows:
        normal = re.sub(r"[ \t-\r]", "", text or "")
        out.append((doc, min(groups[normal])[3], len(groups[normal]), hashlib.sha256(normal.encode()).hexdigest()))
    return sorted(out, key=repr)


def made(n=600, seed=5):
    rng = random.Random(seed)
    texts = ["", " ", "\n\t", None, "a\x00b", "a b", "a b", "ab", "ab ", "ÄÖ ü", "ÄÖü", "\U0001f600 x", "\U0001f600x", "é", "é", "w " * 100_000, "w" * 100_000]
    rows = []
    for k in range(n):
        text = rng.choice(texts) if rng.random() < 0.4 else "hot copy  of all" if rng.random() < 0.5 else f"text {rng.randrange(400)}"
        rows.append((k, text, "x", k, "y"))
    rows += [rows[3], rows[3], rows[9], (None, "ab", "x", 0, ""), (None, "only null", "x", 0, ""), (None, "only null", "x", 0, ""), (700, "ab", "x", 0, ""), (700, "ab", "x", 0, "")]
    return rows


def test_equals_plain_grouping_in_any_tree(spark):
    rows = made()
    for parts, bits in ((1, 3), (2, 1), (13, 1), (40, 3)):
        got = exact_copies(spark.createDataFrame(rows, SCHEMA).repartition(parts), bits=bits).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == plain(rows)
        stays = defaultdict(list)
        for r in got:
            stays[r.text_sha256].append((r.kept, r.doc_id == r.keep_id))
        assert all([own for kept, own in rs if kept] == [True] for rs in stays.values())


def test_empty_table_and_other_types(spark):
    assert exact_copies(spark.createDataFrame([], SCHEMA)).collect() == []
    got = exact_copies(spark.createDataFrame([("b", "x y"), ("a", "xy "), (None, None)], "name string, body string"), doc_id="name", text="body").collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {("a", "a", 2, True), ("b", "a", 2, False), (None, None, 1, True)}


def test_rows_that_stay_keep_their_columns(spark):
    rows = made(200)
    frame = spark.createDataFrame(rows, SCHEMA)
    got = one_per_text(frame).collect()
    assert frame.columns == one_per_text(frame).columns
    texts = [re.sub(r"[ \t-\r]", "", r.text or "") for r in got]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[ \t-\r]", "", t or "") for _, t, *_ in rows})
    keep = {(d, k) for d, k, *_ in plain(rows)}
    assert all((r.doc_id, r.doc_id) in keep for r in got)


def test_plan_has_no_python_and_does_not_shuffle_texts(spark):
    frame = spark.createDataFrame(made(50), SCHEMA)
    plan = exact_copies(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SortAggregate" in plan

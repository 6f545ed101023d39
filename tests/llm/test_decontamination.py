"""Item containment against brute force over word tuples."""

import random
import re

import pyarrow as pa

from pagelake.llm.decontamination import ItemIndex, clean_documents, contained_items, find_items, sketch_size


def grams(text, k=5):
    words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[j : j + k]) for j in range(len(words) - k + 1)}, words


def brute(docs, items):
    out = set()
    for d, text in docs:
        for i, item in items:
            _, words = grams(item)
            k = min(5, len(words))
            if not k:
                continue
            wanted, has = grams(item, k)[0], grams(text, k)[0]
            if 100 * len(wanted & has) >= 75 * len(wanted):
                out.add((d, i, len(wanted & has), len(wanted)))
    return out


def made(seed=3):
    rng = random.Random(seed)
    word = lambda: rng.choice("ab") + str(rng.randrange(300))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 2, 4, 5, 6, 9, 14, 40, 90, 300])]
    items += [(90, None), (91, ""), (92, " \n"), (93, items[6][1].upper())]
    docs = [(0, None), (1, ""), (2, " ")]
    for d in range(3, 120):
        words = [word() for _ in range(rng.randrange(1, 500))]
        if d % 2:
            leak = items[rng.randrange(10)][1].split()
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                leak[rng.randrange(len(leak))] = word()
            at = rng.randrange(len(words))
            words[at:at] = leak
        docs.append((d, rng.choice([" ", "\n", "\t "]).join(words)))
    return docs, items


def test_equals_brute_force_and_survives_blocks(spark):
    docs, items = made()
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string").repartition(4)
    tests = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    want = brute(docs, items)
    assert len(want) > 20
    for block in (2_000_000, 30):
        assert {tuple(r) for r in contained_items(frame, tests, block_shingles=block).collect()} == want
    clean = clean_documents(frame, tests)
    assert clean.columns == frame.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, *_ in want}


def test_long_texts_are_cut_only_to_bound_memory(monkeypatch):
    item = " ".join(f"w{k}" for k in range(30))
    text = "x " * 40_000 + item + " y" * 40_000
    index = ItemIndex([7], [item], 5, 75)
    from pagelake.llm import decontamination, shingles

    monkeypatch.setattr(decontamination, "hashed_words", lambda texts: shingles.hashed_words(texts, piece=1000))
    assert list(find_items(index, pa.array([text, None, "z" * 5000]))) == [(0, 0, 26)]


def test_sketches_cannot_miss():
    for n in range(1, 2000):
        lacking = n - -(-75 * n // 100)
        assert lacking < sketch_size(n, 75) <= n


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert contained_items(docs, items).collect() == []
    assert contained_items(docs.limit(0), docs.selectExpr("doc_id as item_id", "text")).collect() == []
    assert clean_documents(docs, items).count() == 1


def test_leaked_rows_go_whatever_their_id(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    leak = "x y one two three four five six seven z"
    docs = spark.createDataFrame([(None, leak), (None, "clean"), (5, leak), (5, "clean too"), (6, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in clean_documents(docs, items).collect() if r.text) == [("5", "clean too"), ("None", "clean")]

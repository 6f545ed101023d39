"""Links and components against brute force over word tuples."""

import random
import re

import numpy as np

from pagelake.llm import ngram_join
from pagelake.llm.components import components
from pagelake.llm.ngram_join import cost_classes, group_links, one_per_component, similar_components


def shingles(text):
    words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4)))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    low = [d for d, _ in rows]
    changed = True
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in linked:
            least = min(low[a], low[b])
            changed |= low[a] != least or low[b] != least
            low[a] = low[b] = least
    return sorted((d, len(s), c) for (d, _), s, c in zip(rows, sets, low))


def corpus(seed, n=260):
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(60)]
    rows = [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "One  TWO"), (905, "two one"), (906, "a b c d e"), (907, "a b c d e")]
    drift = [f"d{k}" for k in range(80)]
    for d in range(n):
        kind = d % 5
        if kind == 0:
            drift = list(drift)
            drift[rng.randrange(80)] = f"x{d}"
            words = drift
        elif kind == 1 and rows[8:]:
            words = list(rng.choice(rows[8:])[1].split())
            for _ in range(rng.choice([0, 1, 1, 2, 6])):
                words[rng.randrange(len(words))] = f"y{rng.randrange(9)}"
        elif kind == 2:
            words = passage + [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 10, 15, 40]))]
        else:
            words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 200))]
        rows.append((d, rng.choice([" ", "\n"]).join(words)))
    rng.shuffle(rows)
    return rows


def test_components_equal_brute_force(spark):
    rows = corpus(1)
    docs = spark.createDataFrame([(d, t, 5, "x") for d, t in rows], "doc_id long, text string, n long, label string").repartition(5)
    assert sorted(map(tuple, similar_components(docs).collect())) == brute(rows)
    # Groups that are dealt out as pairs of small blocks give the same.
    assert sorted(map(tuple, similar_components(docs, block_docs=7).collect())) == brute(rows)
    kept = one_per_component(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _, c in brute(rows) if d == c)


def test_expensive_keys_move_back_without_losing_links(spark, monkeypatch):
    # Anything above the mean counts as expensive.
    monkeypatch.setattr(ngram_join, "cost_classes", lambda hashes, sketch: (hashes % np.uint64(3)).astype(np.int64))
    rows = corpus(2, 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, similar_components(docs).collect())) == brute(rows)


def test_group_links_connect_exactly_what_links_connect():
    rng = np.random.default_rng(5)
    for _ in range(40):
        base = rng.choice(10_000, 40, replace=False)
        sets = []
        for _ in range(30):
            own = base.copy()
            change = rng.integers(0, 12)
            own[rng.integers(0, 40, change)] = rng.integers(10_000, 20_000, change)
            sets.append(np.unique(own).astype(np.uint64))
        ids = np.arange(30)
        for part in (np.zeros(30, int), ids % 2):
            label = list(range(30))

            def find(x):
                while label[x] != x:
                    x = label[x]
                return x

            for a, b in group_links(ids, part, sets):
                assert len(np.intersect1d(sets[a], sets[b])) * 100 >= 75 * len(np.union1d(sets[a], sets[b]))
                assert find(a) != find(b)
                label[find(a)] = find(b)
            for a in range(30):
                for b in range(a):
                    if len(np.unique(part)) > 1 and part[a] == part[b]:
                        continue
                    inter = len(np.intersect1d(sets[a], sets[b]))
                    if 100 * inter >= 75 * (len(sets[a]) + len(sets[b]) - inter):
                        assert find(a) == find(b)


def test_costs_rise_with_frequency():
    sketch = np.full((2, 1 << ngram_join.SKETCH_BITS), 100)
    hot = np.array([12345678901234567], np.uint64)
    one, two = ngram_join._sketch_places(hot)
    sketch[0][one], sketch[1][two] = 5000, 5000
    assert cost_classes(hot, sketch)[0] > 0
    assert cost_classes(np.array([99], np.uint64), sketch)[0] == 0


def test_components_of_a_chain_a_cycle_and_a_star(spark):
    chain = [(k, k + 1) for k in range(40)]
    star = [(100, 100 + k) for k in range(1, 30)] + [(129, 101)]
    loops = [(500, 500), (600, 601), (601, 600)]
    got = dict(map(tuple, components(spark.createDataFrame(chain + star + loops, "a long, b long")).collect()))
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(30)}, 600: 600, 601: 600}


def test_empty_table_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (None, "z"), (None, None)], "doc_id long, text string")
    got = sorted(map(str, (tuple(r) for r in similar_components(docs).collect())))
    assert got == sorted(map(str, [(None, 2, 4), (4, 2, 4), (None, 1, None), (None, 0, None)]))
    assert similar_components(docs.limit(0)).collect() == []


def test_rows_of_one_id_link_each_by_its_own_text(spark):
    a, b = [f"a{k}" for k in range(60)], [f"b{k}" for k in range(60)]
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(b[:-1] + ["x"])), (3, " ".join(a[:-1] + ["y"])), (7, "c d e f g h"), (7, "c d e f g h"), (7, "other words of a kind")]
    docs = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, h string, number int").repartition(3)
    want = sorted((d, n, {1: 1, 2: 1, 3: 1, 7: 7}[d]) for d, n, _ in brute(rows))
    assert sorted(map(tuple, similar_components(docs).collect())) == want
    kept = sorted((r.doc_id, r.text) for r in one_per_component(docs).collect())
    # The two texts of document 1 are not similar, so both stay; of the repeated row one does.
    assert kept == sorted([(1, rows[0][1]), (1, rows[1][1]), (7, rows[4][1]), (7, rows[6][1])])


def test_rows_without_an_id_are_deduplicated_too(spark):
    words = [f"w{k}" for k in range(50)]
    near = lambda k: " ".join([*words[:-1], f"z{k}"])
    lone = " ".join(f"l{k}" for k in range(40))
    rows = [(None, near(0)), (None, near(1)), (4, near(2)), (None, lone), (None, lone), (None, lone + " end"), (None, None), (None, ""), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(str, (tuple(r) for r in similar_components(docs).collect())))
    assert got == sorted(map(str, [(None, 46, 4), (None, 46, 4), (4, 46, 4), (None, 36, None), (None, 36, None), (None, 37, None), (None, 0, None), (None, 0, None), (8, 0, 8)]))
    kept = one_per_component(docs).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["4", "None", "None", "None", "8"])
    assert sum((r.text or "").startswith("l0 ") for r in kept) == 1

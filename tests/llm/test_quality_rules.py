"""Counts against brute force, the exact bound, and the guarantee."""

import math
import random
import re
from collections import Counter

import numpy as np

from pagelake.llm.quality_rules import GRID, binomial_below, certified, certified_setting, judged, measured, path_of, rejecting, upper_bound


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(runs)
    covered = {i + k for i, r in enumerate(runs) if often[r] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "a", "a b c d e a b c d e", "é é é é é é é", "x\n\nx\n \nx", "# * $\x0b%\x0c&\r|<>", "same " * 3000]
    for _ in range(150):
        texts.append("".join(rng.choice(["a", "b", "c", " ", " ", "\n", "#", "é"]) for _ in range(rng.randrange(120))))
    docs = spark.createDataFrame([(k, t, "w") for k, t in enumerate(texts)] + [(None, "x y", "w"), (3, "a", "w")], "doc_id long, text string, words string")
    got = {(r.doc_id, r.n_words): (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in measured(docs).collect()}
    for k, t in enumerate(texts):
        assert got[k, brute(t)[0]] == brute(t), t
    assert measured(docs).count() == len(texts) + 2


def test_exact_binomial():
    for n, p in ((10, 0.3), (57, 0.02), (400, 0.004)):
        for k in range(0, n, max(1, n // 9)):
            told = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert abs(binomial_below(k, n, p) - told) < 1e-9
    assert binomial_below(10**6, 10**9, 0.002) < 1e-12


def no_path():
    return list(path_of(np.zeros((0, len(GRID)), int), np.zeros(0, int), np.zeros(0, int)))


def test_bounds_are_exact():
    for k, n, level in ((0, 240, 0.0125), (3, 500, 0.05), (40, 3000, 0.01)):
        bound = upper_bound(k, n, level)
        assert abs(sum(math.comb(n, i) * bound**i * (1 - bound) ** (n - i) for i in range(k + 1)) - level) < 1e-9
    assert upper_bound(5, 5, 0.05) == 1.0


def test_settings_stop_at_the_first_that_is_not_certified():
    sizes = [len(c) for c in GRID.values()]
    none = (0,) * len(GRID)
    # Nothing exceeds any cutoff: all rules go to their strictest.
    setting, bound = certified([(0, none, 60, 0, 240)])[0]
    assert setting.tolist() == sizes and bound < 0.02
    assert certified([(0, none, 60, 0, 200)])[0][0].tolist() == [0] * len(GRID)
    # Half of the good documents exceed the first rule's 4 strictest cutoffs: it stays above those, the others are free.
    some = (4, 0, 0, 0, 0)
    setting, bound = certified([(0, none, 300, 50, 1200), (0, some, 300, 50, 1200)])[0]
    assert setting.tolist() == [sizes[0] - 4, *sizes[1:]] and bound < 0.02


def test_the_path_prefers_what_costs_nothing_and_takes_bad_documents():
    levels = np.array([(0, 0, 0, 0, 0), (10, 0, 0, 0, 0), (0, 0, 9, 0, 0)])
    path = path_of(levels, np.array([100, 0, 5]), np.array([5, 50, 0]))
    assert path[0].tolist() == [1, 0, 0, 0, 0] and len(path) == sum(map(len, GRID.values())) == len(no_path())
    assert all((b - a).sum() == 1 and (b >= a).all() for a, b in zip(path, path[1:]))
    assert [p[2] for p in path].index(1) == len(path) - len(GRID["dup_line_share"])


def test_the_guarantee_holds_over_many_holdouts():
    """No more than ``error`` of 1,000 drawn holdouts lead to a setting that truly rejects more than ``risk``."""
    rng = np.random.default_rng(2)
    sizes = np.array([len(c) for c in GRID.values()])
    # Vectors of levels of good documents: each rule has a thin tail over its cutoffs.
    vectors = np.unique(np.minimum(rng.geometric(0.35, (4000, len(GRID))) - 1, sizes) * (rng.random((4000, len(GRID))) < 0.02), axis=0)
    chance = rng.dirichlet(np.where((vectors == 0).all(1), 400.0, 0.4))
    bad = rng.integers(0, 9, len(vectors))
    broken = certified_some = 0
    for _ in range(1000):
        n = int(rng.choice([150, 400, 1500, 6000]))
        path, tested = rng.multinomial(n // 5, chance), rng.multinomial(n - n // 5, chance)
        setting, bound = certified_setting(path_of(vectors, path, bad), vectors, tested, 0.02, 0.05)
        truth = chance[rejecting(vectors, setting)].sum()
        broken += truth > 0.02
        certified_some += bound is not None
    assert broken <= 65 and certified_some > 500, (broken, certified_some)


def test_kept_recomputed_plainly(spark):
    """Every row's verdict from the counts and a plain run over the same settings, on a table whose strata have a few hundred labels."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = judged(docs, labels).collect()
    quality = {}
    for r in labels.collect():
        quality.setdefault(r.doc_id, set()).add(r.quality)
    hashed = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "pmod(xxhash64(doc_id, 31), 5) as h").collect()}

    def values(r):
        words = max(1, r.n_words)
        return r.n_symbols / words, r.n_marks / words, r.n_dup_lines / max(1, r.n_lines), r.n_repeat_words / words, r.word_chars / words

    counts = {}
    for r in rows:
        label = quality.get(r.doc_id)
        if not r.base_failed and label in ({0}, {1}):
            levels = tuple(sum(v > c for c in cutoffs) for v, cutoffs in zip(values(r), GRID.values()))
            own = counts.setdefault((r.band, levels), [0, 0, 0])
            own[1 if label == {0} else 0 if hashed[r.doc_id] == 0 else 2] += 1
    settings = certified([(band, levels, *n) for (band, levels), n in sorted(counts.items())])
    for r in rows:
        setting, bound = settings.get(r.band, (np.zeros(len(GRID), int), None))
        hit = [rule for (rule, cutoffs), v, steps in zip(GRID.items(), values(r), setting.tolist()) if steps and v > cutoffs[steps - 1]]
        assert (r.kept, r.rejected_by, r.bound) == (not r.base_failed and not hit, hit, bound)
    for band in {r.band for r in rows}:
        good = sum(n[0] + n[2] for (b, _), n in counts.items() if b == band)
        assert good < 300 or settings[band][1] is not None, (band, good)
    rejected = [r for r in rows if r.rejected_by and not r.base_failed]
    assert len({r.band for r in rejected}) >= 2


def test_good_documents_are_kept(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(500)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(30)), 1) for k in range(3000)]
    rows += [(10_000 + k, " ".join(rng.choice(words) + "###" for _ in range(30)), 0) for k in range(300)]
    rows += [(20_000, "too short", 1)]
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, q, 5) for d, _, q in rows] + [(None, 1, 1), (1, None, 1)], "doc_id long, quality int, n_words int")
    kept = {r.doc_id: r.kept for r in judged(docs, labels).collect()}
    assert not any(kept[10_000 + k] for k in range(300)) and not kept[20_000]
    assert sum(not kept[k] for k in range(3000)) <= 0.02 * 3000
    assert judged(docs.limit(0), labels.limit(0)).collect() == []
    few = judged(docs, labels.limit(50))
    assert few.where("not kept").count() == 1

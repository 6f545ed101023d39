"""Collocations against plain counting in Python, and the stripes on their own."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from pagelake.llm.collocations import Stripes, blocks, collocations, merged, packed, unpacked

SCHEMA = "doc_id long, text string, lang string, rank int, phrase string, f string, n int"


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\n-\r]", low)]


def plain(rows, min_count, top):
    counts, n = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for size in (1, 2, 3):
                counts.setdefault(lang, Counter()).update(tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        longest = Counter()
        for p, a in candidates.items():
            if len(p) == 3:
                for part in (p[:2], p[1:]):
                    longest[part] = max(longest[part], a)
        scored = []
        for p, a in candidates.items():
            if len(p) == 2 and p in longest and 100 * longest[p] >= 50 * a:
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def made(seed=1, n=160):
    rng = random.Random(seed)
    words = [*"abcdefg", "Ab", "été", "\U0001f600", "x-y", "(z)", "naïve ", "a\x00"]
    rows = []
    for k in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ". ", "\n", " ;! ", "\r\n"]) for _ in range(rng.randrange(0, 60)))
        if k % 3 == 0:
            text += " of the" * rng.randrange(12) + " of the " + rng.choice(words)
        rows.append((k, text, rng.choice(["en", "en", "fr", None, "t\tx", ""]), 1, "p", "f", 2))
    return rows + [rows[0], rows[1], rows[1], (None, None, "en", 1, "", "", 0), (None, "", None, 1, "", "", 0), (5, " ., \n", "de", 1, "", "", 0)]


def results(frame, **options):
    return sorted(map(tuple, collocations(frame, **options).collect()))


def test_equals_plain_counting_whatever_is_hot_or_cut(spark):
    rows = made()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = plain(rows, 5, 40)
    assert len(want) > 60
    for share, chunk in ((8192, 8 << 20), (50, 200), (2, 31), (10**9, 1)):
        assert results(frame, min_count=5, top=40, hot_share=share, chunk=chunk) == want


def test_one_long_text_and_ties(spark):
    rng = random.Random(4)
    rows = [(1, " ".join(rng.choice("abcdefgh") for _ in range(60_000)), "en", 0, "", "", 0), (2, "p q " * 50, "en", 0, "", "", 0)]
    got = results(spark.createDataFrame(rows, SCHEMA), chunk=5_000)
    assert got == plain(rows, 10, 2000)


def test_empty_and_wordless_tables(spark):
    assert results(spark.createDataFrame([], SCHEMA)) == []
    assert results(spark.createDataFrame([(1, None, None, 0, "", "", 0), (2, ".", "x", 0, "", "", 0)], SCHEMA)) == []


def test_blocks_keep_words_whole_and_count_each_once():
    rows = [r[1] for r in made(9, 40)] + ["w" * 500 + " tail", ""]
    langs = pa.array(["en"] * len(rows))
    want = Counter(w for t in rows for p in pieces(t) for w in p)
    for chunk in (1, 3, 64, 1 << 20):
        got = Counter()
        for block in blocks(langs, pa.array(rows), chunk):
            got.update(block.words[i].as_py().split("\t", 1)[1] for i in block.ids[block.fresh :].tolist())
        assert got == want


def test_stripes_pack_and_merge():
    one = Stripes(pa.array(["e\ta", "e\tb", "e\tc"]), np.array([-1, 0]), np.array([-1, 1]), np.array([0, 2, 3]), np.array([0, 2, 2]), np.array([4, 1, 7]))
    two = Stripes(pa.array(["e\tc", "e\ta", "e\tb"]), np.array([1]), np.array([2]), np.array([0, 2]), np.array([0, 2]), np.array([5, 2]))
    whole = merged([unpacked(packed(one)), unpacked(packed(two))])
    name = lambda k: whole.words[int(k)].as_py()[2:] if k >= 0 else ""
    entries = {}
    for k in range(len(whole.first)):
        for at in range(whole.starts[k], whole.starts[k + 1]):
            entries[name(whole.first[k]), name(whole.second[k]), name(whole.nexts[at])] = int(whole.counts[at])
    assert entries == {("", "", "a"): 4, ("", "", "c"): 1, ("a", "b", "c"): 12, ("a", "b", "b"): 2}

"""Phrase places against brute force, and the rules against the same rules in Python."""

import itertools
import random
import re
import time
from re import _parser

from pagelake.llm.license_scan import NAMES, NOTICES, PHRASES, SENTENCES, has_word, rules, scanned


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_base(text):
    words = words_of(text)
    return sorted((i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())


def brute_detections(text):
    words = words_of(text)
    norm = " " + " ".join(words) + " "
    found = []
    for number, (keyword, expression, label, priority, grouped) in enumerate(rules()):
        if keyword in words:
            for m in re.finditer(has_word(expression), norm):
                start = norm[: m.start()].count(" ") - 1
                name = label
                if grouped and m[1]:
                    name = f"{label}-{m[1].replace(' ', '-')}"
                found.append((start, start + len(m[0].split()), priority, number, name))
    holds = lambda o, d: o[0] <= d[0] and d[1] <= o[1] and o[2] >= d[2] and (o[:3] != d[:3] or o[3] < d[3])
    return {(*d[:3], d[4]) for d in found if not any(holds(o, d) for o in found)}


TEXTS = [
    None, "", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.", "All rights reserved. Copyright (c) 2020, 2021", "the MIT\nlicense and the mit-license", "SPDX-License-Identifier: GPL-2.0",
    "accident cc; by", "Ümit License É MIT LICENSE", "gnu gnu general public license apache license apache license", "mit license mit license " * 50,
    "Released into the public domain", "Tous droits réservés", "plain words",
]


def test_places_and_detections(spark):
    rng = random.Random(2)
    pieces = ["mit", "license", "apache", "cc", "by", "gnu general public", "version 2", "licensed under the", "é", "3 0", "all rights reserved", "x", "bsd", "gpl v3"]
    texts = TEXTS + [rng.choice([" ", "-", "\n"]).join(rng.choice(pieces).title() if rng.random() < 0.3 else rng.choice(pieces) for _ in range(rng.randrange(25))) for _ in range(150)]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(None, "MIT license", 1), (3, texts[3], 1)], "doc_id long, text string, base int")
    got = scanned(docs).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = "MIT license" if r.doc_id is None else texts[r.doc_id]
        assert r.n_words == len(words_of(text))
        assert sorted((b.start, b.label) for b in r.base) == brute_base(text), text
        ours = {(d.start, d.end, d.priority, d.label) for d in r.detections}
        told = brute_detections(text)
        assert ours == told, (text, ours ^ told)


def test_labels_of_known_notices(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    labels = {r.doc_id: {d.label for d in r.detections} for r in scanned(docs).collect()}
    assert labels[2] == {"apache-2-0"} and labels[3] == {"gpl-3"} and labels[4] == {"cc-by-nc-4-0"} and labels[14] == set()
    assert labels[12] == {"public-domain"} and labels[13] == {"all-rights-reserved"}
    assert len(rules()) > 300
    assert len({expression for _, expression, *_ in (*NAMES, *NOTICES, *SENTENCES)}) > 130
    assert scanned(docs.limit(0)).collect() == []


def examples(parsed):
    """Texts that a parsed expression matches: every alternative, and optional parts left out and put in."""
    choices = []
    for kind, value in parsed:
        kind = str(kind)
        if kind == "LITERAL":
            choices.append([chr(value)])
        elif kind == "IN":
            choices.append([chr(v if str(k) == "LITERAL" else v[0]) for k, v in value])
        elif kind == "SUBPATTERN":
            choices.append(examples(value[-1]))
        elif kind == "BRANCH":
            choices.append([e for branch in value[1] for e in examples(branch)])
        elif kind == "MAX_REPEAT":
            low, high, inner = value
            own = examples(inner)
            choices.append([own[0] * low] + ([e * max(low, 1) for e in own] if high else []))
        else:
            raise AssertionError(kind)
    return ["".join(c) for c in itertools.product(*choices)]


def test_every_rule_is_found_alone(spark):
    """Each example is the whole text, so no other word opens the gate or brings a keyword."""
    texts = []
    for _, expression, label, priority, _ in rules():
        found = examples(_parser.parse(expression))
        texts += [(e, expression, label, priority) for e in dict.fromkeys([found[0], found[-1], *random.Random(expression).sample(found, min(2, len(found)))])]
    docs = spark.createDataFrame([(k, "\n".join(e.split()).upper() if k % 2 and e.isascii() else e) for k, (e, *_) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in scanned(docs).collect()}
    for k, (e, expression, label, priority) in enumerate(texts):
        best = max((d.priority for d in got[k].detections), default=0)
        assert best >= priority, (e, expression, got[k].detections)


def test_names_the_gate_used_to_miss(spark):
    texts = {
        "CC0 1.0": "cc0", "CDDL 1.0": "cddl", "WTFPL": "wtfpl", "SSPL v1": "sspl-1", "ODbL": "odbl", "GFDL 1.3": "gfdl", "UPL 1.0": "upl", "LPPL": "lppl",
        "CeCILL C": "cecill", "PolyForm Strict": "polyform", "proprietary and confidential": "proprietary", "Expat License": "mit",
        "Permission to use, copy, modify, and/or distribute this software": "isc", "all rights\nreserved": "all-rights-reserved", "free for personal use": "non-commercial",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {d.label for d in r.detections} for r in scanned(docs).collect()}
    assert [got[k] for k in range(len(texts))] == [{label} for label in texts.values()]


def test_a_hundred_thousand_mentions_in_one_row(spark):
    text = "mit license, apache license 2.0; " * 50_000
    docs = spark.createDataFrame([(1, text), (2, "mit license")], "doc_id long, text string")
    start = time.perf_counter()
    got = {r.doc_id: r for r in scanned(docs).selectExpr("doc_id", "size(base) as b", "size(detections) as d").collect()}
    assert time.perf_counter() - start < 60
    assert (got[1].b, got[1].d) == (100_000, 100_000)
    assert got[2].b == got[2].d == 1


def test_license_texts_are_known_by_their_sentences(spark):
    texts = {
        "THE SOFTWARE IS PROVIDED, INCLUDING MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.": "mit",
        "Redistributions in binary form must reproduce the above copyright notice, this list": "bsd", "The origin of this software must not be misrepresented;": "zlib",
        "This is free and unencumbered software released into the public domain.": "unlicense", "with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts": "gfdl",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {d.label for d in r.detections} for r in scanned(docs).collect()}
    assert [got[k] for k in range(len(texts))] == [{label} for label in texts.values()]

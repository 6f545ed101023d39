"""Base spans against the patterns as they are told, and the weak supervision."""

import hashlib
import random
import re
import time

import pytest

from pagelake.llm.personal_data import base_spans, estimate, found_personal_data, luhn, more_candidates
from pagelake.llm.personal_data_queries import joined


def told(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
    return out


@pytest.mark.parametrize("alphabet", ["a.@-%", "0123.+ -()", "45.0@a b+\n", "4111 -"])
def test_base_equals_the_patterns(alphabet):
    rng = random.Random(alphabet)
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
        assert list(base_spans(text)) == told(text), text
    known = "4111 1111-1111 1111 x a@b.c@d.e.f 1.2.3.4.5.6.7.8 256.1.1.1 +1 (555) 010-9999. +++1 23456789"
    assert list(base_spans(known)) == told(known)


def test_long_runs_stay_linear():
    far = " at x dot y "
    for run in (
        "1" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "@" * 100_000, "+1 " * 50_000, "- " * 100_000, "a" * 1_000_000 + far, far + "b" * 1_000_000, "a-" * 200_000 + far,
        " at " * 100_000 + far, "x at y" * 50_000 + far, " dot " * 50_000 + far, "a.b at c dot d " * 20_000, "[at]" * 100_000 + far, "." * 200_000 + far, "a at " + "c dot " * 50_000,
    ):
        start = time.perf_counter()
        list(base_spans(run))
        list(more_candidates(run))
        assert time.perf_counter() - start < 4, run[:20]


def test_a_row_of_many_spans(spark):
    numbers = " ".join(f"call ({200 + k % 700}) 555-{k % 10_000:04d} now," for k in range(50_000)) + " 10.0.0.1" * 50_000
    docs = spark.createDataFrame([(1, numbers), (2, "phone (724) 555-7058")], "doc_id long, text string")
    start = time.perf_counter()
    got = {r.doc_id: r.spans for r in found_personal_data(docs).collect()}
    assert time.perf_counter() - start < 60
    assert sum(s.base for s in got[1]) == 50_000 and sum(s.kind == "number" for s in got[1]) in (0, 50_000)


def test_seeded_findings(spark):
    """Recall and precision of the method's own spans where true ones and look-alikes are known."""
    rng = random.Random(7)
    names = ["Maria Lopez", "James Brown", "Anna Weber", "Pierre Martin", "Juan Garcia"]

    def iban():
        body = "".join(rng.choice("0123456789") for _ in range(18))
        check = 98 - int(body + "131400") % 97
        return f"DE{check:02d}{body}"

    true = [
        lambda: f"call ({rng.randrange(200, 990)}) 555-{rng.randrange(1000, 9999)} please", lambda: f"customer ssn {rng.randrange(100, 999)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}",
        lambda: f"account {iban()} there", lambda: f"contact Dr {rng.choice(names)} today", lambda: f"mail maria{rng.randrange(99)} at example dot com soon",
    ]
    false = [
        lambda: f"version {rng.randrange(100, 999)}.{rng.randrange(100, 999)}.{rng.randrange(10, 99)} was", lambda: f"see page {rng.randrange(100, 999)}-{rng.randrange(100, 999)}-{rng.randrange(10, 99)} of",
        lambda: f"isbn {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}-{rng.randrange(1000, 9999)} in", lambda: f"section AB{rng.randrange(10, 99)} {rng.randrange(1000, 9999)} {rng.randrange(1000, 9999)} was",
    ]
    rows = [(k, f"Some words before, {(true[k % 5] if k % 2 else false[k % 4])()} and more words after it.") for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [s for s in r.spans if not s.base] for r in found_personal_data(docs).collect()}
    recall = [sum(bool(got[k]) for k in range(1, 1500, 2) if k % 5 == kind) / sum(1 for k in range(1, 1500, 2) if k % 5 == kind) for kind in range(5)]
    wrong = sum(bool(got[k]) for k in range(0, 1500, 2)) / 750
    assert min(recall) >= 0.9 and wrong <= 0.1, (recall, wrong)


def test_reliable_labelers_win():
    counts = [(5, "1111???", 50), (5, "1?11???", 40), (5, "0?0?00?", 60), (5, "0???0??", 30)]
    belief = estimate(counts)
    assert belief[5, "1111???"] > 0.9 > 0.1 > belief[5, "0?0?00?"]
    assert estimate([]) == {}


def test_documents(spark):
    texts = ["mail bo.b@x.example.com now", None, "", "call (724) 555-7058 please, phone", "ssn 123-45-6789", "Dr Maria Lopez and Mr James Brown", "é@x.y ÉÉ 10.0.0.1", "x " * 5000 + "10.0.0.1"]
    docs = spark.createDataFrame([(k, t, "spans") for k, t in enumerate(texts)] + [(0, texts[0], "again"), (None, "1.1.1.1", "")], "doc_id long, text string, spans string")
    got = found_personal_data(docs)
    rows = got.select("doc_id", "spans", joined(got["spans"]).alias("j")).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r.doc_id is not None:
            base = [(s["kind"], s["start"], s["end"]) for s in r.spans if s["base"]]
            assert base == told(texts[r.doc_id] or "")
            assert [s for s in r.j.split(",") if s] == [f"{s['kind']}:{s['start']}:{s['end']}" for s in r.spans]
    assert found_personal_data(docs.limit(0)).collect() == []
    assert hashlib.sha256(b"").hexdigest() == spark.sql("select sha2('', 256)").first()[0]


def test_every_spelling_is_a_candidate_alone():
    for before, after in (("[", "]"), ("(", ")"), (" ", " "), (" [", "] "), (" (", ") "), ("( ", " )")):
        for at, dot in (("at", "dot"), ("AT", "DOT"), ("AT", "dot"), ("at", "DOT")):
            text = f"john{before}{at}{after}example{before}{dot}{after}com"
            assert ("address", 0, len(text)) in list(more_candidates(text)), text

"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, a
classifier trained on the result decides.

* Candidates are the four base patterns, which always stay, and looser ones: numbers in groups that may be phones,
  spelled-out addresses (``name at host dot com``), identity and account numbers, and names after a form of address.
* Labelers are patterns, gazetteers and context words. Each votes yes, no or abstains on every candidate.
* The votes of all documents are counted by pattern of votes. Votes have few patterns however many rows there are, so
  the counts fit the driver, where EM estimates how reliable each labeler is for each kind (Dawid-Skene with
  abstentions) and gives each vote pattern the probability that such a candidate is personal data.
* A logistic span classifier is trained on those probabilities over a bounded sample of the spans themselves, shared out
  over the vote patterns and weighted to stand for all, from features that include but are not limited to the
  votes, and decides on every candidate outside the base.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.crf import Adam
from pagelake.session import write_through

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "address", "number", "account", "person")
THRESHOLD = 0.5
ROUNDS, EPOCHS, RATE = 60, 300, 0.1
#: Spans that the classifier is fitted on, shared out over the vote patterns, 20 each at least.
SAMPLE_SPANS = 20_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Spelled-out addresses are found from their at-word, which stands between spaces or in brackets, as dots do.
AT_WORD = re.compile(r"(?: [\[(]? ?|[\[(] ?)(?:at|AT)(?: ?[\])] ?| )")
SPELLED_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:(?: [\[(]? ?|[\[(] ?)(?:dot|DOT)(?: ?[\])] ?| )[A-Za-z0-9-]++)+")
GROUPS = re.compile(r"(?<![\w.+-])\(?[0-9]{3}\)?[ .-][0-9]{3,4}(?:[ .-][0-9]{2,4})+(?![\w-])")
IDENTITY = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
# Forms of address, given names, and words that stand before personal data, in the four languages.
TITLES = "Mr Mrs Ms Dr Prof Herr Frau M. Mme Mlle Señor Señora Sr. Sra. Don Doña".split()
GIVEN = set(
    "james john robert michael william david mary patricia jennifer linda elizabeth anna maria hans peter klaus sabine ursula "
    "jean pierre marie michel claire louis jose juan antonio carmen luis ana pedro sofia".split()
)
CONTEXT = set(
    "email mail e-mail contact phone tel telephone call mobile fax address card visa account iban ssn customer name "
    "telefon anruf karte konto kunde adresse téléphone courriel compte carte client correo teléfono llamar cuenta tarjeta cliente".split()
)
AGAINST = set("version v. isbn page pages chapter figure table section art. nr. no. seite kapitel página capítulo chapitre".split())
PERSON = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(t) for t in TITLES) + r") (?:[A-ZÄÖÜÀ-Ý][a-zß-ÿ]+)(?: [A-ZÄÖÜÀ-Ý][a-zß-ÿ]+)?")
HAS_TITLE = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(t) for t in TITLES) + r") ")
LABELERS = ("strict pattern", "checksum", "gazetteer", "context", "context against", "shape", "alone")
FEATURES = ("bias", "length", "digits", "letters", "groups", "separators", "capitals")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their @: the local part reaches back to the last match or stop."""
    last, at = 0, text.find("@")
    while at >= 0:
        if at >= last and (domain := DOMAIN.match(text, at + 1)):
            start = at
            while start > last and (text[start - 1] in LOCAL):
                start -= 1
            if start < at:
                last = domain.end()
                yield start, last
        at = text.find("@", at + 1)


def spelled_addresses(text: str) -> Iterator[tuple[int, int]]:
    """Addresses like ``ann at example dot org``: back from the at-word as far as a local part reaches, and on over the domain."""
    last = 0
    for word in AT_WORD.finditer(text):
        if word.start() >= last and (domain := SPELLED_DOMAIN.match(text, word.end())):
            start = word.start()
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            while start < word.start() and text[start] == ".":
                start += 1
            if start < word.start():
                last = domain.end()
                yield start, last


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def iban_ok(value: str) -> bool:
    value = value.replace(" ", "")
    return len(value) >= 15 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def digits_of(value: str) -> str:
    return "".join(c for c in value if c in "0123456789")


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """The four kinds in order, each leftmost and non-overlapping; a match that fails its test is dropped."""
    if "@" in text:
        for start, end in emails(text):
            yield "email", start, end
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = digits_of(m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield "card", *m.span()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(digits_of(m[0])) <= 15:
                yield "phone", *m.span()


def more_candidates(text: str) -> Iterator[tuple[str, int, int]]:
    """Looser candidates outside the base, whose verdict is the method's."""
    if ("at" in text or "AT" in text) and ("dot" in text or "DOT" in text):  # as every spelled-out address has
        for start, end in spelled_addresses(text):
            yield "address", start, end
    for pattern in (GROUPS, IDENTITY):
        for m in pattern.finditer(text):
            yield "number", *m.span()
    for m in ACCOUNT.finditer(text):
        yield "account", *m.span()
    if HAS_TITLE.search(text):
        for m in PERSON.finditer(text):
            yield "person", *m.span()


def votes_on(text: str, kind: str, start: int, end: int) -> tuple[list[int], list[float]]:
    """Votes of the labelers (1 yes, 0 no, -1 abstains) and the classifier's own features."""
    value = text[start:end]
    before = text[max(0, start - 40) : start].lower().split()[-4:]
    after = text[end : end + 30].lower().split()[:2]
    near = {w.strip(".,:;()") for w in before + after}
    digits = digits_of(value)
    words = re.findall(r"[^\W\d_]+", value)
    strict = {"number": IDENTITY.fullmatch(value) or re.fullmatch(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", value), "account": iban_ok(value) if kind == "account" else False,
              "address": re.search(r"[\[(](?:at|AT)[\])]", value), "person": len(words) >= 3}.get(kind, True)
    checksum = -1
    if kind == "card":
        checksum = int(luhn(digits))
    elif kind == "account":
        checksum = int(iban_ok(value))
    gazetteer = -1
    if kind in ("person", "address"):
        gazetteer = 1 if any(w.lower() in GIVEN for w in words) else -1
    elif kind == "email":
        gazetteer = 1 if value.rsplit(".", 1)[-1].lower() in ("com", "org", "net", "de", "fr", "es", "edu", "uk") else -1
    wordy = kind in ("address", "person", "email")
    votes = [
        # An address without brackets is no sign against it, and neither are digits in a wordy kind.
        -1 if kind == "address" and not strict else int(bool(strict)), checksum, gazetteer, 1 if near & CONTEXT else -1, 0 if near & AGAINST else -1,
        int(len(set(digits)) > 2) if digits and not wordy else -1, 0 if start and text[start - 1] not in " \n\t(<[:\"'" else -1,
    ]
    features = [
        1.0, min(end - start, 40) / 40, len(digits) / max(1, end - start), len("".join(words)) / max(1, end - start),
        min(len(value.split()), 6) / 6, sum(map(value.count, "-. ()")) / max(1, end - start), sum(map(str.isupper, value)) / max(1, end - start),
    ]
    return votes, features


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.string()), ("features", pa.list_(pa.float64()))])
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            found = []
            text = text or ""
            base_found = list(base_spans(text))
            # Base spans by start, and how far those up to each reach: what overlaps one is no candidate of the method.
            ordered = sorted((s, e) for _, s, e in base_found)
            starts, reach = [s for s, _ in ordered], list(accumulate((e for _, e in ordered), max))
            free = [c for c in more_candidates(text) if not (k := bisect_left(starts, c[2])) or reach[k - 1] <= c[1]]
            for base, spans in ((True, base_found), (False, free)):
                for kind, start, end in spans:
                    votes, features = votes_on(text, kind, start, end)
                    found.append({"kind": KINDS.index(kind), "start": start, "end": end, "base": base, "votes": "".join("?01"[v + 1] for v in votes), "features": features})
            rows.append(found)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(span))], names=["doc_id", "found"])


def estimate(counts: list[tuple[int, str, int]], rounds: int = ROUNDS) -> dict[tuple[int, str], float]:
    """EM over (kind, votes, number): the probability of personal data for each vote pattern.

    Per kind a prevalence; per labeler the chances of its answers given the truth, shared by all kinds.
    """
    if not counts:
        return {}
    kinds = np.array([k for k, _, _ in counts])
    answers = np.array([["?01".index(c) for c in votes] for _, votes, _ in counts])
    n = np.array([c for _, _, c in counts], float)
    belief = 0.5 + 0.15 * ((answers == 2).sum(1) - (answers == 1).sum(1))
    belief = np.clip(belief, 0.05, 0.95)
    for _ in range(rounds):
        prevalence = np.array([((n * belief)[kinds == k].sum() + 1) / (n[kinds == k].sum() + 2) for k in range(len(KINDS))])
        score = np.log(prevalence[kinds]) - np.log(1 - prevalence[kinds])
        for labeler in range(answers.shape[1]):
            yes, no = (np.bincount(answers[:, labeler], n * w, 3) + 0.5 for w in (belief, 1 - belief))
            # A labeler's silence says nothing: only its answers, given that it answers, are weighed.
            yes, no = yes[1:] / yes[1:].sum(), no[1:] / no[1:].sum()
            ratio = np.concatenate([[0.0], np.clip(np.log(yes) - np.log(no), -4, 4)])
            score += ratio[answers[:, labeler]]
        belief = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return {(k, votes): float(b) for (k, votes, _), b in zip(counts, belief)}


def design(kind: int, votes: str, features: list[float]) -> list[float]:
    return [*features, *(float(v == "1") for v in votes), *(float(v == "0") for v in votes), *(float(kind == k) for k in range(len(KINDS)))]


def fit_span_classifier(rows: list[tuple[int, str, list[float], float, float]]) -> np.ndarray:
    """Weighted logistic regression on soft labels; rows are (kind, votes, features, belief, weight)."""
    width = len(FEATURES) + 2 * len(LABELERS) + len(KINDS)
    weights = np.zeros(width)
    if not rows:
        return weights
    x = np.array([design(k, v, f) for k, v, f, _, _ in rows])
    y, w = np.array([b for *_, b, _ in rows]), np.array([c for *_, c in rows], float)
    w = w / w.sum()
    adam = Adam([weights.shape], RATE)
    for _ in range(EPOCHS):
        adam.step([weights], [x.T @ (w * (y - 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))))) - 1e-4 * weights])
    return weights


def found_personal_data(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and ``spans`` (kind, start, end, base, probability) of every row, by kind as listed, then start.

    Code points, end exclusive. A null text is an empty one. A span of the method never overlaps a base span, nor an
    earlier one of its own kind; spans of one kind and start cannot tie. Repeated rows are repeated; an empty table gives
    no rows; other columns are not read. Texts of any length are read whole, in time in proportion to it. An action: the
    texts are read once, candidates with their votes are written, and the rest works on those.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body"))
    id_type = source.schema[0].dataType.simpleString()
    span = "struct<kind:int,start:bigint,end:bigint,base:boolean,votes:string,features:array<double>>"
    found = write_through(source.mapInArrow(_candidates, f"doc_id {id_type}, found array<{span}>"), "candidates")
    each = found.select(F.xxhash64("doc_id").alias("row"), F.explode("found").alias("f")).select("row", "f.*")
    # Vote patterns and kinds are few by construction (3 answers of 7 labelers, 8 kinds), whatever the number of rows.
    grouped = each.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()
    grouped.sort(key=lambda r: (r["kind"], r["votes"]))
    beliefs = estimate([(r["kind"], r["votes"], r["n"]) for r in grouped])
    shared = spark.sparkContext.broadcast(fit_span_classifier(_sampled_spans(each, grouped, beliefs)))
    out = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("probability", pa.float64())])
    schema = f"doc_id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean,probability:double>>"
    return found.mapInArrow(_decided(shared, threshold, out), schema)


def _sampled_spans(each: DataFrame, grouped: list, beliefs: dict[tuple[int, str], float]) -> list[tuple[int, str, list[float], float, float]]:
    """Spans to fit the classifier on: of every vote pattern so many at most, standing for all of its spans."""
    if not grouped:
        return []
    most = max(20, SAMPLE_SPANS // len(grouped))
    shares = each.sparkSession.createDataFrame([(r["kind"], r["votes"], min(1.0, most / r["n"])) for r in grouped], "kind int, votes string, share double")
    chance = F.pmod(F.xxhash64("row", "start", "end"), F.lit(1_000_000)) / 1_000_000
    picked = each.join(F.broadcast(shares), ["kind", "votes"]).where(chance < F.col("share")).select("kind", "votes", "features").collect()
    # Copies of a document may be picked together, so the bound is kept here as well.
    picked.sort(key=lambda r: (r["kind"], r["votes"], r["features"]))
    by_pattern = {key: list(rows) for key, rows in groupby(picked, key=lambda r: (r["kind"], r["votes"]))}
    out = []
    for r in grouped:
        rows = by_pattern.get((r["kind"], r["votes"]), [])
        some = rows[:: max(1, -(-len(rows) // most))]
        out += [(r["kind"], r["votes"], list(row["features"]), beliefs[r["kind"], r["votes"]], r["n"] / len(some)) for row in some]
    return out


def _decided(shared, threshold: float, span: pa.DataType):
    """Scores every candidate; of overlapping ones of a kind the first above the threshold stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, width = shared.value, len(FEATURES)
        for batch in batches:
            rows = []
            for found in batch.column(1).to_pylist():
                kept, ends = set(), [0] * len(KINDS)
                if found:
                    x = np.array([f["features"] for f in found]) @ weights[:width]
                    votes = np.array([f["votes"].encode() for f in found]).view("S1").reshape(len(found), -1)
                    x += (votes == b"1") @ weights[width : width + len(LABELERS)] + (votes == b"0") @ weights[width + len(LABELERS) : width + 2 * len(LABELERS)]
                    x += weights[width + 2 * len(LABELERS) :][[f["kind"] for f in found]]
                    probability = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
                    for f, p in sorted(zip(found, probability.tolist()), key=lambda fp: (fp[0]["kind"], fp[0]["start"], fp[0]["end"])):
                        if f["base"] or (p >= threshold and f["start"] >= ends[f["kind"]]):
                            kept.add((f["kind"], f["start"], f["end"], f["base"], p))
                            ends[f["kind"]] = max(ends[f["kind"]], f["end"])
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "base": b, "probability": p} for k, s, e, b, p in sorted(kept)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(span))], names=["doc_id", "spans"])

    return run

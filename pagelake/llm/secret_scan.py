"""Secret scan: a character convolutional network in numpy scores every candidate with its surroundings.

* Candidates are the three base patterns, which always stay, and every run of 12 or more key-like characters that
  has a digit and a letter, or both cases, unless a base span holds all of it.
* Labelled findings: documents carry no labels for secrets, so learning uses the base findings of all documents as
  positives, and their other candidates, e-mail addresses, links and a plain word of each document as negatives, with
  seeded examples of known key formats and of harmless look-alikes (identifiers, dates, versions, file names) put
  into contexts of negatives. What has the form of a seeded key is left without a label.
* Examples are dealt by hash into blocks of bounded size. In each round tasks take the network through all of their
  blocks, a block at a time from the same weights, and the driver gets the sum of weights of each task. One block of
  examples is learned in one task, over more passes.
* The network embeds the characters of a window of 64 and of 24 before and 12 after, convolves, takes maxima, and passes
  a hidden layer. A longer candidate is covered by windows half a window apart, and its score is that of the strongest, in
  learning and scoring alike. Platt scaling on a holdout, a quarter of all examples, calibrates its scores, counted by
  thousandths; the cutoff is the largest thousandth that keeps ``RECALL`` of the holdout's seeded keys, as it decides on
  nothing but candidates outside the base.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.crf import Adam
from pagelake.session import remove_folder, write_through

KINDS = ("assign", "access", "hex", "key")
RECALL = 0.98
#: Seeded examples: about so many at least, and one for so many others, so that keys keep their share of all.
SYNTHETIC, FOUND_PER_SEEDED = 4000, 5
#: Passes over the examples: of a single block, and rounds of one pass where there are several.
EPOCHS, ROUNDS = 12, 4
RATE, BATCH = 0.01, 128
#: Examples and bytes of a block, on average.
BLOCK, BLOCK_BYTES = 16_384, 1 << 22
BEFORE, INSIDE, AFTER = 24, 64, 12
#: Steps of a score in which the holdout is counted, steps of a weight in which weights are summed: whole numbers add up the same in any order.
SCORE_STEPS, WEIGHT_STEPS = 1000, 1 << 28
LENGTH = BEFORE + INSIDE + AFTER
EMBED, FILTERS, WIDTH, HIDDEN = 8, 24, 5, 16

# Letters count in either case there, within ASCII.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]++")
HEX = re.compile(r"[0-9a-f]{16,}+")
KEY_LIKE = re.compile(r"[A-Za-z0-9+/_=-]{12,}+")
KNOWN_KEY = re.compile(r"gh[a-z]_[A-Za-z0-9]{20}|sk_live_[A-Za-z0-9]{16}|xox[a-z]-[0-9]{8}|AIza[A-Za-z0-9_-]{30}|eyJ[A-Za-z0-9_-]{20}")
RANDOM_RUN = re.compile(r"[A-Za-z0-9+/]{28,}+")


def base_spans(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, True), each kind leftmost and non-overlapping; a match that fails its test is dropped."""
    out = []
    lower = text.lower()
    if any(word in lower for word in ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign", True) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", True) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex", True) for m in HEX.finditer(text)]
    return out


def mixed_characters(value: str) -> bool:
    digits = any(c in "0123456789" for c in value)
    lower, upper = value != value.upper(), value != value.lower()
    return (digits and (lower or upper)) or (lower and upper and value[1:] != value[1:].lower())


def candidates(text: str) -> list[tuple[int, int, str, bool]]:
    """Base spans and other key-like runs, by start, then kind as listed. A run that reaches beyond a base span is one of its own."""
    out = base_spans(text)
    base = sorted((s, e) for s, e, _, _ in out)
    at, reach = 0, 0
    for m in KEY_LIKE.finditer(text):
        while at < len(base) and base[at][0] <= m.start():
            reach = max(reach, base[at][1])
            at += 1
        if reach < m.end() and mixed_characters(m[0]):
            out.append((m.start(), m.end(), "key", False))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """The candidate, or where it is longer than a window, windows that cover it and overlap by half."""
    if end - start <= INSIDE:
        return [(start, end)]
    return [(s, s + INSIDE) for s in (*range(start, end - INSIDE, INSIDE // 2), end - INSIDE)]


def may_be_key(value: str) -> bool:
    """Whether a value has the form of a seeded key, a random run included: such a one is no example of the harmless."""
    return bool(KNOWN_KEY.search(value)) or any(
        all(sum(low <= c <= high for c in m[0]) >= least for low, high, least in (("A", "Z", 5), ("a", "z", 5), ("0", "9", 2))) for m in RANDOM_RUN.finditer(value)
    )


def encoded(text: str, start: int, end: int) -> np.ndarray:
    """Characters of a window and around it as numbers below 128; places outside the text are 0, other characters 1."""
    whole = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0") + text[start:end].ljust(INSIDE, "\0") + text[end : end + AFTER].ljust(AFTER, "\0")
    return np.frombuffer(whole.encode("ascii", "replace").replace(b"?", b"\1"), np.uint8).astype(np.int64) & 127


def packed(text: str, start: int, end: int) -> bytes:
    """A candidate of any length and the characters around it, numbered as in ``encoded``."""
    whole = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0") + text[start:end] + text[end : end + AFTER].ljust(AFTER, "\0")
    return whole.encode("ascii", "replace").replace(b"?", b"\1")


def unpacked(examples: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The windows of all examples as ``encoded`` gives them, and each example's number of windows."""
    out, sizes = [], []
    for example in examples:
        inner = len(example) - BEFORE - AFTER
        of = windows(0, inner)
        sizes.append(len(of))
        if inner <= INSIDE:
            out.append(example[: BEFORE + inner].ljust(BEFORE + INSIDE, b"\0") + example[BEFORE + inner :])
        else:
            out += [example[low : low + LENGTH] for low, _ in of]
    return np.frombuffer(b"".join(out), np.uint8).reshape(-1, LENGTH) & 127, np.array(sizes, np.int64)


class CharNetwork:
    """Embedding, convolution, maximum over places (inside and outside the candidate apart), hidden layer, logistic output."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        shape = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.values = [rng.normal(0, 0.3, (128, EMBED)), shape(WIDTH * (EMBED + 1), FILTERS), np.zeros(FILTERS), shape(2 * FILTERS, HIDDEN), np.zeros(HIDDEN), shape(HIDDEN, 1), np.zeros(1)]
        self.scale, self.shift, self.cutoff = 1.0, 0.0, 0.5

    def _forward(self, codes: np.ndarray):
        table, kernel, bias, w1, b1, w2, b2 = self.values
        n = len(codes)
        inside = np.zeros(LENGTH)
        inside[BEFORE : BEFORE + INSIDE] = 1
        x = np.concatenate([table[codes], np.broadcast_to(inside[None, :, None], (n, LENGTH, 1))], axis=2)
        places = LENGTH - WIDTH + 1
        windows = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(n, places, -1)
        c = windows @ kernel + bias
        within = slice(BEFORE, BEFORE + INSIDE - WIDTH + 1)
        outer = c.copy()
        outer[:, within] = -np.inf
        in_at, out_at = c[:, within].argmax(1) + BEFORE, outer.argmax(1)
        rows, cols = np.arange(n)[:, None], np.arange(FILTERS)[None]
        pooled = np.concatenate([c[rows, in_at, cols], c[rows, out_at, cols]], axis=1)
        p = np.maximum(pooled, 0)
        h = np.maximum(p @ w1 + b1, 0)
        return windows, in_at, out_at, pooled, p, h, (h @ w2 + b2)[:, 0]

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(codes[k : k + BATCH])[-1] for k in range(0, len(codes), BATCH)]) if len(codes) else np.zeros(0)

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(codes) + self.shift, -30, 30)))

    def strongest(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of every candidate, which has the next ``sizes`` windows, the position of the one with the largest score."""
        if (sizes == 1).all():
            return np.arange(len(codes))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        z, several = np.zeros(len(codes)), np.repeat(sizes > 1, sizes)
        z[several] = self.logits(codes[several])
        return np.lexsort((z, owner))[np.cumsum(sizes) - 1]

    def fit(self, codes: np.ndarray, labels: np.ndarray, sizes: np.ndarray | None = None, seed: int = 4, epochs: int = EPOCHS) -> None:
        rng = np.random.default_rng(seed)
        adam = Adam([v.shape for v in self.values], RATE)
        for _ in range(epochs):
            best = self.strongest(codes, np.ones(len(codes), int) if sizes is None else sizes)
            order = rng.permutation(len(best))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                self._step(adam, codes[best[some]], labels[some])

    def _step(self, adam: Adam, codes: np.ndarray, labels: np.ndarray) -> None:
        table, kernel, _, w1, _, w2, _ = self.values
        windows, in_at, out_at, pooled, p, h, z = self._forward(codes)
        n = len(codes)
        d = (labels - 1 / (1 + np.exp(-np.clip(z, -30, 30))))[:, None] / n
        dh = (d @ w2.T) * (h > 0)
        dp = (dh @ w1.T) * (pooled > 0)
        d_kernel, d_table, d_bias = np.zeros_like(kernel), np.zeros_like(table), np.zeros(FILTERS)
        rows = np.arange(n)[:, None]
        for where, part in ((in_at, dp[:, :FILTERS]), (out_at, dp[:, FILTERS:])):
            seen = windows[rows, where]
            d_kernel += np.einsum("nf,nfk->kf", part, seen)
            d_bias += part.sum(0)
            back = (part[:, :, None] * kernel.T[None]).reshape(n, FILTERS, WIDTH, EMBED + 1)[..., :EMBED]
            at = codes[rows[:, :, None], where[:, :, None] + np.arange(WIDTH)]
            np.add.at(d_table, at.reshape(-1), back.reshape(-1, EMBED))
        adam.step(self.values, [d_table, d_kernel, d_bias, p.T @ dh, dh.sum(0), h.T @ d, d.sum(0)])

    def calibrate(self, codes: np.ndarray, labels: np.ndarray, recall: float = RECALL, decided: np.ndarray | None = None) -> None:
        """Platt scaling, then the largest cutoff that keeps ``recall`` of the holdout's positives of the kind it decides on
        (``decided``; all positives, if not given)."""
        self.calibrate_scores(self.logits(codes), labels, np.ones(len(labels)), recall, decided)

    def calibrate_scores(self, z: np.ndarray, labels: np.ndarray, counts: np.ndarray, recall: float = RECALL, decided: np.ndarray | None = None) -> None:
        """As ``calibrate``, from the raw scores and how often each occurs."""
        values = [np.array([1.0]), np.array([0.0])]
        adam = Adam([(1,), (1,)], 0.05)
        positive, every = max(1, int(counts[labels > 0].sum())), max(1, counts.sum())
        target = np.where(labels > 0, (positive + 1) / (positive + 2), 1 / (every - positive + 2))
        for _ in range(400):
            miss = counts * (target - 1 / (1 + np.exp(-np.clip(values[0] * z + values[1], -30, 30))))
            adam.step(values, [np.array([(miss * z).sum() / every]), np.array([miss.sum() / every])])
        self.scale, self.shift = float(values[0][0]), float(values[1][0])
        own = (labels > 0) if decided is None else (labels > 0) & decided
        chance = 1 / (1 + np.exp(-np.clip(self.scale * z[own] + self.shift, -30, 30)))
        if len(chance):
            order = np.argsort(chance, kind="stable")
            below = np.cumsum(counts[own][order])
            self.cutoff = float(chance[order][np.searchsorted(below, np.floor((1 - recall) * below[-1]), side="right")])


def made_values(rng: np.random.Generator) -> tuple[str, int]:
    """A seeded example of a known key format (1) or of a harmless look-alike (0)."""
    pick = lambda alphabet, n: "".join(rng.choice(list(alphabet), n))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    kind = int(rng.integers(12))
    if kind == 0:
        return "ghp_" + pick(lower + upper + digits, 36), 1
    if kind == 1:
        return "sk_live_" + pick(lower + upper + digits, 24), 1
    if kind == 2:
        return "xoxb-" + pick(digits, 11) + "-" + pick(lower + upper + digits, 24), 1
    if kind == 3:
        return "AIza" + pick(lower + upper + digits + "-_", 35), 1
    if kind == 4:
        return "eyJ" + pick(lower + upper + digits + "-_", int(rng.integers(30, 80))), 1
    if kind == 5:
        return pick(lower + upper + digits + "+/", int(rng.integers(28, 60))), 1
    if kind == 6:
        return f"{rng.integers(1990, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}T{rng.integers(24):02d}-00-00", 0
    if kind == 7:
        return "-".join(pick(lower, int(rng.integers(3, 9))) for _ in range(3)) + "-" + pick(digits, 2), 0
    if kind == 8:
        return pick(lower, 8) + "_" + pick(lower, 6) + "_v" + pick(digits, 1), 0
    if kind == 9:
        return pick(upper, 1) + pick(lower, 7) + pick(upper, 1) + pick(lower, 7) + pick(upper, 1) + pick(lower, 4), 0
    if kind == 10:
        return pick(upper, 4) + "-" + pick(digits, 4) + "-" + pick(digits, 5), 0
    return pick(lower, int(rng.integers(12, 24))) + pick(digits, int(rng.integers(1, 3))), 0


EXAMPLE = "number long, place long, label int, codes binary"
EXAMPLE_ARROW = pa.schema([("number", pa.int64()), ("place", pa.int64()), ("label", pa.int32()), ("codes", pa.binary())])


def _findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every candidate of a document as an example (label 1: base) and one plain word, with doc_id and place."""
    for batch in batches:
        rows = []
        for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            number = number or 0
            found = candidates(text)
            for start, end, _, base in found:
                # A run with a base span in it is no example of the harmless.
                if base or not (may_be_key(text[start:end]) or base_spans(text[start:end])):
                    rows.append((number, start, int(base), packed(text, start, end)))
            if len(text) > 200:
                at = int(np.random.default_rng(number % (1 << 32)).integers(0, len(text) - 100))
                cut = text.find(" ", at) + 1
                stop = text.find(" ", cut + 1)
                if 0 < cut < stop and not may_be_key(text[cut:stop]) and not any(s < stop and cut < e for s, e, _, base in found if base):
                    rows.append((number, -1 - cut, 0, packed(text, cut, stop)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, EXAMPLE_ARROW)], schema=EXAMPLE_ARROW)


def _seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (draw, times, codes): so many made values in that example's place."""
    for batch in batches:
        rows = []
        for draw, times, codes in zip(*(c.to_pylist() for c in batch.columns)):
            for k in range(times):
                value, label = made_values(np.random.default_rng([draw % (1 << 64), k]))
                rows.append((draw, k, label, codes[:BEFORE] + value.encode() + codes[-AFTER:]))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, EXAMPLE_ARROW)], schema=EXAMPLE_ARROW)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Number, windows, labels, sizes and whether seeded of each block."""
    for batch in batches:
        for block, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows = rows.values.flatten()
            windows, sizes = unpacked(rows[2].to_pylist())
            yield block, windows, np.asarray(rows[3]).astype(float), sizes, np.asarray(rows[1]) > 0


def _passed(shared, epochs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = CharNetwork()
        n, sums = 0, [np.zeros(v.shape, np.int64) for v in network.values]
        for block, codes, labels, sizes, _ in _blocks(batches):
            network.values = [v.copy() for v in shared.value.values]
            network.fit(codes, labels, sizes, block, epochs)
            n += len(labels)
            for total, value in zip(sums, network.values):
                total += np.rint(value * WEIGHT_STEPS).astype(np.int64) * len(labels)
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "sums": [np.concatenate([v.ravel() for v in sums]).tobytes()]})

    return run


def _counted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        for _, codes, labels, sizes, seeded in _blocks(batches):
            z = np.rint(np.clip(network.logits(codes[network.strongest(codes, sizes)]), -1000, 1000) * SCORE_STEPS).astype(np.int64)
            kinds, counts = np.unique(np.stack([z, labels.astype(np.int64), seeded.astype(np.int64)]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([*map(pa.array, kinds), pa.array(counts, pa.int64())], names=["z", "label", "seeded", "n"])

    return run


def learning_examples(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folders: list[str] | None = None) -> DataFrame:
    """draw, seeded, codes and label of every example of every text. An action; its folder is added to ``folders``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("body")).where("body is not null")
    # Equal examples, of repeated rows or those without ids, are numbered so that no block gets all of them.
    equal = rows.mapInArrow(_findings, EXAMPLE).groupBy("number", "place", "label", "codes").agg(F.count("*").alias("copies"))
    each = equal.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    found = write_through(each.select("label", "codes", F.xxhash64("number", "place", "label", "codes", "copy").alias("draw")), "findings", folders)
    counts = found.agg(F.count("*").alias("n"), F.count(F.when(F.col("label") == 0, 1)).alias("places")).first()
    seeded = max(SYNTHETIC, counts["n"] // FOUND_PER_SEEDED)
    if counts["places"]:
        whole, rest = divmod(seeded * 1_000_000 // counts["places"], 1_000_000)
        times = F.lit(whole) + (F.pmod(F.xxhash64("draw", F.lit(5)), F.lit(1_000_000)) < rest).cast("int")
        places = found.where("label = 0").select("draw", times.cast("int").alias("times"), "codes").where("times > 0")
    else:
        places = spark.range(seeded).select(F.xxhash64("id").alias("draw"), F.lit(1).alias("times"), F.lit(bytes(BEFORE + AFTER)).alias("codes"))
    made = write_through(places.mapInArrow(_seeded, EXAMPLE).withColumn("draw", F.xxhash64("number", "place", F.lit("seeded"))), "seeded", folders)
    columns = "draw", "seeded", "codes", "label"
    return found.withColumn("seeded", F.lit(0)).select(*columns).unionByName(made.withColumn("seeded", F.lit(1)).select(*columns))


def learned_network(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> CharNetwork:
    """Fits on three quarters of all examples of all documents, calibrates and cuts on the others. ``learned_from`` counts them."""
    spark = docs.sparkSession
    examples = learning_examples(docs, doc_id, text, trash := [])
    size = examples.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("codes")), F.lit(0)).alias("bytes")).first()
    count = max(1, -(-size["n"] // BLOCK), -(-size["bytes"] // BLOCK_BYTES))
    # Blocks of the holdout come after the others. Each holds its examples sorted, so what is learned does not depend on how rows came.
    block = F.pmod(F.xxhash64("draw", F.lit(7)), F.lit(count)) + F.when(F.pmod(F.xxhash64("draw", F.lit(11)), F.lit(4)) == 0, count).otherwise(0)
    dealt = examples.withColumn("block", block).repartition(count, "block").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("draw", "seeded", "codes", "label"))).alias("rows"))
    blocks = write_through(dealt, "blocks", trash)
    network = CharNetwork()
    rounds, epochs = (1, EPOCHS) if count == 1 else (ROUNDS, 1)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(network)
        got = blocks.where(F.col("block") < count).mapInArrow(_passed(shared, epochs), "n long, sums binary").collect()
        shared.destroy()
        if got:
            mean = sum(np.frombuffer(r["sums"], np.int64) for r in got) / (sum(r["n"] for r in got) * WEIGHT_STEPS)
            edges = np.cumsum([v.size for v in network.values])[:-1]
            network.values = [part.reshape(v.shape) for part, v in zip(np.split(mean, edges), network.values)]
    shared = spark.sparkContext.broadcast(network)
    scores = blocks.where(F.col("block") >= count).mapInArrow(_counted(shared), "z long, label long, seeded long, n long")
    held = scores.groupBy("z", "label", "seeded").agg(F.sum("n").alias("n")).orderBy("z", "label", "seeded").collect()
    shared.destroy()
    for folder in trash:
        remove_folder(spark, folder)
    if held:
        z, labels, seeded, counts = (np.array(c, float) for c in zip(*held))
        # Base findings stay whatever their score, so only the seeded keys say where others are cut.
        network.calibrate_scores(z / SCORE_STEPS, labels, counts, decided=seeded > 0)
    network.learned_from = size["n"]
    return network


def found_secrets(docs: DataFrame, network: CharNetwork, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``spans`` (start, end, kind, base, probability) of every row, by start, then kind as listed.

    The network scores every candidate whole, however long; base spans stay whatever their score, others from the cutoff
    on. Spans of one start and kind cannot tie, as a kind's spans do not overlap. A null text is an empty one; repeated
    rows are repeated; an empty table gives no rows; other columns are not read. Code points, end exclusive.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_()), ("probability", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        for batch in batches:
            found, codes, sizes = [], [], []
            scores = []

            def flush():
                if codes:
                    scores.append(network.probabilities(np.stack(codes)))
                    codes.clear()

            for body in batch.column(1):
                value = body.as_py() or ""
                own = candidates(value)
                found.append(own)
                for start, end, *_ in own:
                    of = windows(start, end)
                    sizes.append(len(of))
                    for s, e in of:
                        codes.append(encoded(value, s, e))
                        if len(codes) >= 4096:
                            flush()
            flush()
            every = np.concatenate(scores) if scores else np.zeros(0)
            firsts = np.cumsum([0, *sizes[:-1]]) if sizes else []
            probability = iter(np.maximum.reduceat(every, firsts).tolist() if len(every) else ())
            rows = [
                [{"start": s, "end": e, "kind": k, "base": b, "probability": p} for (s, e, k, b), p in zip(own, probability) if b or p >= network.cutoff]
                if own else [] for own in found
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(span))], names=["doc_id", "spans"])

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body"))
    return source.mapInArrow(run, f"doc_id {source.schema[0].dataType.simpleString()}, spans array<struct<start:bigint,end:bigint,kind:string,base:boolean,probability:double>>")

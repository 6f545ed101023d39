"""Document quality from line labels: a linear-chain conditional random field over the lines of a text.

Each line with a word has features of its own and those of the lines before and after it; learned transitions
tie neighbouring labels. Forward-backward gives every line the probability of being good; the mean of these,
weighted by the lines' lengths, is the document's score.

Lines carry no labels of their own, so learning gives each line its document's. It is fitted on a sample bounded
by ``SAMPLE_PER_LABEL`` documents of each label with at most ``SAMPLE_LINES`` consecutive lines of each. Every line
of every text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.crf import Adam, expectations, marginals, observed
from pagelake.llm.holdout import bounded_sample, held_out

SAMPLE_PER_LABEL, SAMPLE_LINES = 1500, 60
EPOCHS, RATE, DECAY = 150, 0.1, 1e-3
THRESHOLD = 0.7
BLOCK_CHARS = 1 << 19
SYMBOLS = "#*$%&|<>"
OWN = (
    "bias", "length", "few words", "symbols", "no symbols", "bars", "marks", "shouted", "many shouted", "variety", "low variety",
    "repeats", "many repeats", "word length", "long words", "digits", "ends a sentence", "starts upper", "commas", "seen before",
)


def line_features(line: str, words: list[str], seen: bool) -> list[float]:
    n, chars = len(words), len(line)
    symbols = sum(map(line.count, SYMBOLS)) / n
    shouted = sum(map(str.isupper, words)) / n
    variety = len(set(words)) / n
    repeats = sum(map(eq, words, words[1:])) / n
    mean = chars / n
    return [
        1.0, min(n, 60) / 60, float(n < 4), min(symbols, 3.0), float(symbols == 0), min(line.count("|") / n, 1.0),
        min(line.count("!") / n, 2.0), shouted, float(shouted > 0.5 and n > 2), variety, float(n >= 10 and variety < 0.4), repeats,
        float(repeats > 0.3), min(mean, 20.0) / 20, float(mean > 14), sum(map(str.isdigit, words)) / n,
        float(words[-1][-1] in ".!?:"), float(words[0][0].isupper()), min(line.count(",") / n, 1.0), float(seen),
    ]


def text_lines(text: str | None) -> tuple[list[list[float]], list[int]]:
    """Features and lengths of the lines that have a word."""
    features, sizes, seen = [], [], set()
    for line in (text or "").split("\n"):
        if words := line.split():
            features.append(line_features(line, words, line in seen))
            sizes.append(len(line))
            seen.add(line)
    return features, sizes


def with_neighbours(own: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the line before and the line after in its text; zeros at the ends."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    starts, ends = bounds[:-1][np.diff(bounds) > 0], bounds[1:][np.diff(bounds) > 0] - 1
    before[starts], after[ends] = 0, 0
    return np.concatenate([own, before, after], axis=1)


class LineModel:
    def __init__(self, weights: np.ndarray, trans: np.ndarray, start: np.ndarray, prior: float):
        self.weights, self.trans, self.start, self.prior = weights, trans, start, prior

    def line_marginals(self, own: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return marginals(with_neighbours(own, bounds) @ self.weights, bounds, self.trans, self.start)[:, 1]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        features, sizes, counts = [], [], []
        for text in texts:
            own, lengths = text_lines(text)
            features += own
            sizes += lengths
            counts.append(len(own))
        bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        if not features:
            return np.full(len(texts), self.prior)
        good = self.line_marginals(np.array(features), bounds)
        weight = np.concatenate([[0], np.cumsum(np.array(sizes, float))])
        total = np.concatenate([[0], np.cumsum(good * np.array(sizes, float))])
        length = weight[bounds[1:]] - weight[bounds[:-1]]
        mean = (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(length, 1)
        return np.clip(np.where(length > 0, mean, self.prior), 0, 1)


def fit_line_model(sequences: list[tuple[int, np.ndarray]], prior: float) -> LineModel:
    width = 3 * len(OWN)
    weights, trans, start = np.zeros((width, 2)), np.zeros((2, 2)), np.zeros(2)
    if not sequences:
        return LineModel(weights, trans, start, prior)
    bounds = np.concatenate([[0], np.cumsum([len(x) for _, x in sequences])])
    x = with_neighbours(np.concatenate([x for _, x in sequences]), bounds)
    tags = np.repeat([label for label, _ in sequences], np.diff(bounds))
    hot, moves, first = observed(tags, bounds, 2)
    adam = Adam([weights.shape, trans.shape, start.shape], RATE)
    for _ in range(EPOCHS):
        gamma, expected_moves, expected_first = expectations(x @ weights, bounds, trans, start)
        adam.step([weights, trans, start], [
            x.T @ (hot - gamma) / len(x) - DECAY * weights, (moves - expected_moves) / len(x) - DECAY * trans, (first - expected_first) / len(x) - DECAY * start,
        ])
    return LineModel(weights, trans, start, prior)


def _sampled_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("lines", pa.list_(pa.list_(pa.float64())))])
    for batch in batches:
        out = {"doc_id": [], "label": [], "lines": []}
        for number, label, text in zip(*(c.to_pylist() for c in batch.columns)):
            own, _ = text_lines(text)
            if own:
                at = number % (len(own) - SAMPLE_LINES) if len(own) > SAMPLE_LINES else 0
                out["doc_id"].append(number)
                out["label"].append(label)
                out["lines"].append(own[at : at + SAMPLE_LINES])
        yield pa.RecordBatch.from_pydict(out, kind)


def learned_line_model(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> LineModel:
    """Fits on documents with a label that are not held out. Where a document has several labels, the smallest counts."""
    marks = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("label")).where(~held_out())
    counts = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    prior = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    # The drawn ids are bounded by the sample's size, so they go to where the texts are, not the texts to them.
    ids = bounded_sample(marks, "label", SAMPLE_PER_LABEL, 2 * SAMPLE_PER_LABEL).collect()
    drawn = F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id long, label int"))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("body"))
    rows = texts.join(drawn, "doc_id").select("doc_id", "label", "body").mapInArrow(_sampled_lines, "doc_id long, label int, lines array<array<double>>").collect()
    rows.sort(key=lambda r: (r["doc_id"], len(r["lines"]), r["lines"]))
    return fit_line_model([(r["label"], np.array(r["lines"])) for r in rows], prior)


def scored(docs: DataFrame, model: LineModel, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of every row. A text without words, or null, has the share
    of label 1 among the labelled rows; repeated rows are repeated; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.utf8_length(batch.column(1)), 0))
            at = 0
            while at < len(sizes):
                stop = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), BLOCK_CHARS)) + at)
                part = batch.slice(at, stop - at)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.scores(part.column(1).to_pylist()))], names=["doc_id", "score"])
                at = stop

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body"))
    return source.mapInArrow(run, f"doc_id {source.schema[0].dataType.simpleString()}, score double")

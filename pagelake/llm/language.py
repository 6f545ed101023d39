"""Language identification: a linear-chain conditional random field over the words of a text.

A word's emission comes from its character n-grams of two to four with both ends marked (those that touch an end
are its affixes) and from lexicons of the frequent words of each language, all learned. Transitions between the
languages of neighbouring words are learned too, from windows of one document and from windows spliced of two
documents, as in code-switched text. Scoring runs forward-backward over every word of the whole text; the mean
marginals are the document's language mixture.

The model is fitted on a sample bounded by ``SAMPLE_PER_LANGUAGE`` and ``SAMPLE_ALL`` documents with at most
``WINDOWS`` windows of ``WINDOW_WORDS`` words each. Everything is scored.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.crf import Adam, expectations, marginals, observed
from pagelake.llm.holdout import bounded_sample, held_out

SAMPLE_PER_LANGUAGE, SAMPLE_ALL = 700, 8000
WINDOWS, WINDOW_WORDS = 2, 40
SPLICED = 0.4
EPOCHS, RATE, DECAY = 40, 0.15, 1e-4
LEXICON_WORDS = 150
MIN_COUNT = 3
MEMO_WORDS = 150_000
BLOCK_CHARS = 1 << 19
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def features_of(word: str) -> list[str]:
    marked = f"<{word}>"
    n = len(marked)
    return [marked[k : k + size] for size in (2, 3, 4) for k in range(n - size + 1)]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {"label": [], "words": []}
        for number, label, text in zip(*(c.to_pylist() for c in batch.columns)):
            words = words_of(text)
            rng = np.random.default_rng(abs(number) % (1 << 32))
            if len(words) <= WINDOW_WORDS * WINDOWS:
                starts = range(0, len(words), WINDOW_WORDS)
            else:
                starts = rng.integers(0, len(words) - WINDOW_WORDS, WINDOWS).tolist()
            for at in starts:
                out["label"].append(label)
                out["words"].append([w[:60] for w in words[at : at + WINDOW_WORDS]])
        yield pa.RecordBatch.from_pydict(out, pa.schema([("label", pa.string()), ("words", pa.list_(pa.string()))]))


class LanguageModel:
    def __init__(self, languages: list[str], features: dict[str, int], weights: np.ndarray, trans: np.ndarray, start: np.ndarray):
        self.languages, self.features, self.weights, self.trans, self.start = languages, features, weights, trans, start
        self.index = self._index()
        self._forget()

    def __getstate__(self):
        return self.languages, self.features, self.weights, self.trans, self.start

    def __setstate__(self, state):
        self.__init__(*state)

    def _index(self) -> tuple[np.ndarray, int, np.ndarray, np.ndarray] | None:
        """Numbers of the features' letters, bits a number takes, the features as packed numbers, sorted, and their places;
        None where the letters are too many to pack four of them."""
        grams = [f for f in self.features if not f.startswith("=")]
        letters = sorted(set("".join(grams)))
        bits = len(letters).bit_length()
        if 4 * bits > 63:
            return None
        number = np.zeros(sys.maxunicode + 1, np.uint16)
        number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        of = {c: k for k, c in enumerate(letters, 1)}
        packed = np.array([sum(of[c] << bits * k for k, c in enumerate(reversed(f))) for f in grams], np.int64)
        order = np.argsort(packed)
        return number, bits, packed[order], np.array([self.features[f] for f in grams], np.int64)[order]

    def _sums(self, words: list[str]) -> np.ndarray:
        """Summed weights of the words' n-grams, for all words at once. A number packs an n-gram; no letter has number 0, so
        n-grams of different lengths never share one."""
        size = self.weights.shape[1]
        if self.index is None or not len(self.index[2]):
            rows = np.zeros((len(words), size))
            for k, word in enumerate(words):
                for f in features_of(word):
                    if f in self.features:
                        rows[k] += self.weights[self.features[f]]
            return rows
        number, bits, packed, places = self.index
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
        letters = number[np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        owner = np.repeat(np.arange(len(words)), lengths)
        left = np.cumsum(lengths)[owner] - np.arange(len(owner))
        owners, found, grams, whole = [], [], letters, letters > 0
        for n in (2, 3, 4):
            # Every n-gram is the one before it and a letter more.
            grams = (grams[:-1] << bits) | letters[n - 1 :]
            whole = whole[:-1] & (letters[n - 1 :] > 0)
            some = np.flatnonzero(whole & (left[: len(grams)] >= n))
            at = np.minimum(np.searchsorted(packed, grams[some]), len(packed) - 1)
            hit = packed[at] == grams[some]
            owners.append(owner[some[hit]])
            found.append(places[at[hit]])
        owners, found = np.concatenate(owners), np.concatenate(found)
        return np.stack([np.bincount(owners, self.weights[found, k], len(words)) for k in range(size)], axis=1)

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(self.languages)))

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of words by language; a word's score depends on the word alone, so known words are looked up."""
        known = self.known
        fresh = list(set(words).difference(known))
        if fresh:
            rows = self._sums(fresh)
            lexicon = np.fromiter((self.features.get("=" + w, -1) for w in fresh), np.int64, len(fresh))
            rows[lexicon >= 0] += self.weights[lexicon[lexicon >= 0]]
            known.update(zip(fresh, range(len(self.table), len(self.table) + len(fresh))))
            self.table = np.concatenate([self.table, rows])
        emit = self.table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]
        if len(known) > MEMO_WORDS:
            self._forget()
        return emit

    def word_marginals(self, words: list[str], bounds: np.ndarray) -> np.ndarray:
        return marginals(self.emissions(words), bounds, self.trans, self.start)

    def mixtures(self, texts: list[str | None]) -> np.ndarray:
        """Mean marginals of the languages per text; rows of zeros for texts without a letter."""
        words, counts = [], []
        for text in texts:
            own = words_of(text)
            if own and not any(map(str.isalpha, text)):
                own = []
            words += own
            counts.append(len(own))
        bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        sums = np.concatenate([np.zeros((1, len(self.languages))), np.cumsum(self.word_marginals(words, bounds), axis=0)])
        return (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)[:, None]


def fit_language_model(labels: list[str], windows: list[list[str]], seed: int = 5) -> LanguageModel | None:
    """Maximum likelihood with decay, by full-batch Adam; the sample's order does not matter."""
    pairs = sorted((label, words) for label, words in zip(labels, windows) if words)
    if not pairs:
        return None
    languages = sorted({label for label, _ in pairs})
    number = {label: k for k, label in enumerate(languages)}
    rng = np.random.default_rng(seed)
    sequences = []
    for label, words in pairs:
        tags = [number[label]] * len(words)
        if rng.random() < SPLICED:
            other, more = pairs[rng.integers(len(pairs))]
            cut, turn = int(rng.integers(1, len(words) + 1)), int(rng.integers(0, len(more)))
            words, tags = words[:cut] + more[turn:], tags[:cut] + [number[other]] * (len(more) - turn)
        sequences.append((words, tags))
    flat = [w for words, _ in sequences for w in words]
    tags = np.array([t for _, own in sequences for t in own])
    bounds = np.concatenate([[0], np.cumsum([len(w) for w, _ in sequences])])
    vocabulary = sorted(set(flat))
    place = {w: k for k, w in enumerate(vocabulary)}
    at = np.array([place[w] for w in flat])

    by_language = [Counter() for _ in languages]
    for word, tag in zip(flat, tags.tolist()):
        by_language[tag][word] += 1
    lexicon = {w for counts in by_language for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LEXICON_WORDS]}
    seen = Counter(f for w in vocabulary for f in features_of(w))
    names = sorted(f for f, n in seen.items() if n >= MIN_COUNT) + ["=" + w for w in sorted(lexicon)]
    features = {f: k for k, f in enumerate(names)}
    refs, sizes = [], []
    for w in vocabulary:
        own = [features[f] for f in features_of(w) if f in features] + ([features["=" + w]] if w in lexicon else [])
        refs += own
        sizes.append(len(own))
    refs, of_word = np.array(refs, np.int64), np.repeat(np.arange(len(vocabulary)), sizes)

    size = len(languages)
    weights, trans, start = np.zeros((len(names), size)), np.zeros((size, size)), np.zeros(size)
    hot, moves, first = observed(tags, bounds, size)
    adam = Adam([weights.shape, trans.shape, start.shape], RATE)
    for _ in range(EPOCHS):
        scores = np.stack([np.bincount(of_word, weights[refs, k], len(vocabulary)) for k in range(size)], axis=1)
        gamma, expected_moves, expected_first = expectations(scores[at], bounds, trans, start)
        miss = hot - gamma
        by_word = np.stack([np.bincount(at, miss[:, k], len(vocabulary)) for k in range(size)], axis=1)
        grad = np.stack([np.bincount(refs, by_word[of_word, k], len(names)) for k in range(size)], axis=1)
        adam.step([weights, trans, start], [grad / len(flat) - DECAY * weights, (moves - expected_moves) / len(flat), (first - expected_first) / len(flat)])
    return LanguageModel(languages, features, weights, trans, start)


def learned_model(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel | None:
    """Fits on rows that are not held out and have an id, a language and a text."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).alias("label"), F.col(text).alias("body"))
    rows = rows.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sample = bounded_sample(rows, "label", SAMPLE_PER_LANGUAGE, SAMPLE_ALL)
    got = sample.select("doc_id", "label", "body").mapInArrow(_windows, "label string, words array<string>").collect()
    return fit_language_model([r["label"] for r in got], [r["words"] for r in got])


def identified(docs: DataFrame, model: LanguageModel | None, *, doc_id: str = "doc_id", text: str = "text", keep: list[str] = (), keep_text: bool = False) -> DataFrame:
    """doc_id, ``keep`` (and the text, as ``text``, on demand), lang_pred, score and languages (those with a tenth of the words or more) of every row.

    ``und`` with score 0 where the text is null or has no letter, or where nothing could be learned. Repeated rows
    are repeated; other columns are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"), *[F.col(c) for c in keep])
    passed = [c for c in source.columns if keep_text or c != "__text"]
    fields = [f.simpleString().replace(":", " ", 1) for f in source.schema if keep_text or f.name != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(1)
            sizes = np.asarray(pc.fill_null(pc.utf8_length(texts), 0))
            at = 0
            while at < len(sizes):
                stop = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), BLOCK_CHARS)) + at)
                part = batch.slice(at, stop - at)
                n = part.num_rows
                if model is None:
                    mix, names = np.zeros((n, 1)), [UNKNOWN]
                else:
                    mix, names = model.mixtures(part.column(1).to_pylist()), model.languages
                best = mix.argmax(1)
                score = np.clip(mix[np.arange(n), best], 0, 1)
                pred = [names[k] if s > 0 else UNKNOWN for k, s in zip(best.tolist(), score.tolist())]
                several = [",".join(names[k] for k in np.flatnonzero(row >= 0.1)) for row in mix]
                columns = [part.column(k) for k in range(batch.num_columns) if keep_text or k != 1]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(several, pa.string())],
                    names=[*passed, "lang_pred", "score", "languages"],
                )
                at = stop
        if model is not None:
            model._forget()  # the worker lives on, but holds nothing for the next stage

    rows = source.mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double", "languages string"]))
    return rows.withColumnRenamed("__text", "text") if keep_text else rows

"""Quality rules whose cutoffs are chosen under a guarantee on how many good documents they reject.

Each rule rejects documents whose value lies above a cutoff of a fixed grid. In every stratum (a band of text lengths)
the rules work together: a *setting* names a cutoff, or none, for each rule, and a document is rejected if any rule
rejects it. Labelled good documents are the holdout; a fifth of them only lays out a path of settings, each one step
stricter than the one before in one rule, starting with the steps that cost that fifth least and take most of the labelled
bad documents along. On the other four fifths the settings are tested in this order: the exact binomial test of "this
setting rejects at least ``risk`` of the good documents" must reject, and the first one that does not ends the sequence.
The path owes nothing to the documents it is tested on and its order is fixed beforehand, so a stratum needs no correction
within; strata are corrected by sharing ``error`` among them (Bonferroni). So with probability ``1 - error`` no stratum loses
more than ``risk`` of its good documents. About 220 tested documents without a rejection certify a setting; a stratum
with fewer gets none, hence no rejection.

All work on rows is done by DataFrame functions. The driver sees counts per stratum and vector of levels (how many cutoffs
of each rule a document exceeds): at most some ten thousands a stratum, whatever the number of documents.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.session import write_through

SPACE = "[\\x20\\x09-\\x0D]+"
WINDOW = 5
MIN_WORDS, REPEAT_PERCENT = 10, 20
RISK, ERROR = 0.02, 0.05
#: One good document in so many lays out the path; all others are what it is tested on.
PATH_SHARE = 5
#: Upper ends of the length bands, in words.
BANDS = (50, 200, 1000)
#: Values by rule, and the grid of cutoffs from lenient to strict.
GRID = {
    "symbols_per_word": (2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05, 0.02),
    "marks_per_word": (2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
    "repeat_share": (0.18, 0.15, 0.12, 0.1, 0.08, 0.05),
    "chars_per_word": (40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0),
}


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of every whole text (null: none). Steps are projections of their own, so that no array is built twice."""
    body = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    split = body.select("doc_id", "body", words_of(F.col("body")).alias("words"), F.filter(F.split("body", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"))
    hashed = split.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
        F.aggregate("words", F.lit(0).cast("long"), lambda total, w: total + F.length(w)).alias("word_chars"),
        F.regexp_count("body", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("body", F.lit("!")).cast("long").alias("n_marks"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    windows = hashed.withColumn("windows", F.when(F.size("h") < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.sequence(F.lit(0), F.size("h") - WINDOW), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)]),
    ))).drop("h")
    # Only texts with an equal pair of windows sort them; all others are done.
    repeated = windows.withColumn("sorted", F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("at")))),
    )).drop("windows")
    same = lambda s, i: F.coalesce(F.get("sorted", i)["x"] == s["x"], F.lit(False))
    places = repeated.withColumn("places", F.sort_array(F.transform(
        F.filter("sorted", lambda s, i: same(s, i - 1) | same(s, i + 1)), lambda s: s["at"],
    ))).drop("sorted")
    covered = F.aggregate(
        "places", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")), lambda acc: acc["n"],
    )
    return places.select(
        "doc_id", "n_words", "n_lines", "word_chars", "n_symbols", "n_marks", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def rule_values() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / words, "marks_per_word": F.col("n_marks") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), "repeat_share": F.col("n_repeat_words") / words,
        "chars_per_word": F.col("word_chars") / words,
    }


def stratum() -> Column:
    band = F.lit(len(BANDS))
    for k in reversed(range(len(BANDS))):
        band = F.when(F.col("n_words") < BANDS[k], k).otherwise(band)
    return band


def binomial_below(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), by the continued fraction of the incomplete beta function, for any n."""
    if k >= n:
        return 1.0
    a, b, x = float(n - k), float(k + 1), 1 - p
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    return _beta(a, b, x)


def _beta(a: float, b: float, x: float) -> float:
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1e-300, abs(v := 1 - (a + b) * x / (a + 1))) * (1 if v > 0 else -1)
    value = d
    for m in range(1, 100_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d)
            c = 1 + term / c
            value *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * value


def upper_bound(k: int, n: int, level: float) -> float:
    """Exact upper confidence bound of a share of which ``k`` of ``n`` were seen."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if binomial_below(k, n, middle) > level else (low, middle)
    return high


def rejecting(levels: np.ndarray, setting: np.ndarray) -> np.ndarray:
    """Whether a setting rejects vectors of levels; it names so many cutoffs of each rule, the last of which counts."""
    sizes = np.array([len(c) for c in GRID.values()])
    return ((setting > 0) & (levels + setting > sizes)).any(axis=-1)


def path_of(levels: np.ndarray, good: np.ndarray, bad: np.ndarray) -> list[np.ndarray]:
    """Settings from lenient to strict, from counts of good and bad documents by their vectors of levels."""
    sizes = np.array([len(c) for c in GRID.values()])
    setting, path = np.zeros(len(sizes), int), []
    while (setting < sizes).any():
        steps = []
        for rule in np.flatnonzero(setting < sizes):
            after = setting.copy()
            after[rule] += 1
            gone = rejecting(levels, after) if len(levels) else np.zeros(0, bool)
            steps.append((int(good[gone].sum()), -int(bad[gone].sum()), setting[rule] / sizes[rule], rule))
        setting = setting.copy()
        setting[min(steps)[-1]] += 1
        path.append(setting)
    return path


def certified_setting(path: list[np.ndarray], levels: np.ndarray, tested: np.ndarray, risk: float, level: float) -> tuple[np.ndarray, float | None]:
    """The strictest setting of the path that holds, with the bound of its rejections; no rule and no bound if none does."""
    n, best, bound = int(tested.sum()), np.zeros(len(GRID), int), None
    for setting in path:
        k = int(tested[rejecting(levels, setting)].sum()) if n else 0
        if n == 0 or binomial_below(k, n, risk) > level:
            break
        best, bound = setting, upper_bound(k, n, level)
    return best, bound


def certified(counts: list[tuple[int, tuple[int, ...], int, int, int]], risk: float = RISK, error: float = ERROR) -> dict[int, tuple[np.ndarray, float | None]]:
    """For each stratum its setting and bound, from rows (stratum, levels, good for the path, bad, good to be tested)."""
    out = {}
    for band in sorted({c[0] for c in counts}):
        rows = [c for c in counts if c[0] == band]
        levels = np.array([c[1] for c in rows]).reshape(len(rows), len(GRID))
        path, bad, tested = (np.array([c[k] for c in rows], np.int64) for k in (2, 3, 4))
        out[band] = certified_setting(path_of(levels, path, bad), levels, tested, risk, error / (len(BANDS) + 1))
    return out


def judged(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Per row the counts, ``base_failed``, ``rejected_by`` (rules above their certified cutoff), ``kept`` (neither failed nor
    rejected), and ``bound``: the certified bound of good documents lost in the row's stratum, null where nothing is certified.

    Good documents are those with label 1 only and bad ones those with 0 only; labels of unknown documents and null labels
    count for nothing. Null, empty and wordless texts fail the base. Repeated rows are repeated, each counted as often as it
    stands. Texts of any length are measured whole; an empty table gives no rows; other columns are not read. An
    action: the counts are written once, then used twice.
    """
    counts = write_through(measured(docs, doc_id, text).withColumn("base_failed", base_failed()).withColumn("band", stratum()), "measured")
    marked = labels.groupBy(F.col(doc_id).alias("marked_id")).agg(F.min(label).alias("low"), F.max(label).alias("high")).where("low = high and low in (0, 1)")
    values = rule_values()
    exceeded = [sum((F.when(values[rule] > c, 1).otherwise(0) for c in cutoffs), F.lit(0)).alias(rule) for rule, cutoffs in GRID.items()]
    for_path = F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(PATH_SHARE)) == 0
    held = counts.where(~F.col("base_failed")).join(marked, F.col("doc_id") == F.col("marked_id"))
    seen = held.select("band", *exceeded, F.col("low"), for_path.alias("path")).groupBy("band", *GRID).agg(
        F.count(F.when((F.col("low") == 1) & F.col("path"), 1)).alias("for_path"), F.count(F.when(F.col("low") == 0, 1)).alias("bad"),
        F.count(F.when((F.col("low") == 1) & ~F.col("path"), 1)).alias("tested"),
    ).collect()
    seen = sorted((r["band"], tuple(r[rule] for rule in GRID), r["for_path"], r["bad"], r["tested"]) for r in seen)
    above, bound = {rule: F.lit(False) for rule in GRID}, F.lit(None).cast("double")
    for band, (setting, limit) in certified(seen, risk, error).items():
        for (rule, cutoffs), steps in zip(GRID.items(), setting.tolist()):
            if steps:
                above[rule] = above[rule] | ((F.col("band") == band) & (values[rule] > cutoffs[steps - 1]))
        if limit is not None:
            bound = F.when(F.col("band") == band, float(limit)).otherwise(bound)
    rules = F.array_compact(F.array(*[F.when(hit, F.lit(rule)) for rule, hit in above.items()]))
    return counts.withColumns({"rejected_by": rules, "bound": bound}).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))

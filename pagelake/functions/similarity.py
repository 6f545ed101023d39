"""String similarity, the one measure without a built-in counterpart.

``difflib`` defines the result, so it runs in Arrow batches; callers settle equal, contained and
empty pairs with Columns first and pass NULL for them.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _ratio(gold: str, pred: str, floor: float = 0.0) -> float:
    """Ratio of two strings, or any value up to ``floor`` when it cannot exceed it."""
    if gold == pred:
        return 1.0
    total = len(gold) + len(pred)
    if 2.0 * min(len(gold), len(pred)) / total <= floor:
        return 0.0
    matcher = SequenceMatcher(None, gold, pred)
    if floor > 0.0 and matcher.quick_ratio() <= floor:
        return 0.0
    return matcher.ratio()


@F.arrow_udf(T.DoubleType())
def string_ratio(gold: pa.Array, pred: pa.Array) -> pa.Array:
    """Ratcliff-Obershelp ratio per row, NULL where either side is NULL."""
    pairs = zip(gold.to_pylist(), pred.to_pylist(), strict=True)
    return pa.array([None if g is None or p is None else _ratio(g, p) for g, p in pairs], pa.float64())


def _best(item: str, options: list[str], known: frozenset[str]) -> float:
    if item in known:
        return 1.0
    best = 0.0
    for option in options:
        best = max(best, _ratio(item, option, best))
    return best


@F.arrow_udf(T.DoubleType())
def best_match_mean(gold: pa.Array, pred: pa.Array) -> pa.Array:
    """Mean over gold items of the best ratio among the row's predicted items; NULL for NULL or no gold.

    Pairs are compared inside the row and never emitted; exact hits and pairs that cannot beat the
    best so far are skipped, which leaves the result unchanged.
    """
    means: list[float | None] = []
    for wanted, given in zip(gold.to_pylist(), pred.to_pylist(), strict=True):
        if not wanted or given is None:
            means.append(None)
            continue
        options, known = list(dict.fromkeys(given)), frozenset(given)
        means.append(sum(_best(item, options, known) for item in wanted) / len(wanted))
    return pa.array(means, pa.float64())

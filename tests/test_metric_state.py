"""States of metrics merge to what one pass over all values gives, in any grouping."""

import math
import random

from pyspark.sql import functions as F

from pagelake.operators.metric_state import merged_states, states_of, store_batch, stored_states, summary_of


def made(spark, seed=3):
    rng = random.Random(seed)
    # Far from zero and close together: sums of squares alone would lose all digits.
    rows = [(f"m{rng.randrange(3)}", 1e5 + rng.random() if k % 2 else None, rng.randrange(9), rng.choice(["a", None])) for k in range(4000)]
    rows += [("lone", 5.0, 1, "a"), ("missing", None, 1, "a")]
    return spark.createDataFrame(rows, "metric string, value double, batch int, model string")


def summary(states, by=None):
    return {tuple(r[c] for c in (*(by or []), "metric")): r for r in summary_of(states, by).collect()}


def close(got, want):
    assert got.keys() == want.keys()
    for key, w in want.items():
        g = got[key]
        assert (g.n, g.min, g.max) == (w.n, w.min, w.max)
        assert math.isclose(g.mean, w.mean, rel_tol=1e-12) and math.isclose(g.std, w.std, rel_tol=1e-9, abs_tol=1e-11), (key, g, w)


def test_merged_equals_one_pass(spark):
    seen = made(spark)
    one = summary(states_of(seen))
    assert ("missing",) not in one and one[("lone",)].std == 0
    parts = states_of(seen, ["batch", "model"])
    close(summary(merged_states(parts)), one)
    close(summary(merged_states(merged_states(merged_states(parts, ["batch"])))), one)
    uneven = merged_states(parts.where("batch < 1")).unionByName(merged_states(parts.where("batch >= 1 and batch < 8"))).unionByName(parts.where("batch = 8").drop("batch", "model"))
    close(summary(merged_states(uneven)), one)
    close(summary(merged_states(parts, ["model"]), ["model"]), summary(states_of(seen, ["model"]), ["model"]))


def test_batches_written_again_count_once(spark, tmp_path):
    seen, path = made(spark), str(tmp_path / "states")
    for batch in (0, 3, 0, 1, 2, 3):
        store_batch(seen.where(F.col("batch") % 4 == batch), path, str(batch))
    close(summary(stored_states(spark, path)), summary(states_of(seen)))


def test_no_values_give_no_states(spark):
    assert merged_states(states_of(made(spark).limit(0))).collect() == []

"""Targets, flow and selection of the mix."""

from collections import defaultdict

from pyspark.sql import functions as F

from pagelake.llm.mixing import min_cost_flow, mixed_documents, mixed_single_source, source_targets, word_count


def reshared(sizes, weights):
    """The rule as it is told: share by weight, cap, share the excess again."""
    targets, left, open_ = [0.0] * len(sizes), 1.5 * sum(sizes), set(range(len(sizes)))
    while open_:
        level = left / sum(weights[k] for k in open_)
        over = {k for k in open_ if level * weights[k] > 2 * sizes[k]}
        if not over:
            for k in open_:
                targets[k] = level * weights[k]
            break
        for k in over:
            targets[k] = 2.0 * sizes[k]
            left -= targets[k]
        open_ -= over
    return targets


def test_targets_follow_the_rule():
    for sizes in ([10, 20, 30], [1, 1000, 5], [0, 0], [7], [500, 1, 1, 1, 300, 0, 20], []):
        weights = [(5, 2, 1)[k % 3] for k in range(len(sizes))]
        for a, b in zip(source_targets(sizes, weights), reshared(sizes, weights)):
            assert abs(a - b) < 1e-6


def test_flow_uses_overlap_and_repeats_late():
    flows = min_cost_flow([(("a",), 10), (("a", "b"), 10), (("b",), 2)], {"a": 15, "b": 7})
    assert sum(f.get("a", 0) for f in flows) == 15 and sum(f.get("b", 0) for f in flows) == 7
    assert sum(max(0, sum(f.values()) - s) for f, s in zip(flows, (10, 10, 2))) == 0
    flows = min_cost_flow([(("a",), 10)], {"a": 50})
    assert flows == [{"a": 20}]


def test_each_source_comes_near_its_target(spark):
    rows = [(k, " ".join(["w"] * (1 + k * 7 % 23)), None if k % 11 == 0 else "hot" if k % 3 else f"s{k % 5}", 1) for k in range(3000)]
    rows += [(None, "a b", "s1", 1), (5000, None, "s2", 1), (5001, "", "hot", 1), (5001, "", "hot", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixed_single_source(docs, keep=["source"]).collect()
    assert len(got) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, mixed_single_source(docs.repartition(7), keep=["source"]).collect()))
    by = defaultdict(lambda: [0, 0, 0])
    for r in got:
        assert r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0
        by[r.source][0] += r.taken
        by[r.source][1], by[r.source][2] = r.target, r.source_size
    for taken, target, size in by.values():
        assert target <= 2 * size and target - 24 <= taken <= target


def test_overlapping_sources(spark):
    docs = spark.createDataFrame([(k, ["a", "b"] if k % 2 else ["a"], 10) for k in range(100)], "doc_id long, of array<string>, n long")
    mix, targets = mixed_documents(docs, F.col("of"), F.col("n"))
    assert {r.name: r.source_size for r in targets.collect()} == {"a": 1000, "b": 500}
    assert sum(r.repeats * r["size"] for r in mix.collect()) > 0


def test_word_count_and_empty_table(spark):
    row = spark.sql(r"select ' a\tb\u000bc\n\nd e ' as t, '' as e, cast(null as string) as n")
    assert tuple(row.select(word_count(F.col("t")), word_count(F.col("e")), word_count(F.col("n"))).first()) == (4, 0, 0)
    assert mixed_single_source(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []

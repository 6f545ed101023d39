"""Mixing sources to target weights by a min-cost flow between membership patterns and source quotas.

* Documents are aggregated by membership pattern, the set of sources they belong to; only one row per pattern,
  with its tokens, reaches the driver. The flow network has that size: it does not grow with the documents.
* Every pattern offers its tokens once per epoch, each epoch dearer than the one before (convex repetition
  costs), to the quotas of its sources. Successive shortest paths give the cheapest flow that fills the quotas.
* A pattern's flow is whole epochs of all its documents, and a rest. The rest goes to the documents that come
  first in a seeded order. Cuts are found from sums over ``BUCKETS`` equal parts of the hash space, so no task
  ever orders all documents of a source: only the one part that holds the cut is ordered.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelake.session import write_through

WEIGHTS = (5, 2, 1)
SHARE, EPOCHS = 1.5, 2
SEED = "mix"
#: Hex digits of the seeded hash that name a part of the hash space: 4096 parts.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    """Number of runs of characters other than 0x20 and 0x09-0x0D; 0 for null."""
    spaced = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.filter(F.split(spaced, " "), lambda w: w != "")), F.lit(0)).cast("long")


def source_targets(sizes: list[int], weights: list[int], share: float = SHARE, limit: int = EPOCHS) -> list[float]:
    """Shares of ``share`` times all sizes by weight; none above ``limit`` times its size, the excess reshared by weight."""
    rest = sorted(range(len(sizes)), key=lambda k: (limit * sizes[k] / weights[k], k))
    capped, open_weight, targets = 0, sum(weights), [0.0] * len(sizes)
    for position, k in enumerate(rest):
        level = (share * sum(sizes) - capped) / open_weight
        if level * weights[k] <= limit * sizes[k]:
            for other in rest[position:]:
                targets[other] = level * weights[other]
            break
        targets[k] = float(limit * sizes[k])
        capped += limit * sizes[k]
        open_weight -= weights[k]
    return targets


def min_cost_flow(patterns: list[tuple[tuple, int]], quotas: dict, epochs: int = EPOCHS) -> list[dict]:
    """Tokens that each pattern gives to each of its sources: as many as quotas and epochs allow, at the least cost.

    The e-th repetition of a token costs e, so the e-th epoch of a pattern is opened only where that is needed.
    """
    names = list(quotas)
    start, end = 0, 1
    of_source = {name: 2 + k for k, name in enumerate(names)}
    first_pattern = 2 + len(names)
    edges: list[list] = []
    out: list[list[int]] = [[] for _ in range(first_pattern + len(patterns))]

    def edge(a: int, b: int, capacity: int, cost: int) -> int:
        for x, y, c, p in ((a, b, capacity, cost), (b, a, 0, -cost)):
            out[x].append(len(edges))
            edges.append([y, c, p])
        return len(edges) - 2

    used = []
    for k, (members, size) in enumerate(patterns):
        for e in range(epochs):
            edge(start, first_pattern + k, size, e)
        used.append({name: edge(first_pattern + k, of_source[name], epochs * size, 0) for name in members})
    for name, quota in quotas.items():
        edge(of_source[name], end, quota, 0)
    while True:
        cost, via, waiting = {start: 0}, {}, deque([start])
        queued = {start}
        while waiting:
            node = waiting.popleft()
            queued.discard(node)
            for e in out[node]:
                to, capacity, price = edges[e]
                if capacity > 0 and cost[node] + price < cost.get(to, 1 << 60):
                    cost[to], via[to] = cost[node] + price, e
                    if to not in queued:
                        queued.add(to)
                        waiting.append(to)
        if end not in via:
            break
        path, node = [], end
        while node != start:
            path.append(via[node])
            node = edges[via[node] ^ 1][0]
        amount = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= amount
            edges[e ^ 1][1] += amount
    return [{name: edges[e ^ 1][1] for name, e in own.items()} for own in used]


def mixed_documents(
    docs: DataFrame, sources: Column, size: Column, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
    epochs: int = EPOCHS, seed: str = SEED, doc_id: str = "doc_id", keep: list[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Per document: doc_id, ``keep``, members, size, and ``repeats``, how often the mix takes the document;
    and per source: name, source_size and target.

    ``sources`` is the array of sources a document belongs to; null names a source of its own. Sources stand in
    code point order, null last, and take ``weights`` in turn. A size of 0 can be taken any number of times and
    is taken as often as its pattern. Documents with the same id and content share their fate only by position
    in the seeded order; reruns agree. Actions: the sized rows are written once and summed twice.
    """
    spark = docs.sparkSession
    member = F.array_sort(F.array_distinct(F.transform(sources, lambda s: F.struct(s.isNull().alias("none"), s.alias("name")))))
    order = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))
    sized = write_through(docs.select(
        F.col(doc_id).alias("doc_id"), *[F.col(c) for c in keep], member.alias("members"), size.alias("size"), order.alias("place"),
    ), "mix")
    totals = sized.groupBy("members").agg(F.sum("size").alias("size")).collect()
    patterns = [(tuple((m["none"], m["name"]) for m in row["members"]), row["size"] or 0) for row in totals]
    names = sorted({m for members, _ in patterns for m in members}, key=lambda m: (m[0], (m[1] or "").encode()))
    sizes = [sum(s for members, s in patterns if m in members) for m in names]
    targets = source_targets(sizes, [weights[k % len(weights)] for k in range(len(names))], share, epochs)
    flows = min_cost_flow(patterns, {m: int(t) for m, t in zip(names, targets)}, epochs)

    parts = []
    for row, (_, total), flow in zip(totals, patterns, flows):
        taken = sum(flow.values())
        whole = taken // total if total else 0
        parts.append((row["members"], whole, taken - whole * total))
    pattern_type = sized.schema["members"].dataType.simpleString()
    plan = spark.createDataFrame(parts, f"pattern {pattern_type}, whole long, rest long")
    bucket = F.substring("place", 1, BUCKET_DIGITS)
    through = Window.partitionBy("members").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        sized.groupBy("members", bucket.alias("bucket")).agg(F.sum("size").alias("size"))
        .withColumn("before", F.coalesce(F.sum("size").over(through), F.lit(0)))
        .join(plan, F.col("members") == F.col("pattern"))
        .where("before <= rest and before + size > rest")
    )
    # One row per pattern, as in the network.
    cuts = {tuple(row["members"]): (row["bucket"], row["before"]) for row in sums.select("members", "bucket", "before").collect()}
    placed = spark.createDataFrame(
        [(m, w, r, *cuts.get(tuple(m), ("g", 0))) for m, w, r in parts],
        f"pattern {pattern_type}, whole long, rest long, cut string, before long",
    )
    joined = sized.join(placed, F.col("members") == F.col("pattern")).drop("pattern")
    outside = joined.where(bucket != F.col("cut")).withColumn("more", F.when(bucket < F.col("cut"), 1).otherwise(0).cast("long"))
    running = F.sum("size").over(Window.partitionBy("members").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, 0))
    # Dealt out anew after the filter: else the window would hold the join above to one task per pattern.
    inside = joined.where(bucket == F.col("cut")).repartition("members").withColumn("more", F.when(F.col("before") + running <= F.col("rest"), 1).otherwise(0).cast("long"))
    listed = spark.createDataFrame([(n, s, t) for (_, n), s, t in zip(names, sizes, targets)], "name string, source_size long, target double")
    result = outside.unionByName(inside).select("doc_id", *keep, F.col("members.name").alias("members"), "size", (F.col("whole") + F.col("more")).alias("repeats"))
    return result, listed


def mixed_single_source(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """Per document of one source each: doc_id, size, source_size, target (its source's), taken and repeats."""
    frame, targets = mixed_documents(docs, F.array(F.col(source)), word_count(F.col(text)), doc_id=doc_id, **options)
    return frame.join(targets, F.col("members")[0].eqNullSafe(F.col("name"))).select(
        "doc_id", *options.get("keep", ()), "size", "source_size", "target", (F.col("repeats") * F.col("size")).alias("taken"), "repeats",
    )

"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.session import cut_lineage, release


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y] if y in up else y
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([root(x) for x in up], pa.int64())], ["node", "component"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100, native: bool = False) -> DataFrame:
    """``(node, component)`` for every node of an undirected edge table; a component is named by its least node.

    Nodes are whole numbers. Each partition first reduces its own edges to a forest; then rounds alternate
    neighbourhood minima with pointer jumping, so that chains of length n take about log n of them. Each
    round is two joins and partial aggregates, with the lineage cut in the shared checkpoint folder.
    Nulls and self loops give no link; a node that only has a self loop is its own component. An empty
    table gives no rows. ``native`` leaves the forests out, whose code is Python.
    """
    pairs = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where("a is not null and b is not null")
    if native:
        forest = cut_lineage(pairs.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component")))
    else:
        forest = cut_lineage(pairs.mapInArrow(_roots, "node long, component long"))
    down = forest.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    both = cut_lineage(down.union(down.select("b", "a")).distinct())
    ends = forest.union(forest.select("component", "component"))
    labels = held = cut_lineage(ends.groupBy("node").agg(F.min("component").alias("l")))
    release(forest)
    for _ in range(max_rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("l").alias("near"))
        step = labels.join(near, labels.node == near.a, "left").select("node", "l", F.least("l", "near").alias("m"))
        # what the label's own node, and the node itself, now point to
        hooks = step.where("m < l").groupBy(F.col("l").alias("h")).agg(F.min("m").alias("hm"))
        step = step.join(hooks, step.l == hooks.h, "left").select("node", F.col("l").alias("was"), F.least("m", "hm").alias("l"))
        jump = step.select(F.col("node").alias("j"), F.col("l").alias("jl"))
        step = step.join(jump, step.l == jump.j).select("node", "was", F.least("l", "jl").alias("l"))
        step = cut_lineage(step)
        release(held)
        labels, held = step.select("node", "l"), step
        if not step.where("l != was").limit(1).count():
            break
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    release(both)
    return labels.withColumnRenamed("l", "component")

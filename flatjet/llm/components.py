"""Connected components: edges contracted task by task, then alternating large-star and small-star steps.

Each round first replaces the edges of every task by stars of that task's own
components, then takes one partial aggregation and one equi-join for each
step, so hubs are combined before the shuffle and skewed joins are left to
adaptive execution. Edges that one task can hold are settled by the first
round. No edge, label or component goes to the driver; the only figures read
there are two sums that tell whether a round changed anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, partitions, release

#: Edges for each task of a round.
TASK_EDGES = 50_000


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a task's edges with the smallest node that those edges reach."""
    root: dict = {}
    kind = None

    def find(x):
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while x != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        kind = batch.schema[0].type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = [x for x in root if find(x) != x]
    for lo in range(0, len(nodes), 10_000):
        part = nodes[lo : lo + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([root[x] for x in part], kind)], ["u", "v"])


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Label every node that has an edge with the smallest node of its component.

    Returns ``node`` and ``component`` (both of the type of ``src``). Null ends,
    loops and repeated edges are ignored; an empty table gives no rows.
    """
    spark = edges.sparkSession
    kind = edges.schema[src].dataType.simpleString()
    edges = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == state or mark[0] == 0:
            break
        state = mark
        # Few edges need few tasks and files, whatever the session's number of partitions.
        parts = min(partitions(spark), 1 + mark[0] // TASK_EDGES)
        held = now.coalesce(parts).mapInArrow(_stars, f"u {kind}, v {kind}")
        if parts > 1:
            held = _small(_large(held.coalesce(parts)).coalesce(parts)).where("u <> v").distinct().coalesce(parts)
        before, now = now, cut(held)
        release(before)
        if parts == 1:
            break  # one task has seen all edges
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)

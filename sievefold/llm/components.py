"""Connected components by alternating large-star and small-star rounds.

Links stay a distributed table all the time.  A round shuffles the links twice on one
endpoint; minima are aggregated before they are shuffled, and a node with very many
links is a skewed join key that Spark splits.  Before a round's links are written, each
task joins those that it holds, so chains get short and few rounds are needed.  Once
``JOINED`` links at most are left, in however many partitions, one bounded task joins them:
what a round costs then is the tasks of its shuffles, not the links.  Every
round is written to the shared folder, so the plan stays short and a lost executor costs
one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_batches, discard, materialize

#: Links that a task joins at once.
JOINED = 200_000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node (long) of a link the smallest node it is joined with.

    Links to itself and repeated links change nothing; links with a null end are left
    out; without links the result is empty.
    """
    x, y = F.col(a), F.col(b)
    edges = links.where((x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    edges = materialize(_joined(edges))
    while edges.count() > JOINED and _is_open(edges):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()
        before, edges = edges, materialize(_joined(small))
        discard(before)
    if edges.count() <= JOINED:
        before, edges = edges, materialize(_joined(edges.coalesce(1)))
        discard(before)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _joined(edges: DataFrame) -> DataFrame:
    """Links (u, v) that join what the links of each task join: every node with its smallest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= JOINED:
                yield stars(held)
                held = []
        if held:
            yield stars(held)

    return bounded_batches(edges).mapInArrow(run, "u long, v long")


def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    ends = [np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1)]
    nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
    root = np.arange(len(nodes)).tolist()

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for x, y in zip(*np.split(at, 2), strict=True):
        x, y = find(int(x)), find(int(y))
        root[max(x, y)] = min(x, y)
    top = np.array([find(x) for x in range(len(nodes))], np.int64)
    rest = np.flatnonzero(top != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[rest]), pa.array(nodes[top[rest]])], ["u", "v"])


def _is_open(edges: DataFrame) -> bool:
    """Whether a node still has two links down, or links down and up."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down")).union(edges.select("v", F.lit(0)))
    once = ends.groupBy("node").agg(F.sum("down").alias("n"), F.min("down").alias("least"))
    return once.where("n > 1 OR (n = 1 AND least = 0)").agg(F.count(F.lit(1))).first()[0] > 0

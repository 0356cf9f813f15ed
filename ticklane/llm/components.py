"""Connected components of a graph given by its edges: each task's edges become a forest, whose trees are joined across tasks
by alternating large and small stars, as joins and minima."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklane.llm.common import SALTS, checkpointed, salted_lookup, shuffle_width

EDGES_A_TASK = 20_000
#: Edges that a task makes a forest of; a graph of no more needs no rounds, each of which would be a plan and some stages on the driver.
EDGES_A_FOREST = 200_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a, b), and of each the least node that it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])  # roots hang on lesser roots only
        while (root != root[root]).any():
            root = root[root]
    return nodes, nodes[root]


def _forest(batches):
    """A task's edges as stars: each node that is not its tree's least one, tied to that."""
    edges = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches if batch.num_rows]
    if edges:
        node, root = roots(*map(np.concatenate, zip(*edges, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node[node != root]), pa.array(root[node != root])], ["a", "b"])


def _star(edges: DataFrame, large: bool, tasks: int) -> DataFrame:
    """Large: each node ties its larger neighbours to the least of its neighbours and itself. Small: its lesser ones."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = both if large else both.where("b < a")
    least = seen.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
    # a large graph's hubs are dealt over several tasks; a small one would only get more shuffle files, and a broadcast in each
    # round would be a job of a task for each partition, whose table the driver holds until it collects its garbage
    tied = salted_lookup(seen, "a", F.col("b"), least) if tasks >= SALTS else seen.join(least.hint("merge"), "a")
    if large:
        tied = tied.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        tied = tied.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    # few edges don't need many tasks, each with its shuffle files
    return tied.where("a <> b").coalesce(tasks)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (a, b); component is the least node reached. Edges may repeat, in either
    direction; loops are left out. Where one task's forest is not all, rounds go on until one changes nothing; each brings a
    path's ends closer by half."""
    edges = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    forests = min(shuffle_width(edges.sparkSession), 1 + edges.count() // EDGES_A_FOREST)
    edges = checkpointed(edges.coalesce(forests).mapInArrow(_forest, "a long, b long"))
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    last, now = None, mark(edges) if forests > 1 else (0, None)
    tasks = min(shuffle_width(edges.sparkSession), 1 + now[0] // EDGES_A_TASK)
    while now[0] and now != last:
        edges = checkpointed(_star(_star(edges, True, tasks), False, tasks).distinct().coalesce(tasks))
        last, now = now, mark(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))

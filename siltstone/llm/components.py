"""Connected components of an edge table: alternating large-star and small-star steps, and a finish of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import materialize

#: Once at most this many edges are left (16 bytes each), a single task ends the work; until then steps are joins.
FINISH = 2_000_000


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges of a bounded table, by smallest labels and pointer jumping."""
    parts = [np.column_stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
    if not parts:
        return
    nodes, index = np.unique(np.concatenate(parts), return_inverse=True)
    a, b = index.reshape(-1, 2).T
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "root"])


def _changed(now: DataFrame, before: DataFrame) -> bool:
    return now.count() != before.count() or now.join(before, ["a", "b"], "left_anti").limit(1).count() > 0


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of edges (a, b): root is the component's smallest node. Materialized.

    Each step joins the edges with each node's smallest neighbour, so that a hub's edges are a skewed join, which
    can be split, and never a group in one task. Loops and repeated edges are left out; without edges there are no rows.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while edges.count() > FINISH:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small_ = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        before, edges = edges, materialize(small_, "edges")
        if not _changed(edges, before):
            nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return materialize(nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "roots")
    return materialize(edges.coalesce(1).mapInArrow(_finished, "node long, root long"), "roots")

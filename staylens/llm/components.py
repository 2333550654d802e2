"""Connected components of an edge table by alternating large and small stars.

Every round is a few groupings and joins; no component is gathered anywhere.  A graph of at most
``TASK_EDGES`` edges, at the start or after a round, is finished by one task in a few array passes: at
that size a round is all overhead of its stages.  The bound is fixed, larger graphs never go to one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import map_arrow, stored

#: Edges that one task finishes; two 64-bit numbers each.
TASK_EDGES = 1 << 18


def least_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node of each one's component) of the edges (u, v).

    In every pass each root hooks on to the smallest root beside it, and paths are then halved down to one step;
    a component's roots at least halve in number."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j = at[:len(u)], at[len(u):]
    label = np.arange(len(nodes))
    while True:
        x, y = label[i], label[j]
        new = label.copy()
        np.minimum.at(new, x, y)
        np.minimum.at(new, y, x)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if parts:
            nodes, least = least_nodes(*[np.concatenate(x) for x in zip(*parts)])
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], ["node", "component"])

    return map_arrow(edges.select("u", "v").coalesce(1), run, "node long, component long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on an edge (a, b) of whole numbers; the component is its smallest node."""
    ends = [F.col(c).cast("long") for c in ("a", "b")]
    stars = stored(edges.where("a != b").select(F.greatest(*ends).alias("u"), F.least(*ends).alias("v")).distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())

    seen = mark(stars)
    while seen[0] > TASK_EDGES:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        stars = stored(small, "edges")
        now = mark(stars)
        if now == seen:
            return (stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
                    .unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())
        seen = now
    return _in_one_task(stars)

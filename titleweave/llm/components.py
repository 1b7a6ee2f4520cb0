"""Connected components of an edge table: few edges in one task, more by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titleweave.llm.common import discard, materialize

#: Up to so many distinct edges one task joins them; each round over all partitions costs the driver more than that.
FEW_EDGES = 1 << 18


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the least node each is connected with: roots are hooked to lesser ones and paths halved until
    nothing changes.
    """
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(nodes):
        x, y, before = root[a], root[b], root.copy()
        least = np.minimum(x, y)
        np.minimum.at(root, x, least)
        np.minimum.at(root, y, least)
        root = root[root]
        if (root == before).all():
            break
    return nodes, nodes[root]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            node, root = roots(*map(np.concatenate, zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])

    return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(run, "node long, root long")


def _rewire(edges: DataFrame, large: bool) -> DataFrame:
    """One star round. edges: distinct (u, v) with u > v. Minima are partial aggregates; the join back is one that AQE can split."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(u, v), long numbers: root is the least node it is connected with.

    Of more than FEW_EDGES, rounds until nothing changes; each round's table is written to the shared folder and the one
    before it deleted. No edges give no rows.
    """
    clean = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(clean, "edges")
    state = _state(now)
    if state[0] <= FEW_EDGES:
        few = materialize(_in_one_task(now), "components")
        discard(now)
        return few
    while True:
        step = materialize(_rewire(_rewire(now, True), False), "edges")
        discard(now)
        now, before = step, state
        state = _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

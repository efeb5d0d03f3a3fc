"""Connected components of a graph held in DataFrames, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm._shared import materialize

#: Edges (16 bytes each) that one task may finish.
SMALL = 1 << 20


def _finish(edges: DataFrame) -> DataFrame:
    """``node, label`` of at most SMALL edges, by pointer jumping over arrays in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
        a, b = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in (0, 1))
        nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = ends[: len(a)], ends[len(a) :]
        label = np.arange(len(nodes))
        while True:
            least = np.minimum(label[x], label[y])
            new = label.copy()
            for side in (label[x], label[y], x, y):
                np.minimum.at(new, side, least)
            new = new[new]
            if np.array_equal(new, label):
                break
            label = new
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "label"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, label long")


def connected_components(edges: DataFrame, small: int = SMALL, most_rounds: int = 60) -> DataFrame:
    """``node, label`` for every node of ``edges(a, b)``: label is the least node of its component.

    While there are more than ``small`` edges, a round links every node's larger neighbours to its
    least neighbour (large star), then its smaller neighbours (small star), which contracts the
    graph; rounds end when one changes nothing.  Least neighbours are aggregated and joined, so a
    node with very many edges is not a group in one task.  A graph of at most ``small`` edges, at the
    start or after some rounds, is finished by one task.  Only counts reach the driver.  Loops
    and repeated edges are harmless.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges", light=True)
    state = _state(now)
    for _ in range(most_rounds):
        if state[0] <= small:
            return _finish(now)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(least, "a")
        both_ends = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(linked.select("a", F.col("m").alias("b")))
        now = materialize(both_ends.where("a <> b").distinct(), "edges", light=True)
        new = _state(now)
        if new == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        state = new
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)

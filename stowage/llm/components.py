"""Connected components over pairs: spanning forests within tasks, then large-star and small-star steps between them.

Nothing is gathered on the driver. Defined cases: null ends and pairs of equal ends are no edges; repeated pairs count once; no
edges give no rows; edges that need more rounds than allowed raise an error instead of a part of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import frugal, written

#: Edges of which a task makes a forest at a time.
FOREST = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ids joined by these edges: each id but a tree's least one, and that least one."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        p, q = root[x], root[y]
        if (p == q).all():
            break
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
    inner = root != np.arange(len(ids))
    return ids[inner], ids[root[inner]]


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges that connect the same ids, fewer: each task's become stars, FOREST of them at a time."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            a, b = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held, n = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= FOREST:
                yield told()
                held, n = [], 0
        if n:
            yield told()

    return edges.mapInArrow(run, "a long, b long")


def _stars(pairs: DataFrame) -> bool:
    """Whether each a stands in one pair and is no other's b."""
    ends = pairs.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(pairs.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("root").alias("root")).filter("up > 1 OR up = 1 AND root = 1").isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """id, label: the smallest id that each id of edges (a, b) reaches. Ids without an edge aren't in it.

    Tasks contract their edges first. While stars of different tasks still meet, a round links every node's larger neighbours to
    its least one, then its smaller ones likewise, and contracts again; rounds grow with the logarithm of the longest
    path. A node of many edges costs one aggregate row a task, not one task.
    """
    pairs = written(_contracted(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), "edges")
    for _ in range(rounds):
        if _stars(pairs):
            return pairs.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(pairs.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # a table: its join can be split over tasks where a node has very many edges
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        pairs = written(_contracted(small), "edges")
    raise RuntimeError(f"components: not converged after {rounds} rounds")

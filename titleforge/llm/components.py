"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titleforge.session import cut_lineage

BLOCK = 2_000_000  # edges a task contracts at once
EDGE = "a long, b long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of the edges a - b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars around the least nodes, block by block."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0

    def stars() -> pa.RecordBatch:
        node, root = forest(*(np.concatenate(x) for x in zip(*held)))
        use = node != root
        return pa.RecordBatch.from_pydict({"a": node[use], "b": root[use]})

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
        count += batch.num_rows
        if count >= BLOCK:
            yield stars()
            held, count = [], 0
    if held:
        yield stars()


def components(edges: DataFrame, most_rounds: int = 60, whole: int = 1_000_000) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): root is the least node of its component.

    Each task first contracts its own edges to stars, in blocks of bounded size. While more than `whole`
    edges are left, rounds of alternating star contraction follow: each hangs every node's larger
    (then smaller) neighbours on its least neighbour, in a few shuffles of the edge table; rounds grow
    with the logarithm of the longest path. What is left then, at most `whole` edges, is contracted
    by one task. Nothing is collected; a node with very many neighbours is aggregated on the map
    side and its neighbour list is never built. Each round is checkpointed."""
    now = edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    before = None
    for _ in range(most_rounds):
        now = cut_lineage(now.mapInArrow(_contract, EDGE))
        if now.count() <= whole:
            now = now.coalesce(1).mapInArrow(_contract, EDGE)
            break
        # large star: every node links its neighbours above itself to its least neighbour
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: every node links its neighbours below itself, and itself, to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        now = cut_lineage(small)
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    # one row per leaf, one more per root
    stars = cut_lineage(now)
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

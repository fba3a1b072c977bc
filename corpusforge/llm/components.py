"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.session import materialize

#: Links of one part, about, that are thinned together.
PART_LINKS = 200_000


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each component of the links between a and b, over 0..n-1."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        if (before == root).all():
            return root


def _thinned(edges: DataFrame, count: int) -> DataFrame:
    """Links that join the same nodes: of each part of the links, at most one per node it names, to the least it reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def span() -> pa.RecordBatch:
            names, place = np.unique(np.concatenate(held), return_inverse=True)
            place = place.reshape(-1, 2)
            root = _roots(len(names), place[:, 0], place[:, 1])
            away = np.flatnonzero(root != np.arange(len(names)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(names[away]), pa.array(names[root[away]])], names=["u", "v"])

        for batch in batches:
            held.append(np.stack([batch.column("u").to_numpy(), batch.column("v").to_numpy()], 1))
            if sum(map(len, held)) >= 2 * PART_LINKS:
                yield span()
        if held:
            yield span()

    return edges.repartition(max(1, -(-count // PART_LINKS))).mapInArrow(run, "u long, v long")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connect(links: DataFrame) -> DataFrame:
    """From links (u, v), longs, the table (node, root) of all linked nodes; root is the least node reachable.

    Links are thinned part by part first, as a group may be linked over and over. Each round writes its links to the
    shared folder. The least neighbour of a node is found by an
    aggregation that combines first; the join that hands it to the neighbours has one row per node on
    its other side, so adaptive execution can split a hub. Rounds grow with the logarithm of the
    longest chain. Self-links and nulls are dropped; an empty table gives an empty one.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()
    edges = materialize(edges, "links")
    count = edges.count()
    if count:
        edges = materialize(_thinned(edges, count).distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = materialize(small.filter("u != v").distinct(), "links")
        before, state = state, _state(edges)
        if before == state:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()

"""Connected components of an edge table.

Chunks of bounded size are contracted to stars by themselves first, so most edges never move.
What crosses chunks is settled by alternating large-star and small-star rounds, which are joins and
combinable minima over the edges left. Nothing is gathered on the driver but counts and a checksum.
Lineage is cut through the shared checkpoint folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import apart, cut, ship

CHUNK = 1_000_000  # edges that one task contracts


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that it reaches over the pairs (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        was = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (was == root).all():
            return root


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one chunk at a time to edges from every node to the least one that it reaches in the chunk."""
    us: list[np.ndarray] = []
    vs: list[np.ndarray] = []

    def stars() -> pa.RecordBatch:
        names, at = np.unique(np.concatenate([*us, *vs]), return_inverse=True)
        a, b = np.split(at, 2)
        root = forest(len(names), a, b)
        move = np.flatnonzero(root != np.arange(len(names)))
        us.clear()
        vs.clear()
        return pa.RecordBatch.from_arrays([pa.array(names[move]), pa.array(names[root[move]])], names=["u", "v"])

    for batch in batches:
        us.append(batch.column("u").to_numpy())
        vs.append(batch.column("v").to_numpy())
        if sum(map(len, us)) >= CHUNK:
            yield stars()
    if us:
        yield stars()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v. Large: hang u's greater neighbours on u's least one; small: hang the lesser ones."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = both.join(least.select(apart(F.col("u")).alias("k"), "m"), F.col("u") == F.col("k"))
    if large:
        return met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") > F.col("v"))
    out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") > F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v), which should be cheap to read twice: component is the least node that it reaches.

    Direction, repeats, loops and edges with a null end don't matter; nodes that have only
    loops don't appear. An empty table gives an empty one.
    """
    ship(edges.sparkSession)
    long = lambda c: F.col(c).cast("long")
    pair = edges.where(edges["u"].isNotNull() & edges["v"].isNotNull() & (edges["u"] != edges["v"])).select(long("u").alias("u"), long("v").alias("v"))
    chunks = max(1, math.ceil(pair.count() / CHUNK))
    now = cut(pair.coalesce(chunks).mapInArrow(_contract, "u long, v long"))
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
    seen = mark(now) if chunks > 1 else None  # the stars of a single chunk are final
    while seen and seen[0]:
        now = cut(_star(_star(now, True), False))
        was, seen = seen, mark(now)
        if was == seen:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)

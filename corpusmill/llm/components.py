"""Connected components: slices contracted by union-find, then alternating stars as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import stored

#: Edges of a slice that one task contracts in its memory.
SLICE = 100_000


def roots(a, b, n: int):
    """For the vertices 0 to n - 1 and the edges (a, b): the smallest vertex of each one's component."""
    import numpy as np

    root = np.arange(n)
    while True:  # every vertex takes the smallest root of its neighbours, then the root of its root
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def forest(a, b, n: int):
    """Which of the edges (a, b), the most wanted first, make the best spanning forest of the vertices 0 to n - 1."""
    import numpy as np

    kept, root, rank = np.zeros(len(a), bool), np.arange(n), np.arange(len(a))
    while True:  # every component takes its best edge that leads out of it
        live = root[a] != root[b]
        if not live.any():
            return kept
        best = np.full(n, len(a))
        np.minimum.at(best, root[a[live]], rank[live])
        np.minimum.at(best, root[b[live]], rank[live])
        kept[best[best < len(a)]] = True
        root = roots(a[kept], b[kept], n)


def _contracted(batches):
    """Edges (u, v) of one slice: each of its vertices with the smallest vertex of its component there."""
    import numpy as np
    import pyarrow as pa

    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    ends = np.concatenate([np.concatenate(p) for p in zip(*parts, strict=True)])
    names, place = np.unique(ends, return_inverse=True)
    root = roots(place[: len(place) // 2], place[len(place) // 2 :], len(names))
    own = np.flatnonzero(root != np.arange(len(names)))
    yield pa.RecordBatch.from_arrays([pa.array(names[own]), pa.array(names[root[own]])], ["u", "v"])


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v, m): every pair with the smallest of u and all its partners.

    The smallest ones are stored, so that the join knows their size: few are broadcast, many are
    shuffled like the pairs, and a vertex with very many partners is then split by adaptive execution.
    """
    least = stored(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
    return pairs.join(least, "u")


def components(edges: DataFrame, slice_edges: int = SLICE) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b): root is the smallest vertex of its component.

    Edges are first contracted in slices of about ``slice_edges``, each in one task's memory: a dense
    group leaves one edge for each of its vertices there. Each round then links all larger partners
    of a vertex to its smallest one, then all smaller ones. The number of rounds grows with the
    logarithm of the longest path. Every round is written to the shared folder; nothing but counts
    and a checksum reaches the driver. Edges with a = b are ignored, and no edges give no rows.
    """
    given = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    slices = max(1, -(-given.count() // slice_edges))
    now, before = stored(given.coalesce(slices).mapInArrow(_contracted, "u long, v long").distinct(), "stars"), None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), "stars")
        small = _star(large)  # u > v in every pair
        small = small.select("v", "m").union(small.select("u", "m")).toDF("u", "v")
        now = stored(small.where("u <> v").distinct(), "stars")
    return now.select(F.col("u").alias("v"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def least_labels(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, component_id) of ``vertices`` (v, least): the smallest ``least`` that can be reached over ``edges`` (a, b)."""
    linked = stored(components(edges).join(vertices, "v"), "linked")
    roots = linked.groupBy("root").agg(F.min("least").alias("component"))
    labels = linked.join(roots, "root").select("v", "component", F.lit(True).alias("linked"))
    own = F.when(F.col("linked"), F.col("component")).otherwise(F.col("least"))
    return vertices.join(labels, "v", "left").select("v", own.alias("component_id"))

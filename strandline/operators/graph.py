"""Connected components of variant matches: local forests, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import drop_durable, durable

MAX_ROUNDS = 60
LOCAL_VERTICES = 1_000_000


def least_roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of the vertices 0..n-1 the least vertex it is linked with: roots hook onto lesser roots, then all paths are halved."""
    parent = np.arange(n)
    while len(u):
        a, b = parent[u], parent[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    return parent


def forest_of(u: pa.Array, v: pa.Array) -> tuple[pa.Array, pa.Array, int]:
    """``v, r`` (vertex, least vertex of its tree, by byte order) of the edges, and the number of their vertices."""
    coded = pa.concat_arrays([u, v]).dictionary_encode()
    words = coded.dictionary
    order = pc.array_sort_indices(words).to_numpy()
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    ends = rank[coded.indices.to_numpy()]
    parent = least_roots(ends[: len(u)], ends[len(u) :], len(words))
    under = np.flatnonzero(parent != np.arange(len(words)))
    return words.take(pa.array(order[under])), words.take(pa.array(order[parent[under]])), len(words)


def local_forest(most_vertices: int):
    """Union-find over the edges of a task: from each edge list (two string columns) only the pairs
    (vertex, least vertex of its local tree) are kept, as ``v, r``.

    Beyond ``most_vertices`` vertices the forest is emitted and begun anew; any split of the edges
    yields valid links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: tuple[list[pa.Array], list[pa.Array]] = ([], [])

        def reduced() -> tuple[pa.Array, pa.Array, int]:
            out = forest_of(*(pa.concat_arrays(x) for x in ends))
            ends[0][:], ends[1][:] = [out[0]], [out[1]]
            return out

        def emitted() -> Iterator[pa.RecordBatch]:
            v, r = ends[0][0].cast(pa.string()), ends[1][0].cast(pa.string())
            for at in range(0, len(v), 100_000):
                yield pa.RecordBatch.from_arrays([v[at : at + 100_000], r[at : at + 100_000]], ["v", "r"])
            ends[0].clear(), ends[1].clear()

        for batch in batches:
            for kept, column in zip(ends, batch.columns):
                kept.append(column.cast(pa.large_string()))
            if sum(map(len, ends[0])) > most_vertices and reduced()[2] > most_vertices // 2:
                yield from emitted()
        if ends[0]:
            reduced()
            yield from emitted()

    return run


def _is_stars(edges: DataFrame) -> bool:
    """Whether every ``u`` has one ``v`` and no ``v`` is a ``u``."""
    twice = edges.groupBy("u").count().where("count > 1").select("u")
    inner = edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").select("u")
    return not twice.unionByName(inner).limit(1).count()


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component`` (its least id) of every vertex (``id``) under undirected edges (``src, dst``, strings).

    Every task first reduces its edges to a forest. Large-star then links the greater neighbours of a
    vertex to the least of its neighbourhood, small-star the smaller ones; both are a minimum by
    vertex with map-side combine and a join, no neighbour list is gathered, so a vertex with very many
    partners is an ordinary hot key. Rounds are stored in the shared folder until all trees are
    stars. Vertices in no edge are components of their own; null ends link nothing.
    """
    once = edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    now = durable(once.hint("rebalance").mapInArrow(local_forest(LOCAL_VERTICES), "v string, r string").select(F.col("v").alias("u"), F.col("r").alias("v")), "forest")
    for _ in range(MAX_ROUNDS):
        if _is_stars(now):
            parents = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
            return vertices.select("id").distinct().join(parents, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = durable(small, "stars")
        drop_durable(now)
        now = after
    raise RuntimeError(f"components did not become stable within {MAX_ROUNDS} rounds")

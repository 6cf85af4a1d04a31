"""One group identifier for all records that pairs link, directly or through others (problem 6).

Method: a two-dimensional grid. Vertices are hashed into blocks; an edge belongs to the cell (block
of its one end, block of its other end). Every task runs union-find on the edges of its cells and
keeps only a forest, (vertex, least vertex of its local tree). A vertex lies in the cells of one row
and one column of the grid, so it gets at most twice as many representatives as the grid has blocks:
they are exchanged by vertex, and the least becomes its parent. What is left to decide is which
representatives belong together: the others of a vertex are linked with its parent, and a
representative that has a parent with that. These links are the next round's edges; their vertices
are representatives only, so they get fewer each time, until no parent changes. Then the rounds'
parents are put together from the last to the first.

The grid's side in the first round, whose edges come from the scan, is the root of the number of
shuffle partitions, so there are about as many cells as tasks; later rounds have as many cells as
keep about ``cell_edges`` links in each, at most that many. A hot vertex is spread over all cells of
its row or column; an edge repeated very often is one edge after the partial aggregation of the scan.
Local state is bounded: beyond ``local_vertices`` vertices the forest is emitted and begun anew,
which is sound as union-find on any part of the edges yields valid links.

Every round is a table in the shared folder; nothing is collected to the driver but counts.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.graph import local_forest
from strandline.session import drop_durable, durable

CELL_EDGES = 400_000
LOCAL_VERTICES = 1_000_000
MISSING_IDS = ("", ".", "NA")  # fixed values of the data: ids written so are missing
MAX_ROUNDS = 60


def grid_side(spark: SparkSession) -> int:
    """Blocks of vertices on either axis of the grid, two at least."""
    return max(2, math.ceil(math.sqrt(int(spark.conf.get("spark.sql.shuffle.partitions")))))


def component_parents(edges: DataFrame, side: int | None = None, cell_edges: int = CELL_EDGES, local_vertices: int = LOCAL_VERTICES) -> DataFrame:
    """``v, m``: the least vertex of its component for every vertex that isn't the least itself.

    ``edges`` has two string columns ``u, v``. Loops, repeated and reversed edges change nothing.
    """
    side = side or grid_side(edges.sparkSession)
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(side))
    now = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    rounds: list[DataFrame] = []
    left = 1
    while left:
        if len(rounds) == MAX_ROUNDS:
            raise RuntimeError(f"parents did not become stable within {MAX_ROUNDS} rounds")
        cells = now.select("u", "v", (block("u") * side + block("v")).alias("cell")).repartition(side * side, "cell")
        local = cells.select("u", "v").mapInArrow(local_forest(local_vertices), "v string, r string")
        # At most two representatives for each block of the grid meet at a vertex.
        met = durable(local.groupBy("v").agg(F.min("r").alias("m"), F.collect_set("r").alias("all")), "met")
        if rounds:
            drop_durable(now)
        rounds.append(met.select("v", "m"))
        found = met.select(F.explode("all").alias("v")).distinct()
        others = met.where(F.size("all") > 1).select(F.col("m").alias("u"), F.explode("all").alias("v")).where("u <> v")
        own = met.join(found, "v", "left_semi").select(F.col("m").alias("u"), "v")
        now = durable(others.unionByName(own).distinct(), "links")
        left = now.count()
        side = min(side, max(1, math.ceil(math.sqrt(left / cell_edges))))
    parents = rounds.pop()
    for earlier in reversed(rounds):
        up = parents.select(F.col("v").alias("m"), F.col("m").alias("top"))
        lower = earlier.join(up, "m", "left").select("v", F.coalesce("top", "m").alias("m"))
        parents = lower.unionByName(parents.join(earlier.select("v"), "v", "left_anti"))
    return parents


def linked_groups(pairs: DataFrame, side: int | None = None, cell_edges: int = CELL_EDGES) -> DataFrame:
    """``call_id, group_id`` for every id in ``id1, id2, linked``.

    ``linked`` tells whether the row links its ids (null: it doesn't). Rows with a missing id must
    be gone. An id that nothing links is a group of its own; an empty table gives no row.
    """
    parents = component_parents(pairs.where("linked").select(F.col("id1").alias("u"), F.col("id2").alias("v")), side, cell_edges)
    ids = pairs.select(F.explode(F.array("id1", "id2")).alias("call_id")).distinct()
    return ids.join(parents.withColumnRenamed("v", "call_id"), "call_id", "left").select("call_id", F.coalesce("m", "call_id").alias("group_id"))


def call_groups(dist_pairs: DataFrame, most_edits: int = 20) -> DataFrame:
    """Groups of calls under the DIST rows with an edit distance from 0 to ``most_edits``."""
    there = [F.col(c).isNotNull() & ~F.col(c).isin(*MISSING_IDS) for c in ("id1", "id2")]
    pairs = dist_pairs.where(there[0] & there[1]).select("id1", "id2", F.col("edit_distance").between(0, most_edits).alias("linked"))
    return linked_groups(pairs)

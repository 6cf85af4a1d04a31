"""Clusters of equivalent calls: members, exact sub-clusters, the representative, largest distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.graph import components


def cluster_calls(calls: DataFrame, distances: DataFrame, accepted: Column) -> DataFrame:
    """``id, cluster, exact`` of every call (``id``): its cluster under the accepted distance rows, and its sub-cluster under those with no difference at all."""
    good = distances.where(accepted).select(F.col("id1").alias("src"), F.col("id2").alias("dst"), "relshift", "relsizediff", "reldist")
    same = good.where("relshift = 0 and relsizediff = 0 and reldist = 0")
    clusters = components(calls, good.select("src", "dst")).withColumnRenamed("component", "cluster")
    exact = components(calls, same.select("src", "dst")).withColumnRenamed("component", "exact")
    return clusters.join(exact, "id")


#: Largest distances of a cluster: their names and the distances they are of, under either rule.
MAXIMA = {"max_shift": "relshift", "max_size": "relsizediff", "max_edit": "reldist"}
RATE_MAXIMA = {"max_subs": "subsdist", "max_indel": "indeldist"}


def cluster_distances(members: DataFrame, distances: DataFrame, accepted: Column, by_rates: bool = False) -> DataFrame:
    """``cluster, max_shift, max_size, max_edit`` (or ``max_subs, max_indel``): the largest accepted distances within each cluster."""
    inside = distances.where(accepted).join(members.select(F.col("id").alias("id1"), "cluster"), "id1")
    return inside.groupBy("cluster").agg(*(F.max(F.abs(c)).alias(n) for n, c in (RATE_MAXIMA if by_rates else MAXIMA).items()))


def cluster_sizes(members: DataFrame) -> DataFrame:
    """``cluster, n_calls, n_exact, representative``.

    The representative is the least id of the largest exact sub-cluster, of equally large ones the
    one with the least id: a fixed choice among those that are equally good.
    """
    exact = members.groupBy("cluster", "exact").agg(F.count(F.lit(1)).alias("n"))
    best = exact.groupBy("cluster").agg(F.sum("n").alias("n_calls"), F.min(F.struct((-F.col("n")).alias("neg"), F.col("exact").alias("id"))).alias("b"))
    return best.select("cluster", "n_calls", (-F.col("b.neg")).alias("n_exact"), F.col("b.id").alias("representative"))


def cluster_lists(members: DataFrame, delimiter: str = ":") -> DataFrame:
    """``cluster, member_ids, exact_ids``: the ids as sorted text, for the INFO of a merged file.

    A list is as long as its cluster and belongs into one field by the format; statistics should use
    :func:`cluster_sizes`.
    """
    sizes = cluster_sizes(members).select("cluster", F.col("representative").alias("rep_exact"))
    joined = members.join(sizes, "cluster")
    listed = lambda x: F.array_join(F.sort_array(F.collect_list(x)), delimiter)
    return joined.groupBy("cluster").agg(listed(F.col("id")).alias("member_ids"), listed(F.when(F.col("exact") == F.col("rep_exact"), F.col("id"))).alias("exact_ids"))


def unclustered(calls: DataFrame, members: DataFrame) -> DataFrame:
    """Adds ``in_graph``: whether the call took part in clustering at all; others are printed alone."""
    return calls.join(members.select("id", F.lit(True).alias("in_graph")).distinct(), "id", "left").withColumn("in_graph", F.coalesce("in_graph", F.lit(False)))


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")

"""Row numbers and neighbours by order within keys, without sorting a whole key in one task.

Rows are laid out in ranges of (keys, order) and stored, as ranges drawn anew could differ. Within a
range rows stand in order; what a range has to know of those before it is one row for each key.
Null keys are keys like others; rows with equal keys and order stay in one range, in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import durable


def _ranged(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    laid = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return durable(laid.withColumns({"_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()}), "ranges")


def _join_pieces(rows: DataFrame, pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with what is known of its key and range."""
    named = pieces.withColumnsRenamed({k: f"_k_{k}" for k in keys} | {"_part": "_k_part"})
    same = F.col("_part") == F.col("_k_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(named, same).drop("_k_part", *(f"_k_{k}" for k in keys))


def ranked(rows: DataFrame, keys: list[str], order: list[str | Column], name: str) -> DataFrame:
    """Adds ``name``: 1, 2, … by ``order`` within each key."""
    laid = _ranged(rows, keys, order)
    pieces = laid.groupBy(*keys, "_part").agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select(*keys, "_part", "_first", F.coalesce(earlier, F.lit(0)).alias("_before"))
    return _join_pieces(laid, pieces, keys).withColumn(name, F.col("_seq") - F.col("_first") + F.col("_before") + 1).drop("_part", "_seq", "_first", "_before")


def with_previous(rows: DataFrame, keys: list[str], order: list[str | Column], columns: list[str], name: str) -> DataFrame:
    """Adds ``name``: a struct of ``columns`` of the row before in the same key, null for the first."""
    laid = _ranged(rows, keys, order)
    value = F.struct(*columns)
    last = laid.groupBy(*keys, "_part").agg(F.max_by(value, "_seq").alias("_last"))
    pieces = last.select(*keys, "_part", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_part")).alias("_carry"))
    inside = laid.withColumn("_inside", F.lag(value).over(Window.partitionBy("_part", *keys).orderBy("_seq")))
    return _join_pieces(inside, pieces, keys).withColumn(name, F.coalesce("_inside", "_carry")).drop("_part", "_seq", "_inside", "_carry")

"""Joins by nearness of positions as equi-joins on bins, and joins of intervals by shared bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_pos: str, right_pos: str, width: int, strict: bool = False, how: str = "inner", extra: Column | None = None) -> DataFrame:
    """Pairs with equal ``keys`` and positions at most (``strict``: less than) ``width`` apart.

    A row of the right side is laid into its own bin, one of the left side looks into three: each
    pair meets in exactly one bin, so no ``distinct`` is needed. The bins are as wide as the band. A
    crowded bin is an ordinary hot join key, which adaptive execution splits. The columns of both
    sides other than ``keys`` must differ; ``extra`` is a further condition on them.
    """
    size = max(1, width)
    bin_of = lambda pos: F.floor(F.col(pos) / size)
    looks = left.withColumn("_bin", F.explode(F.sequence(bin_of(left_pos) - 1, bin_of(left_pos) + 1)))
    lies = right.withColumn("_bin", bin_of(right_pos)).withColumnsRenamed({k: f"_r_{k}" for k in keys})
    gap = F.abs(F.col(left_pos) - F.col(right_pos))
    near = gap < width if strict else gap <= width
    match = F.col("l._bin").eqNullSafe(F.col("r._bin"))
    for k in keys:
        match = match & (F.col(f"l.{k}") == F.col(f"r._r_{k}"))
    condition = match & near & (extra if extra is not None else F.lit(True))
    joined = looks.alias("l").join(lies.alias("r"), condition, how)
    return joined.drop("_bin", *(f"_r_{k}" for k in keys))


def band_self_pairs(rows: DataFrame, keys: list[str], pos: str, order: list[str], columns: list[str], width: int) -> DataFrame:
    """Each unordered pair of near rows once, as ``a_*`` and ``b_*``, a before b in (pos, order)."""
    a = rows.select(*keys, *(F.col(c).alias(f"a_{c}") for c in dict.fromkeys([pos, *order, *columns])))
    b = rows.select(*keys, *(F.col(c).alias(f"b_{c}") for c in dict.fromkeys([pos, *order, *columns])))
    side = lambda s: F.struct(*(F.col(f"{s}_{c}") for c in [pos, *order]))
    return band_join(a, b, keys, f"a_{pos}", f"b_{pos}", width, extra=side("a") < side("b"))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], left_range: tuple[str, str], right_range: tuple[str, str], bin_size: int, condition: Column, how: str = "inner", row_key: list[str] | None = None) -> DataFrame:
    """Pairs of closed intervals that share a base and fulfil ``condition``.

    Both sides are laid into all bins they touch; a pair is kept only in the bin that holds the
    greater of both starts, so it comes once. For ``left_semi`` and ``left_anti``, ``row_key`` names
    the columns that identify a row of the left side.
    """
    bins = lambda r: F.explode(F.sequence(F.floor(F.col(r[0]) / bin_size), F.floor(F.col(r[1]) / bin_size)))
    proper = lambda df, r: df.where(F.col(r[1]) >= F.col(r[0]))
    a = proper(left, left_range).withColumn("_bin", bins(left_range))
    b = proper(right, right_range).withColumn("_bin", bins(right_range)).withColumnsRenamed({k: f"_r_{k}" for k in keys})
    match = F.col("l._bin") == F.col("r._bin")
    for k in keys:
        match = match & (F.col(f"l.{k}") == F.col(f"r._r_{k}"))
    meets = (F.col(left_range[0]) <= F.col(right_range[1])) & (F.col(right_range[0]) <= F.col(left_range[1]))
    once = F.col("l._bin") == F.floor(F.greatest(left_range[0], right_range[0]) / bin_size)
    pairs = a.alias("l").join(b.alias("r"), match & meets & once & condition)
    if how == "inner":
        return pairs.drop("_bin", *(f"_r_{k}" for k in keys))
    hits = pairs.select(*(F.col(f"l.{k}").alias(f"_h_{k}") for k in row_key)).distinct()
    same = F.lit(True)
    for k in row_key:
        same = same & F.col(k).eqNullSafe(F.col(f"_h_{k}"))
    return left.join(hits, same, how)

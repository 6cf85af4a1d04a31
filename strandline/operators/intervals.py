"""Regions: discovery between alignments, merging, coverage by spanning alignments, containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.bandjoin import overlap_join
from strandline.operators.coverage import overlapping
from strandline.operators.ordering import with_previous

BIN = 1 << 16


def regions_between(alignments: DataFrame, tie: list[str], max_size: int | None = None) -> DataFrame:
    """``ref_entry, kind, start, end`` between an alignment and the one before it on the same pair of entries.

    OVERLAP ``[start, end of the one before]`` if it begins before that end, else GAP ``[end of the
    one before, start]``; with ``max_size`` only regions less wide than that.
    """
    needed = alignments.select("ref_entry", "query_entry", "ref_start", "ref_end", *tie)
    rows = with_previous(needed, ["ref_entry", "query_entry"], ["ref_start", "ref_end", *tie], ["ref_end"], "_previous")
    rows = rows.withColumn("before", F.col("_previous.ref_end")).where(F.col("before").isNotNull())
    overlap = F.col("ref_start") < F.col("before")
    out = rows.select(
        "ref_entry", F.when(overlap, "OVERLAP").otherwise("GAP").alias("kind"),
        F.least("ref_start", "before").alias("start"), F.greatest("ref_start", "before").alias("end"),
    )
    return out if max_size is None else out.where(F.col("end") - F.col("start") < max_size)


def merge_regions(regions: DataFrame, key: str) -> DataFrame:
    """Islands of overlapping regions; a new one begins where a start lies beyond all ends before it."""
    return overlapping(regions, key, "start", "end")


def spanning_pairs(regions: DataFrame, alignments: DataFrame, buffer: int, segment: int, bin_size: int = BIN) -> DataFrame:
    """``region_id, chrom, start, end, query_entry, comp``: queries with alignments strictly over the segment left of a region and over the one right of it, on one strand (forward if both strands do)."""
    marks = regions.select(
        "region_id", "chrom", "start", "end",
        (F.col("start") - buffer).alias("ls"), (F.col("start") - buffer + segment - 1).alias("le"),
        (F.col("end") + buffer - segment + 1).alias("rs"), (F.col("end") + buffer).alias("re"),
    )
    aligned = alignments.select(F.col("ref_entry").alias("chrom"), "query_entry", "comp", "ref_start", "ref_end")
    # A spanning alignment covers the segment's first base, so that base alone is looked up; both segments go through one join.
    spot = lambda side, a, b: F.struct(F.lit(side).alias("side"), F.col(a).alias("p"), F.col(b).alias("q"))
    spots = marks.select("region_id", "chrom", "start", "end", F.explode(F.array(spot("left", "ls", "le"), spot("right", "rs", "re"))).alias("m"))
    spots = spots.select("region_id", "chrom", "start", "end", "m.side", F.col("m.p").alias("_p"), F.col("m.p").alias("_p2"), F.col("m.q").alias("_q"))
    strict = (F.col("ref_start") < F.col("_p")) & (F.col("ref_end") > F.col("_q"))
    hits = overlap_join(spots, aligned, ["chrom"], ("_p", "_p2"), ("ref_start", "ref_end"), bin_size, strict)
    both = hits.groupBy("region_id", "chrom", "start", "end", "query_entry", "comp").agg(F.bool_or(F.col("side") == "left").alias("l"), F.bool_or(F.col("side") == "right").alias("r"))
    return both.where("l and r").groupBy("region_id", "chrom", "start", "end", "query_entry").agg(F.min("comp").alias("comp"))


def uncovered(regions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Regions without a spanning query."""
    return regions.join(pairs.select("region_id"), "region_id", "left_anti")


def touching(rows: DataFrame, regions: DataFrame, row_key: list[str], start: str = "start", end: str = "end", bin_size: int = BIN) -> DataFrame:
    """Rows that share a base with any region (``chrom, r_start, r_end``)."""
    return overlap_join(rows, regions, ["chrom"], (start, end), ("r_start", "r_end"), bin_size, F.lit(True), "left_semi", row_key)


def covered_flags(points: DataFrame, coverage: DataFrame, row_key: list[str], start: str = "start", end: str = "end", bin_size: int = BIN) -> DataFrame:
    """Adds ``covered``: whether one coverage row (``chrom, r_start, r_end``) contains the whole row."""
    within = (F.col("r_start") <= F.col(start)) & (F.col("r_end") >= F.col(end))
    first = points.withColumn("_p", F.col(start)).withColumn("_q", F.col(start))
    hits = overlap_join(first, coverage, ["chrom"], ("_p", "_q"), ("r_start", "r_end"), bin_size, within).select(*row_key).distinct().withColumn("covered", F.lit(True))
    return points.join(hits, row_key, "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def strand_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Whether two directed stretches overlap; a stretch of one base overlaps nothing."""
    lo1, hi1, lo2, hi2 = F.least(s1, e1), F.greatest(s1, e1), F.least(s2, e2), F.greatest(s2, e2)
    return (lo1 < hi1) & (lo2 < hi2) & (lo1 <= hi2) & (lo2 <= hi1)


def interpolate(position: Column, s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """The place on the second stretch that corresponds to one on the first, cut to a whole number."""
    share = F.try_divide(position - s1, e1 - s1)
    return (s2 + share * (e2 - s2)).cast("bigint")


def away_from_edges(regions: DataFrame, contigs: DataFrame, buffer: int) -> DataFrame:
    """Adds ``status``: ``chromend`` where the buffered region leaves its contig, else ``ok``."""
    rows = regions.join(contigs.select("chrom", "contig_len"), "chrom", "left")
    outside = (F.col("start") - buffer <= 0) | (F.col("end") + buffer > F.col("contig_len")) | F.col("contig_len").isNull()
    return rows.withColumn("status", F.when(outside, "chromend").otherwise("ok")).drop("contig_len")


def longest_at_endpoints(alignments: DataFrame, group: str, start: str, end: str, row_key: str, bin_size: int = BIN) -> DataFrame:
    """Adds ``redundant``: false for an alignment that is the longest of those over any of the end points.

    Every start and end of the group is looked up in the alignments that contain it; ties in length
    keep the first by ``row_key``.
    """
    rows = alignments.withColumns({"_s": F.least(start, end), "_e": F.greatest(start, end)})
    points = rows.select(F.col(group).alias("_g"), F.explode(F.array("_s", "_e")).alias("_p")).distinct().withColumn("_q", F.col("_p"))
    active = overlap_join(points.withColumnRenamed("_g", group), rows.select(group, "_s", "_e", row_key), [group], ("_p", "_q"), ("_s", "_e"), bin_size, F.lit(True))
    best = active.groupBy(group, "_p").agg(F.min(F.struct((F.col("_s") - F.col("_e")).alias("neg"), F.col(row_key).alias("key"))).alias("b")).select(F.col("b.key").alias(row_key)).distinct()
    kept = best.withColumn("redundant", F.lit(False))
    return alignments.join(kept, row_key, "left").withColumn("redundant", F.coalesce("redundant", F.lit(True)))

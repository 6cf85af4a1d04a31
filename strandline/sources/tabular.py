"""Line formats besides VCF: BED, distances, coords, show-diff, manifests, coverage, relational tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DISTANCE_KINDS = ["string"] * 2 + ["double", "bigint", "double", "bigint", "bigint", "bigint", "bigint", "double", "double", "double", "bigint", "bigint", "bigint", "double", "double"]
DISTANCE_NAMES = ("id1", "id2", "avgaltlength", "altlengthdiff", "avgsize", "sizediff", "edit_distance", "maxshift", "posdiff", "relshift", "relsizediff", "reldist", "numsubs", "numindels", "marlength", "subsdist", "indeldist")


def bed(lines: DataFrame) -> DataFrame:
    """``chrom, start, end`` (1-based, inclusive) of BED lines (column ``line``); ``status`` is ``reversed`` for an end before the start and ``malformed`` for other lines."""
    pattern = r"^(\S+)\s(\d+)\s(\d+)"
    part = lambda i: F.regexp_extract("line", pattern, i)
    start, end = part(2).try_cast("bigint") + 1, part(3).try_cast("bigint")
    status = F.when(~F.col("line").rlike(pattern), "malformed").when(end < start, "reversed").otherwise("ok")
    return lines.where((F.trim("line") != "") & ~F.col("line").startswith("#")).select(F.when(status != "malformed", part(1)).alias("chrom"), start.alias("start"), end.alias("end"), status.alias("status"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return bed(spark.read.text(path).withColumnRenamed("value", "line"))


def distances(lines: DataFrame) -> DataFrame:
    """Distance rows of lines that begin with ``DIST``; the header and short lines are left out."""
    cells = F.split("line", "\t")
    rows = lines.where(F.col("line").startswith("DIST\t") & (F.size(cells) >= 18) & (cells[1] != "ID1")).withColumn("c", cells)
    return rows.select(*(F.get("c", F.lit(i + 1)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(zip(DISTANCE_NAMES, _DISTANCE_KINDS))))


def show_diff_gaps(lines: DataFrame) -> DataFrame:
    """``ref_entry`` and the six numbers of the GAP rows of a show-diff listing."""
    cells = F.split("line", "\t")
    rows = lines.where((F.size(cells) >= 7) & (cells[1] == "GAP"))
    names = ("ref_start", "ref_end", "ref_gap", "query_gap", "gap_diff")
    return rows.select(cells[0].alias("ref_entry"), *(cells[i + 2].try_cast("bigint").alias(n) for i, n in enumerate(names)))


def coords(lines: DataFrame) -> DataFrame:
    """The 13 columns of a coords listing; rows without the last column are left out."""
    names = ["ref_start", "ref_end", "query_start", "query_end", "ref_span", "query_span", "identity", "ref_len", "query_len", "ref_cover", "query_cover"]
    kinds = ["bigint"] * 6 + ["double"] + ["bigint"] * 2 + ["double"] * 2
    cells = F.split("line", "\t")
    rows = lines.where(F.get(cells, F.lit(12)).isNotNull() & (F.get(cells, F.lit(12)) != "") & cells[0].rlike(r"^\d+\z"))
    return rows.select(*(cells[i].try_cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds))), cells[11].alias("ref_entry"), cells[12].alias("query_entry"))


def manifest(lines: DataFrame) -> DataFrame:
    """``sample, vcf, coverage, delta`` of whitespace-parted lines."""
    cells = F.split(F.trim("line"), r"\s+")
    return lines.where((F.trim("line") != "") & ~F.col("line").startswith("#")).select(*(F.get(cells, F.lit(i)).alias(n) for i, n in enumerate(("sample", "vcf", "coverage", "delta"))))


def coverage(lines: DataFrame) -> DataFrame:
    """Distinct ``chrom, start, end, contig`` of coverage lines."""
    cells = F.split(F.trim("line"), r"\s+")
    return lines.where(F.size(cells) >= 4).select(cells[0].alias("chrom"), cells[1].try_cast("bigint").alias("start"), cells[2].try_cast("bigint").alias("end"), cells[3].alias("contig")).distinct()


def file_list(paths: list[str], lists: list[str]) -> list[str]:
    """Paths given and paths named in list files; comments, blanks and unreadable paths are passed over. None left is an error."""
    found = list(paths)
    for name in lists:
        with open(name) as lines:
            found += [x for line in lines if (x := line.strip()) and not x.startswith("#") and os.access(x, os.R_OK)]
    if not found:
        raise ValueError("no readable input file")
    return found


def relational(spark: SparkSession, url: str, table: str, column: str | None = None, low: int = 0, high: int = 0, parts: int = 1) -> DataFrame:
    """A table over JDBC, in parts by a numeric column."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if column is not None:
        reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.load()

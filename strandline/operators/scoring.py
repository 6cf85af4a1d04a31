"""Benchmark of a test call set against a truth set."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import info as I


def size_passes(size: Column, least: int, truth: bool) -> Column:
    """A truth call may have the least size, a test call must exceed it."""
    return size >= least if truth else size > least


def read_support(records: DataFrame, least: int) -> DataFrame:
    """Records whose sample has at least ``least`` variant reads (DV); those without DV drop out."""
    return records.where(I.format_value(F.col("format"), F.get("samples", F.lit(0)), "DV").try_cast("bigint") >= least)


def read_fraction(records: DataFrame, least: float) -> DataFrame:
    """Drops records with variant reads below ``least`` times the reference reads, where both are above 0."""
    ref, var = (F.coalesce(I.format_value(F.col("format"), F.get("samples", F.lit(0)), k).try_cast("bigint"), F.lit(0)) for k in ("DR", "DV"))
    return records.where(~((ref > 0) & (var > 0) & (var < ref * least)))


@dataclass(frozen=True)
class Benchmark:
    """Rows of ``metrics`` (one), false positives, false negatives, the matched pairs and, where they were computed, the distances of all pairs."""

    metrics: DataFrame
    false_positives: DataFrame
    false_negatives: DataFrame
    matches: DataFrame
    distances: DataFrame | None = None


def score(test: DataFrame, truth: DataFrame, matches: DataFrame, key: str = "id") -> Benchmark:
    """Metrics of two sets of records with a unique ``key``, under matched pairs (``test_key, truth_key``).

    Pairs count only where both sides are among the given (already filtered) records. A ratio
    without a base is null.
    """
    good = matches.join(test.select(F.col(key).alias("test_key")), "test_key", "left_semi").join(truth.select(F.col(key).alias("truth_key")), "truth_key", "left_semi")
    flags = []
    for rows, side in ((test, "test_key"), (truth, "truth_key")):
        hit = good.select(F.col(side).alias(key)).distinct().withColumn("matched", F.lit(True))
        flags.append(rows.join(hit, key, "left").withColumn("matched", F.coalesce("matched", F.lit(False))))
    counts = [f.agg(F.count_if("matched").alias(f"{n}_matched"), F.count_if(~F.col("matched")).alias(f"{n}_missed")) for f, n in zip(flags, ("test", "truth"))]
    # Two rows of counts side by side, by a constant key.
    one = counts[0].withColumn("k", F.lit(1)).join(counts[1].withColumn("k", F.lit(1)), "k")
    precision = F.try_divide(F.col("test_matched"), F.col("test_matched") + F.col("test_missed"))
    recall = F.try_divide(F.col("truth_matched"), F.col("truth_matched") + F.col("truth_missed"))
    metrics = one.select(
        F.col("test_matched").alias("ptp"), F.col("test_missed").alias("fp"), F.col("truth_matched").alias("dtp"), F.col("truth_missed").alias("fn"),
        precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * precision * recall, precision + recall).alias("f1"),
    )
    return Benchmark(metrics, flags[0].where("not matched").drop("matched"), flags[1].where("not matched").drop("matched"), good)


def multiple_matches(matches: DataFrame, side: str, other: str) -> DataFrame:
    """Records of one side with several matches: their number and the ids of the others as sorted text."""
    return matches.groupBy(side).agg(F.count(F.lit(1)).alias("n_matches"), F.array_join(F.sort_array(F.collect_list(other)), ",").alias("ids")).where("n_matches > 1")


def report_lines(row) -> list[str]:
    """The printed report of a metrics row; ratios without a base print as NaN."""
    shown = lambda x: "NaN" if x is None else f"{100 * x:5.2f}"
    return [
        f"Number of true variants found: {row.dtp}", f"Number of true variants missed: {row.fn}",
        f"Number of test variants that match: {row.ptp}", f"Number of test variants that don't: {row.fp}",
        f"Recall: {shown(row.recall)}%", f"Precision: {shown(row.precision)}%", f"F1: {'NaN' if row.f1 is None else format(row.f1, '.15g')}",
    ]

"""Distances of pairs of variants: cheap bounds, haplotypes, the full record, and what counts as a match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.align import align_udf

#: Columns of the distance table, in order.
HEADER = ("DIST", "ID1", "ID2", "AVGALTLENGTH", "ALTLENGTHDIFF", "AVGSIZE", "SIZEDIFF", "EDITDIST", "MAXSHIFT", "POSDIFF", "RELSHIFT", "RELSIZEDIFF", "RELDIST", "NUMSUBS", "NUMINDELS", "MARLENGTH", "SUBSDIST", "INDELDIST")


def _c(side: str, name: str) -> Column:
    return F.col(f"{side}_{name}")


def sizes(side: str) -> Column:
    return _c(side, "altlength") - _c(side, "reflength")


def denominator() -> Column:
    """Mean of the larger alleles of both sides."""
    return (F.greatest(_c("a", "reflength"), _c("a", "altlength")) + F.greatest(_c("b", "reflength"), _c("b", "altlength"))) / 2


def potential_match(rel_size: float = 1.0, rel_shift: float = 1.0, shift_factor: float | None = None) -> Column:
    """The size difference bounds the shift from below, so it must keep within both thresholds."""
    shared = F.lit(shift_factor) if shift_factor is not None else denominator()
    gap = F.abs(sizes("a") - sizes("b"))
    return (gap <= shared * rel_size) & (gap <= shared * rel_shift)


def affected_length() -> Column:
    """The longest of the reference window of both variants and the window under either; 0 across chromosomes."""
    window = F.greatest("a_end", "b_end") - F.least("a_pos", "b_pos") + 1
    longest = F.greatest(window, window + sizes("a"), window + sizes("b"))
    return F.when(F.col("a_chrom") == F.col("b_chrom"), longest).otherwise(0).cast("bigint")


def prohibitive_shift(rate: float) -> Column:
    return F.abs(_c("a", "altlength") - _c("b", "altlength")) > rate * affected_length()


def haplotypes(pairs: DataFrame, slices, buffer: int = 0) -> DataFrame:
    """Adds ``hap_a, hap_b``: the reference between both variants with either allele put in.

    ``slices(df, chrom, start, end, name)`` adds reference bases; where the window leaves the contig
    it gives null, and so are the haplotypes.
    """
    left, right = F.least("a_pos", "b_pos"), F.greatest("a_end", "b_end")
    framed = slices(pairs.withColumns({"_l": left - buffer, "_r": right + buffer}), "a_chrom", F.col("_l"), F.col("_r"), "_window")
    put = lambda s: F.concat(
        F.substring("_window", F.lit(1), (F.col(f"{s}_pos") - F.col("_l")).cast("int")),
        F.col(f"{s}_alt"),
        F.substring("_window", (F.col(f"{s}_end") - F.col("_l") + 2).cast("int"), F.lit(2**31 - 1)),
    )
    full = F.length("_window") == F.col("_r") - F.col("_l") + 1
    return framed.withColumns({"hap_a": F.when(full, put("a")), "hap_b": F.when(full, put("b"))}).drop("_l", "_r", "_window")


def aligned(pairs: DataFrame) -> DataFrame:
    """Adds ``edit_distance, max_shift, subs, indels`` of the haplotypes; equal ones never reach Python."""
    same = F.col("hap_a") == F.col("hap_b")
    x, y = F.when(~same, F.col("hap_a")), F.when(~same, F.col("hap_b"))
    out = pairs.withColumn("_m", align_udf(x, y))
    pick = lambda n: F.when(same, F.lit(0)).otherwise(F.col(f"_m.{n}")).cast("bigint")
    return out.withColumns({n: pick(n) for n in ("edit_distance", "max_shift", "subs", "indels")}).drop("_m")


def distance_record(pairs: DataFrame) -> DataFrame:
    """The distance columns of aligned pairs (``a_*``, ``b_*``) and ``match_type``.

    A failed alignment leaves its columns null and is NWFAIL, so it can't count as a perfect match.
    """
    shared, affected = denominator(), affected_length()
    size_a, size_b = sizes("a"), sizes("b")
    least = F.least(F.abs(size_a), F.abs(size_b))
    per = lambda value, by: F.try_divide(value.cast("double"), by)
    kind = F.when(F.col("hap_a") == F.col("hap_b"), "EXACTMATCH").when(F.abs("max_shift") < least, "NWMATCH").otherwise("NWFAIL")
    return pairs.select(
        F.col("a_id").alias("id1"), F.col("b_id").alias("id2"),
        ((_c("a", "altlength") + _c("b", "altlength")) / 2).alias("avgaltlength"), (_c("a", "altlength") - _c("b", "altlength")).alias("altlengthdiff"),
        ((size_a + size_b) / 2).alias("avgsize"), (size_a - size_b).alias("sizediff"),
        "edit_distance", F.col("max_shift").alias("maxshift"), (F.col("a_pos") - F.col("b_pos")).alias("posdiff"),
        per(F.abs("max_shift"), shared).alias("relshift"), per(F.abs(size_a - size_b), shared).alias("relsizediff"), per(F.col("edit_distance"), shared).alias("reldist"),
        F.col("subs").alias("numsubs"), F.col("indels").alias("numindels"), affected.alias("marlength"),
        per(F.col("subs"), affected).alias("subsdist"), per(F.col("indels"), affected).alias("indeldist"), kind.alias("match_type"),
    )


def usable(distances: DataFrame) -> DataFrame:
    """Distance rows as delivered: a null or negative edit distance marks a failed alignment, whose derived columns don't count."""
    failed = F.col("edit_distance").isNull() | (F.col("edit_distance") < 0)
    return distances.withColumns({c: F.when(~failed, F.col(c)) for c in ("relshift", "relsizediff", "reldist", "subsdist", "indeldist")})


def classic_match(shift: float = 0.2, size: float = 0.2, dist: float = 0.2) -> Column:
    return (F.abs("relshift") <= shift) & (F.abs("relsizediff") <= size) & (F.abs("reldist") <= dist)


def rate_match(max_subs: float, max_indel: float) -> Column:
    """The newer rule; both rates have to be given."""
    return (F.col("subsdist") <= max_subs) & (F.col("indeldist") <= max_indel)

"""INFO and FORMAT fields of VCF records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "."


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def end_tag(info: Column, anchored: bool = True) -> Column:
    """END; unanchored, any tag that ends in END counts too (CIEND and the like)."""
    return _first(info, r"(?:^|;)\s*END=(\d+)" if anchored else r"END=(\d+)").try_cast("bigint")


def svlen_tag(info: Column) -> Column:
    """The signed SVLEN."""
    return _first(info, r"SVLEN=(-?\d+)").try_cast("bigint")


def svtype_tag(info: Column) -> Column:
    return _first(info, r"SVTYPE=([^;\s]+)")


def seq_tag(info: Column) -> Column:
    """The inserted sequence of SEQ, in capitals."""
    return F.upper(_first(info, r"(?:^|;)\s*SEQ=([ACGTNacgtn]+)"))


def widened_tag(info: Column, tag: str) -> Column:
    """``chrom, start, end, comp`` of ``tag=chrom:start-end`` with an optional ``_comp``."""
    pattern = rf"{tag}=([^:;]+):(\d+)-(\d+)(_comp)?"
    part = lambda i: F.regexp_extract(info, pattern, i)
    return F.when(
        info.rlike(pattern),
        F.struct(part(1).alias("chrom"), part(2).try_cast("bigint").alias("start"), part(3).try_cast("bigint").alias("end"), (part(4) != "").alias("comp")),
    )


def info_pairs(info: Column) -> Column:
    """Array of (key, value) of the entries ``key=value``; flags and values with another ``=`` are dropped."""
    entries = F.filter(F.transform(F.split(info, ";"), lambda x: F.trim(x)), lambda x: F.size(F.split(x, "=")) == 2)
    return F.transform(entries, lambda x: F.struct(F.split(x, "=")[0].alias("key"), F.split(x, "=")[1].alias("value")))


def info_value(info: Column, key: str) -> Column:
    """The last value of a key among :func:`info_pairs`."""
    hits = F.filter(info_pairs(info), lambda p: p["key"] == key)
    return F.try_element_at(hits, F.lit(-1))["value"]


def format_value(format_keys: Column, sample: Column, key: str) -> Column:
    """The sample's value under a FORMAT key; null without the key or with ``.``."""
    at = F.array_position(F.split(format_keys, ":"), key)
    value = F.get(F.split(sample, ":"), (at - 1).cast("int"))
    return F.when((at > 0) & (value != MISSING), value)


def variant_size(info: Column, ref: Column, alt: Column) -> Column:
    """Absolute size: SVLEN, else the difference of the allele lengths of spelled-out alleles, else 0.

    A symbolic ALT has no length of its own, so it gives 0 without SVLEN.
    """
    spelled = ref.rlike(r"^[A-Za-z]+\z") & alt.rlike(r"^[A-Za-z]+\z")
    return F.coalesce(F.abs(svlen_tag(info)), F.when(spelled, F.abs(F.length(ref) - F.length(alt))).cast("bigint"), F.lit(0).cast("bigint"))


def keep_declared(info: Column, keys: Column) -> Column:
    """INFO without the entries whose key isn't in the array ``keys``."""
    return F.array_join(F.filter(F.split(info, ";"), lambda x: F.array_contains(keys, F.split(F.trim(x), "=")[0])), ";")

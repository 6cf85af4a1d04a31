"""Sequence functions: complement, ambiguity codes, repeat units, shifting of small indels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.align import common_begin

_SHIFTED = T.StructType(
    [T.StructField("first", T.StringType()), T.StructField("second", T.StringType()), T.StructField("left_bases", T.IntegerType()), T.StructField("right_bases", T.IntegerType())]
)

# The IUPAC codes, each beside the bases it stands for, and its complement.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "M": "AC", "R": "AG", "W": "AT", "S": "CG", "Y": "CT", "K": "GT", "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT", "N": "ACGT"}
COMPLEMENT_FROM = "ACGTUMRWSYKVHDBNacgtumrwsykvhdbn"
COMPLEMENT_TO = "TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn"


def reverse_complement(seq: Column) -> Column:
    """Reverse complement with ambiguity codes; null for a text with other characters."""
    return F.when(seq.rlike(rf"^[{COMPLEMENT_FROM}]*\z"), F.reverse(F.translate(seq, COMPLEMENT_FROM, COMPLEMENT_TO)))


def reverse_complement_text(seq: str) -> str:
    return seq.translate(str.maketrans(COMPLEMENT_FROM, COMPLEMENT_TO))[::-1]


def iupac_code(bases: Column) -> Column:
    """The code of a set of bases given as a string in any order and case; N for anything else."""
    table = F.create_map(*(F.lit(x) for code, of in IUPAC.items() for x in (of, code)))
    ordered = F.array_join(F.array_sort(F.array_distinct(F.split(F.upper(bases), ""))), "")
    return F.coalesce(F.try_element_at(table, ordered), F.lit("N"))


def iupac_bases(code: Column) -> Column:
    """The bases that a code stands for; null for no code."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in IUPAC.items() for x in pair)), F.upper(code))


def wrap(seq: Column, width: int = 50) -> Column:
    """The sequence in lines of ``width`` characters."""
    return F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), r"\n\z", "")


def least_period(text: str) -> int:
    """The least p such that each character equals the one p before it (the length if there is none), by borders of prefixes."""
    border = [0] * len(text)
    k = 0
    for i in range(1, len(text)):
        while k and text[i] != text[k]:
            k = border[k - 1]
        k += text[i] == text[k]
        border[i] = k
    return len(text) - border[-1] if text else 0


def repeat_alias(allele: str) -> str:
    """``n(unit)rest`` for the smallest unit whose repetition, with a part of it at the end, is the allele."""
    if not allele or allele == "*":
        return allele
    size = least_period(allele)
    times = len(allele) // size
    return allele if times == 1 else f"{times}({allele[:size]}){allele[times * size :]}"


def even_repeat_alias(allele: str) -> str:
    """As :func:`repeat_alias`, by cutting the allele into pieces of each size: the pieces must be equal but for the last."""
    # The last piece is free, so the unit's repeats must cover all whole pieces; sizes are tried against borders of the pieces.
    n = len(allele)
    for size in range(1, n // 2 + 1):
        whole = n // size * size
        if common_begin(allele[: whole - size], allele[size:whole]) == whole - size:
            return f"{n // size}({allele[:size]}){allele[whole:]}"
    return allele


def _repeated(free: str, flank: str) -> int:
    """How far the flank repeats the free bases that stand before it: each base must equal the one a free length back. Case doesn't count."""
    free, flank = free.upper(), flank.upper()
    return common_begin(free + flank, flank) if free else 0


def shift_indel(left_flank: str, first: str, second: str, right_flank: str) -> tuple[str, str, int, int]:
    """Widen two alleles over the flanking bases that repeat them: right first, then left.

    Returns both alleles and the number of bases taken from the left and the right flank. Only where
    the shorter allele begins the longer one can it move right, only where it ends it, left.
    """
    first, second = first.replace("*", ""), second.replace("*", "")
    right = left = 0
    short, long = sorted((first, second), key=len)
    if len(short) < len(long) and long[: len(short)].upper() == short.upper():
        right = _repeated(long[len(short) :], right_flank)
        first, second = first + right_flank[:right], second + right_flank[:right]
        short, long = sorted((first, second), key=len)
    if len(short) < len(long) and long[len(long) - len(short) :].upper() == short.upper():
        left = _repeated(long[: len(long) - len(short)][::-1], left_flank[::-1])
        took = left_flank[len(left_flank) - left :]
        first, second = took + first, took + second
    return first, second, left, right


MATCH, MISMATCH, GIVE_UP = 3, -7, 200  # fixed values of local alignment: scores, and the bases after which no better end is looked for


def repeat_extent(free: str, flank: str, bridging: bool = True) -> int:
    """How far the flank goes on to repeat the free bases before it.

    Exactly, or (``bridging``) over mismatches: the end of the best-scoring run of matches and
    mismatches, where nothing better comes within GIVE_UP bases.
    """
    exact = _repeated(free, flank)
    if not bridging or not free or exact == len(flank):
        return exact
    x, y = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in ((free + flank)[: len(flank)].upper(), flank.upper()))
    score = np.cumsum(np.where(x == y, MATCH, MISMATCH))
    best = np.maximum.accumulate(score)
    at = np.arange(len(score))
    since = at - np.maximum.accumulate(np.where(np.concatenate([[score[0] > 0], score[1:] > best[:-1]]), at, -1))
    late = np.flatnonzero(since > GIVE_UP)
    upto = late[0] if len(late) else len(score)
    top = int(np.argmax(score[:upto]))
    return top + 1 if score[top] > 0 else 0


_EXTENTS = T.StructType([T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType())])


def repeat_extents_udf(bridging: bool):
    """``left, right`` of (left flank, first, second, right flank): how far the longer allele's free bases are repeated on either side, where the shorter one is empty."""

    @F.pandas_udf(_EXTENTS)
    def run(left: pd.Series, first: pd.Series, second: pd.Series, right: pd.Series) -> pd.DataFrame:
        rows = []
        for before, a, b, after in zip(left, first, second, right):
            free = (a or b or "") if not (a and b) else ""
            rows.append((repeat_extent(free[::-1], (before or "")[::-1], bridging), repeat_extent(free, after or "", bridging)))
        return pd.DataFrame(rows, columns=["left", "right"])

    return run


_TRIMMED = T.StructType([T.StructField(n, T.StringType()) for n in ("prefix", "ref", "alt", "suffix")])


@F.pandas_udf(_TRIMMED)
def trim_alleles(ref: pd.Series, alt: pd.Series) -> pd.DataFrame:
    """``prefix, ref, alt, suffix``: common bases at the begin, then at the end, cut off; null alleles count as empty."""
    rows = []
    for a, b in zip(ref, alt):
        a, b = a or "", b or ""
        p = common_begin(a, b)
        most = min(len(a), len(b)) - p
        q = common_begin(a[len(a) - most :][::-1], b[len(b) - most :][::-1])
        rows.append((a[:p], a[p : len(a) - q], b[p : len(b) - q], a[len(a) - q :]))
    return pd.DataFrame(rows, columns=["prefix", "ref", "alt", "suffix"])


@F.pandas_udf(T.StringType())
def repeat_alias_udf(alleles: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in alleles:
        yield part.map(lambda a: None if a is None else repeat_alias(a))


@F.pandas_udf(_SHIFTED)
def shift_indel_udf(left: pd.Series, first: pd.Series, second: pd.Series, right: pd.Series) -> pd.DataFrame:
    rows = [shift_indel(*(x or "" for x in row)) for row in zip(left, first, second, right)]
    return pd.DataFrame(rows, columns=["first", "second", "left_bases", "right_bases"])

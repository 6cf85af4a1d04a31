"""CIGAR strings: parsing, statistics, end points, offsets of delta files, lifting of positions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = "array<struct<n:int,op:string>>"


def parse(cigar: Column) -> Column:
    """Array of (n, op); null where the string is no CIGAR."""
    counts = F.regexp_extract_all(cigar, F.lit("([0-9]+)[MIDNSHP=X]"), F.lit(1))
    ops = F.regexp_extract_all(cigar, F.lit("[0-9]+([MIDNSHP=X])"), F.lit(1))
    pairs = F.transform(F.arrays_zip(counts.alias("c"), ops.alias("o")), lambda x: F.struct(x["c"].cast("int").alias("n"), x["o"].alias("op")))
    return F.when(cigar.rlike(r"^([0-9]+[MIDNSHP=X])+\z"), pairs)


def total(ops: Column, kinds: str) -> Column:
    """Bases under the operations ``kinds``."""
    return F.aggregate(F.filter(ops, lambda x: x["op"].isin(*kinds)), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])


def longest(ops: Column, kind: str) -> Column:
    """The longest run of an operation, 0 without one."""
    return F.coalesce(F.array_max(F.transform(F.filter(ops, lambda x: x["op"] == kind), lambda x: x["n"])), F.lit(0))


def mismatch_rate(mismatches: Column, ops: Column) -> Column:
    """Mismatches by aligned columns (M, I and D)."""
    return F.try_divide(mismatches, total(ops, "MID"))


def clip(ops: Column, last: bool) -> Column:
    """Clipped bases (S and H) at the first or last end."""
    end = F.reverse(ops) if last else ops
    return F.aggregate(
        end,
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda a, x: F.struct((a["n"] + F.when(a["on"] & x["op"].isin("S", "H"), x["n"]).otherwise(0)).alias("n"), (a["on"] & x["op"].isin("S", "H")).alias("on")),
        lambda a: a["n"],
    )


def endpoints(pos: Column, ops: Column, reverse: Column) -> Column:
    """``ref_start, ref_end, query_start, query_end`` of an alignment that begins at ``pos``.

    Query positions count on the whole query as it was before clipping; of a reversed alignment the
    start is greater than the end. ``N`` and ``P`` advance nothing.
    """
    first, last, body = clip(ops, False), clip(ops, True), total(ops, "MI")
    whole = first + body + last
    return F.struct(
        pos.cast("bigint").alias("ref_start"),
        (pos + total(ops, "MD") - 1).cast("bigint").alias("ref_end"),
        F.when(reverse, whole - first).otherwise(first + 1).cast("bigint").alias("query_start"),
        F.when(reverse, last + 1).otherwise(first + body).cast("bigint").alias("query_end"),
    )


def from_delta(offsets: list[int], ref_start: int, ref_end: int, query_start: int, query_end: int) -> str | None:
    """CIGAR of the signed distances of a delta alignment; None if what remains has unequal lengths.

    A positive distance has its last base in the reference only (D), a negative one in the query (I).
    """
    ops: list[list] = []

    def add(n: int, op: str) -> None:
        if n and ops and ops[-1][1] == op:
            ops[-1][0] += n
        elif n:
            ops.append([n, op])

    used_ref = used_query = 0
    for d in offsets:
        add(abs(d) - 1, "M")
        add(1, "D" if d > 0 else "I")
        used_ref += abs(d) - (d < 0)
        used_query += abs(d) - (d > 0)
    rest = ref_end - ref_start + 1 - used_ref
    if rest != abs(query_end - query_start) + 1 - used_query or rest < 0:
        return None
    ops.append([rest, "M"])
    return "".join(f"{n}{op}" for n, op in ops)


_PART = re.compile(r"(\d+)([MDI])")


def lift(cigar: str, ref_start: int, query_start: int, query_end: int, position: int, to_ref: bool) -> int | None:
    """The position on the other sequence; inside a gap that of the last base before it.

    None outside the alignment.
    """
    sign = -1 if query_start > query_end else 1
    ref, query = ref_start - 1, query_start - sign
    for n, op in ((int(a), b) for a, b in _PART.findall(cigar or "")):
        ref_after = ref + n * (op != "I")
        query_after = query + sign * n * (op != "D")
        here = (position - query) * sign if to_ref else position - ref
        there = (query_after - query) * sign if to_ref else ref_after - ref
        if 0 < here <= there:
            if op == "M":
                return ref + here if to_ref else query + sign * here
            return ref if to_ref else query
        ref, query = ref_after, query_after
    return None


def lifted(ops: Column, ref_start: Column, query_start: Column, query_end: Column, position: Column, to_ref: bool) -> Column:
    """:func:`lift` of parsed operations as one fold: the places reached on both sequences go along, and the first operation that reaches the position gives the result."""
    sign = F.when(query_start > query_end, F.lit(-1)).otherwise(F.lit(1))
    kind = "struct<r:bigint,q:bigint,x:bigint>"
    start = F.struct((ref_start - 1).alias("r"), (query_start - sign).alias("q"), F.lit(None).cast("bigint").alias("x")).cast(kind)

    def step(a: Column, op: Column) -> Column:
        on_ref = F.when(op["op"].isin("M", "D"), op["n"]).otherwise(0)
        on_query = F.when(op["op"].isin("M", "I"), op["n"]).otherwise(0)
        here = (position - a["q"]) * sign if to_ref else position - a["r"]
        there = on_query if to_ref else on_ref
        base = F.when(op["op"] == "M", here).otherwise(0)
        value = a["r"] + base if to_ref else a["q"] + sign * base
        hit = a["x"].isNull() & (here > 0) & (here <= there)
        return F.struct((a["r"] + on_ref).alias("r"), (a["q"] + sign * on_query).alias("q"), F.when(hit, value).otherwise(a["x"]).alias("x")).cast(kind)

    return F.aggregate(ops, start, step, lambda a: a["x"])


def lift_to_ref(ops: str | Column, ref_start: str, query_start: str, query_end: str, position: Column) -> Column:
    return _lifted(ops, ref_start, query_start, query_end, position, True)


def lift_to_query(ops: str | Column, ref_start: str, query_start: str, query_end: str, position: Column) -> Column:
    return _lifted(ops, ref_start, query_start, query_end, position, False)


def _lifted(ops: str | Column, ref_start: str, query_start: str, query_end: str, position: Column, to_ref: bool) -> Column:
    parsed = F.col(ops) if isinstance(ops, str) else ops
    return F.when(position.isNotNull(), lifted(parsed, F.col(ref_start), F.col(query_start), F.col(query_end), position, to_ref))

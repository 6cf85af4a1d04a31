"""Variants in the breaks between alignments of a contig: slices, breaks, types, output coordinates."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.cigar import lift_to_query, lift_to_ref, parse
from strandline.functions.sequence import reverse_complement
from strandline.operators.bandjoin import overlap_join
from strandline.session import durable


def _key(prefix: str = "") -> Column:
    """The order of a contig's alignments."""
    return F.struct(F.col(f"{prefix}ref_start").alias("s"), F.col(f"{prefix}ref_end").alias("e"), F.col(f"{prefix}align_no").alias("n"))


def next_starts(asked: DataFrame, alignments: DataFrame, bin_size: int) -> DataFrame:
    """Adds ``stop``, the first alignment's key on the same contig and chromosome beyond the key ``after``, null without one.

    It lies in the bin where ``after`` begins, or is the first of the next bin that has any: one row
    a bin is enough to know that.
    """
    on = ["query_entry", "chrom"]
    rows = alignments.select("query_entry", F.col("ref_entry").alias("chrom"), F.floor(F.col("ref_start") / bin_size).alias("_bin"), _key().alias("_k"))
    looked = asked.withColumn("_bin", F.floor(F.col("after.s") / bin_size))
    here = looked.select(*on, "_bin", "after").distinct().join(rows, [*on, "_bin"]).where("_k > after").groupBy(*on, "after").agg(F.min("_k").alias("_here"))
    firsts = rows.groupBy(*on, "_bin").agg(F.min("_k").alias("_k")).unionByName(looked.select(*on, "_bin").distinct(), allowMissingColumns=True)
    firsts = firsts.groupBy(*on, "_bin").agg(F.min("_k").alias("_k"))
    later = F.first("_k", ignorenulls=True).over(Window.partitionBy(*on).orderBy("_bin").rowsBetween(1, Window.unboundedFollowing))
    beyond = firsts.select(*on, "_bin", later.alias("_later"))
    return looked.join(here, [*on, "after"], "left").join(beyond, [*on, "_bin"], "left").withColumn("stop", F.coalesce("_here", "_later")).drop("_here", "_later", "_bin")


def region_slices(pairs: DataFrame, alignments: DataFrame, buffer: int, segment: int, bin_size: int = 1 << 16) -> DataFrame:
    """The alignments of each (region, contig) that reach across the region, as ``n`` = 1, 2, …

    They begin with the first on the region's chromosome that ends beyond the left segment and go to
    the one before the first that begins beyond the right one; that one is added if exactly two came
    before it, as it may show an inversion. Alignments to other chromosomes keep their place in the order.

    As a spanning alignment lies over the left segment (``pairs`` are spanned), the first one lies over
    the base before it too, so it is found by that base. The others are a range of the contig's order,
    fetched by its bins; only the slices themselves are numbered.
    """
    keyed = pairs.select("region_id", "chrom", "start", "end", "query_entry")
    left = keyed.withColumns({"_p": F.col("start") - buffer, "_q": F.col("start") - buffer})
    here = alignments.select("query_entry", F.col("ref_entry").alias("chrom"), "ref_start", "ref_end", "align_no")
    over = overlap_join(left, here, ["query_entry", "chrom"], ("_p", "_q"), ("ref_start", "ref_end"), bin_size, F.col("ref_end") > F.col("start") - buffer + segment - 1)
    entered = over.groupBy("region_id", "chrom", "start", "end", "query_entry").agg(F.min(_key()).alias("enter"))
    beyond = F.struct((F.col("end") + buffer - segment + 1).cast("bigint").alias("s"), F.lit(2**62).cast("bigint").alias("e"), F.lit(2**62).cast("bigint").alias("n"))
    ranges = durable(next_starts(entered.withColumn("after", F.greatest(beyond, F.col("enter"))), alignments, bin_size).drop("after"), "ranges")
    last = alignments.groupBy("query_entry").agg(F.max("ref_start").alias("_last"))
    asked = ranges.join(last, "query_entry").withColumns({"_from": F.col("enter.s"), "_to": F.coalesce("stop.s", "_last")}).drop("_last")
    points = alignments.withColumns({"_a": F.col("ref_start"), "_b": F.col("ref_start")})
    inside = (_key() >= F.col("enter")) & (F.col("stop").isNull() | (_key() <= F.col("stop")))
    rows = overlap_join(asked, points, ["query_entry"], ("_from", "_to"), ("_a", "_b"), bin_size, inside).drop("_from", "_to", "_a", "_b")
    each = Window.partitionBy("region_id", "query_entry").orderBy(_key())
    rows = rows.withColumn("n", F.row_number().over(each))
    kept = F.col("stop").isNull() | (_key() < F.col("stop")) | (F.col("n") == 3)
    return rows.where(kept).drop("enter", "stop")


FEW = 1 << 20  # contigs whose hashes are broadcast


def _segments(buffer: int, segment: int) -> tuple[Column, Column, Column, Column]:
    """First and last base of the segments left and right of a region."""
    first, last = F.col("start") - buffer, F.col("end") + buffer
    return first, first + segment - 1, last - segment + 1, last


def _level(buffer: int, segment: int, bin_size: int) -> Column:
    """The region with its buffers fits into ``bin_size << level`` bases."""
    a, b, c, d = _segments(buffer, segment)
    times = F.call_function("div", F.greatest(F.greatest(b, d) - F.least(a, c) - 1, F.lit(0)), F.lit(bin_size))
    return F.when(times == 0, 0).otherwise(F.length(F.bin(times)))


def _bin_width(bin_size: int) -> Column:
    return F.expr(f"shiftleft({bin_size}L, _level)")


def region_levels(regions: DataFrame, buffer: int, segment: int, bin_size: int) -> DataFrame:
    """``chrom, levels``: the levels of each chromosome's regions."""
    return regions.groupBy("chrom").agg(F.collect_set(_level(buffer, segment, bin_size)).alias("levels"))


def placed(alignments: DataFrame, levels: DataFrame) -> DataFrame:
    """The alignments to chromosomes of ``levels``, numbered in the order of their contig (``rn``) and within its chromosome (``n``).

    With the contig's next alignment on the chromosome as ``next_rn``, the strands of the next two as
    ``comp_1, comp_2``, and ``reach``: its end, or the last base before which no other of them begins
    and which one so far still covers. Alignments to other chromosomes only count for ``rn``.
    """
    on = F.col("chrom").isNotNull()
    rows = alignments.where("query_entry is not null").join(F.broadcast(levels.select("chrom")), F.col("ref_entry") == F.col("chrom"), "left")
    contigs = durable(rows.where(on).select(F.xxhash64("query_entry").alias("_id")).distinct(), "contigs")
    rows = rows.select("query_entry", "chrom", "ref_start", "ref_end", "align_no", *(F.when(on, F.col(c)).alias(c) for c in ("query_start", "query_end", "comp", "cigar")))
    if contigs.count() <= FEW:  # contigs without any of these chromosomes need no shuffle; equal hashes only let some through
        rows = rows.join(F.broadcast(contigs), F.xxhash64("query_entry") == F.col("_id"), "left_semi")
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("query_entry").orderBy("ref_start", "ref_end", "align_no"))).where(on)
    mine = Window.partitionBy("query_entry", "chrom").orderBy("rn")
    nxt = lambda c, k=1: F.lead(c, k).over(mine)
    rows = rows.withColumns({"n": F.row_number().over(mine), "next_rn": nxt("rn"), "comp_1": nxt("comp"), "comp_2": nxt("comp", 2), "_next": nxt("ref_start"), "_top": F.max("ref_end").over(mine.rowsBetween(Window.unboundedPreceding, 0))})
    return rows.withColumn("reach", F.greatest("ref_end", F.least(F.col("_next") - 1, "_top"))).drop("_next", "_top")


def region_pairs(regions: DataFrame, rows: DataFrame, levels: DataFrame, buffer: int, segment: int, bin_size: int = 1 << 16) -> DataFrame:
    """``region_id, chrom, start, end, query_entry, first, n_ref, status, spans`` of each region and contig that spans it, from the alignments of :func:`placed`.

    The slice is that of :func:`region_slices`; of it, the alignments to the region's chromosome have
    the numbers ``first`` to ``first + n_ref - 1``, and ``spans`` those over the whole buffered region.
    ``status`` is NOVARFOUND, SIMPLE, INVERSION, MULTIALIGNS or OTHER.

    A region is looked up in one bin, where each contig is one row with its alignments over that bin
    and the next, so nothing of a pair is shuffled. The slice ends before the one after the last that
    begins up to the right segment; that last one lies in the bin by its ``reach``, as a pair has an
    alignment over the segment.
    """
    left, left_end, right, right_end = _segments(buffer, segment)
    spread = rows.join(F.broadcast(levels), "chrom").withColumn("_level", F.explode("levels")).withColumn("_width", _bin_width(bin_size)).where("reach >= ref_start")
    spread = spread.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("ref_start") / F.col("_width")) - 1, F.floor(F.col("reach") / F.col("_width")))))
    one = F.struct("rn", F.col("ref_start").alias("s"), F.col("ref_end").alias("e"), "n", "next_rn", "comp", "comp_1", "comp_2")
    pieces = spread.groupBy("chrom", "_level", "_bin", "query_entry").agg(F.array_sort(F.collect_list(one)).alias("_rows"), F.min("ref_start").alias("_low"), F.max("ref_end").alias("_high"))
    marks = regions.select("region_id", "chrom", "start", "end").distinct().withColumn("_level", _level(buffer, segment, bin_size))
    marks = marks.withColumn("_bin", F.floor(F.least(left, right) / _bin_width(bin_size)))
    near = (F.col("_low") < F.least(left, right)) & (F.col("_high") > F.greatest(left_end, right_end))
    over = lambda a, b: F.transform(F.filter("_rows", lambda x: (x["s"] < a) & (x["e"] > b)), lambda x: x["comp"])
    pairs = marks.join(pieces, ["chrom", "_level", "_bin"]).where(near).where(F.arrays_overlap(over(left, left_end), over(right, right_end)))
    pairs = pairs.withColumn("_enter", F.filter("_rows", lambda x: x["e"] > left_end)[0])
    pairs = pairs.withColumn("_last", F.element_at(F.filter("_rows", lambda x: (x["s"] <= right) | (x["rn"] <= F.col("_enter.rn"))), -1))
    third = F.coalesce(F.col("_last.next_rn") - F.col("_enter.rn") == 2, F.lit(False)).cast("bigint")
    pairs = pairs.withColumn("n_ref", F.col("_last.n") - F.col("_enter.n") + 1 + third)
    kept = lambda x: (x["s"] < left) & (x["e"] > right_end) & (x["n"] >= F.col("_enter.n")) & (x["n"] < F.col("_enter.n") + F.col("n_ref"))
    pairs = pairs.withColumn("spans", F.transform(F.filter("_rows", kept), lambda x: x["n"]))
    same, turned = F.col("_enter.comp") == F.col("_enter.comp_1"), F.col("_enter.comp_1") != F.col("_enter.comp_2")
    status = (
        F.when(F.size("spans") == F.col("n_ref"), "NOVARFOUND").when(F.col("n_ref") > 3, "MULTIALIGNS")
        .when(same & ((F.col("n_ref") == 2) | ((F.col("n_ref") == 3) & ~turned)), "SIMPLE").when((F.col("n_ref") == 3) & ~same & turned, "INVERSION").otherwise("OTHER")
    )
    return pairs.select("region_id", "chrom", "start", "end", "query_entry", F.col("_enter.n").alias("first"), "n_ref", status.alias("status"), "spans")


def consecutive_breaks(alignments: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each alignment with the next of its group as ``ref1, ref2, query1, query2`` and both alignments' CIGARs.

    Valid if the reference ends rise and the query goes on along the strand.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    nxt = lambda c: F.lead(c).over(w)
    rows = alignments.withColumns({f"r_{c}": nxt(c) for c in ("ref_start", "ref_end", "query_start", "query_end", "comp", "cigar") if c in alignments.columns})
    forward = (F.col("comp") == 0) & (F.col("query_start") < F.col("r_query_start")) & (F.col("query_end") < F.col("r_query_end"))
    backward = (F.col("comp") == 1) & (F.col("query_start") > F.col("r_query_start")) & (F.col("query_end") > F.col("r_query_end"))
    valid = F.col("r_ref_start").isNotNull() & (F.col("comp") == F.col("r_comp")) & (F.col("ref_end") < F.col("r_ref_end")) & (forward | backward)
    return rows.where(valid).withColumns({"ref1": F.col("ref_end"), "ref2": F.col("r_ref_start"), "query1": F.col("query_end"), "query2": F.col("r_query_start")})


def classified(breaks: DataFrame) -> DataFrame:
    """Adds ``ref_gap, query_gap, svsize, svkind, repeat_bases`` to breaks (``ref1, ref2, query1, query2, comp``)."""
    ref_gap = F.col("ref2") - F.col("ref1") - 1
    query_gap = F.when(F.col("comp") == 1, F.col("query1") - F.col("query2") - 1).otherwise(F.col("query2") - F.col("query1") - 1)
    size = F.col("ref_gap") - F.col("query_gap")
    kind = (
        F.when(size == 0, "ARTIFACT")
        .when((size < 0) & (F.col("ref_gap") > 0), "SUBSINS")
        .when((size > 0) & (F.col("query_gap") > 0), "SUBSDEL")
        .when((F.col("ref_gap") < 0) & (F.col("query_gap") < 0), F.when(size < 0, "DUP").otherwise("CONTRAC"))
        .otherwise(F.when(size < 0, "SIMPLEINS").otherwise("SIMPLEDEL"))
    )
    repeat = F.when(F.col("svkind").isin("SIMPLEINS", "DUP"), -F.col("ref_gap")).when(F.col("svkind").isin("SIMPLEDEL", "CONTRAC"), -F.col("query_gap")).otherwise(0)
    return breaks.withColumns({"ref_gap": ref_gap, "query_gap": query_gap}).withColumns({"svsize": F.abs(size), "svkind": kind}).withColumn("repeat_bases", repeat)


def break_status(max_size: int = 0) -> Column:
    """``ok``, or why a classified break is no variant."""
    big = F.lit(max_size > 0) & (F.col("svsize") > max_size)
    return F.when((F.col("svsize") == 0) | (F.col("repeat_bases") > 10 * F.col("svsize")), "ARTIFACT").when(big, "MAXSIZE").otherwise("ok")


def widened(breaks: DataFrame, left_default: int = 1) -> DataFrame:
    """Adds ``query1p, query2p`` (insertions) and ``ref1p, ref2p`` (deletions): the break's ends lifted through the other alignment, or the neighbouring base where it doesn't reach."""
    ins, dele = F.col("svkind").isin("SIMPLEINS", "DUP"), F.col("svkind").isin("SIMPLEDEL", "CONTRAC")
    left, right = ("_left_ops", "ref_start", "query_start", "query_end"), ("_right_ops", "r_ref_start", "r_query_start", "r_query_end")
    at = lambda when, c: F.when(when, F.col(c))
    parsed = breaks.withColumns({"_left_ops": parse(F.col("cigar")), "_right_ops": parse(F.col("r_cigar"))})
    return parsed.withColumns(
        {
            "query1p": F.when(ins, F.coalesce(lift_to_query(*right, at(ins, "ref1")), F.col("query2") - 1)),
            "query2p": F.when(ins, F.coalesce(lift_to_query(*left, at(ins, "ref2")), F.col("query1") - 1)),
            "ref1p": F.when(dele, F.coalesce(lift_to_ref(*right, at(dele, "query1")), F.col("ref2") - 1)),
            "ref2p": F.when(dele, F.coalesce(lift_to_ref(*left, at(dele, "query2")), F.col("ref1") + left_default)),
        }
    ).drop("_left_ops", "_right_ops")


def output_coordinates(breaks: DataFrame) -> DataFrame:
    """Adds ``pos, sv_end, altpos, altend, svlen, wide_from, wide_to, altwide_from, altwide_to`` and ``svtype``; deletions whose position lies beyond their end get the status ``POSITION``.

    Deletions keep a positive SVLEN, as their positions are written.
    """
    ins, dele = F.col("svkind").isin("SIMPLEINS", "DUP"), F.col("svkind").isin("SIMPLEDEL", "CONTRAC")
    back = F.when(F.col("comp") == 1, 1).otherwise(-1)  # towards the base before, on the query's strand
    no_repeat = dele & (F.col("repeat_bases") == 0)
    pos = F.when(ins, F.col("ref2") - 1).when(dele, F.col("ref2p") - 1).otherwise(F.col("ref1") + 1)
    altpos = F.when(ins, F.col("query2p") + back).when(dele, F.col("query2") + back).otherwise(F.col("query1") - back)
    rows = breaks.withColumns({"pos": pos, "sv_end": F.col("ref2") - 1, "altpos": altpos, "altend": F.when(dele, altpos).otherwise(F.col("query2") + back)})
    rows = rows.withColumns(
        {
            "svtype": F.when(F.col("svkind").isin("SIMPLEINS", "DUP", "SUBSINS"), "INS").otherwise("DEL"),
            "svlen": F.when(dele, F.col("sv_end") - F.col("pos")).otherwise(F.col("altend") - F.col("altpos") - (F.col("sv_end") - F.col("pos"))),
            "wide_from": F.when(ins, F.col("ref2")).when(dele, F.col("ref2p") + no_repeat.cast("int")).otherwise(F.col("ref1")),
            "wide_to": F.when(ins, F.col("ref1")).when(dele, F.col("ref1p")).otherwise(F.col("ref2")),
            "altwide_from": F.when(ins, F.col("query2p")).when(dele, F.col("query2") + F.when(no_repeat, back).otherwise(0)).otherwise(F.col("query1")),
            "altwide_to": F.when(ins, F.col("query1p")).when(dele, F.col("query1")).otherwise(F.col("query2")),
        }
    )
    if "status" not in rows.columns:
        rows = rows.withColumn("status", F.lit("ok"))
    return rows.withColumn("status", F.when((F.col("status") == "ok") & dele & (F.col("pos") > F.col("sv_end")), "POSITION").otherwise(F.col("status")))


def inversions(alignments: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Three alignments in a row whose strand changes twice, with the output coordinates; ``status`` is ASYMMETRIC or REPEAT where the symmetry fails."""
    w = Window.partitionBy(*keys).orderBy(*order)
    nxt = lambda c, k: F.lead(c, k).over(w)
    rows = alignments.withColumns({f"{c}_{k}": nxt(c, k) for k in (1, 2) for c in ("ref_start", "ref_end", "query_start", "query_end", "comp")})
    rows = rows.where((F.col("comp") != F.col("comp_1")) & (F.col("comp_1") != F.col("comp_2")))
    span = F.abs(F.col("sv_end") - F.col("pos")) + F.abs(F.col("altend") - F.col("altpos"))
    rows = rows.withColumns({"pos": F.col("ref_end"), "sv_end": F.col("ref_start_2") - 1, "altpos": F.col("query_end"), "altend": F.col("query_start_2") - 1})
    rows = rows.withColumns({"svlen": F.abs(F.col("sv_end") - F.col("pos")) - F.abs(F.col("altend") - F.col("altpos")), "repeat_bases": F.col("ref_end") - F.col("ref_start_1")})
    status = F.when(F.try_divide(2 * F.abs("svlen"), span) >= 0.1, "ASYMMETRIC").when(F.try_divide(2 * F.abs("repeat_bases"), span) >= 5.0, "REPEAT").otherwise("ok")
    return rows.withColumns({"status": F.coalesce(status, F.lit("ok")), "wide_from": F.col("ref_start_1"), "wide_to": F.col("ref_end_1"), "altwide_from": F.col("query_start_1"), "altwide_to": F.col("query_end_1"), "svtype": F.lit("INV"), "svkind": F.lit("INV")})


MAX_REACH = 1 << 20  # bases of the longest window of one step
_EXTENSION = T.StructType([T.StructField("left", T.LongType()), T.StructField("right", T.LongType())])


def common_bases(ref: str, query: str) -> int:
    """Bases that both begin with, in any case, up to the first N of the reference."""
    ref, query = ref.upper(), query.upper()
    stop = ref.find("N")
    return len(os.path.commonprefix([ref if stop < 0 else ref[:stop], query]))


@F.pandas_udf(_EXTENSION)
def _extension(ref_before: pd.Series, query_before: pd.Series, ref_after: pd.Series, query_after: pd.Series) -> pd.DataFrame:
    text = lambda x: x or ""
    right = [common_bases(text(a), text(b)) for a, b in zip(ref_after, query_after)]
    left = [common_bases(text(a)[::-1], text(b)[::-1]) for a, b in zip(ref_before, query_before)]
    return pd.DataFrame({"left": left, "right": right})


def extended(alignments: DataFrame, ref_slices, query_slices, reach: int = 2_000) -> DataFrame:
    """Alignments carried on over exactly matching bases, to the right and to the left, up to a mismatch, an N of the reference or the end of a sequence; the outer M runs of the CIGAR grow.

    ``reach`` bases are looked at on either side; those that match to the end of that window are
    looked at again, with windows twice as long each time (up to MAX_REACH), until none does.
    """
    rows = durable(_extended_once(alignments, ref_slices, query_slices, reach), "extended")
    done = rows.where("not _more")
    while not rows.where("_more").isEmpty():
        reach = max(reach, min(2 * reach, MAX_REACH))
        rows = durable(_extended_once(rows.where("_more").drop("_more"), ref_slices, query_slices, reach), "extended")
        done = done.unionByName(rows.where("not _more"))
    return done.drop("_more")


def _extended_once(alignments: DataFrame, ref_slices, query_slices, reach: int) -> DataFrame:
    """Adds ``_more``: whether an end went on to the end of its window of ``reach`` bases."""
    comp = F.col("comp") == 1
    right_room = F.least(F.lit(reach), F.when(comp, F.col("query_end") - 1).otherwise(F.lit(reach)))
    left_room = F.least(F.lit(reach), F.col("ref_start") - 1, F.when(comp, F.lit(reach)).otherwise(F.col("query_start") - 1))
    rows = alignments.withColumns({"_rr": F.greatest(right_room, F.lit(0)), "_lr": F.greatest(left_room, F.lit(0))})
    some = lambda room, x: F.when(F.col(room) > 0, x)
    # Of a reversed alignment the query is read towards its begin, as its reverse complement.
    rows = ref_slices(rows, "ref_entry", some("_rr", F.col("ref_end") + 1), some("_rr", F.col("ref_end") + F.col("_rr")), "_ra")
    rows = ref_slices(rows, "ref_entry", some("_lr", F.col("ref_start") - F.col("_lr")), some("_lr", F.col("ref_start") - 1), "_rb")
    rows = query_slices(rows, "query_entry", some("_rr", F.when(comp, F.col("query_end") - F.col("_rr")).otherwise(F.col("query_end") + 1)), some("_rr", F.when(comp, F.col("query_end") - 1).otherwise(F.col("query_end") + F.col("_rr"))), "_qa")
    rows = query_slices(rows, "query_entry", some("_lr", F.when(comp, F.col("query_start") + 1).otherwise(F.col("query_start") - F.col("_lr"))), some("_lr", F.when(comp, F.col("query_start") + F.col("_lr")).otherwise(F.col("query_start") - 1)), "_qb")
    turned = lambda c: F.when(comp, reverse_complement(F.upper(c))).otherwise(F.col(c))
    rows = rows.withColumn("_x", _extension("_rb", turned("_qb"), "_ra", turned("_qa")))
    sign = F.when(comp, -1).otherwise(1)
    grow = lambda pattern, n, cigar: F.when(cigar.rlike(pattern), F.regexp_replace(cigar, pattern, F.concat((F.regexp_extract(cigar, pattern, 1).cast("bigint") + n).cast("string"), F.lit("M")))).otherwise(cigar)
    cigar = grow(r"^(\d+)M", F.col("_x.left"), grow(r"(\d+)M\z", F.col("_x.right"), F.col("cigar")))
    out = rows.withColumns(
        {
            "ref_start": F.col("ref_start") - F.col("_x.left"), "ref_end": F.col("ref_end") + F.col("_x.right"),
            "query_start": F.col("query_start") - sign * F.col("_x.left"), "query_end": F.col("query_end") + sign * F.col("_x.right"), "cigar": cigar,
            "_more": (F.col("_x.left") == reach) | (F.col("_x.right") == reach),
        }
    )
    return out.select(*alignments.columns, "_more")

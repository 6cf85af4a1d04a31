import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.functions import align as A
from strandline.functions import cigar as C
from strandline.functions import dates as T
from strandline.functions import info as I
from strandline.functions import sequence as S

bases = st.text("ACGT", max_size=18)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(bases, bases)
def test_alignment_is_optimal_and_complete(a, b):
    found = A.align(a, b)
    assert found["edit_distance"] == edits(a, b) == found["subs"] + found["indels"]
    ops = [(int(n), o) for n, o in re.findall(r"(\d+)([MID])", found["cigar"])]
    assert sum(n for n, o in ops if o != "D") == len(a) and sum(n for n, o in ops if o != "I") == len(b)
    assert A.align(b, a)["edit_distance"] == found["edit_distance"]


@settings(max_examples=200, deadline=None)
@given(bases, bases, st.integers(1, 9))
def test_path_is_the_same_for_any_number_of_kept_columns(a, b, block):
    assert A._path(a, b, block) == A._path(a, b)


def test_long_pairs_are_aligned_like_short_ones():
    rng = random.Random(3)
    a = "".join(rng.choice("ACGT") for _ in range(12_000))
    b = a[:5_000] + "".join(c for c in a[5_000:7_000] if rng.random() > 0.1) + "T" + a[7_000:]
    whole = A.align(a, b)
    assert whole["edit_distance"] == whole["subs"] + whole["indels"] < 300
    assert A.align(a[4_900:7_100], b[4_900 : 4_900 + len(b) - 9_800])["edit_distance"] == whole["edit_distance"]


def test_shift_is_the_first_farthest_diagonal():
    assert A.align("AACCGG", "AACCGG")["max_shift"] == 0
    assert A.align("AATTTCCGG", "AACCGG")["max_shift"] == 3
    assert A.align("AACCGG", "AATTTCCGG")["max_shift"] == -3


@pytest.mark.parametrize("offsets, ends, want", [([], (1, 9, 1, 9), "9M"), ([4, -3], (1, 10, 1, 10), "3M1D2M1I4M"), ([2, 1, 1], (1, 8, 1, 5), "1M3D4M"), ([-1, -1], (5, 6, 9, 6), "2I2M"), ([4], (1, 9, 1, 9), None)])
def test_delta_offsets(offsets, ends, want):
    assert C.from_delta(offsets, *ends) == want


def test_lifting_round_trips_in_blocks_and_stops_in_gaps():
    for start, end in ((101, 112), (112, 101)):
        sign = 1 if end > start else -1
        args = ("4M3D5M3I", 11, start, end)
        for ref in range(11, 23):
            there = C.lift(*args, ref, False)
            if ref <= 14 or 18 <= ref <= 22:
                assert C.lift(*args, there, True) == ref
            else:
                assert there == start + 3 * sign
        assert C.lift(*args, start + 10 * sign, True) == 22
        assert C.lift(*args, 99_999, True) is None and C.lift(*args, 10, False) is None


def test_lifting_columns_agree_with_lifting(spark):
    rows = [(c, 11, a, b, p) for c in ("4M3D5M3I2M", "3I4M2D1M", "6M", "*", None) for a, b in ((101, 114), (114, 101)) for p in (9, 10, *range(11, 28), *range(99, 117), None)]
    df = spark.createDataFrame(rows, "cigar string, r int, a int, b int, p int").withColumn("ops", C.parse(F.col("cigar")))
    got = df.select("*", C.lift_to_query("ops", "r", "a", "b", F.col("p")).alias("q"), C.lift_to_ref("ops", "r", "a", "b", F.col("p")).alias("t")).collect()
    assert sum(x.q is not None for x in got) > 40 and sum(x.t is not None for x in got) > 40
    for x in got:
        want = [None if x.p is None or x.cigar in (None, "*") else C.lift(x.cigar, x.r, x.a, x.b, x.p, to_ref) for to_ref in (False, True)]
        assert [x.q, x.t] == want


def test_cigar_columns(spark):
    rows = [("5S10M2I3D4M6H", 100, False), ("5S10M2I3D4M6H", 100, True), ("*", 1, False), (None, 1, False)]
    df = spark.createDataFrame(rows, "cigar string, pos int, rev boolean").withColumn("o", C.parse(F.col("cigar")))
    out = df.select(C.endpoints(F.col("pos"), F.col("o"), F.col("rev")).alias("e"), C.longest(F.col("o"), "M").alias("m"), C.total(F.col("o"), "MID").alias("t")).collect()
    assert tuple(out[0].e) == (100, 116, 6, 21) and tuple(out[1].e) == (100, 116, 22, 7) and out[0].m == 10 and out[0].t == 19
    assert out[2].t is None


@settings(max_examples=200, deadline=None)
@given(st.text("ACGTMRWSYKVHDBN", max_size=20))
def test_complement_twice_is_the_same(seq):
    assert S.reverse_complement_text(S.reverse_complement_text(seq)) == seq


@settings(max_examples=300, deadline=None)
@given(st.text("AC", min_size=1, max_size=12))
def test_repeat_aliases_spell_the_allele(allele):
    for alias in (S.repeat_alias(allele), S.even_repeat_alias(allele)):
        assert re.sub(r"(\d+)\((\w+)\)", lambda m: m[2] * int(m[1]), alias) == allele


def test_repeat_alias_cases():
    assert S.repeat_alias("ACACACA") == "3(AC)A" and S.repeat_alias("AAAA") == "4(A)" and S.repeat_alias("ACG") == "ACG" and S.repeat_alias("*") == "*" and S.repeat_alias("") == ""


def test_indels_shift_over_repeats():
    assert S.shift_indel("GGACAC", "*", "AC", "ACACTT") == ("ACACACAC", "ACACACACAC", 4, 4)
    assert S.shift_indel("GGG", "A", "", "TTT") == ("A", "", 0, 0)
    assert S.shift_indel("GG", "A", "C", "AA") == ("A", "C", 0, 0)


def test_sequence_columns(spark):
    df = spark.createDataFrame([("ACGTNry", "CA"), ("AX", ""), (None, None)], "s string, b string")
    got = df.select(S.reverse_complement(F.col("s")).alias("r"), S.iupac_code(F.col("b")).alias("c"), S.iupac_bases(F.lit("b")).alias("d")).collect()
    assert [tuple(r) for r in got] == [("ryNACGT", "M", "CGT"), (None, "N", "CGT"), (None, "N", "CGT")]


def test_info_fields(spark):
    df = spark.createDataFrame([("CIEND=3; END=9;SVLEN=-12;X;SVTYPE=DEL;A=b=c", "GT:DV", "0/1:7", "AAAA", "A"), ("CIEND=3", "GT", "0/1:7", "AAAA", "<DEL>"), (None, None, None, None, None)], "i string, f string, s string, r string, a string")
    got = df.select(I.end_tag(F.col("i")).alias("e"), I.end_tag(F.col("i"), False).alias("l"), I.variant_size(F.col("i"), F.col("r"), F.col("a")).alias("z"), I.format_value(F.col("f"), F.col("s"), "DV").alias("d"), I.info_value(F.col("i"), "SVTYPE").alias("t")).collect()
    assert [tuple(r) for r in got] == [(9, 3, 12, "7", "DEL"), (None, 3, 0, None, None), (None, None, 0, None, None)]


def test_dates(spark):
    cases = [("970203", "1997-02-03"), ("790203", "2079-02-03"), ("3-JAN-81", "1981-01-03"), ("3-jan-80", "2080-01-03"), ("1/2/51", "1951-01-02"), ("1/2/50", "2050-01-02"), ("03/Feb/1999", "1999-02-03"), ("Jan 3 2001 10:22", "2001-01-03"), ("January 3, 2001", "2001-01-03"), ("2024-02-30", None), ("86400000", "1972-09-27"), ("nonsense", None), (None, None)]
    got = spark.createDataFrame([(a,) for a, _ in cases], "t string").select(T.parse_date(F.col("t")).cast("string").alias("d")).collect()
    assert [r.d for r in got] == [b for _, b in cases]
    one = spark.createDataFrame([("1997-01-07",)], "t string").select(F.to_date("t").alias("d")).select(T.day_number(F.col("d")), T.week_number(F.col("d")), T.month_ordinal(F.col("d")), T.month_label(F.lit(13)), T.noon_epoch(F.col("d")), T.parse_mmddyy(F.lit("020397")).cast("string")).first()
    assert tuple(one) == (1, 0, 1, "1/98", 852_638_400, "1997-02-03")

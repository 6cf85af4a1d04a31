import random
import re

import pytest

from strandline.operators import compare, coverage, packed, quarantine


# ------------------------------------------------------------ periods and gaps


def brute_periods(rows):
    out, groups = [], {}
    for g, s, e in rows:
        groups.setdefault(g, []).append((s, e))
    for g, spans in groups.items():
        merged = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(g, "period", a, b) for a, b in merged]
        out += [(g, "gap", a[1] + 1, b[0] - 1) for a, b in zip(merged, merged[1:])]
    return sorted(out)


@pytest.mark.parametrize("bits", [4, 20])
def test_periods_equal_brute_force_across_tiles(spark, bits):
    rng = random.Random(bits)
    rows = []
    for _ in range(600):
        g, s = rng.choice(["a", "a", "a", "b", "c"]), rng.randint(1, 3000)
        rows.append((g, s, s + rng.choice([0, 0, 1, 3, 10, 200 if rng.random() < 0.05 else 2])))
    rows += rows[:30] + [("far", 1, 2**45), ("far", 2**45 + 1, 2**45 + 5), ("far", 2**45 + 9, 2**46), ("one", 5, 5)]
    df = spark.createDataFrame(rows, "g string, s bigint, e bigint").repartition(5)
    got = sorted(tuple(r) for r in coverage.periods_and_gaps(df, bits).collect())
    assert got == brute_periods(rows)


def test_coverage_of_dirty_rows(spark):
    calls = [("v", "chr1", 5, 9, "x"), ("v", "1", 10, 12, "x"), ("v", "1", 20, 20, "x"), ("v", None, 1, 2, "x"), ("v", "1", None, 2, "x"), ("v", "1", 3, None, "x"), ("v", "1", 0, 30, "x"), ("v", "1", 30, 25, "x"), (None, "1", 1, 2, "x")]
    regions = [("s", "X", 1, 2), ("s", "X", 2, 3)]
    a = spark.createDataFrame(calls, "callset string, chrom string, pos bigint, end_pos bigint, g string")
    b = spark.createDataFrame(regions, "sample_name string, chrom string, hr_start bigint, hr_end bigint")
    got = sorted((tuple(r) for r in coverage.coverage(a, b).collect()), key=str)
    want = [("svcalls", "v", "1", "period", 5, 12), ("svcalls", "v", "1", "gap", 13, 19), ("svcalls", "v", "1", "period", 20, 20), ("svcalls", None, "1", "period", 1, 2), ("hr_regions", "s", "X", "period", 1, 3)]
    assert got == sorted(want, key=str)
    assert coverage.coverage(a.limit(0), b.limit(0)).count() == 0


# ------------------------------------------------------------ packed fields


def brute_items(field, pattern):
    out, i, run = [], 0, ""
    while i < len(field):
        if field[i] in "\"'":
            out += re.findall(pattern, run)
            run, q, text = "", field[i], ""
            i += 1
            while i < len(field):
                if field[i] == q:
                    if field[i + 1 : i + 2] != q:
                        break
                    i += 1
                text += field[i]
                i += 1
            if text:
                out.append(text)
        else:
            run += field[i]
        i += 1
    return out + re.findall(pattern, run)


def test_packed_fields_equal_brute_force(spark):
    rng = random.Random(2)
    bits = ["ACG", "tt", "<DEL>", "<INS:ME>", "*", "A]6:848[", "[5:35[C", ",", ";", " | ", "/", '"', "'", '""', "<DEL, left>", "."]
    fields = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(500)] + ["", None, "A", '"A,""B"', "'x;y',C", '""', "A," * 3000, "'q' " * 400]
    rows = [(i, f, None, 1) for i, f in enumerate(fields)]
    df = spark.createDataFrame(rows, "row_id bigint, alt_allele string, info string, idx bigint")
    got = sorted((r.row_id, r.packed_field, r.idx, r.item) for r in packed.split_packed(df).collect())
    want = []
    for i, f in enumerate(fields):
        items = brute_items(f or "", packed.ALT_ITEMS)
        if len(items) > 1:
            want += [(i, "ALT", k, x) for k, x in enumerate(items, 1)]
    assert got == sorted(want)


def test_id_lists_in_info(spark):
    rows = [
        (1, "A", "SVTYPE=INS;ClusterIDs=a.1:b-2::c_3;END=4"),
        (2, "A", "NOTE=\"x; ClusterIDs=n1:n2\"; ExactMatchIDs = no;PREV_ClusterIDs=x:y"),
        (3, "A,C", " ExactMatchIDs='p;q' \"r \"\"s\"\"\"|t ;ClusterIDs=one"),
        (4, "A", "ClusterIDs=a:b;ClusterIDs=c:d"),
        (5, None, None), (6, "", "."),
    ]
    got = sorted(tuple(r) for r in packed.split_packed(spark.createDataFrame(rows, "row_id bigint, alt_allele string, info string")).collect())
    want = [(1, "ClusterIDs", i, x) for i, x in enumerate(["a.1", "b-2", "c_3"], 1)] + [(3, "ALT", 1, "A"), (3, "ALT", 2, "C")]
    want += [(3, "ExactMatchIDs", i, x) for i, x in enumerate(["p;q", 'r "s"', "t"], 1)] + [(4, "ClusterIDs", 1, "a"), (4, "ClusterIDs", 2, "b")]
    assert got == sorted(want)
    assert packed.split_packed(spark.createDataFrame([], "row_id bigint, alt_allele string, info string")).count() == 0


# ------------------------------------------------------------ differences


def test_differences_equal_a_full_comparison(spark):
    rng = random.Random(7)
    a = {f"k{i:05}": (rng.randint(1, 99), rng.choice(["INS", "DEL", None]), rng.choice([None, -5, 7])) for i in range(3000)}
    b = dict(a)
    for k in rng.sample(sorted(b), 60):
        del b[k]
    for k in rng.sample(sorted(b), 60):
        i = rng.randrange(3)
        b[k] = (*b[k][:i], rng.choice([None, [12345, "BND", 99][i]]), *b[k][i + 1 :])
    b |= {f"n{i}": (1, "INS", 1) for i in range(40)}
    schema = "call_id string, pos bigint, svtype string, svlen bigint"
    frames = [spark.createDataFrame([(k, *v) for k, v in x.items()], schema) for x in (a, b)]
    got = sorted(tuple(r) for r in compare.differences(*frames, "call_id", ["pos", "svtype", "svlen"], 60_000).collect())
    want = [(k, "only_a", "none") for k in a.keys() - b.keys()] + [(k, "only_b", "none") for k in b.keys() - a.keys()]
    want += [(k, "differs", n) for k in a.keys() & b.keys() for n, x, y in zip(("POS", "SVTYPE", "SVLEN"), a[k], b[k]) if x != y]
    assert got == sorted(want) and len(got) > 100
    # Most chunks are equal and drop out before any row is compared.
    left, right = (compare.fingerprints(compare.chunked(f, "call_id", ["pos", "svtype", "svlen"], 3)) for f in frames)
    assert left.join(right, ["range", "n", "f1", "f2"], "left_anti").count() < left.count()


def test_spellings_versions_and_missing_values(spark):
    import datetime as dt

    t = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    a = [("x", 1066480, " ins", 598, t[1], 0), ("x", 5, "DEL", 5, t[0], 0), ("y", 7, None, None, t[0], 0), ("y", 7, None, None, t[0], 0), ("z", 1, "INS", 1, None, 0), (None, 1, "INS", 1, t[0], 0), ("w", 1, "INS", -25, t[0], 0)]
    b = [("x", " 1,066,480", "INS ", "+598.0", t[0]), ("y", "0007", ".", "NA", t[0]), ("z", "1", "INS", "2", t[2]), ("z", "1", "INS", "1", None), ("w", "1", "", "-0025", t[0]), ("q", "junk", None, None, t[0])]
    left = spark.createDataFrame(a, "call_id string, pos bigint, svtype string, svlen bigint, updated_at timestamp, chunk int")
    right = spark.createDataFrame(b, "call_id string, pos string, svtype string, svlen string, updated_at timestamp")
    got = sorted(tuple(r) for r in compare.call_differences(left, right).collect())
    assert got == [("q", "only_b", "none"), ("w", "differs", "SVTYPE"), ("z", "differs", "SVLEN")]
    assert compare.call_differences(left.limit(0), right.limit(0)).count() == 0
    assert {r.kind for r in compare.call_differences(left, right.limit(0)).collect()} == {"only_a"}


# ------------------------------------------------------------ lines that don't load

GOOD = "1\t10\tid\tA\tC\t.\tPASS\tSVTYPE=INS;END=10;SVLEN=-4\tGT\t0/1"


def line(pos="10", info="END=10", extra=""):
    return f"1\t{pos}\tid\tA\tC\t.\tPASS\t{info}\tGT\t0/1{extra}"


LINES = [
    (GOOD, None), (GOOD + "\r", None), (GOOD + "\r\r", None), ("", ""), ("  \t", ""), ("#x", ""), (None, ""), ("\r", ""),
    (line(info='NOTE="a;b\tc";END=10'), None), (line(info='NOTE="a'), "quoting"), (line(info='NOTE=a"b"'), "quoting"), (line(info='N="a"b'), "quoting"), (line(info='N=""'), None), (line(extra='="x"'), None),
    (line() + "\tmore", "columns"), ("1\t2", "columns"), (line(pos="x"), "pos"), (line(pos=""), "pos"), (line(pos="000400000000", info="."), None), (line(pos="400000001", info="."), "pos"), (line(pos="9" * 50, info="."), "pos"), (line(pos="0", info="."), None), (line(pos="-1", info="."), "pos"),
    (line(info=";"), "info"), (line(info="END=10;"), None), (line(info="END=10;;"), "info"), (line(info=""), "info"), (line(info="1A=2"), "info"), (line(info="_a.B=x=y"), None), (line(info="A="), "info"), (line(info="FLAG"), None), (line(info="END"), "info"), (line(info="SVLEN=+3"), "info"), (line(info="SVLEN=1.0"), "info"), (line(info="END=9"), "info"), (line(info="END=-11"), "info"), (line(pos="0", info="END=-0"), None), (line(info="END=" + "9" * 40), None), (line(info="END=0010"), None), (line(info=" END=10"), "info"), (line(info="."), None), (line(info=".;A"), "info"),
]


def test_rejected_and_loaded_lines(spark):
    rows = [(i, text, "clash") for i, (text, _) in enumerate(LINES)] + [(500, "1\t2", "clash"), (500, "1\t2", "clash")]
    df = spark.createDataFrame(rows, "line_id bigint, raw_line string, line string")
    got = sorted(tuple(r) for r in quarantine.rejected(df).collect())
    assert got == sorted([(i, why) for i, (_, why) in enumerate(LINES) if why] + [(500, "columns")] * 2)
    loaded = {r.line_id: r for r in quarantine.strict_load(df).collect()}
    assert sorted(loaded) == [i for i, (_, why) in enumerate(LINES) if why is None]
    noted = loaded[next(i for i, (t, _) in enumerate(LINES) if t and 'NOTE="a;b' in t)]
    assert noted.vcf_info == 'NOTE="a;b\tc";END=10' and noted.vcf_pos == 10 and noted.vcf_sample == "0/1"
    assert quarantine.rejected(df.limit(0)).count() == 0


def test_very_long_line(spark):
    df = spark.createDataFrame([(1, line(info="N=" + "x" * 500_000)), (2, line(info=";".join(f'K{i}="v;{i}"' for i in range(5000)))), (3, line(info='A="' + "\t" * 100_000))], "line_id bigint, raw_line string")
    assert [tuple(r) for r in quarantine.rejected(df).collect()] == [(3, "quoting")]


def test_packed_fields_of_great_length_take_linear_time(spark):
    from time import time

    n = 5_000
    quoted, bare, doubled, ids = ",".join(['"AC;G"'] * n), ",".join(["ACG"] * n), '"' + '""' * n + '",T', ";".join(["X=1"] * n) + ";ClusterIDs=" + "|".join(["a.1"] * n) + ";END=5"
    rows = [(1, quoted, None), (2, bare, ""), (3, doubled, None), (4, None, ids), (5, '"' * (2 * n + 1), "ClusterIDs='" + ";" * n + "','b'")]
    df = spark.createDataFrame(rows, "row_id bigint, alt_allele string, info string")
    began = time()
    got = packed.split_packed(df).groupBy("row_id", "packed_field").agg({"idx": "max", "item": "max"}).collect()
    assert time() - began < 60
    assert {(r.row_id, r.packed_field): r["max(idx)"] for r in got} == {(1, "ALT"): n, (2, "ALT"): n, (3, "ALT"): 2, (4, "ClusterIDs"): n, (5, "ClusterIDs"): 2}


def test_info_entries_with_separators_and_control_characters_in_quotations(spark):
    info = "A='x;y';B=\x1a1;ClusterIDs=\"p;q\x1a\"\"r\" , s;ClusterIDs=z,z"
    df = spark.createDataFrame([(1, "A", info)], "row_id bigint, alt_allele string, info string")
    assert [(r.idx, r.item) for r in packed.split_packed(df).orderBy("idx").collect()] == [(1, 'p;q\x1a"r'), (2, "s")]


def test_strict_load_with_clashing_columns(spark):
    line = "1\t5\tx\tA\tC\t.\t.\t.\tGT\t0"
    df = spark.createDataFrame([(1, line, "own", "kept", 7)], "line_id bigint, raw_line string, vcf_pos string, line string, cells int")
    row = quarantine.strict_load(df).first().asDict()
    assert row["vcf_pos"] == 5 and row["line"] == "kept" and row["cells"] == 7 and row["vcf_chrom"] == "1"
    assert quarantine.rejected(df).count() == 0 and quarantine.rejected(df.withColumn("raw_line", df.line)).first().reason == "columns"

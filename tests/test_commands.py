"""The commands end to end: over contigs laid out from a table beside nested loops, and on small files worked out by hand."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandline import cli
from strandline.functions.align import align
from strandline.functions.sequence import repeat_extent, shift_indel
from strandline.operators import intervals as V
from strandline.plans import commands, genome
from strandline.sources import fasta, sinks

DATA = Path("/root/testdata/sf0.001")
tables = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


def record(a, b, seq):
    """Distances of two laid-out calls by the written rules."""
    end = lambda r: r.pos + len(r.ref) - 1
    low, high = min(a.pos, b.pos), max(end(a), end(b))
    hap = lambda r: seq[low - 1 : r.pos - 1] + r.alt + seq[end(r) : high]
    found = align(hap(a), hap(b))
    shared = (max(len(a.ref), len(a.alt)) + max(len(b.ref), len(b.alt))) / 2
    sizes = [len(r.alt) - len(r.ref) for r in (a, b)]
    affected = max(high - low + 1, *(high - low + 1 + s for s in sizes))
    return {
        "possible": abs(sizes[0] - sizes[1]) <= shared, "relshift": abs(found["max_shift"]) / shared, "relsizediff": abs(sizes[0] - sizes[1]) / shared, "reldist": found["edit_distance"] / shared,
        "subsdist": found["subs"] / affected, "indeldist": found["indels"] / affected,
    }


@pytest.fixture(scope="module")
def laid(spark):
    d = str(DATA)
    rows = genome.records(spark, d)
    seqs = {r.chrom: r.s for r in genome.contigs(spark, d).collect()}
    return rows, genome.slices(spark, d), seqs


@tables
def test_benchmark_with_its_defaults_equals_nested_loops(laid):
    rows, slices, seqs = laid
    calls = rows.collect()
    near = [(a, b, record(a, b, seqs[a.chrom])) for a in calls for b in calls if a.side == 0 and b.side == 1 and a.chrom == b.chrom]
    accepted = [(a.line_no, b.line_no) for a, b, r in near if r["possible"] and max(r["relshift"], r["relsizediff"], r["reldist"]) <= 0.2]
    assert len(accepted) > 20
    got = commands.benchmark(rows.where("side = 0"), rows.where("side = 1"), slices)
    assert sorted((int(m.test_key.split(":")[1]), int(m.truth_key.split(":")[1])) for m in got.matches.collect()) == sorted(accepted)
    m = got.metrics.first()
    mine = [c for c in calls if c.side == 0]
    assert (m.ptp, m.ptp + m.fp, m.dtp) == (len({a for a, _ in accepted}), len(mine), len({b for _, b in accepted}))
    by_rates = commands.BenchmarkParams(max_subs_rate=0.05, max_indel_rate=0.1)
    rates = [(a.line_no, b.line_no) for a, b, r in near if r["possible"] and r["subsdist"] <= 0.05 and r["indeldist"] <= 0.1]
    again = commands.benchmark(rows.where("side = 0"), rows.where("side = 1"), slices, by_rates).matches.collect()
    assert sorted((int(m.test_key.split(":")[1]), int(m.truth_key.split(":")[1])) for m in again) == sorted(rates) != sorted(accepted)


@tables
def test_widening_bridges_mismatches_only_where_the_score_allows(laid, spark):
    rows, slices, seqs = laid
    contigs = spark.createDataFrame([(k, len(v)) for k, v in seqs.items()], "chrom string, contig_len bigint")
    exact = {r.id: r for r in commands.widen(rows, slices, contigs, 60, bridging=False).collect()}
    for r in rows.collect():
        seq = seqs[r.chrom]
        ahead, behind = seq[max(0, r.pos - 61) : r.pos], seq[r.pos + len(r.ref) - 1 : r.pos + len(r.ref) - 1 + 60]
        _, _, left, right = shift_indel(ahead, r.ref[1:], r.alt[1:], behind)
        # Shifting goes right first and then left over what it took in; from the ends both are what the flanks repeat.
        assert exact[r.id].wide_end == r.pos + len(r.ref) + right and exact[r.id].wide_start == r.pos - left
    flank = "ACGT" * 5 + "CCGT" + "ACGT" * 10 + "T" * 50
    assert repeat_extent("ACGT" * 10, flank, False) == 20 and repeat_extent("ACGT" * 10, flank) == 64
    assert repeat_extent("ACGT", "", True) == repeat_extent("", "ACGT", True) == repeat_extent("ACGT", "GGGG", True) == 0


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def write_fasta(path, **seqs):
    path.write_text("".join(f">{n}\n" + "\n".join(s[i : i + 60] for i in range(0, len(s), 60)) + "\n" for n, s in seqs.items()))
    return str(path)


def write_vcf(path, rows, header=()):
    names = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "S"]
    path.write_text("\n".join(["##fileformat=VCFv4.2", *header, "\t".join(names), *("\t".join(map(str, r)) for r in rows)]) + "\n")
    return str(path)


def text(spark, path):
    return [r.value for r in spark.read.text(str(path)).collect()]


@pytest.fixture
def place(tmp_path):
    rng = random.Random(3)
    chrom = dna(rng, 60_000)
    return tmp_path, chrom, write_fasta(tmp_path / "ref.fa", **{"1": chrom}), rng


def deletion(chrom, pos, size, name, reads="0/1:10:10", filters="PASS"):
    return ("1", pos, name, chrom[pos - 1 : pos + size], chrom[pos - 1], ".", filters, "SVTYPE=DEL", "GT:DR:DV", reads)


def scored(spark, tmp_path, test, truth, ref, *more):
    cli.main(["benchmark", "--ref", ref, "--test", test, "--truth", truth, "--prefix", str(tmp_path / "b"), *more])
    return {k: v for k, v in (x.split(": ") for x in text(spark, tmp_path / "b.report"))}


def test_benchmark_options_on_a_table_worked_out_by_hand(spark, place):
    tmp_path, chrom, ref, _ = place
    # Four test calls: the same as a truth call, the same size 120 bases on, one of 50 bases, one with few reads.
    truth = write_vcf(tmp_path / "truth.vcf", [deletion(chrom, 1000, 100, "a"), deletion(chrom, 3000, 200, "b"), deletion(chrom, 5000, 50, "c"), deletion(chrom, 7000, 80, "d")])
    test = write_vcf(tmp_path / "test.vcf", [deletion(chrom, 1000, 100, "w"), deletion(chrom, 3120, 200, "x"), deletion(chrom, 5000, 50, "y", "0/1:1:1"), deletion(chrom, 7000, 80, "z", "0/1:20:4", "LowQual")])
    all_ = scored(spark, tmp_path, test, truth, ref)
    # The haplotypes of the second pair differ in 120 bases that have nothing in common, far more than a fifth of 201.
    assert (all_["Number of true variants found"], all_["Number of test variants that don't"]) == ("3", "1")
    lines = text(spark, tmp_path / "b.distances/01-records")
    assert text(spark, tmp_path / "b.distances/00-header") == [sinks.distance_header(True)]
    assert {tuple(x.split("\t")[1:3]): x.split("\t")[7] for x in lines}["x", "b"] != "0" and {tuple(x.split("\t")[1:3]): x.split("\t")[7] for x in lines}["w", "a"] == "0"
    sized = scored(spark, tmp_path, test, truth, ref, "--minsize", "50")
    assert (sized["Number of true variants found"], sized["Number of test variants that match"]) == ("2", "2") and sized["Number of true variants missed"] == "2"
    reads = scored(spark, tmp_path, test, truth, ref, "--minreadsupport", "2")
    assert (reads["Number of true variants found"], reads["Number of true variants missed"], reads["Number of test variants that don't"]) == ("2", "2", "1")
    share = scored(spark, tmp_path, test, truth, ref, "--minreadfrac", "0.5")
    assert share["Number of test variants that match"] == "2"
    passing = scored(spark, tmp_path, test, truth, ref, "--testfilter", "PASS")
    assert passing["Number of test variants that match"] == "2" and passing["Precision"] == "66.67%"
    near = scored(spark, tmp_path, write_vcf(tmp_path / "far.vcf", [deletion(chrom, 1000, 100, "w")]), write_vcf(tmp_path / "t2.vcf", [deletion(chrom, 50_000, 100, "a")]), ref)
    assert near["Number of true variants found"] == "0" and near["F1"] == "NaN"


def test_merge_writes_distances_and_the_tags_of_either_rule(spark, place):
    tmp_path, chrom, ref, _ = place
    path = write_vcf(tmp_path / "m.vcf", [deletion(chrom, 1000, 100, "a"), deletion(chrom, 1000, 100, "b"), deletion(chrom, 1004, 100, "c"), deletion(chrom, 9000, 70, "d"), ("1", 0, "telo", ".", "A", ".", "PASS", "X=1", "GT", "0")], ["##INFO=<ID=SVTYPE,Number=1>"])
    cli.main(["merge", "--ref", ref, "--variants", path, "--prefix", str(tmp_path / "m")])
    rows = {x.split("\t")[2]: x.split("\t")[7] for x in text(spark, tmp_path / "m.clustered.vcf/01-records")}
    assert set(rows) == {"a", "d", "telo"} and "ClusterIDs=a:b:c;NumClusterSVs=3;ExactMatchIDs=a:b;NumExactMatchSVs=2;ClusterMaxShiftDist=0" in rows["a"] and "Subs" not in rows["a"]
    header = text(spark, tmp_path / "m.clustered.vcf/00-header")
    assert sum("Cluster" in x or "ExactMatch" in x for x in header) == 7
    assert len(text(spark, tmp_path / "m.distances/01-records")) == 3
    cli.main(["merge", "--ref", ref, "--variants", path, "--prefix", str(tmp_path / "n"), "--newdist", "--seqspecific", "--delimiter", "+"])
    rows = {x.split("\t")[2]: x.split("\t")[7] for x in text(spark, tmp_path / "n.clustered.vcf/01-records")}
    assert set(rows) == {"a", "d"} and "ClusterIDs=a+b+c" in rows["a"] and "ClusterMaxSubsDist=" in rows["a"] and "ClusterMaxIndelDist=" in rows["a"] and "MaxShift" not in rows["a"]
    assert sum("Cluster" in x or "ExactMatch" in x for x in text(spark, tmp_path / "n.clustered.vcf/00-header")) == 6
    cli.main(["merge", "--ref", ref, "--variants", path, "--prefix", str(tmp_path / "o"), "--skip_clusters"])
    assert (tmp_path / "o.distances").exists() and not (tmp_path / "o.clustered.vcf").exists()


def turned(x):
    return x.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def test_refine_writes_all_five_files_with_inversions(spark, place):
    tmp_path, chrom, _, rng = place
    ref = write_fasta(tmp_path / "r.fa", **{"1": chrom[:9000]})
    # Contigs with a deletion of 100 bases at 2000 and with an inversion of 600 at 5000, and one that is as the reference.
    shorter, flipped = chrom[:2000] + chrom[2100:4000], chrom[4000:5000] + turned(chrom[5000:5600]) + chrom[5600:9000]
    query = write_fasta(tmp_path / "q.fa", d=shorter, q=flipped, same=chrom[:9000])
    delta = tmp_path / "a.delta"
    entry = lambda name, n, *rows: f">1 {name} 9000 {n}\n" + "".join(f"{a} {b} {c} {d} 0 0 0\n0\n" for a, b, c, d in rows)
    delta.write_text(
        f"{ref} {query}\nNUCMER\n" + entry("d", 3900, (1, 2000, 1, 2000), (2101, 4000, 2001, 3900)) + entry("q", 5000, (4001, 5000, 1, 1000), (5001, 5600, 1600, 1001), (5601, 9000, 1601, 5000)) + entry("same", 9000, (1, 9000, 1, 9000))
    )
    regions = tmp_path / "g.bed"
    regions.write_text("1\t1899\t2200\n1\t4899\t5700\n1\t40000\t40100\n")
    out = {k: str(tmp_path / k) for k in ("vcf", "ref", "nocov", "sv")}
    cli.main(["refine", "--delta", str(delta), "--ref_fasta", ref, "--query_fasta", query, "--regions", str(regions), "--outvcf", out["vcf"], "--outref", out["ref"], "--nocov", out["nocov"], "--svregions", out["sv"], "--samplename", "NA1", "--refname", "toy", "--includeseqs"])
    header = text(spark, out["vcf"] + "/00-header")
    assert header[0] == "##fileformat=VCFv4.3" and header[1].startswith("##fileDate=") and "##reference=toy" in header and header[-1].endswith("FORMAT\tNA1")
    rows = [x.split("\t") for x in text(spark, out["vcf"] + "/01-records")]
    kinds = [(r[0], dict(x.split("=") for x in r[7].split(";"))["SVTYPE"], r[9]) for r in rows]
    assert kinds == [("1", "DEL", "0/1"), ("1", "INV", "0/1")]
    deleted, inverted = rows
    assert len(deleted[3]) - len(deleted[4]) == 100 and chrom[int(deleted[1]) - 1 :].startswith(deleted[3])
    assert "REFWIDENED=1:" in inverted[7] and "ALTWIDENED=q:" in inverted[7] and len(inverted[3]) == len(inverted[4]) and inverted[3][1:] == turned(inverted[4][1:])
    bed = [x.split("\t") for x in text(spark, out["sv"] + "/01-records")]
    assert [(b[3], b[4]) for b in bed] == [("DEL", "1"), ("INV", "2")] and all(b[5].startswith("END=") for b in bed)
    assert text(spark, out["nocov"] + "/01-records") == []  # the third region lies beyond the chromosome
    assert {x for x in text(spark, out["ref"] + "/01-records")} == {"1\t1\t9000\tsame\t1\t9000"}


#: Regions of one chromosome (start from 0, end), and the alignments of one contig to it: those before and after the contig have no coverage.
REGIONS = """794925 797671 799388 880266 883083 885110 889191 891812 893175 898763 898981 901224 903776 905876 906028 908713 909009 939504 940044 944120 944675 949097 952161 954320 956967 958970 961713 967429
968796 971142 975739 978634 982101 987300 990982 994214 995448 998464 999138 1001703 1002582 1032930 1033429 1045497 1046980 1048982 1052651 1055501 1056925 1059391 1060824 1063098 1066596 1068674 1069602 1079310
1079927 1085480 1087410 1090156 1091675 1093715 1094523 1100578 1102389 1105226 1110387 1112388 1112914 1116331 1119036 1121799 1123239 1128746 1128908 1132659 1136201 1139739 1144365 1234093"""


def test_regions_without_coverage(spark):
    from test_operators import CONTIG

    numbers = list(map(int, REGIONS.split()))
    regions = [(f"g{i}", "1", a + 1, b) for i, (a, b) in enumerate(zip(numbers[::2], numbers[1::2]))]
    df = spark.createDataFrame(regions, "region_id string, chrom string, start bigint, end bigint")
    rows = [("1", "c", i, a, b, c, d, 0, f"{b - a + 1}M") for i, (a, b, c, d) in enumerate(CONTIG)]
    aligned = spark.createDataFrame(rows, "ref_entry string, query_entry string, align_no bigint, ref_start bigint, ref_end bigint, query_start bigint, query_end bigint, comp int, cigar string")
    bare = V.uncovered(df, V.spanning_pairs(df, aligned, 0, 50))
    assert sorted(r.start for r in bare.collect()) == [r[2] for r in regions[:16]] + [regions[-1][2]]
    found = commands.refine(aligned, df, spark.createDataFrame([("1", 249_250_621)], "chrom string, contig_len bigint"))
    assert found.uncovered.count() == 17 and found.coverage.select("r_start").distinct().count() == 3


def test_back_genotypes_as_vcf(spark, place):
    tmp_path, chrom, ref, rng = place
    inserted = dna(rng, 100)

    def call(pos, bases, name):
        wide = f"SVTYPE=INS;SVLEN={len(bases)};REFWIDENED=1:{pos}-{pos + 1};ALTWIDENED=ctg:{pos}-{pos + 1}"
        return ("1", pos, name, chrom[pos - 1], chrom[pos - 1] + bases, ".", "PASS", wide)

    paths = {
        "own": write_vcf(tmp_path / "own.vcf", [call(1000, inserted, "t1"), call(5000, inserted, "t2"), call(9000, inserted, "t3")], ["##source=x", "##fileDate=20200101"]),
        "twin": write_vcf(tmp_path / "twin.vcf", [call(1000, inserted, "s1")]),
        "near": write_vcf(tmp_path / "near.vcf", [call(5003, chrom[5000:5003] + inserted[:-3], "n0"), ("1", 5000, "n1", chrom[4999], chrom[4999] + inserted, ".", "PASS", "SVTYPE=INS;SVLEN=100;REFWIDENED=1:4990-5010")]),
        "none": write_vcf(tmp_path / "none.vcf", []),
    }
    (tmp_path / "cov").write_text("1\t8000\t9900\tc1\n1\t8500\t9500\tc2\n1\t8000\t9900\tc1\n")
    (tmp_path / "empty").write_text("")
    manifest = tmp_path / "manifest"
    manifest.write_text("".join(f"{k} {v} {tmp_path / ('cov' if k == 'none' else 'empty')} x.delta\n" for k, v in paths.items()))
    cli.main(["backgenotype", "--ref", ref, "--target", "own", "--manifest", str(manifest), "--out", str(tmp_path / "g")])
    header = text(spark, tmp_path / "g/00-header")
    assert "##source=strandline" in header and "##fileDate=20200101" not in header and sum("GTMT" in x for x in header) == 1 and header[-1].endswith("FORMAT\town\ttwin\tnear\tnone")
    rows = {x.split("\t")[2]: x.split("\t")[8:] for x in text(spark, tmp_path / "g/01-records")}
    assert rows == {"t1": ["GT:GTMT", "1:H", "1:H", ".:.", ".:."], "t2": ["GT:GTMT", "1:H", ".:.", "1:L", ".:."], "t3": ["GT:GTMT", "1:H", ".:.", ".:.", "0/0:H,H"]}


def test_show_diff_gaps_as_vcf(spark, tmp_path):
    rng = random.Random(8)
    chrom, new = dna(rng, 6000), dna(rng, 90)
    chrom = chrom[:999] + "A" + chrom[1000:]
    contig = chrom[:1000] + new + chrom[1000:3000] + chrom[3120:]
    ref, query = write_fasta(tmp_path / "r.fa", **{"1": chrom}), write_fasta(tmp_path / "q.fa", q=contig)
    n = len(contig)
    delta, diffs = tmp_path / "a.delta", tmp_path / "d.rdiff"
    delta.write_text(f"{ref} {query}\nNUCMER\n>1 q 6000 {n}\n1 1000 1 1000 0 0 0\n0\n1001 3000 1091 3090 0 0 0\n0\n3121 6000 3091 {n} 0 0 0\n0\n")
    cli.main(["delta2bed", "--delta", str(delta), "--out", str(tmp_path / "bed")])
    ends = sorted(tuple(map(int, x.split("\t")[1:3])) for x in text(spark, tmp_path / "bed"))
    (_, e1), (s2, e2), (s3, _) = ends  # extension may go on over chance matches
    q1, q2, q3, q4 = e1, s2 + 1 + 90, e2 + 90, s3 + 1 - 30
    gap = lambda a, b, c, d: f"1\tGAP\t{a + 1}\t{b - 1}\t{b - a - 1}\t{d - c - 1}\t{(b - a - 1) - (d - c - 1)}"
    diffs.write_text(f"{ref} {query}\nNUCMER\n\n{gap(e1, s2 + 1, q1, q2)}\n{gap(e2, s3 + 1, q3, q4)}\n1\tGAP\t{e1 + 1}\t{s2}\t{s2 - e1}\t7\t{s2 - e1 - 7}\n")
    cli.main(["showdiff", "--delta", str(delta), "--diffs", str(diffs), "--out", str(tmp_path / "v"), "--includeseqs"])
    rows = [x.split("\t") for x in text(spark, tmp_path / "v/01-records")]
    tags = [dict(x.split("=") for x in r[7].split(";")) for r in rows]
    assert [(t["SVTYPE"], t["SVLEN"]) for t in tags] == [("INS", "90"), ("DEL", "-120")]
    assert all({"HOMAPPLEN", "REFWIDENED", "CONTIGALTPOS", "CONTIGWIDENED"} <= set(t) for t in tags)
    assert tags[0]["REFWIDENED"] == f"1:{s2 + 1}-{e1}" and rows[0][3] == chrom[s2] and new[5:80] in rows[0][4] and chrom[int(rows[1][1]) - 1 :].startswith(rows[1][3])


def test_plot_script_and_segments(spark, tmp_path):
    coords = tmp_path / "x.coords"
    rows = [(1, 100, 1, 100), (150, 300, 110, 260), (400, 900, 700, 200), (5000, 6000, 1, 1000)]
    coords.write_text("\n".join("\t".join(map(str, (*r, r[1] - r[0], 1, 99.0, 9000, 900, 1.0, 1.0, "1", "q"))) for r in rows) + "\n")
    cli.main(["plotaligns", "--coords", str(coords), "--refregion", "1:50-1000", "--queryregion", "q:1-800", "--prefix", str(tmp_path / "p"), "--title", "Toy"])
    assert len(text(spark, tmp_path / "p.segments")) == 3
    script = text(spark, tmp_path / "p.R")
    assert script[0].startswith("pdf(") and "x0 <- c(1, 150, 400)" in script and "y1 <- c(100, 260, 200)" in script and any("xlim=c(1, 900)" in x and "Toy" in x for x in script)


def test_polymorphism_strings(spark):
    poly = spark.createDataFrame(
        [("amp", None, "7", 120, 119, 121, "SNP", "A", "G", 40), (None, "p", None, 5, 4, 8, "Deletion", "ACG", "", 3), ("z", "p", "1", 9, 8, 9, "Other", None, "T", 1)],
        "amplimer_id string, project_id string, analysis_id string, position int, left_flank_end int, right_flank_start int, type string, allele1 string, allele2 string, score int",
    )
    assert sorted(r.line for r in sinks.polymorphism_strings(poly).collect()) == [
        "NA:5D\tp\tNA\tAMPLIMER\tNA\t4\t8\tDeletion\tACG\t-\t3", "amp:120\tNA\t7\tAMPLIMER\tamp\t119\t121\tSNP\tA\tG\t40", "z:9ID\tp\t1\tAMPLIMER\tz\t8\t9\tOther\t-\tT\t1",
    ]
    reads = spark.createDataFrame(
        [("amp", 120, "r1", "A", "G", 9, 3, 4, None, 7), ("amp", 120, "x.REF.1", "A", "A", 9, 1, 1, 1, 1), ("amp", 120, "r2", "W", "A", 9, 1, 1, 1, 1), ("amp", 120, "r3", None, "", 2, None, None, None, None), ("other", 1, "r4", "A", "A", 9, 1, 1, 1, 1)],
        "amplimer_id string, position int, read_name string, allele1 string, allele2 string, score int, allele1_left_end int, allele1_right_start int, allele2_left_end int, allele2_right_start int",
    )
    assert sorted(r.line for r in sinks.polymorphism_genotype_strings(reads, poly).collect()) == ["amp:120\tr1\t7\tA\tG\t9\t3\t4\t0\t7", "amp:120\tr3\t7\t-\t-\t2\t0\t0\t0\t0"]


def test_refined_variants_keep_status_of_failed_inversions(spark):
    rows = [("1", "q", i, a, b, c, d, comp, "9M") for i, (a, b, c, d, comp) in enumerate([(1, 100, 1, 100, 0), (101, 200, 200, 101, 1), (400, 500, 201, 300, 0)])]
    df = spark.createDataFrame(rows, "ref_entry string, query_entry string, n int, ref_start bigint, ref_end bigint, query_start bigint, query_end bigint, comp int, cigar string")
    from strandline.operators import alignments as A

    assert [r.status for r in A.inversions(df, ["query_entry"], ["n"]).collect()] == ["ASYMMETRIC"]


def test_fasta_index_and_packed_files_are_read_by_tasks(spark, tmp_path):
    import gzip

    rng = random.Random(4)
    seqs = {"a": dna(rng, 200), "b": dna(rng, 70_000)}
    plain = write_fasta(tmp_path / "x.fa", **seqs)
    with open(plain, "rb") as source, gzip.open(tmp_path / "y.fa.gz", "wb") as packed:
        packed.write(source.read())
    for path in (plain, str(tmp_path / "y.fa.gz")):
        assert [(r.chrom, r.contig_len, r.ord) for r in fasta.contigs(spark, path).orderBy("ord").collect()] == [("a", 200, 0), ("b", 70_000, 1)]
        whole = fasta.chunks(spark, path).groupBy("chrom").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "seq"))), lambda x: x["seq"]), "").alias("s"))
        assert {r.chrom: r.s for r in whole.collect()} == seqs

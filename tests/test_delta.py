import random

from strandline import cli
from strandline.operators import alignments as A
from strandline.sources import alignments as SA
from strandline.sources import fasta


def turned(x):
    return x.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def dna(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def files(tmp_path, chrom, contig, heads):
    """A delta file of alignments of q (the contig) and r (its reverse complement)."""
    ref, query, delta = (tmp_path / x for x in ("r.fa", "q.fa", "a.delta"))
    ref.write_text(f">1\n{chrom}\n")
    query.write_text(f">q\n{contig}\n>r\n{turned(contig)}\n")
    entries = "".join(f">1 {name} {len(chrom)} {len(contig)}\n{head}\n0\n" for name, head in heads)
    delta.write_text(f"{ref} {query}\nNUCMER\n{entries}")
    return str(delta)


def other(base):
    return "A" if base != "A" else "C"


def test_delta_converters_extend_and_write_whole_sam(spark, tmp_path):
    chrom = dna(1, 1000)
    contig = chrom[100:900]
    contig = other(contig[0]) + contig[1:-1] + other(contig[-1])  # matches run from 102 to 899
    delta = files(tmp_path, chrom, contig, [("q", "111 880 11 780 0 0 0"), ("r", "111 880 790 21 0 0 0")])
    cli.main(["delta2bed", "--delta", delta, "--out", str(tmp_path / "bed")])
    bed = sorted(r.value for r in spark.read.text(str(tmp_path / "bed")).collect())
    assert bed == ["1\t101\t899\tq\t100.0\t-", "1\t101\t899\tr\t100.0\t+"]
    cli.main(["delta2sam", "--delta", delta, "--out", str(tmp_path / "sam")])
    assert [r.value for r in spark.read.text(str(tmp_path / "sam/00-header")).collect()] == ["@HD\tVN:1.6\tSO:coordinate", "@SQ\tSN:1\tLN:1000", "@PG\tID:strandline"]
    sam = sorted(r.value for r in spark.read.text(str(tmp_path / "sam/01-records")).collect())
    assert sam == [f"{name}\t{flag}\t1\t102\t40\t1H798M1H\t*\t0\t0\t{chrom[101:899]}\t*" for name, flag in (("q", 0), ("r", 16))]


def test_extension_goes_on_to_the_mismatch(spark, tmp_path):
    chrom = dna(2, 40_000)
    contig = other(chrom[500]) + chrom[501:39_499] + other(chrom[39_499])  # matches run from 502 to 39499
    n = len(contig)
    delta = files(tmp_path, chrom, contig, [("q", f"15001 15100 {15001 - 500} {15100 - 500} 0 0 0"), ("r", f"15001 15100 {n + 1 - 14501} {n + 1 - 14600} 0 0 0"), ("q", "39301 39400 38801 38900 0 0 0")])
    ref, query = (fasta.slicer(fasta.chunks(spark, str(tmp_path / x))) for x in ("r.fa", "q.fa"))
    got = {(r.query_entry, r.ref_start, r.ref_end, r.query_start, r.query_end, r.cigar) for r in A.extended(SA.read_delta(spark, [delta]), ref, query, 100).collect()}
    assert got == {("q", 502, 39_499, 2, n - 1, "38998M"), ("r", 502, 39_499, n - 1, 2, "38998M")}
    default = A.extended(SA.read_delta(spark, [delta]), ref, query).collect()
    assert len(default) == 3 and {(r.ref_start, r.ref_end, r.cigar) for r in default} == {(502, 39_499, "38998M")}


def test_extension_to_sequence_ends_and_n(spark, tmp_path):
    chrom = dna(3, 9_000)
    chrom = chrom[:1_000] + "N" + chrom[1_001:]
    delta = files(tmp_path, chrom, chrom, [("q", "5001 5100 5001 5100 0 0 0"), ("r", "5001 5100 4000 3901 0 0 0")])
    ref, query = (fasta.slicer(fasta.chunks(spark, str(tmp_path / x))) for x in ("r.fa", "q.fa"))
    got = {(r.query_entry, r.ref_start, r.ref_end, r.query_start, r.query_end, r.cigar) for r in A.extended(SA.read_delta(spark, [delta]), ref, query).collect()}
    assert got == {("q", 1_002, 9_000, 1_002, 9_000, "7999M"), ("r", 1_002, 9_000, 7_999, 1, "7999M")}

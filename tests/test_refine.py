"""What ``refine`` finds beside a walk over all contigs, and how much it stores for that."""

import random
from pathlib import Path

import pytest
from test_operators import brute_slices

from strandline.operators import alignments as A
from strandline.plans import commands

ROWS = "ref_entry string, query_entry string, ref_start bigint, ref_end bigint, query_start bigint, query_end bigint, align_no bigint, comp int, cigar string"
REGIONS = "region_id string, chrom string, start bigint, end bigint"


def stored(spark, make):
    """The result of ``make``, and rows and bytes of the tables that it wrote."""
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.glob("strandline-*"))
    result = make()
    tables = [x for x in shared.glob("strandline-*") if x not in before]
    return result, sum(spark.read.parquet(f"file://{x}").count() for x in tables), sum(f.stat().st_size for x in tables for f in x.rglob("*.parquet"))


def brute(rows, regions, buffer, segment):
    """Status by (region, contig), and the coverage's rows, by walking over each contig."""
    status, coverage = {}, []
    for g in regions:
        a, b, c, d = g[2] - buffer, g[2] - buffer + segment - 1, g[3] + buffer - segment + 1, g[3] + buffer
        for q in {r[1] for r in rows}:
            mine = [r for r in rows if r[1] == q]
            over = lambda x, y: {r[7] for r in mine if r[0] == g[1] and r[2] < x and r[3] > y}
            if not over(a, b) & over(c, d):
                continue
            kept = set(brute_slices(g, mine, buffer, segment))
            on = sorted((r for r in mine if r[6] in kept and r[0] == g[1]), key=lambda r: (r[2], r[3], r[6]))
            spans = [r for r in on if r[2] < a and r[3] > d]
            coverage += [(r[0], r[2], r[3], q, r[4], r[5]) for r in spans]
            strands = "".join(str(r[7]) for r in on)
            kind = "NOVARFOUND" if len(spans) == len(on) else "MULTIALIGNS" if len(on) > 3 else "SIMPLE" if strands in ("00", "11", "000", "111") else "INVERSION" if strands in ("010", "101") else "OTHER"
            status[g[0], q] = (len(on), kind)
    return status, sorted(coverage)


@pytest.mark.parametrize("bin_size, few, buffer, segment", [(16, 0, 5, 4), (64, 1 << 20, 20, 30), (1 << 16, 1 << 20, 0, 50)])
def test_pairs_equal_a_walk_over_each_contig(spark, monkeypatch, bin_size, few, buffer, segment):
    monkeypatch.setattr(A, "FEW", few, raising=False)
    rng = random.Random(3)
    rows = []
    for i in range(200):
        s = rng.randint(1, 900)
        e = s + rng.choice([3, 30, 60, 200, 700])
        rows.append((rng.choice("aabc"), f"q{i % 7}", s, e, s + rng.randint(0, 9), e + rng.randint(0, 9), i, int(rng.random() < 0.3), f"{e - s + 1}M"))
    regions = [(f"g{i}", rng.choice("ab"), s := rng.randint(25, 900), s + rng.choice([0, 10, 60, 300])) for i in range(70)]
    df, rdf = spark.createDataFrame(rows, ROWS), spark.createDataFrame([*regions, regions[0], ("edge", "a", 0, 9), ("none", "z", 100, 120)], REGIONS)
    contigs = spark.createDataFrame([("a", 5000), ("b", 5000), ("c", 5000)], "chrom string, contig_len bigint")
    found = commands.refine(df, rdf, contigs, buffer, segment, bin_size=bin_size)
    status, coverage = brute(rows, regions, buffer, segment)
    got = found.status.collect()
    assert {(r.region_id, r.query_entry): (r.n_ref, r.status) for r in got if r.query_entry} == status and len([r for r in got if r.query_entry]) == len(status)
    assert {r.region_id for r in got if r.status == "CHROMEND"} == {"edge", "none"}
    assert sorted(map(tuple, found.coverage.collect())) == coverage
    assert {k for _, k in status.values()} >= {"NOVARFOUND", "SIMPLE", "MULTIALIGNS", "OTHER"}


def test_status_stores_one_row_for_a_pair(spark):
    rows = [("a", f"q{q}", 100 + q, 9000, 100 + q, 9000, q, 0, "8901M") for q in range(20)] + [("z", f"q{q}", 200 + q, 900, 1, 700, 100 + q, 0, "701M") for q in range(20)]
    regions = [(f"g{i}", "a", 1000 + i, 1100 + i) for i in range(300)]
    contigs = spark.createDataFrame([("a", 100_000), *((f"x{i}", 100_000) for i in range(5000))], "chrom string, contig_len bigint")
    found, held, _ = stored(spark, lambda: commands.refine(spark.createDataFrame(rows, ROWS), spark.createDataFrame(regions, REGIONS), contigs, 20, 30))
    assert found.status.where("status = 'NOVARFOUND' and n_ref = 1").count() == 6000
    assert held <= 6000 + 100  # was 24,000


def test_variants_store_alignments_of_their_pairs_only(spark):
    rows = [("a", f"q{q}", 100, 9000, 100, 9000, q, 0, "8901M") for q in range(1, 20)]
    rows += [("a", "q0", 100, 1050, 100, 1050, 100, 0, "951M"), ("a", "q0", 1091, 9000, 1051, 8960, 101, 0, "7910M")]  # 40 bases are missing
    regions = [(f"g{i}", "a", 1031 + i, 1100 + i) for i in range(300)]
    contigs = spark.createDataFrame([("a", 100_000), *((f"x{i}", 100_000) for i in range(5000))], "chrom string, contig_len bigint")
    found, held, _ = stored(spark, lambda: commands.refine(spark.createDataFrame(rows, ROWS), spark.createDataFrame(regions, REGIONS), contigs, 20, 10))
    got = found.variants.select("query_entry", "svtype", "pos", "sv_end", "svlen", "covered").distinct().collect()
    assert [tuple(r) for r in got] == [("q0", "DEL", 1050, 1090, 40, True)]
    assert held <= 20 * 300 + 100  # was 17,907


def test_coverage_counts_the_regions_of_an_alignment(spark):
    rows = [("a", f"q{q}", 100, 9000, 100, 9000 + q, q, 0, "8901M") for q in range(20)]
    regions = [(f"g{i}", "a", 1000 + i, 1100 + i) for i in range(300)]
    contigs = spark.createDataFrame([("a", 100_000)], "chrom string, contig_len bigint")
    found, held, _ = stored(spark, lambda: commands.refine(spark.createDataFrame(rows, ROWS), spark.createDataFrame(regions, REGIONS), contigs, 20, 30))
    got = found.coverage.groupBy(*found.coverage.columns).count().collect()
    assert sorted(map(tuple, got)) == sorted(("a", 100, 9000, f"q{q}", 100, 9000 + q, 300) for q in range(20))
    assert held <= 20 * 300 + 100  # was 18,000


def test_variants_store_no_pair_without_one(spark):
    rows = [("a", f"q{q}", 100, 9000, 100, 9000, q, 0, "8901M") for q in range(1, 20)]
    rows += [("a", "q0", 100, 1050, 100, 1050, 100, 0, "951M"), ("a", "q0", 1091, 9000, 1051, 8960, 101, 0, "7910M")]
    regions = [(f"g{i}", "a", 1031 + i, 1100 + i) for i in range(300)]
    contigs = spark.createDataFrame([("a", 100_000)], "chrom string, contig_len bigint")
    got, held, _ = stored(spark, lambda: commands.refine(spark.createDataFrame(rows, ROWS), spark.createDataFrame(regions, REGIONS), contigs, 20, 10).variants.select("query_entry", "pos", "sv_end", "svlen", "covered").collect())
    assert len(got) > 10 and set(map(tuple, got)) == {("q0", 1050, 1090, 40, True)}
    assert held <= 2 * len(got) + 100  # before, each of the 6,000 pairs was a row


def test_coverage_is_known_without_a_row_for_each_region(spark):
    rows = [("a", f"q{q}", 100, 9000, 100, 9000 + q, q, 0, "8901M") for q in range(20)] + [("a", "q0", 100, 9000, 100, 9000, 20, 0, "8901M")]
    regions = [(f"g{i}", "a", 1000 + i, 1100 + i) for i in range(300)]
    contigs = spark.createDataFrame([("a", 100_000)], "chrom string, contig_len bigint")
    got, held, _ = stored(spark, lambda: commands.refine(spark.createDataFrame(rows, ROWS), spark.createDataFrame(regions, REGIONS), contigs, 20, 30).spanning.collect())
    assert sorted(map(tuple, got)) == sorted([("a", 100, 9000, "q0", 100, 9000, 300), *(("a", 100, 9000, f"q{q}", 100, 9000 + q, 300) for q in range(20))])
    assert held <= 100  # before, each of the 6,000 pairs was a row

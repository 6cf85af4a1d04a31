import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import alignments as A
from strandline.operators import graph
from strandline.operators import intervals as V
from strandline.operators.bandjoin import band_join, band_self_pairs, overlap_join
from strandline.functions import sequence as S
from strandline.plans import commands
from strandline.sources import alignments as SA
from strandline.sources import fasta, sinks, tabular, vcf


def points(spark, n, seed, name):
    rng = random.Random(seed)
    rows = [(rng.choice(["1", "2"]), rng.randint(-50, 400), i) for i in range(n)] + [(None, 5, n), ("1", None, n + 1)]
    return spark.createDataFrame(rows, f"chrom string, {name}_pos bigint, {name}_id bigint"), rows


@pytest.mark.parametrize("width, strict", [(0, False), (1, True), (7, False), (7, True), (1000, False)])
def test_band_join_equals_nested_loop(spark, width, strict):
    a, x = points(spark, 150, 1, "a")
    b, y = points(spark, 150, 2, "b")
    got = sorted((r.a_id, r.b_id) for r in band_join(a, b, ["chrom"], "a_pos", "b_pos", width, strict).collect())
    near = lambda p, q: p is not None and q is not None and (abs(p - q) < width if strict else abs(p - q) <= width)
    assert got == sorted((i, j) for c, p, i in x for k, q, j in y if c is not None and c == k and near(p, q))


def test_self_pairs_come_once(spark):
    a, x = points(spark, 120, 3, "x")
    df = a.withColumnsRenamed({"x_pos": "pos", "x_id": "id"})
    got = sorted(tuple(sorted((r.a_id, r.b_id))) for r in band_self_pairs(df, ["chrom"], "pos", ["id"], [], 9).collect())
    assert got == sorted((i, j) for n, (c, p, i) in enumerate(x) for k, q, j in x[n + 1 :] if c and c == k and p is not None and q is not None and abs(p - q) <= 9)


def test_overlap_join_equals_nested_loop(spark):
    rng = random.Random(5)
    make = lambda: [(rng.choice("ab"), s := rng.randint(0, 300), s + rng.choice([0, 3, 90, -2]), i) for i in range(120)]
    x, y = make(), make()
    a, b = spark.createDataFrame(x, "chrom string, s bigint, e bigint, i bigint"), spark.createDataFrame(y, "chrom string, r_start bigint, r_end bigint, j bigint")
    want = sorted((i, j) for c, s, e, i in x for k, p, q, j in y if c == k and e >= s and q >= p and s <= q and p <= e)
    assert sorted((r.i, r.j) for r in overlap_join(a, b, ["chrom"], ("s", "e"), ("r_start", "r_end"), 16, F.lit(True)).collect()) == want
    assert sorted(r.i for r in V.touching(a, b, ["i"], "s", "e", 16).collect()) == sorted({i for i, _ in want})


@pytest.mark.parametrize("local", [1_000_000, 12])
def test_components_equal_union_find(spark, local, monkeypatch):
    monkeypatch.setattr(graph, "LOCAL_VERTICES", local)
    if local == 12:  # forests of a few edges each, so that the star steps have work to do
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    rng = random.Random(8)
    edges = [(f"v{rng.randrange(120)}", f"v{rng.randrange(120)}") for _ in range(80)] + [("hub", f"v{i}") for i in range(5)] + [(f"c{i}", f"c{i + 1}") for i in range(40)]
    parent = {x: x for e in edges for x in e} | {"alone": "alone"}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    got = graph.components(spark.createDataFrame([(x,) for x in parent], "id string"), spark.createDataFrame(edges, "src string, dst string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted((x, root(x)) for x in parent)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)


#: Alignments of one contig whose breaks were worked out by hand from the rules.
CONTIG = [(981902, 1014602, 1, 32705), (1014722, 1016409, 32705, 34391), (1016055, 1075483, 34471, 93895), (1075061, 1176093, 92863, 193880), (1176009, 1180675, 193842, 198502), (1180119, 1185067, 198390, 203349), (1183435, 1219507, 202112, 238181)]


def test_break_types_of_a_contig(spark):
    rows = [("1", "c", i, a, b, c, d, 0) for i, (a, b, c, d) in enumerate(CONTIG)]
    df = spark.createDataFrame(rows, "ref_entry string, query_entry string, align_no bigint, ref_start bigint, ref_end bigint, query_start bigint, query_end bigint, comp int")
    got = A.classified(A.consecutive_breaks(df, ["ref_entry", "query_entry"], ["ref_start", "ref_end"])).orderBy("align_no").collect()
    assert [(r.svkind, r.ref_gap, r.query_gap, r.svsize) for r in got] == [("SIMPLEDEL", 119, -1, 120), ("SIMPLEINS", -355, 79, 434), ("CONTRAC", -423, -1033, 610), ("DUP", -85, -39, 46), ("DUP", -557, -113, 444), ("DUP", -1633, -1238, 395)]


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


@pytest.fixture(scope="module")
def genome(spark, tmp_path_factory):
    rng = random.Random(11)
    chrom = dna(rng, 3000) + "ACACACACAC" + dna(rng, 3000)
    other = dna(rng, 150_000)
    path = tmp_path_factory.mktemp("fa") / "g.fa"
    wrap = lambda s: "\n".join(s[i : i + 60] for i in range(0, len(s), 60))
    path.write_text(f">1 first\n{wrap(chrom)}\n>2\n{wrap(other)}\n>empty\n")
    return str(path), chrom, other


def test_fasta_slices(spark, genome):
    path, chrom, other = genome
    assert [tuple(r) for r in fasta.contigs(spark, path).orderBy("ord").collect()] == [("1", len(chrom), 0), ("2", len(other), 1), ("empty", 0, 2)]
    asked = [("1", 1, 5), ("chr1", 10, 20), ("2", 65_530, 65_545), ("2", 131_000, 140_000), ("1", 20, 10), ("1", len(chrom) - 2, len(chrom) + 50), ("1", len(chrom) + 5, len(chrom) + 9), ("9", 1, 5), ("1", 0, 5), ("1", 1, 5)]
    df = spark.createDataFrame(asked, "c string, a bigint, b bigint")
    got = fasta.slicer(fasta.chunks(spark, path))(df, "c", "a", "b", "t").collect()
    seq = {"1": chrom, "2": other}

    def want(c, a, b):
        s = seq.get(c.removeprefix("chr"))
        if s is None or min(a, b) < 1:
            return None
        t = s[min(a, b) - 1 : max(a, b)]
        return t if a <= b else t.translate(str.maketrans("ACGT", "TGCA"))[::-1]

    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, ((*x, want(*x)) for x in asked)))


def vcf_rows(spark, rows, file="t.vcf"):
    full = [(file, i, *r, None, []) for i, r in enumerate(rows, 1)]
    return spark.createDataFrame(full, "file string, line_no bigint, chrom string, pos bigint, id string, ref string, alt string, qual string, filter string, info string, format string, samples array<string>")


def calls(chrom, seed=1):
    rng = random.Random(seed)
    out = []
    for i, pos in enumerate(range(200, 2800, 300)):
        if i % 2:
            out.append(("1", pos, f"d{i}", chrom[pos - 1 : pos + 60], chrom[pos - 1], ".", "PASS", "SVTYPE=DEL"))
        else:
            out.append(("1", pos, "." if i == 4 else f"i{i}", chrom[pos - 1], chrom[pos - 1] + dna(rng, 70), ".", "PASS", "SVTYPE=INS"))
    return out


def test_benchmark_of_a_set_against_itself_and_against_nothing(spark, genome):
    path, chrom, _ = genome
    slices = fasta.slicer(fasta.chunks(spark, path))
    rows = vcf_rows(spark, calls(chrom) + [("1", 0, "t", "A", "ACG", ".", "PASS", ""), ("1", 9, "b", "A", "<BND>", ".", "PASS", "SVTYPE=BND")])
    same = commands.benchmark(rows, rows, slices, commands.BenchmarkParams(max_dist=100))
    m = same.metrics.first()
    assert (m.ptp, m.fp, m.dtp, m.fn, m.precision, m.recall, m.f1) == (9, 0, 9, 0, 1.0, 1.0, 1.0)
    moved = vcf_rows(spark, [("1", p + 4, i, r if len(a) > 1 else chrom[p + 3 : p + 3 + len(r)], a if len(a) > 1 else chrom[p + 3], q, f, x) for p, i, r, a, q, f, x in (c[1:] for c in calls(chrom, 2))], "m.vcf")
    other = commands.benchmark(moved, rows, slices, commands.BenchmarkParams(max_dist=100)).metrics.first()
    assert other.ptp == 4 and other.fp == 5  # shifted deletions are the same event, other insertions aren't
    none = commands.benchmark(rows.limit(0), rows, slices).metrics.first()
    assert (none.ptp, none.fn, none.precision, none.f1) == (0, 9, None, None) and none.recall == 0.0
    from strandline.operators.scoring import report_lines

    assert any("NaN%" in x for x in report_lines(none))


def test_merge_of_two_files(spark, genome):
    path, chrom, _ = genome
    slices = fasta.slicer(fasta.chunks(spark, path))
    first = [(c[0], c[1], f"a{n}", *c[3:]) for n, c in enumerate(calls(chrom))]
    second = [(c[0], c[1], f"b{n}", *c[3:]) for n, c in enumerate(calls(chrom))][:5] + [("1", 0, "telo", ".", "A", ".", "PASS", "")]
    rows = vcf_rows(spark, first).unionByName(vcf_rows(spark, second, "u.vcf"))
    got = {r.id: r for r in commands.merge(rows, slices).clusters.collect()}
    assert {i: (r.n_calls, r.member_ids) for i, r in got.items()} == {**{f"a{n}": (2, f"a{n}:b{n}") for n in range(5)}, **{f"a{n}": (1, f"a{n}") for n in range(5, 9)}, "telo": (1, "telo")}
    assert got["a0"].n_exact == 2 and got["a0"].max_shift == 0 and got["telo"].max_shift is None
    with pytest.raises(ValueError, match="more than once"):
        commands.merge(rows.unionByName(rows), slices)


def test_positional_comparison(spark, genome):
    path, chrom, _ = genome
    a = vcf_rows(spark, [("1", 200, "x", "A" * 44, "A", ".", ".", ""), ("1", 300, "y", "A" * 38, "A", ".", ".", ""), ("1", 1, "z", "A", "<X>", ".", ".", "")])
    b = vcf_rows(spark, [("1", 210, "p", "A" * 38, "A", ".", ".", ""), ("2", 300, "q", "A", "AC", ".", ".", "")])
    got = {r.n: r for r in commands.compare_in_order(a, b).collect()}
    assert got[1].avgsize == -40 and got[2].status == "DIFFCHROMS" and got[3].status == "missing"


def test_widening_over_a_repeat(spark, genome):
    path, chrom, _ = genome
    at = chrom.index("ACACACACAC")
    low, high = at, at + 10
    while chrom[low - 1] == "AC"[(low - 1 - at) % 2]:
        low -= 1
    while chrom[high] == "AC"[(high - at) % 2]:
        high += 1
    rows = vcf_rows(spark, [("1", at + 4, "rep", chrom[at + 3], chrom[at + 3] + "AC", ".", ".", "X"), ("1", 500, "uni", chrom[499:530], chrom[499], ".", ".", "X"), ("1", 5, "sym", "A", "<INS>", ".", ".", "X")])
    slices = fasta.slicer(fasta.chunks(spark, path))
    got = {r.id: r for r in commands.widen(rows, slices, fasta.contigs(spark, path), buffer=1000).collect()}
    assert (got["rep"].rep_type, got["rep"].wide_start, got["rep"].wide_end, got["rep"].break_length) == ("DUP", low, high + 1, high - low)
    assert got["uni"].rep_type == "SIMPLEDEL" and got["sym"].status == "symbolic" and got["uni"].status == "ok"
    long = commands.widen(rows, slices, fasta.contigs(spark, path), buffer=1000, max_length=100).collect()
    assert {r.status for r in long} == {"TOOLONG", "symbolic"}


def test_delta_files_and_extension(spark, tmp_path, genome):
    path, chrom, _ = genome
    contig = chrom[100:900] + chrom[960:1800]  # a deletion of 60 bases
    back = contig.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    query = tmp_path / "q.fa"
    query.write_text(f">q\n{contig}\n>r\n{back}\n")
    n = len(contig)
    text = f"ref query\nNUCMER\n>1 q {len(chrom)} {n}\n111 890 11 790 0 0 0\n0\n965 1790 805 1630 0 0 0\n0\n>1 r {len(chrom)} {n}\n111 890 {n - 10} {n - 789} 0 0 0\n0\n"
    delta = tmp_path / "a.delta"
    delta.write_text(text)
    rows = SA.read_delta(spark, [str(delta)])
    ref, qry = (fasta.slicer(fasta.chunks(spark, p)) for p in (path, str(query)))
    got = sorted((r.query_entry, r.ref_start, r.ref_end, r.query_start, r.query_end, r.cigar) for r in A.extended(rows, ref, qry).collect())
    right = 900
    while chrom[right] == contig[right - 100]:
        right += 1
    left = 960
    while chrom[left - 1] == contig[left - 1 - 160]:
        left -= 1
    assert got == [("q", 101, right, 1, right - 100, f"{right - 100}M"), ("q", left + 1, 1800, left - 159, n, f"{n - left + 160}M"), ("r", 101, right, n, n - (right - 101), f"{right - 100}M")]
    assert SA.read_delta(spark, [str(delta)], query_entry="r").count() == 1
    regions = spark.createDataFrame([("g", "1", 850, 1000), ("far", "1", 5000, 5100), ("edge", "1", 5, 20)], "region_id string, chrom string, start bigint, end bigint")
    found = commands.refine(A.extended(rows, ref, qry), regions, fasta.contigs(spark, path), buffer=20, segment=10)
    v = found.variants.collect()
    assert [(r.svtype, r.svkind in ("SIMPLEDEL", "CONTRAC"), r.pos <= 900 <= r.sv_end, r.query_entry) for r in v] == [("DEL", True, True, "q")]
    assert {r.region_id for r in found.uncovered.collect()} == {"far"} and {(r.region_id, r.status) for r in found.status.collect()} >= {("edge", "CHROMEND"), ("g", "SIMPLE")}
    assert sinks.refined_lines(found.variants.withColumns({"refseq": F.lit("N"), "altseq": F.lit("<DEL>")})).first().line.startswith("1\t")
    with pytest.raises(ValueError):
        list(SA.parse_entry(text.split("\n>")[1].replace("111 890 11 790", "111 890 11 780")))


def test_sam_and_bam(spark, tmp_path):
    import gzip
    import struct

    sam = ["@HD\tVN:1.6", "q\t0\t1\t11\t40\t5H10M2D3M\t*", "q\t16\t1\t50\t40\t4S6M\t*", "q\t256\t1\t50\t40\t6M\t*", "q\t4\t*\t0\t0\t*\t*"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(sam)], "file string, line_no bigint, line string")
    rows = [(r.ref_start, r.ref_end, r.query_start, r.query_end, r.comp, r.cigar, r.query_len) for r in SA.from_sam(df).orderBy("align_no").collect()]
    assert rows == [(11, 25, 6, 18, 0, "10M2D3M", 18), (50, 55, 6, 1, 1, "6M", 10)]
    record = lambda name, flag, pos, ops: (lambda body: struct.pack("<i", len(body)) + body)(struct.pack("<iiBBHHHiiii", 0, pos, len(name) + 1, 40, 0, len(ops), flag, 0, -1, -1, 0) + name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in ops))
    data = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 2) + b"1\0" + struct.pack("<i", 900) + record("q", 0, 10, [(5, "H"), (10, "M"), (2, "D"), (3, "M")]) + record("q", 16, 49, [(4, "S"), (6, "M")])
    path = tmp_path / "x.bam"
    path.write_bytes(gzip.compress(data[:40]) + gzip.compress(data[40:]))
    assert [(r.ref_start, r.ref_end, r.query_start, r.query_end, r.comp, r.cigar, r.query_len) for r in SA.read_bam(spark, [str(path)]).orderBy("align_no").collect()] == rows


def test_line_formats(spark, tmp_path):
    lines = lambda *x: spark.createDataFrame([(y,) for y in x], "line string")
    assert [tuple(r) for r in tabular.bed(lines("1\t4\t9\tx", "1\t9\t4", "junk", "# c")).collect()] == [("1", 5, 9, "ok"), ("1", 10, 4, "reversed"), (None, None, None, "malformed")]
    gap = tabular.show_diff_gaps(lines("1\tGAP\t10\t20\t11\t5\t6", "1\tBRK\t1\t2\t3"))
    assert [tuple(r) for r in gap.collect()] == [("1", 10, 20, 11, 5, 6)]
    assert tabular.coords(lines("\t".join(map(str, [1, 9, 2, 8, 9, 7, 99.5, 100, 90, 9.0, 8.0, "r", "q"])), "1\t2")).first().query_entry == "q"
    assert [tuple(r) for r in tabular.manifest(lines("s a.vcf a.cov a.delta", "", "#x")).collect()] == [("s", "a.vcf", "a.cov", "a.delta")]
    ok = tmp_path / "a.vcf"
    ok.write_text("x")
    listed = tmp_path / "f.fof"
    listed.write_text(f"# c\n{ok}\n/nowhere\n")
    assert tabular.file_list([], [str(listed)]) == [str(ok)]
    with pytest.raises(ValueError):
        tabular.file_list([], [])
    alignments = spark.createDataFrame([("1", "c", 0, 1, 9, 1, 9, "9M"), ("1", "c", 0, 21, 30, 16, 25, "10M")], "ref_entry string, query_entry string, comp int, ref_start bigint, ref_end bigint, query_start bigint, query_end bigint, cigar string")
    gaps = tabular.show_diff_gaps(lines("1\tGAP\t10\t20\t11\t6\t5", "1\tGAP\t10\t20\t11\t5\t6"))  # the second isn't what the alignments leave
    assert [r.svkind for r in commands.gap_variants(gaps, alignments).collect()] == ["SUBSDEL"]


def test_small_pieces(spark):
    assert sinks.with_header_lines(["##a", "#CHROM"], ("##INFO=<x>",)) == ["##a", "##INFO=<x>", "#CHROM"]
    assert sinks.with_header_lines(["##INFO=<a>", "##z", "#CHROM"], ("##INFO=<a>", "##INFO=<b>")) == ["##INFO=<a>", "##INFO=<b>", "##z", "#CHROM"]
    assert sinks.distance_header(True).endswith("NOSUBS\tNOINDELS\tMAR\tSUBSDIST\tINDELDIST") and len(sinks.refine_header("S", "20260101")) == 13
    nums = spark.createDataFrame([(0.1 + 0.2,), (5.0,), (1e-20,), (None,)], "x double").select(sinks.number(F.col("x")).alias("s")).collect()
    assert [r.s for r in nums] == ["0.3", "5", "1e-20", "NaN"]
    t = spark.createDataFrame([("GATTACA", "GATACA"), ("A", "ACC"), ("AC", "GT"), ("AAA", "A")], "r string, a string").select(S.trim_alleles(F.col("r"), F.col("a")).alias("t")).collect()
    assert [tuple(x.t) for x in t] == [("GAT", "T", "", "ACA"), ("A", "", "CC", ""), ("", "AC", "GT", ""), ("A", "AA", "", "")]


def test_streaming_of_dropped_files(spark, tmp_path):
    from strandline.streaming import filedrop

    raw = spark.createDataFrame([(1, "1\t5\tx\tA\tC\t.\t.\t.\tGT\t0"), (2, "1\tx\tx\tA\tC\t.\t.\t.\tGT\t0"), (3, "# note"), (4, "short")], "line_id bigint, raw_line string")
    assert {r.outcome: r.n for r in filedrop.line_outcomes(raw).collect()} == {"loaded": 1, "pos": 1, "columns": 1}
    drop, out = tmp_path / "in", tmp_path / "out"
    one = vcf_rows(spark, [("1", 5, "a", "A", "AC", ".", ".", "")]).selectExpr("id call_id", "chrom", "pos")
    one.write.parquet(str(drop))
    schema = "call_id string, chrom string, pos bigint"
    for expected in (1, 3):
        filedrop.each_batch(filedrop.watch(spark, str(drop), schema), lambda b: b.groupBy("chrom").count(), str(out), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(out)).agg(F.sum("count")).first()[0] == expected
        one.union(one).write.mode("append").parquet(str(drop))


def test_command_line(spark, tmp_path, genome):
    from strandline import cli

    path, chrom, _ = genome
    vcf_path = tmp_path / "a.vcf"
    body = "\n".join("\t".join(map(str, c)) for c in calls(chrom))
    vcf_path.write_text("##fileformat=VCFv4.2\n##INFO=<ID=SVTYPE,Number=1>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n" + body + "\n")
    cli.main(["widen", "--variants", str(vcf_path), "--ref", path, "--prefix", str(tmp_path / "w"), "--buffer", "500"])
    text = [r.value for r in spark.read.text(str(tmp_path / "w.vcf/01-records")).collect()]
    assert len(text) == 9 and all("REFWIDENED=1:" in x for x in text)
    cli.main(["vcffilter", "--vcf", str(vcf_path), "--out", str(tmp_path / "f"), "--svtype", "DEL", "--region", "1:1-1500"])
    assert spark.read.text(str(tmp_path / "f/01-records")).count() == 2
    cli.main(["merge", "--ref", path, "--variants", str(vcf_path), "--prefix", str(tmp_path / "m")])
    assert all("NumClusterSVs=1" in r.value for r in spark.read.text(str(tmp_path / "m.clustered.vcf/01-records")).collect())
    cli.main(["benchmark", "--ref", path, "--test", str(vcf_path), "--truth", str(vcf_path), "--prefix", str(tmp_path / "b")])
    assert spark.read.text(str(tmp_path / "b.fp.vcf/01-records")).count() == 0


@pytest.mark.parametrize("size", [40, 1000, 100_000])
def test_lines_of_files_are_numbered_by_place(spark, tmp_path, size):
    import gzip

    for k, n in enumerate((3, 0, 700)):
        (tmp_path / f"{k}.txt").write_text("".join(f"line {i}\n" for i in range(1, n + 1)))
    with gzip.open(tmp_path / "z.txt.gz", "wt") as file:
        file.write("line 1\nline 2\n")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = vcf.read_lines(spark, [str(tmp_path)]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert len(got) == 705 and all(r.line == f"line {r.line_no}" for r in got) and len({(r.file, r.line_no) for r in got}) == 705


@pytest.mark.parametrize("size", [60, 100_000])
def test_delta_files_are_read_in_pieces(spark, tmp_path, size):
    entries = [(f"r{i % 5}", f"q{i}", [(1 + j, 100 + j, 5, 104, [4, -3] * (j % 2)) for j in range(1 + i % 3)]) for i in range(40)]
    path = tmp_path / "a.delta"
    path.write_text("/x/ref.fa /x/query.fa\nNUCMER\n" + "".join(f">{r} {q} 900 800\n" + "".join(f"{a} {b} {c} {d} 1 1 0\n" + "".join(f"{o}\n" for o in offsets) + "0\n" for a, b, c, d, offsets in rows) for r, q, rows in entries))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = SA.read_delta(spark, [str(path)]).orderBy("align_no").collect()
        one = SA.read_delta(spark, [str(path)], query_entry="q7").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    want = [(r, q, a, b) for r, q, rows in entries for a, b, *_ in rows]
    assert [(r.ref_entry, r.query_entry, r.ref_start, r.ref_end) for r in got] == want and [r.align_no for r in got] == list(range(1, len(want) + 1))
    assert len(one) == 2 and {r.query_len for r in one} == {800}


def brute_slices(region, rows, buffer, segment):
    """The slice by walking over the contig's alignments in order."""
    _, chrom, start, end = region
    out = []
    for row in sorted(rows, key=lambda r: (r[2], r[3], r[6])):
        if not out and not (row[0] == chrom and row[3] > start - buffer + segment - 1):
            continue
        if out and row[0] == chrom and row[2] > end + buffer - segment + 1:
            if len(out) == 2:
                out.append(row)
            break
        out.append(row)
    return [r[6] for r in out]


@pytest.mark.parametrize("bin_size", [16, 1 << 16])
def test_slices_of_regions_equal_a_walk_over_each_contig(spark, bin_size):
    rng = random.Random(21)
    rows = [(rng.choice("ab"), f"q{i % 4}", s := rng.randint(1, 400), s + rng.randint(1, 150), 1, 100, i, rng.randint(0, 1)) for i in range(120)]
    regions = [(f"g{i}", rng.choice("ab"), s := rng.randint(20, 350), s + rng.randint(0, 60)) for i in range(60)]
    df = spark.createDataFrame(rows, "ref_entry string, query_entry string, ref_start bigint, ref_end bigint, query_start bigint, query_end bigint, align_no bigint, comp int")
    rdf = spark.createDataFrame(regions, "region_id string, chrom string, start bigint, end bigint")
    for buffer, segment in ((5, 4), (0, 50)):
        pairs = V.spanning_pairs(rdf, df, buffer, segment, bin_size).collect()
        over = lambda r, a, b: r[2] < a and r[3] > b
        want = set()
        for g in regions:
            for q in {r[1] for r in rows}:
                mine = [r for r in rows if r[1] == q and r[0] == g[1]]
                for c in (0, 1):
                    sides = [[r for r in mine if r[7] == c and over(r, a, b)] for a, b in ((g[2] - buffer, g[2] - buffer + segment - 1), (g[3] + buffer - segment + 1, g[3] + buffer))]
                    if all(sides):
                        want.add((g[0], q))
        assert {(p.region_id, p.query_entry) for p in pairs} == want and len(pairs) == len(want) > (5 if segment < 50 else 0)
        got = {}
        for r in A.region_slices(spark.createDataFrame(pairs, "region_id string, chrom string, start bigint, end bigint, query_entry string, comp int"), df, buffer, segment, bin_size).orderBy("n").collect():
            got.setdefault((r.region_id, r.query_entry), []).append(r.align_no)
        assert got == {(p.region_id, p.query_entry): brute_slices((p.region_id, p.chrom, p.start, p.end), [r for r in rows if r[1] == p.query_entry], buffer, segment) for p in pairs}


def test_merged_regions_equal_a_sweep(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), s := rng.randint(0, 3_000_000) if i % 3 else rng.randint(0, 900), s + rng.choice([0, 1, 40, 2_000_000 if i % 50 == 0 else 7])) for i in range(400)] + [("a", 5_000_000, 5_000_001), ("a", 5_000_002, 5_000_003), ("a", 5_000_003, 5_000_009)]
    want = []
    for key in "abc":
        reach = None
        for _, s, e in sorted(r for r in rows if r[0] == key):
            if reach is None or s > reach:
                want.append([key, s, e])
                reach = e
            else:
                reach = max(reach, e)
                want[-1][2] = reach
    got = V.merge_regions(spark.createDataFrame([*rows, (None, 1, 2), ("a", None, 2)], "k string, start bigint, end bigint"), "k").collect()
    assert sorted([list(r) for r in got]) == sorted(want)


def test_numbers_and_neighbours_by_order_within_keys(spark):
    from strandline.operators import ordering

    rng = random.Random(6)
    rows = [(rng.choice(["hot"] * 20 + ["a", "b", None]), rng.randint(0, 400), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, p int, i int")
    by = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        by.setdefault(r[0], []).append(r)
    number = {r.i: r.n for r in ordering.ranked(df, ["k"], ["p", "i"], "n").collect()}
    before = {r.i: r.x and tuple(r.x) for r in ordering.with_previous(df, ["k"], ["p", "i"], ["p", "i"], "x").collect()}
    for mine in by.values():
        assert [number[r[2]] for r in mine] == list(range(1, len(mine) + 1))
        assert [before[r[2]] for r in mine] == [None, *(r[1:] for r in mine[:-1])]
    assert ordering.ranked(df.limit(0), ["k"], ["p"], "n").count() == 0

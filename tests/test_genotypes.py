import random

from strandline.plans import commands
from strandline.sources import fasta


def test_nearby_variants_must_match(spark):
    rng = random.Random(7)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    chrom, inserted = dna(3000), dna(100)
    base = lambda pos: chrom[pos - 1]

    def row(sample, contig, line_no, pos, ref, alt, svtype):
        return (contig, contig, line_no, sample, "1", pos - line_no, pos + len(ref) + line_no, float(pos), svtype, len(alt) - len(ref), pos, pos + len(ref) - 1, ref, alt, len(ref), len(alt), None)

    schema = "target_id string, contig string, line_no bigint, sample string, chrom string, wide_start bigint, wide_end bigint, wide_mean double, svtype string, svlen bigint, pos bigint, end bigint, ref string, alt string, reflength bigint, altlength bigint, deleted_to bigint"
    target = spark.createDataFrame([row("t", "t1", 1, 1000, base(1000), base(1000) + inserted, "INS")], schema)
    samples = spark.createDataFrame(
        [
            row("same", "s2", 5, 1000, base(1000), base(1000) + inserted, "INS"), row("same", "s1", 6, 1000, base(1000), base(1000) + inserted, "INS"),
            row("other_bases", "o1", 2, 1300, base(1300), base(1300) + dna(100), "INS"),
            row("deletion", "d1", 2, 1010, chrom[1009:1110], base(1010), "DEL"),
            row("larger", "l1", 2, 1001, base(1001), base(1001) + dna(400), "INS"),
            row("too_far", "f1", 2, 2900, base(2900), base(2900) + inserted, "INS"),
        ],
        schema,
    )
    none = spark.createDataFrame([], "sample string, chrom string, hr_start bigint, hr_end bigint, contig string")
    slices = fasta.slicer(spark.createDataFrame([("1", 0, chrom)], "chrom string, chunk bigint, seq string"))
    got = lambda s, far: {r.sample: r.genotype for r in commands.back_genotype(target, samples, none, s, far).collect()}
    assert got(slices, 1500) == {"t": "1", "same": "1"}
    assert got(None, 1500) == {"t": "1", "same": "1", "other_bases": "1"}
    assert set(got(None, commands.BACK_DIST)) == {"t", "same", "other_bases", "too_far"}

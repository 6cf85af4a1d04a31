"""Back-genotyping of one sample's variants in others, and reconciling genotypes of polymorphisms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import distances as D
from strandline.operators.bandjoin import band_join, overlap_join

EXACT = ("chrom", "wide_start", "wide_end", "svtype", "svlen")
_ALLELES = ("pos", "end", "ref", "alt", "reflength", "altlength")


def exact_genotypes(target: DataFrame, samples: DataFrame) -> DataFrame:
    """``target_id, sample, contig, allele`` (1) where a sample has the same widened interval, type and length."""
    theirs = samples.select(*EXACT, "sample", "contig").distinct()
    return target.select("target_id", *EXACT).join(theirs, list(EXACT)).select("target_id", "sample", "contig", F.lit("1").alias("allele"), F.lit("EXACT").alias("how"))


def nearby_pairs(target: DataFrame, samples: DataFrame, max_dist: int, done: DataFrame, extra=None) -> DataFrame:
    """Pairs whose widened means lie less than ``max_dist`` apart, as ``a_*`` and ``b_*``; a target and sample that matched exactly are passed over."""
    side = lambda rows, s, *more: rows.select("chrom", *more, F.col("wide_mean").alias(f"{s}_mean"), F.col("chrom").alias(f"{s}_chrom"), *(F.col(c).alias(f"{s}_{c}") for c in _ALLELES))
    pairs = band_join(side(target, "a", "target_id"), side(samples, "b", "sample", "contig", "line_no"), ["chrom"], "a_mean", "b_mean", max_dist, strict=True, extra=extra)
    return pairs.join(done.select("target_id", "sample"), ["target_id", "sample"], "left_anti")


def any_nearby(pairs: DataFrame) -> DataFrame:
    """An allele 1 for each contig of :func:`nearby_pairs`, whatever its variant is."""
    return pairs.select("target_id", "sample", "contig", F.lit("1").alias("allele"), F.lit("NEARBY").alias("how")).distinct()


def nearby_genotypes(target: DataFrame, samples: DataFrame, max_dist: int, done: DataFrame, slices=None) -> DataFrame:
    """One allele 1 for a target and sample: the first variant in file order, less than ``max_dist`` away by the widened mean, that matches.

    It matches if it is a potential match by size and its distance record says MATCH. The record
    needs reference bases (``slices``); without them the size alone decides. Symbolic alleles, whose
    length isn't known, never match.
    """
    pairs = nearby_pairs(target, samples, max_dist, done, D.potential_match())
    if slices is not None:
        keys = ("target_id", "sample", "contig", "line_no")
        aligned = D.aligned(D.haplotypes(pairs, slices)).withColumns({"a_id": F.struct(*keys), "b_id": F.lit(None).cast("string")})
        pairs = D.distance_record(aligned).where(F.col("match_type").contains("MATCH")).select("id1.*")
    first = pairs.groupBy("target_id", "sample").agg(F.min(F.struct("line_no", "contig")).alias("f"))
    return first.select("target_id", "sample", "f.contig", F.lit("1").alias("allele"), F.lit("NEARBY").alias("how"))


def reference_alleles(target: DataFrame, coverage: DataFrame, bin_size: int = 1 << 18) -> DataFrame:
    """One allele 0 for each homozygous-reference stretch (sample, contig, start, end) that strictly contains the widened interval."""
    within = (F.col("hr_start") < F.col("wide_start")) & (F.col("hr_end") > F.col("wide_end"))
    points = target.select("target_id", "chrom", "wide_start", "wide_end").withColumns({"_p": F.col("wide_start"), "_q": F.col("wide_start")})
    hits = overlap_join(points, coverage.select("sample", "chrom", "hr_start", "hr_end", "contig"), ["chrom"], ("_p", "_q"), ("hr_start", "hr_end"), bin_size, within)
    rows = hits.select("target_id", "sample", "contig", "hr_start", "hr_end").distinct()
    return rows.select("target_id", "sample", "contig", F.lit("0").alias("allele"), F.lit("REF").alias("how"))


def genotype_strings(alleles: DataFrame) -> DataFrame:
    """``target_id, sample, genotype, kinds``: all alleles, sorted and joined by ``/``, and the kind of each (H, or L for a match nearby), joined by commas.

    A target and sample have as many alleles as stretches and matches.
    """
    kind = F.when(F.col("how") == "NEARBY", "L").otherwise("H")
    listed = F.sort_array(F.collect_list(F.struct("allele", kind.alias("kind"))))
    part = lambda c, by: F.array_join(F.transform("x", lambda y: y[c]), by)
    return alleles.groupBy("target_id", "sample").agg(listed.alias("x")).select("target_id", "sample", part("allele", "/").alias("genotype"), part("kind", ",").alias("kinds"))


def genotype_table(strings: DataFrame, samples: list[str]) -> DataFrame:
    """One column for each sample, ``.`` where nothing is known."""
    return strings.groupBy("target_id").pivot("sample", samples).agg(F.first("genotype")).na.fill(".", samples)


def reconcile(genotypes: DataFrame) -> DataFrame:
    """All genotypes of a source get the alleles of its best one.

    ``locus, source, read_name, allele1, allele2, score``. The new score is the best one plus a quarter
    of the scores that agree and minus those that don't. Rows without a source stay as they are; of
    equally good ones the least read name decides.
    """
    keyed = genotypes.where(F.col("source").isNotNull())
    best = keyed.groupBy("locus", "source").agg(F.min(F.struct((-F.col("score")).alias("neg"), "read_name", "allele1", "allele2")).alias("b"))
    rows = keyed.join(best, ["locus", "source"])
    own = F.col("read_name") == F.col("b.read_name")
    agrees = (F.col("allele1") == F.col("b.allele1")) & (F.col("allele2") == F.col("b.allele2"))
    delta = rows.groupBy("locus", "source").agg(F.sum(F.when(own, 0.0).when(agrees, 0.25 * F.col("score")).otherwise(-1.0 * F.col("score"))).alias("d"))
    out = rows.join(delta, ["locus", "source"]).select("locus", "source", "read_name", F.col("b.allele1").alias("allele1"), F.col("b.allele2").alias("allele2"), (-F.col("b.neg") + F.col("d")).alias("score"))
    return out.unionByName(genotypes.where(F.col("source").isNull()).select("locus", "source", "read_name", "allele1", "allele2", F.col("score").cast("double").alias("score")))


def polymorphism_scores(genotypes: DataFrame, reference: DataFrame) -> DataFrame:
    """``locus, score``: the best score of a genotype that isn't homozygous for the reference allele (``locus, ref_allele``)."""
    rows = genotypes.join(reference, "locus", "left")
    other = ~((F.col("allele1") == F.col("ref_allele")) & (F.col("allele2") == F.col("ref_allele")))
    return rows.groupBy("locus").agg(F.max(F.when(other, F.col("score"))).alias("score"))


def alleles_seen(genotypes: DataFrame) -> DataFrame:
    """The distinct alleles of each locus, sorted."""
    return genotypes.select("locus", F.explode(F.array("allele1", "allele2")).alias("a")).groupBy("locus").agg(F.sort_array(F.collect_set("a")).alias("alleles"))


def last_genotypes(genotypes: DataFrame, order: str) -> DataFrame:
    """Adding genotypes one after the other: the last by read name stays."""
    w = Window.partitionBy("locus", "read_name").orderBy(F.desc(order))
    return genotypes.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")

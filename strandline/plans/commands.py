"""The commands as pipelines of operators: benchmark, merge, comp, refine, widen, back-genotype and the converters."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import cigar as C
from strandline.functions import info as I
from strandline.functions.sequence import repeat_extents_udf, trim_alleles
from strandline.operators import alignments as A
from strandline.operators import clusters as K
from strandline.operators import distances as D
from strandline.operators import genotype as G
from strandline.operators import intervals as V
from strandline.operators.bandjoin import band_join, band_self_pairs
from strandline.operators.ordering import ranked
from strandline.operators.scoring import Benchmark, read_fraction, read_support, score, size_passes
from strandline.session import durable
from strandline.sources import vcf
from strandline.sources.fasta import Slices

_SIDE = ("id", "pos", "end", "ref", "alt", "reflength", "altlength")


def _side(svs: DataFrame, side: str, key: str) -> DataFrame:
    return svs.select("chrom", F.col(key).alias(f"{side}_key"), *(F.col(c).alias(f"{side}_{c}") for c in _SIDE), F.col("chrom").alias(f"{side}_chrom"))


def pair_distances(pairs: DataFrame, slices: Slices) -> DataFrame:
    """Distance records of candidate pairs, with ``a_key, b_key`` where the pairs have them; pairs that leave their contig drop out."""
    aligned = D.aligned(D.haplotypes(pairs, slices)).where(F.col("hap_a").isNotNull() & F.col("hap_b").isNotNull())
    keys = [c for c in ("a_key", "b_key") if c in aligned.columns]
    record = D.distance_record(aligned.withColumn("a_id", F.struct("a_id", *keys)))
    return record.select(F.col("id1.a_id").alias("id1"), *(c for c in record.columns if c != "id1"), *(F.col(f"id1.{k}").alias(k) for k in keys))


@dataclass(frozen=True)
class BenchmarkParams:
    max_dist: int = 50_000
    min_size: int = 0
    min_read_support: int | None = None
    min_read_fraction: float | None = None
    test_filter: str | None = None
    truth_filter: str | None = None
    shift: float = 0.2
    size: float = 0.2
    dist: float = 0.2
    max_subs_rate: float | None = None
    max_indel_rate: float | None = None

    def accepted(self) -> Column:
        if self.max_subs_rate is not None and self.max_indel_rate is not None:
            return D.rate_match(self.max_subs_rate, self.max_indel_rate)
        return D.classic_match(self.shift, self.size, self.dist)


def filtered(records: DataFrame, filter_value: str | None) -> DataFrame:
    """Records with one value of FILTER; all without one."""
    return records if filter_value is None else records.where(F.col("filter") == filter_value)


def prepared(records: DataFrame, prefix: str, filter_value: str | None, regions: DataFrame | None) -> DataFrame:
    """Sequence-specific records with a unique ``key`` (file and line), restricted to a FILTER value and to regions."""
    svs = vcf.normalized(filtered(records, filter_value)).where("status = 'ok' and pos > 0").withColumn("key", F.concat_ws(":", "file", F.col("line_no").cast("string")))
    if regions is not None:
        svs = V.touching(svs, regions, ["key"])
    return vcf.with_running_ids(svs, prefix, ["chrom", "pos", "key"])


def benchmark(test: DataFrame, truth: DataFrame, slices: Slices, params: BenchmarkParams = BenchmarkParams(), regions: DataFrame | None = None, distances: DataFrame | None = None) -> Benchmark:
    """Scores test records against truth records. Distances may be given, by ids; else the result has those of all pairs that were aligned."""
    mine, theirs = prepared(test, "testsv", params.test_filter, regions), prepared(truth, "truesv", params.truth_filter, regions)
    mine, theirs = durable(vcf.with_deleted_bases(mine, slices), "test"), durable(vcf.with_deleted_bases(theirs, slices), "truth")
    if distances is None:
        pairs = band_join(_side(mine, "a", "key"), _side(theirs, "b", "key"), ["chrom"], "a_pos", "b_pos", params.max_dist, extra=D.potential_match())
        distances = durable(pair_distances(pairs, slices), "distances")
        found = distances.where(params.accepted()).select(F.col("a_key").alias("test_key"), F.col("b_key").alias("truth_key"))
    else:
        rows = distances.where(params.accepted()).select("id1", "id2")
        rows = rows.join(mine.select(F.col("id").alias("id1"), F.col("key").alias("test_key")), "id1").join(theirs.select(F.col("id").alias("id2"), F.col("key").alias("truth_key")), "id2")
        found = rows.select("test_key", "truth_key")
    size = I.variant_size(F.col("info"), F.col("ref"), F.col("alt"))
    mine, theirs = mine.where(size_passes(size, params.min_size, False) | F.lit(params.min_size <= 0)), theirs.where(size_passes(size, params.min_size, True))
    if params.min_read_support is not None:
        mine = read_support(mine, params.min_read_support)
    if params.min_read_fraction is not None:
        mine = read_fraction(mine, params.min_read_fraction)
    return replace(score(mine, theirs, durable(found.distinct(), "matches"), "key"), distances=distances)


@dataclass(frozen=True)
class MergeParams:
    max_dist: int = 2_000
    shift: float = 0.2
    size: float = 0.2
    dist: float = 0.2
    min_size: int = 0
    max_subs_rate: float | None = None
    max_indel_rate: float | None = None

    def by_rates(self) -> bool:
        return self.max_subs_rate is not None and self.max_indel_rate is not None

    def accepted(self) -> Column:
        return D.rate_match(self.max_subs_rate, self.max_indel_rate) if self.by_rates() else D.classic_match(self.shift, self.size, self.dist)


@dataclass(frozen=True)
class Merged:
    """The clusters' rows, and the distances they rest on."""

    clusters: DataFrame
    distances: DataFrame


def merge(records: DataFrame, slices: Slices, params: MergeParams = MergeParams(), distances: DataFrame | None = None, delimiter: str = ":", seqspecific: bool = False) -> Merged:
    """One row for each cluster of equivalent calls of several files (and each call outside the graph): the representative's record, the cluster's sizes, member lists and largest distances.

    An id that comes twice is an error. With ``seqspecific`` the calls outside the graph don't come. Under the rate rule the largest distances are ``max_subs``
    and ``max_indel``.
    """
    svs = durable(vcf.with_deleted_bases(vcf.normalized(records, params.min_size), slices), "svs")
    twice = svs.groupBy("id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"the id {twice[0]['id']} comes more than once")
    nodes = svs.where("status = 'ok' and pos > 0")
    if distances is None:
        pairs = band_self_pairs(nodes.withColumn("c", F.col("chrom")), ["chrom"], "pos", ["id"], [*_SIDE, "c"], params.max_dist)
        pairs = pairs.withColumnsRenamed({"a_c": "a_chrom", "b_c": "b_chrom"}).where(D.potential_match(params.size, params.shift))
        distances = durable(pair_distances(pairs, slices), "distances")
    members = durable(K.cluster_calls(nodes.select("id"), distances, params.accepted()), "members")
    chosen = K.cluster_sizes(members).join(K.cluster_lists(members, delimiter), "cluster").join(K.cluster_distances(members, distances, params.accepted(), params.by_rates()), "cluster", "left")
    largest = K.RATE_MAXIMA if params.by_rates() else K.MAXIMA
    chosen = chosen.na.fill(0.0, list(largest)).withColumnRenamed("representative", "id")
    alone = K.unclustered(svs, members).where(~F.col("in_graph") & F.lit(not seqspecific)).select("id")
    picked = chosen.unionByName(alone.withColumns({"n_calls": F.lit(1).cast("bigint"), "n_exact": F.lit(1).cast("bigint"), "member_ids": F.col("id"), "exact_ids": F.col("id")}), allowMissingColumns=True)
    return Merged(records.join(picked.drop("cluster"), "id"), distances)


def compare_in_order(first: DataFrame, second: DataFrame, slices: Slices | None = None, ignore_length: bool = False, pair: tuple[str, ...] = (), order: tuple[str, ...] = ("line_no",), keep: tuple[str, ...] = ()) -> DataFrame:
    """The n-th record of one file with the n-th of the other (by ``line_no``), as distance records.

    Several pairs of files are told apart by the columns ``pair``; ``keep`` are further columns for
    ``a_*`` and ``b_*``.

    ``status`` is ``missing`` where one side ends early, ``DIFFCHROMS``, or why a record can't be
    compared. Without ``slices`` only the columns that need no bases are there.
    """
    sides = []
    for rows, side in ((first, "a"), (second, "b")):
        form = vcf.comparable(rows, ignore_length).withColumns({"reflength": F.length("ref").cast("bigint"), "altlength": F.length("alt").cast("bigint")})
        form = ranked(form, ["file"], list(order), "n")
        sides.append(form.select(*pair, "n", *(F.col(c).alias(f"{side}_{c}") for c in (*_SIDE, "chrom", "status", *keep))))
    both = sides[0].join(sides[1], [*pair, "n"], "full")
    status = F.when(F.col("a_status").isNull() | F.col("b_status").isNull(), "missing").when(~F.col("a_chrom").eqNullSafe(F.col("b_chrom")), "DIFFCHROMS").when(F.col("a_status") != "ok", F.col("a_status")).when(F.col("b_status") != "ok", F.col("b_status")).otherwise("ok")
    both = both.withColumn("status", status)
    if slices is None:
        return both.withColumns({"avgsize": (D.sizes("a") + D.sizes("b")) / 2, "sizediff": D.sizes("a") - D.sizes("b"), "posdiff": F.col("a_pos") - F.col("b_pos"), "marlength": D.affected_length()})
    return pair_distances(both.where("status = 'ok'"), slices)


@dataclass(frozen=True)
class Refined:
    """The parts of :func:`refine`, each worked out when it is first asked for.

    ``pairs`` are joined from ``regions`` and ``rows`` each time: for ``status``, for ``uncovered``, and once for ``found``, on which the others rest.
    ``inversions`` hold those that failed the symmetry rules too, by ``status``.
    """

    regions: DataFrame
    chrom_ends: DataFrame
    rows: DataFrame
    pairs: DataFrame
    max_size: int

    @cached_property
    def found(self) -> DataFrame:
        """What is stored of the pairs: a row for each that may hold a variant, and for each spanning alignment (without ``kind``) its number of ``regions``."""
        place = ("region_id", "start", "end", "n_ref")
        none = [F.lit(None).cast(self.pairs.schema[c].dataType).alias(c) for c in place]
        spanning = F.transform("spans", lambda n: F.struct(n.alias("n"), *none, F.lit(None).cast("string").alias("kind")))
        broken = F.filter(F.array(F.struct(F.col("first").alias("n"), *place, F.col("status").alias("kind"))), lambda x: x["kind"].isin("SIMPLE", "INVERSION"))
        rows = self.pairs.select("query_entry", "chrom", F.explode(F.concat(spanning, broken)).alias("x")).select("query_entry", "chrom", "x.*")
        return durable(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("regions")), "found")

    def _details(self, numbers: DataFrame) -> DataFrame:
        details = self.rows.select("query_entry", "chrom", "n", F.col("chrom").alias("ref_entry"), "align_no", "ref_start", "ref_end", "query_start", "query_end", "comp", "cigar")
        return numbers.join(details, ["query_entry", "chrom", "n"])

    def _slices(self, kind: str) -> DataFrame:
        number = F.explode(F.sequence(F.col("n"), (F.col("n") + F.col("n_ref") - 1).cast("int"))).alias("n")
        return self._details(self.found.where(F.col("kind") == kind).select("region_id", "chrom", "query_entry", number))

    @cached_property
    def spanning(self) -> DataFrame:
        """``chrom, r_start, r_end, query_entry, query_start, query_end`` of each alignment over whole regions, once, with the number of ``regions``."""
        over = self._details(self.found.where("kind is null").select("query_entry", "chrom", "n", "regions"))
        return over.select("chrom", F.col("ref_start").alias("r_start"), F.col("ref_end").alias("r_end"), "query_entry", "query_start", "query_end", "regions")

    def _flags(self, rows: DataFrame) -> DataFrame:
        keyed = rows.withColumn("_k", F.xxhash64("region_id", "query_entry", "pos", "sv_end", "altpos", "altend"))
        return V.covered_flags(keyed, self.spanning.select("chrom", "r_start", "r_end"), ["_k"], "pos", "sv_end").drop("_k")

    @cached_property
    def variants(self) -> DataFrame:
        breaks = A.classified(A.consecutive_breaks(self._slices("SIMPLE"), ["region_id", "query_entry"], ["n"])).withColumn("status", A.break_status(self.max_size))
        called = durable(A.output_coordinates(A.widened(breaks.where("status = 'ok'"))), "called")
        return self._flags(called.where("status = 'ok'"))

    @cached_property
    def inversions(self) -> DataFrame:
        return self._flags(durable(A.inversions(self._slices("INVERSION"), ["region_id", "query_entry"], ["n"]), "inverted"))

    @cached_property
    def coverage(self) -> DataFrame:
        """A row for each region of each alignment of ``spanning``."""
        return self.spanning.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("regions")))).drop("regions", "_i")

    @cached_property
    def uncovered(self) -> DataFrame:
        return V.uncovered(self.regions, self.pairs.select("region_id").distinct())

    @cached_property
    def status(self) -> DataFrame:
        chrom_end = self.chrom_ends.select("region_id", F.lit(None).cast("string").alias("query_entry"), F.lit(0).cast("bigint").alias("n_ref"), F.lit("CHROMEND").alias("status"))
        return self.pairs.select("region_id", "query_entry", "n_ref", "status").unionByName(chrom_end)


def refine(alignments: DataFrame, regions: DataFrame, contigs: DataFrame, buffer: int = 0, segment: int = 50, max_size: int = 0, bin_size: int = V.BIN) -> Refined:
    """Variants, homozygous-reference stretches and uncovered regions from alignments of contigs (``region_id, chrom, start, end`` regions)."""
    named = durable(contigs.join(F.broadcast(regions.select("chrom").distinct()), "chrom", "left_semi").select("chrom", "contig_len"), "named")
    inside = V.away_from_edges(regions, F.broadcast(named), buffer)
    usable = inside.where("status = 'ok'").drop("status")
    levels = durable(A.region_levels(usable, buffer, segment, bin_size), "levels")
    rows = durable(A.placed(alignments, levels), "placed")
    return Refined(usable, inside.where("status = 'chromend'"), rows, A.region_pairs(usable, rows, levels, buffer, segment, bin_size), max_size)


def allele_sequences(rows: DataFrame, ref: Slices, query: Slices) -> DataFrame:
    """Refined variants with the bases of their alleles as ``refseq, altseq``; those beyond the end of a sequence are left out."""
    subs, turned = F.col("svkind").startswith("SUBS"), F.col("svtype") == "INV"
    stop = F.when((F.col("svtype") == "DEL") | subs | turned, F.col("sv_end")).otherwise(F.col("pos"))
    # The contig's bases of an inversion lie between its ends, read along the strand of the outer alignments.
    first = F.when(turned & (F.col("comp") == 1), F.col("altend") + 2).otherwise(F.col("altpos"))
    last = F.when(turned & (F.col("comp") == 1), F.col("altpos")).otherwise(F.col("altend"))
    rows = ref(rows.drop("refseq", "altseq"), "chrom", F.col("pos"), stop, "refseq")
    rows = query(rows, "query_entry", first, last, "altseq")
    single = (F.col("altpos") == F.col("altend")) & (F.col("comp") == 1)
    return rows.withColumn("altseq", F.when(single, F.translate(F.upper("altseq"), "ACGT", "TGCA")).otherwise(F.upper("altseq"))).where("refseq is not null and altseq is not null")


def discover_regions(alignments: DataFrame, max_size: int | None = None) -> DataFrame:
    """Regions between the alignments of all contigs, merged, with ``region_id``."""
    found = V.merge_regions(V.regions_between(alignments, ["align_no"], max_size), "ref_entry").withColumnRenamed("ref_entry", "chrom")
    return found.withColumn("region_id", F.concat_ws(":", "chrom", F.col("start").cast("string"), F.col("end").cast("string")))


def widen(records: DataFrame, slices: Slices, contigs: DataFrame, buffer: int = 10_000, max_length: int = 100_000, bridging: bool = True) -> DataFrame:
    """Records with ``wide_start, wide_end, break_length, rep_type`` and ``status``.

    Both alleles are laid between ``buffer`` bases of the reference, and the two windows are aligned
    from either end: over the flank, then as far as the sequence beyond the break goes on alike,
    exactly or (``bridging``) over mismatches by score. What both alignments share is the widened
    interval. ``TOOLONG`` – either window exceeds ``max_length``; ``REFDIFFERS`` – REF isn't what the
    reference has (annotated all the same).
    """
    rows = vcf.widenable(records).join(contigs.select("chrom", "contig_len"), "chrom", "left")
    left, right = F.greatest(F.col("pos") - buffer, F.lit(1)), F.least(F.col("end") + buffer, F.col("contig_len"))
    rows = rows.withColumns({"_l": left, "_r": right})
    longest = F.col("_r") - F.col("_l") + 1 + F.greatest(F.length("alt") - F.length("ref"), F.lit(0))
    rows = rows.withColumn("status", F.when((F.col("status") == "ok") & (longest > max_length), "TOOLONG").otherwise(F.col("status")))
    good = slices(rows.where("status = 'ok'"), "chrom", "_l", "_r", "_w")
    ahead = F.substring("_w", F.lit(1), (F.col("pos") - F.col("_l")).cast("int"))
    behind = F.substring("_w", (F.col("end") - F.col("_l") + 2).cast("int"), F.lit(2**31 - 1))
    middle = F.substring("_w", (F.col("pos") - F.col("_l") + 1).cast("int"), F.length("ref"))
    good = good.withColumns({"_a": F.upper(ahead), "_b": F.upper(behind), "status": F.when(F.upper(middle) == F.col("ref"), "ok").otherwise("REFDIFFERS")})
    # Padding: bases that both alleles begin or end with belong to the flanks.
    trimmed = good.withColumn("_t", trim_alleles(F.col("ref"), F.col("alt")))
    shifted = trimmed.withColumn("_s", repeat_extents_udf(bridging)(F.concat("_a", "_t.prefix"), F.col("_t.ref"), F.col("_t.alt"), F.concat("_t.suffix", "_b")))
    start = F.col("pos") + F.length("_t.prefix")
    stop = start + F.length("_t.ref") - 1
    simple = (F.length("_t.ref") == 0) | (F.length("_t.alt") == 0)
    grown = F.length("alt") - F.length("ref")
    repeat = F.col("_s.left") + F.col("_s.right")
    kind = (
        F.when(~simple, F.when(grown > 0, "SUBSINS").when(grown < 0, "SUBSDEL").otherwise("SUBS"))
        .when(grown > 0, F.when(repeat >= grown, "DUP").otherwise("SIMPLEINS"))
        .otherwise(F.when(repeat >= -grown, "CONTRAC").otherwise("SIMPLEDEL"))
    )
    done = shifted.withColumns({"wide_start": start - 1 - F.col("_s.left"), "wide_end": stop + 1 + F.col("_s.right"), "break_length": repeat, "rep_type": kind})
    return done.drop("_l", "_r", "_w", "_a", "_b", "_t", "_s", "contig_len").unionByName(rows.where("status <> 'ok'").drop("_l", "_r", "contig_len"), allowMissingColumns=True)


BACK_DIST = 10_000


def without_long_n(records: DataFrame) -> DataFrame:
    """Records without six N in a row in either allele."""
    return records.where(~(F.col("ref").contains("NNNNNN") | F.col("alt").contains("NNNNNN")))


def back_genotype(target: DataFrame, samples: DataFrame, coverage: DataFrame, slices: Slices | None, max_dist: int = BACK_DIST, skip_ns: bool = False) -> DataFrame:
    """``target_id, sample, genotype, kinds`` of the target's variants in all samples; records in both the normalized and the genotypable form.

    A target has its own allele in its own sample (column ``sample``, if it has one). In the others
    an exact match gives an allele, else a nearby variant that matches by size and by the distance
    record. ``slices`` gives the reference bases for the record; only where there are none at all,
    pass None and let the size decide.
    """
    rows = without_long_n(target) if skip_ns else target
    if slices is not None:
        rows, samples = vcf.with_deleted_bases(rows, slices), vcf.with_deleted_bases(samples, slices)
    own = rows.where(F.col("sample").isNotNull()).select("target_id", "sample", F.lit(None).cast("string").alias("contig"), F.lit("1").alias("allele"), F.lit("OWN").alias("how"))
    known = own.select("target_id", "sample")
    exact = G.exact_genotypes(rows, samples).join(known, ["target_id", "sample"], "left_anti")
    near = G.nearby_genotypes(rows, samples, max_dist, exact.select("target_id", "sample").unionByName(known), slices)
    return G.genotype_strings(own.unionByName(exact).unionByName(near).unionByName(G.reference_alleles(rows, coverage)))


def back_records(records: DataFrame, sample: str) -> DataFrame:
    """Records of one sample's file in the form that :func:`back_genotype` takes, ``target_id`` being the line number."""
    rows = vcf.genotypable(vcf.normalized(records)).where("status = 'ok'")
    wide = {"chrom": F.col("widened.chrom"), "wide_start": F.col("widened.start"), "wide_end": F.col("widened.end"), "wide_mean": F.col("widemean")}
    return rows.withColumns(wide | {"target_id": F.col("line_no"), "sample": F.lit(sample), "contig": F.coalesce("altwidened.chrom", "id")})


def find_matches(first: DataFrame, second: DataFrame, window: int = 100_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of records of two files on a chromosome less than ``window`` apart, as ``a_*`` and ``b_*``; ``keep`` are further columns."""
    side = lambda rows, s: rows.select("chrom", *(F.col(c).alias(f"{s}_{c}") for c in ("id", "pos", "line_no", *keep)))
    return band_join(side(first, "a"), side(second, "b"), ["chrom"], "a_pos", "b_pos", window, strict=True)


def filter_vcf(records: DataFrame, region: tuple[str, int, int] | None = None, min_len: int | None = None, max_len: int | None = None, svtype: str | None = None) -> DataFrame:
    """Records by region, signed SVLEN and SVTYPE; a record without the tag passes."""
    rows = records if region is None else vcf.in_region(records, *region)
    length, kind = I.svlen_tag(F.col("info")), I.svtype_tag(F.col("info"))
    for test in [length >= min_len if min_len is not None else None, length <= max_len if max_len is not None else None, kind == svtype if svtype is not None else None]:
        rows = rows if test is None else rows.where(F.coalesce(test, F.lit(True)))
    return rows


def gap_variants(gaps: DataFrame, alignments: DataFrame) -> DataFrame:
    """Variants from show-diff gaps: the alignments of one contig that end before a gap and begin after it, classified; here jumps of 0 are repeats too.

    Both strands count. A gap whose reported unaligned bases (``query_gap``) aren't those of the two
    alignments is left out.
    """
    sides = ("ref_start", "ref_end", "query_start", "query_end", "cigar")
    a = alignments.select("ref_entry", "query_entry", "comp", *sides, F.col("ref_end").alias("ref1"), F.col("query_end").alias("query1"))
    b = alignments.select("ref_entry", "query_entry", "comp", *(F.col(c).alias(f"r_{c}") for c in sides), F.col("ref_start").alias("ref2"), F.col("query_start").alias("query2"))
    ends = gaps.select("ref_entry", (F.col("ref_start") - 1).alias("ref1"), (F.col("ref_end") + 1).alias("ref2"), F.col("query_gap").alias("reported"))
    found = A.classified(ends.join(a, ["ref_entry", "ref1"]).join(b, ["ref_entry", "query_entry", "comp", "ref2"])).where("query_gap = reported").drop("reported")
    size = F.col("ref_gap") - F.col("query_gap")
    both = (F.col("ref_gap") <= 0) & (F.col("query_gap") <= 0)
    kind = (
        F.when(size == 0, "SUBS").when((size < 0) & (F.col("ref_gap") > 0), "SUBSINS").when((size > 0) & (F.col("query_gap") > 0), "SUBSDEL")
        .when(both, F.when(size < 0, "DUP").otherwise("CONTRAC")).when(size < 0, "SIMPLEINS").otherwise("SIMPLEDEL")
    )
    repeat = F.when(kind.isin("SIMPLEINS", "DUP"), -F.col("ref_gap")).when(kind.isin("SIMPLEDEL", "CONTRAC"), -F.col("query_gap")).otherwise(0)
    return found.withColumns({"repeat_bases": repeat, "svkind": kind})


def gap_calls(gaps: DataFrame, alignments: DataFrame) -> DataFrame:
    """Variants of show-diff gaps with output coordinates: ``chrom, pos, sv_end, svtype, svlen, altpos, altend, wide_*, altwide_*, refseq, altseq``; deletions have a negative length."""
    rows = A.widened(gap_variants(gaps, alignments), -1)
    ins, dele = F.col("svkind").isin("SIMPLEINS", "DUP"), F.col("svkind").isin("SIMPLEDEL", "CONTRAC")
    back = F.when(F.col("comp") == 1, 1).otherwise(-1)  # towards the base before, on the query's strand
    bare = (dele & (F.col("repeat_bases") == 0)).cast("int")
    pick = lambda a, b, c: F.when(ins, a).when(dele, b).otherwise(c)
    col = F.col
    named = F.when(col("svkind") == "SIMPLEINS", "INS").when(col("svkind") == "SIMPLEDEL", "DEL").when(col("svkind") == "CONTRAC", "CON").otherwise(col("svkind"))
    shrinks = dele | (col("svkind") == "SUBSDEL")
    query2 = col("query2") + bare * back
    return rows.select(
        col("ref_entry").alias("chrom"), "query_entry", "comp", "repeat_bases", named.alias("svtype"), F.when(shrinks, -col("svsize")).otherwise(col("svsize")).alias("svlen"),
        pick(col("ref2"), col("ref2p") + bare, col("ref1")).alias("pos"), pick(col("ref2"), col("ref2") - bare, col("ref2") - 1).alias("sv_end"),
        pick(col("query2p"), query2, col("query1")).alias("altpos"), pick(col("query2"), query2, col("query2") + back).alias("altend"),
        pick(col("ref2"), col("ref2p") + bare, col("ref1")).alias("wide_from"), pick(col("ref1"), col("ref1p"), col("ref2")).alias("wide_to"),
        pick(col("query2p"), query2, col("query1")).alias("altwide_from"), pick(col("query1p"), col("query1"), col("query2")).alias("altwide_to"),
        F.lit("N").alias("refseq"), pick(F.lit("<INS>"), F.lit("<DEL>"), F.lit("N")).alias("altseq"),
    )


def plot_segments(alignments: DataFrame, ref: tuple[str, int, int], query: tuple[str, int, int] | None = None, either: bool = False) -> DataFrame:
    """Alignments that overlap a reference region and (``either``: or) a query region."""
    inside = lambda entry, a, b, region: (F.col(entry) == region[0]) & V.strand_overlap(F.col(a), F.col(b), F.lit(region[1]), F.lit(region[2]))
    on_ref = inside("ref_entry", "ref_start", "ref_end", ref)
    if query is None:
        return alignments.where(on_ref)
    on_query = inside("query_entry", "query_start", "query_end", query)
    return alignments.where((on_ref | on_query) if either else (on_ref & on_query))


def axis_extents(segments: DataFrame, trim: bool = False) -> DataFrame:
    """Extents of both axes by pair of entries; trimmed, the lowest start and the highest end of more than four segments are left out."""
    pair = ["ref_entry", "query_entry"]
    low, high = F.least("ref_start", "ref_end"), F.greatest("ref_start", "ref_end")
    qlow, qhigh = F.least("query_start", "query_end"), F.greatest("query_start", "query_end")
    rows = segments.select(*pair, low.alias("lo"), high.alias("hi"), qlow.alias("qlo"), qhigh.alias("qhi"), *(["align_no"] if trim else []))
    if trim:
        first, last = F.struct("lo", "align_no"), F.struct((-F.col("hi")).alias("neg"), "align_no")
        outer = rows.groupBy(*pair).agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("first"), F.min(last).alias("last"))
        few = F.col("n") <= 4
        rows = rows.join(outer, pair).withColumns({"lo": F.when(few | (first != F.col("first")), F.col("lo")), "hi": F.when(few | (last != F.col("last")), F.col("hi"))})
    return rows.groupBy(*pair).agg(F.min("lo").alias("ref_from"), F.max("hi").alias("ref_to"), F.min("qlo").alias("query_from"), F.max("qhi").alias("query_to"))


def end_alignments(alignments: DataFrame, highest: bool = True) -> DataFrame:
    """By pair of entries the alignment that starts at 1 on both sides and the one that ends at both ends.

    Of several the one with the highest mismatch rate is taken, as the last of an ascending order is;
    ``highest=False`` takes the lowest.
    """
    rate = C.mismatch_rate(F.col("mismatches"), C.parse(F.col("cigar")))
    rows = alignments.withColumn("rate", F.coalesce(rate, F.lit(0.0)))
    at_left, at_right = (F.col("ref_start") == 1) & (F.col("query_start") == 1), (F.col("ref_end") == F.col("ref_len")) & (F.col("query_end") == F.col("query_len"))
    pick = F.max_by if highest else F.min_by
    one = lambda when: pick(F.when(when, F.col("align_no")), F.when(when, F.struct("rate", "align_no")))
    return rows.groupBy("ref_entry", "query_entry").agg(one(at_left).alias("left_align"), one(at_right).alias("right_align"), F.bool_or(at_left & at_right).alias("end_to_end"))

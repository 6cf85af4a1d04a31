"""Command line: ``python -m strandline.cli COMMAND …``, one command for each pipeline that works on files.

Arguments with blanks stay whole. Results are folders of text parts in order.
"""

from __future__ import annotations

import argparse
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.plans import commands
from strandline.session import durable, ship
from strandline.sources import alignments, fasta, sinks, tabular, vcf
from strandline.sources.fasta import Slices


def _records(spark: SparkSession, paths: list[str]):
    return vcf.split_records(vcf.read_lines(spark, paths)).where("status = 'ok'").drop("status")


def _header(spark: SparkSession, path: str) -> list[str]:
    rows = vcf.headers(vcf.read_lines(spark, [path])).orderBy("line_no").select("line").collect()  # a file's header is short
    return [r.line for r in rows]


def _benchmark(spark: SparkSession, o: argparse.Namespace) -> None:
    params = commands.BenchmarkParams(o.maxdist, o.minsize, o.minreadsupport, o.minreadfrac, o.testfilter, o.truthfilter, o.normshift, o.normsizediff, o.normdist, o.max_subs_rate, o.max_indel_rate)
    if o.newdist and (o.max_subs_rate is None or o.max_indel_rate is None):
        raise SystemExit("--newdist needs --max_subs_rate and --max_indel_rate")
    regions = tabular.read_bed(spark, o.includebed).where("status = 'ok'").select("chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end")) if o.includebed else None
    known = tabular.distances(spark.read.text(o.distance_file).withColumnRenamed("value", "line")) if o.distance_file else None
    result = commands.benchmark(_records(spark, [o.test]), _records(spark, [o.truth]), fasta.slicer(fasta.chunks(spark, fasta.resolve(o.ref))), params, regions, known)
    sinks.write_lines(spark, result.false_positives, f"{o.prefix}.fp.vcf", ["chrom", "pos", "line"])
    sinks.write_lines(spark, result.false_negatives, f"{o.prefix}.fn.vcf", ["chrom", "pos", "line"])
    from strandline.operators.scoring import report_lines

    if known is None:
        sinks.write_lines(spark, sinks.distance_lines(result.distances), f"{o.prefix}.distances", ["line"], [sinks.distance_header(True)])
    text = report_lines(result.metrics.first())
    spark.createDataFrame([(x,) for x in text], "line string").coalesce(1).write.mode("overwrite").text(f"{o.prefix}.report")
    print("\n".join(text))


def _merge(spark: SparkSession, o: argparse.Namespace) -> None:
    paths = tabular.file_list([o.variants] if o.variants else [], [o.fof] if o.fof else [])
    params = commands.MergeParams(o.maxdist, o.relshift, o.relsizediff, o.reldist, o.minsize, o.max_subs_rate if o.newdist else None, o.max_indel_rate if o.newdist else None)
    known = tabular.distances(spark.read.text(o.distance_file).withColumnRenamed("value", "line")) if o.distance_file else None
    merged = commands.merge(_records(spark, paths), fasta.slicer(fasta.chunks(spark, fasta.resolve(o.ref))), params, known, o.delimiter, o.seqspecific)
    if known is None:
        sinks.write_lines(spark, sinks.distance_lines(merged.distances), f"{o.prefix}.distances", ["line"], [sinks.distance_header()])
    if o.skip_clusters:
        return
    header = _header(spark, paths[0])
    keys = F.array(*(F.lit(x.split("<ID=")[1].split(",")[0]) for x in header if x.startswith("##INFO=<ID=")), F.lit(""))
    lines = sinks.vcf_lines(merged.clusters.withColumns({"info": sinks.merged_info(F.col("info"), keys, params.by_rates()), "format": F.lit("."), "samples": F.array(F.lit("."))}), ["chrom", "pos"])
    added = sinks.MERGE_INFO + (sinks.MERGE_RATE_MAXIMA if params.by_rates() else sinks.MERGE_MAXIMA)
    sinks.write_lines(spark, lines, f"{o.prefix}.clustered.vcf", ["chrom", "pos", "line"], sinks.with_header_lines(header, added))


def _comp(spark: SparkSession, o: argparse.Namespace) -> None:
    rows = commands.compare_in_order(_records(spark, [o.first]), _records(spark, [o.second]), fasta.slicer(fasta.chunks(spark, fasta.resolve(o.ref))), o.ignore_length)
    sinks.write_lines(spark, sinks.distance_lines(rows), f"{o.prefix}.distances", ["line"], [sinks.distance_header()])


def _refine(spark: SparkSession, o: argparse.Namespace) -> None:
    found = alignments.read_delta(spark, [o.delta]) if o.delta else alignments.read_bam(spark, [o.bam])
    contigs = fasta.contigs(spark, fasta.resolve(o.ref_fasta))
    ref, query = (fasta.slicer(fasta.chunks(spark, fasta.resolve(x))) for x in (o.ref_fasta, o.query_fasta))
    if o.delta:
        from strandline.operators.alignments import extended

        found = extended(found, ref, query)
    if o.regions:
        regions = tabular.read_bed(spark, o.regions).where("status = 'ok'").drop("status").withColumn("region_id", F.concat_ws(":", "chrom", F.col("start").cast("string"), F.col("end").cast("string")))
    else:
        regions = commands.discover_regions(found, o.maxsize or None)
    result = commands.refine(found, regions, contigs, o.buffer if o.buffer is not None else (0 if o.regions else 1000), o.bufseg, o.maxsize)
    symbols = {"refseq": F.lit("N"), "altseq": F.when(F.col("svkind").startswith("SUBS"), "N").otherwise(F.concat(F.lit("<"), "svtype", F.lit(">")))}
    rows = result.variants.unionByName(result.inversions.where("status = 'ok'"), allowMissingColumns=True).withColumns(symbols)
    if o.includeseqs:
        rows = commands.allele_sequences(rows, ref, query)
    lines = sinks.refined_lines(rows)
    header = [] if o.noheader else sinks.refine_header(o.samplename, date.today().strftime("%Y%m%d"), o.refname)
    sinks.write_lines(spark, lines, o.outvcf, ["chrom", "pos", "sv_end", "line"], header)
    sinks.write_lines(spark, sinks.coverage_bed(result.coverage), o.outref, ["chrom", "r_start", "r_end", "line"])
    sinks.write_lines(spark, sinks.uncovered_bed(result.uncovered), o.nocov, ["chrom", "start", "end"])
    if o.svregions:
        sinks.write_lines(spark, sinks.refined_regions(lines), o.svregions, ["chrom", "pos", "sv_end", "number"])


def _backgenotype(spark: SparkSession, o: argparse.Namespace) -> None:
    listed = tabular.manifest(spark.read.text(o.manifest).withColumnRenamed("value", "line")).collect()  # one row a sample
    target = next((r for r in listed if r["sample"] == o.target), None)
    if target is None:
        raise SystemExit(f"{o.target} is not in {o.manifest}")
    ref = fasta.slicer(fasta.chunks(spark, fasta.resolve(o.ref)))

    def calls(path: str, sample: str) -> DataFrame:
        return commands.back_records(_records(spark, [path]), sample)

    def stretches(path: str, sample: str) -> DataFrame:
        lines = tabular.coverage(spark.read.text(path).withColumnRenamed("value", "line"))
        return lines.select(F.lit(sample).alias("sample"), "chrom", F.col("start").alias("hr_start"), F.col("end").alias("hr_end"), "contig")

    rows = durable(calls(target["vcf"], o.target), "target")
    others = [r for r in listed if r["sample"] != o.target]
    samples = reduce(DataFrame.unionByName, [calls(r["vcf"], r["sample"]) for r in others], rows.limit(0))
    coverage = reduce(DataFrame.unionByName, [stretches(r["coverage"], r["sample"]) for r in listed])
    found = commands.back_genotype(rows, samples, coverage, ref, o.maxdist, o.skip_ns)
    names = [r["sample"] for r in listed]
    lines = sinks.genotyped_lines(rows.select("target_id", "chrom", "pos", "line_no", "line"), found, names)
    header = sinks.genotyped_header(_header(spark, target["vcf"]), names, date.today().strftime("%Y%m%d"))
    sinks.write_lines(spark, lines, o.out, ["line_no"], header)


def _showdiff(spark: SparkSession, o: argparse.Namespace) -> None:
    rows, ref_path, query = _extended_delta(spark, o)
    gaps = tabular.show_diff_gaps(spark.read.text(o.diffs).withColumnRenamed("value", "line"))
    found = commands.gap_calls(gaps, rows)
    if o.includeseqs:
        ref = fasta.slicer(fasta.chunks(spark, ref_path))
        ins, dele = F.col("svtype").isin("INS", "DUP"), F.col("svtype").isin("DEL", "CON")
        found = ref(found.drop("refseq", "altseq"), "chrom", F.col("pos"), F.when(ins, F.col("pos")).otherwise(F.col("sv_end")), "refseq")
        found = ref(found, "chrom", F.col("pos"), F.col("pos"), "_base")
        found = query(found, "query_entry", F.col("altpos"), F.col("altend"), "_alt")
        single = (F.col("altpos") == F.col("altend")) & (F.col("comp") == 1)
        turned = F.when(single, F.translate(F.upper("_alt"), "ACGT", "TGCA")).otherwise(F.upper("_alt"))
        found = found.withColumns({"refseq": F.upper("refseq"), "altseq": F.when(dele, F.upper("_base")).otherwise(turned)})
    header = [] if o.noheader else ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"]
    sinks.write_lines(spark, sinks.gap_lines(found), o.out, ["chrom", "pos", "sv_end", "line"], header)


def _plotaligns(spark: SparkSession, o: argparse.Namespace) -> None:
    text = spark.read.text(o.coords or o.delta)
    rows = tabular.coords(text.withColumnRenamed("value", "line")).withColumn("align_no", F.monotonically_increasing_id()) if o.coords else alignments.read_delta(spark, [o.delta])
    region = lambda x: (lambda chrom, span: (chrom, *map(int, span.split("-"))))(*x.rsplit(":", 1))
    found = durable(commands.plot_segments(rows, region(o.refregion), region(o.queryregion) if o.queryregion else None, o.either), "segments")
    found.select("ref_entry", "query_entry", "ref_start", "ref_end", "query_start", "query_end").orderBy("ref_entry", "query_entry", "ref_start").write.mode("overwrite").option("sep", "\t").csv(f"{o.prefix}.segments")
    one = found.select("ref_entry", "query_entry").orderBy("ref_entry", "query_entry").first()
    if one is None:
        return
    mine = found.where((F.col("ref_entry") == one[0]) & (F.col("query_entry") == one[1]))
    segments = [tuple(r) for r in mine.select("ref_start", "ref_end", "query_start", "query_end").orderBy("ref_start", "query_start").collect()]  # those of one plotted region
    extent = commands.axis_extents(mine, True).select("ref_from", "ref_to", "query_from", "query_to").first()
    script = sinks.plot_script(segments, one[0], one[1], tuple(extent), o.prefix, o.format, o.title)
    spark.createDataFrame([(x,) for x in script], "line string").coalesce(1).write.mode("overwrite").text(f"{o.prefix}.R")


def _widen(spark: SparkSession, o: argparse.Namespace) -> None:
    path = fasta.resolve(o.ref)
    rows = commands.widen(_records(spark, [o.variants]), fasta.slicer(fasta.chunks(spark, path)), fasta.contigs(spark, path), o.buffer, o.maxlength).where("status <> 'TOOLONG' and status <> 'symbolic'")
    tags = F.when(F.col("rep_type").isNotNull(), F.concat(F.lit(";REPTYPE="), "rep_type", F.lit(";BREAKSIMLENGTH="), F.col("break_length").cast("string"), F.lit(";REFWIDENED="), "chrom", F.lit(":"), F.col("wide_start").cast("string"), F.lit("-"), F.col("wide_end").cast("string"))).otherwise("")
    lines = sinks.vcf_lines(rows.withColumn("info", F.concat("info", tags)), ["chrom", "pos"])
    sinks.write_lines(spark, lines, f"{o.prefix}.vcf", ["chrom", "pos", "line"], sinks.with_header_lines(_header(spark, o.variants), sinks.WIDEN_INFO))


def _vcffilter(spark: SparkSession, o: argparse.Namespace) -> None:
    region = None
    if o.region:
        chrom, _, span = o.region.rpartition(":")
        region = (chrom, *map(int, span.split("-")))
    rows = commands.filter_vcf(_records(spark, [o.vcf]), region, o.minlen, o.maxlen, o.svtype)
    sinks.write_lines(spark, rows, o.out, ["chrom", "pos", "line"], [x for x in _header(spark, o.vcf) if x.startswith("##INFO")])


def _vcf2tdf(spark: SparkSession, o: argparse.Namespace) -> None:
    rows = _records(spark, [o.vcf])
    declared = [x.split("<ID=")[1].split(",")[0] for x in _header(spark, o.vcf) if x.startswith("##INFO=<ID=")]
    keys = declared or sorted(r.info_key for r in vcf.info_keys(rows).collect())  # the keys of a format are few
    sinks.flat_table(rows, keys, o.sequences).write.mode("overwrite").option("sep", "\t").option("header", True).csv(o.out)


def _extended_delta(spark: SparkSession, o: argparse.Namespace) -> tuple[DataFrame, str, Slices]:
    """The delta file's alignments, carried on over exact matches, the path of the reference and the slices of the query; sequence files that aren't given are those that the delta file names."""
    from strandline.operators.alignments import extended

    named = spark.read.text(o.delta).first().value.split()
    paths = [fasta.resolve(given or name) for given, name in zip((o.ref_fasta, o.query_fasta), named, strict=True)]
    ref, query = (fasta.slicer(fasta.chunks(spark, p)) for p in paths)
    return extended(alignments.read_delta(spark, [o.delta]), ref, query), paths[0], query


def _delta2bed(spark: SparkSession, o: argparse.Namespace) -> None:
    sinks.delta_bed(_extended_delta(spark, o)[0]).orderBy("chrom", "start").write.mode("overwrite").option("sep", "\t").csv(o.out)


def _delta2sam(spark: SparkSession, o: argparse.Namespace) -> None:
    rows, ref, query = _extended_delta(spark, o)
    header = [] if o.noheader else sinks.sam_header(sorted((r.chrom, r.contig_len) for r in fasta.contigs(spark, ref).collect()))
    sinks.write_lines(spark, sinks.sam_lines(query(rows, "query_entry", "query_start", "query_end", "seq")), o.out, ["ref_entry", "pos", "line"], header)


def _findmatches(spark: SparkSession, o: argparse.Namespace) -> None:
    first, second = (vcf.with_running_ids(_records(spark, [p]), "sv", ["chrom", "pos", "line_no"]) for p in (o.first, o.second))
    commands.find_matches(first, second, o.maxwindow).write.mode("overwrite").option("sep", "\t").csv(o.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandline")
    kinds = top.add_subparsers(dest="command", required=True)

    def command(name, run, required=(), defaults=None, flags=()):
        p = kinds.add_parser(name)
        for x in required:
            p.add_argument(f"--{x}", required=True)
        for x, (kind, value) in (defaults or {}).items():
            p.add_argument(f"--{x}", type=kind, default=value)
        for x in flags:
            p.add_argument(f"--{x}", action="store_true")
        p.set_defaults(run=run)

    rates = {"max_subs_rate": (float, None), "max_indel_rate": (float, None), "distance_file": (str, None)}
    command("benchmark", _benchmark, ("ref", "test", "truth"), {"maxdist": (int, 50_000), "minsize": (int, 0), "minreadsupport": (int, None), "minreadfrac": (float, None), "prefix": (str, "benchmark"), "includebed": (str, None), "testfilter": (str, None), "truthfilter": (str, None), "normshift": (float, 0.2), "normsizediff": (float, 0.2), "normdist": (float, 0.2), **rates}, ("newdist",))
    command("merge", _merge, ("ref",), {"variants": (str, None), "fof": (str, None), "maxdist": (int, 2_000), "relshift": (float, 0.2), "relsizediff": (float, 0.2), "reldist": (float, 0.2), "minsize": (int, 0), "prefix": (str, "merged"), "delimiter": (str, ":"), **(rates | {"max_subs_rate": (float, 0.2), "max_indel_rate": (float, 0.2)})}, ("newdist", "skip_clusters", "seqspecific"))
    command("comp", _comp, ("ref", "first", "second"), {"prefix": (str, "svcomp")}, ("ignore_length",))
    command("refine", _refine, ("ref_fasta", "query_fasta"), {"delta": (str, None), "bam": (str, None), "regions": (str, None), "outvcf": (str, "refined.vcf"), "outref": (str, "refined.homref.bed"), "nocov": (str, "refined.nocov.bed"), "buffer": (int, None), "bufseg": (int, 50), "maxsize": (int, 0), "samplename": (str, "SAMPLE"), "refname": (str, None), "svregions": (str, None)}, ("includeseqs", "noheader"))
    command("widen", _widen, ("variants", "ref"), {"prefix": (str, "widened"), "buffer": (int, 10_000), "maxlength": (int, 100_000)})
    command("vcffilter", _vcffilter, ("vcf", "out"), {"region": (str, None), "minlen": (int, None), "maxlen": (int, None), "svtype": (str, None)})
    command("vcf2tdf", _vcf2tdf, ("vcf", "out"), {}, ("sequences",))
    sequences = {"ref_fasta": (str, None), "query_fasta": (str, None)}
    command("delta2bed", _delta2bed, ("delta", "out"), sequences)
    command("delta2sam", _delta2sam, ("delta", "out"), sequences, ("noheader",))
    command("backgenotype", _backgenotype, ("ref", "target", "manifest", "out"), {"maxdist": (int, commands.BACK_DIST)}, ("skip_ns",))
    command("showdiff", _showdiff, ("delta", "diffs", "out"), sequences, ("includeseqs", "noheader"))
    command("plotaligns", _plotaligns, ("refregion",), {"coords": (str, None), "delta": (str, None), "queryregion": (str, None), "prefix": (str, "aligns"), "format": (str, "pdf"), "title": (str, "Alignments")}, ("either",))
    command("findmatches", _findmatches, ("first", "second", "out"), {"maxwindow": (int, 100_000)})
    return top


def main(args: list[str] | None = None) -> None:
    options = parser().parse_args(args)
    spark = SparkSession.builder.appName("strandline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    options.run(spark, options)


if __name__ == "__main__":
    main()

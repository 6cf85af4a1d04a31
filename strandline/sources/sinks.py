"""Text forms of results. Every function gives a table with ``line`` (and order columns); :func:`write_lines` stores it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import cigar as C
from strandline.functions.info import info_value
from strandline.functions.sequence import wrap
from strandline.operators.distances import HEADER
from strandline.sources.vcf import with_running_ids

#: INFO lines that merging adds to a header.
MERGE_INFO = (
    '##INFO=<ID=ClusterIDs,Number=1,Type=String,Description="Ids of the calls in the cluster">',
    '##INFO=<ID=NumClusterSVs,Number=1,Type=Integer,Description="Number of calls in the cluster">',
    '##INFO=<ID=ExactMatchIDs,Number=1,Type=String,Description="Ids of the calls that match exactly">',
    '##INFO=<ID=NumExactMatchSVs,Number=1,Type=Integer,Description="Number of calls that match exactly">',
)
MERGE_MAXIMA = (
    '##INFO=<ID=ClusterMaxShiftDist,Number=1,Type=Float,Description="Largest relative shift in the cluster">',
    '##INFO=<ID=ClusterMaxSizeDiff,Number=1,Type=Float,Description="Largest relative size difference in the cluster">',
    '##INFO=<ID=ClusterMaxEditDist,Number=1,Type=Float,Description="Largest relative edit distance in the cluster">',
)
MERGE_RATE_MAXIMA = (
    '##INFO=<ID=ClusterMaxSubsDist,Number=1,Type=Float,Description="Largest rate of substitutions in the cluster">',
    '##INFO=<ID=ClusterMaxIndelDist,Number=1,Type=Float,Description="Largest rate of inserted and deleted bases in the cluster">',
)
REFINE_INFO = (
    '##INFO=<ID=END,Number=1,Type=Integer,Description="End position">',
    '##INFO=<ID=SVTYPE,Number=1,Type=String,Description="Type of the variant">',
    '##INFO=<ID=REPTYPE,Number=1,Type=String,Description="Type with regard to repeats">',
    '##INFO=<ID=SVLEN,Number=.,Type=Integer,Description="Difference in length">',
    '##INFO=<ID=BREAKSIMLENGTH,Number=1,Type=Integer,Description="Bases that repeat at the breakpoint">',
    '##INFO=<ID=REFWIDENED,Number=1,Type=String,Description="Widened reference interval">',
    '##INFO=<ID=ALTPOS,Number=1,Type=String,Description="Position on the contig">',
    '##INFO=<ID=ALTWIDENED,Number=1,Type=String,Description="Widened contig interval">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
)
GENOTYPE_FORMATS = (
    '##FORMAT=<ID=GT,Number=1,Type=Integer,Description="Genotype">',
    '##FORMAT=<ID=GTMT,Number=1,Type=Character,Description="Kind of match of each allele: H exact, L not exact">',
)
WIDEN_INFO = (
    '##INFO=<ID=REPTYPE,Number=1,Type=String,Description="Type with regard to repeats">',
    '##INFO=<ID=BREAKSIMLENGTH,Number=1,Type=Integer,Description="Bases that repeat at the breakpoint">',
    '##INFO=<ID=REFWIDENED,Number=1,Type=String,Description="Widened reference interval">',
)


@F.pandas_udf(T.StringType())
def _rounded(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if pd.isna(x) else f"{x:.15g}")


def number(x: Column) -> Column:
    """15 significant digits, rounded by the exact binary value, without trailing zeros; null prints as NaN."""
    return F.coalesce(_rounded(x.cast("double")), F.lit("NaN"))


def _tabbed(*columns: Column) -> Column:
    return F.concat_ws("\t", *(F.coalesce(c.cast("string"), F.lit(".")) for c in columns))


def distance_lines(distances: DataFrame) -> DataFrame:
    """Rows under :data:`HEADER`; failed alignments print NA."""
    names = ["avgaltlength", "altlengthdiff", "avgsize", "sizediff", "edit_distance", "maxshift", "posdiff", "relshift", "relsizediff", "reldist", "numsubs", "numindels", "marlength", "subsdist", "indeldist"]
    shown = [F.when(F.col(n).isNull(), "NA").otherwise(number(F.col(n))) for n in names]
    return distances.select(F.concat_ws("\t", F.lit("DIST"), "id1", "id2", *shown).alias("line"))


def distance_header(benchmark: bool = False) -> str:
    """The header; benchmarks name three columns otherwise."""
    other = {"NUMSUBS": "NOSUBS", "NUMINDELS": "NOINDELS", "MARLENGTH": "MAR"} if benchmark else {}
    return "\t".join(other.get(x, x) for x in HEADER)


def vcf_lines(records: DataFrame, order: list[str]) -> DataFrame:
    """Data lines of records in the columns of the scans."""
    samples = F.when(F.size("samples") > 0, F.concat_ws("\t", F.lit(""), F.col("samples"))).otherwise("")
    core = _tabbed(*(F.col(c) for c in ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info")))
    line = F.concat(core, F.when(F.col("format").isNotNull(), F.concat(F.lit("\t"), F.col("format"), samples)).otherwise(""))
    return records.select(*order, line.alias("line"))


def with_header_lines(header: list[str], added: tuple[str, ...]) -> list[str]:
    """Puts INFO lines after the last INFO line, else before the column names; lines that are there already aren't repeated."""
    new = [x for x in added if x not in header]
    spots = [i for i, x in enumerate(header) if x.startswith("##INFO")]
    names = next((i for i, x in enumerate(header) if x.startswith("#CHROM")), len(header))
    at = spots[-1] + 1 if spots else names
    return header[:at] + new + header[at:]


def merged_info(info: Column, keys: Column, by_rates: bool = False) -> Column:
    """INFO of a cluster's representative: declared entries and the cluster's tags (``n_calls, n_exact, member_ids, exact_ids, max_*``).

    Under the rate rule the largest rates take the place of the three largest distances.
    """
    kept = F.filter(F.split(info, ";"), lambda x: F.array_contains(keys, F.split(F.trim(x), "=")[0]))
    largest = [("ClusterMaxSubsDist", "max_subs"), ("ClusterMaxIndelDist", "max_indel")] if by_rates else [("ClusterMaxShiftDist", "max_shift"), ("ClusterMaxSizeDiff", "max_size"), ("ClusterMaxEditDist", "max_edit")]
    tags = [("ClusterIDs", F.col("member_ids")), ("NumClusterSVs", F.col("n_calls")), ("ExactMatchIDs", F.col("exact_ids")), ("NumExactMatchSVs", F.col("n_exact")), *((t, number(F.col(c))) for t, c in largest)]
    return F.concat_ws(";", F.coalesce(kept, F.array().cast("array<string>")), *(F.concat(F.lit(f"{t}="), v.cast("string")) for t, v in tags))


def refine_header(sample: str, day: str, reference: str | None = None) -> list[str]:
    """The header of a refined file, with the date ``yyyymmdd`` and, if given, the reference's name."""
    named = [f"##reference={reference}"] if reference else []
    return ["##fileformat=VCFv4.3", f"##fileDate={day}", "##source=strandline", *named, *REFINE_INFO, f"#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t{sample}"]


def _span(a: str, b: str) -> Column:
    return F.concat(F.col(a).cast("string"), F.lit("-"), F.col(b).cast("string"))


def refined_info(comp: Column) -> Column:
    """INFO of refined variants."""
    return F.concat(
        F.lit("END="), F.col("sv_end").cast("string"), F.lit(";SVTYPE="), "svtype", F.lit(";REPTYPE="), "svkind", F.lit(";SVLEN="), F.col("svlen").cast("string"), F.lit(";BREAKSIMLENGTH="), F.col("repeat_bases").cast("string"),
        F.lit(";REFWIDENED="), "chrom", F.lit(":"), _span("wide_from", "wide_to"), F.lit(";ALTPOS="), "query_entry", F.lit(":"), _span("altpos", "altend"), comp,
        F.lit(";ALTWIDENED="), "query_entry", F.lit(":"), _span("altwide_from", "altwide_to"), comp,
    )


def refined_lines(variants: DataFrame) -> DataFrame:
    """VCF lines of refined variants with ``refseq, altseq, covered``, and their ``info, svtype, wide_from, wide_to``; lines with 50 N in a row are left out."""
    comp = F.when(F.col("comp") == 1, "_comp").otherwise("")
    gt = F.when(F.col("covered"), "0/1").otherwise("1")
    rows = variants.withColumn("info", refined_info(comp))
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), "refseq", "altseq", F.lit("."), F.lit("PASS"), "info", F.lit("GT"), gt)
    return rows.select("chrom", "pos", "sv_end", "svtype", "wide_from", "wide_to", "info", line.alias("line")).distinct().where(~F.col("line").rlike("N{50}"))


def refined_regions(lines: DataFrame) -> DataFrame:
    """BED lines of the widened intervals of :func:`refined_lines`: start from 0, type, running id in the order of the file, INFO."""
    rows = lines.select("chrom", "pos", "sv_end", "info", "svtype", "wide_from", "wide_to", F.lit(None).cast("string").alias("id"))
    numbered = with_running_ids(rows, "", ["chrom", "pos", "sv_end", "info"])
    number_ = F.regexp_replace("id", "^_", "")
    line = F.concat_ws("\t", "chrom", (F.col("wide_from") - 1).cast("string"), F.col("wide_to").cast("string"), "svtype", number_, "info")
    return numbered.select("chrom", "pos", "sv_end", number_.cast("bigint").alias("number"), line.alias("line"))


def genotyped_lines(records: DataFrame, genotypes: DataFrame, samples: list[str]) -> DataFrame:
    """VCF lines of target records (``target_id, line``) with ``GT:GTMT`` of each sample, in the order of ``samples``.

    ``genotypes`` has ``target_id, sample, genotype, kinds``; where nothing is known both are ``.``.
    """
    value = F.concat_ws(":", "genotype", "kinds")
    wide = genotypes.groupBy("target_id").agg(F.map_from_entries(F.collect_list(F.struct("sample", value.alias("v")))).alias("m"))
    known = records.join(wide, "target_id", "left")
    cells = [F.coalesce(F.try_element_at(F.col("m"), F.lit(s)), F.lit(".:.")) for s in samples]
    first = F.array_join(F.slice(F.split("line", "\t"), 1, 8), "\t")
    return known.withColumn("line", F.concat_ws("\t", first, F.lit("GT:GTMT"), *cells)).drop("m")


def genotyped_header(header: list[str], samples: list[str], day: str) -> list[str]:
    """The target's header with the source and date of this run, the two FORMAT lines and the samples' names."""
    out = []
    for line in header:
        if line.startswith("##source="):
            out.append("##source=strandline")
        elif line.lower().startswith("##filedate="):
            out.append(f"##fileDate={day}")
        elif line.startswith("##"):
            out.append(line)
    return [*out, *GENOTYPE_FORMATS, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]


def gap_lines(variants: DataFrame) -> DataFrame:
    """VCF lines of the variants of :func:`strandline.plans.commands.gap_calls`, with HOMAPPLEN, REFWIDENED, CONTIGALTPOS and CONTIGWIDENED."""
    comp = F.when(F.col("comp") == 1, "_comp").otherwise("")
    at = F.when(F.col("svtype").isin("INS", "DUP"), _span("altpos", "altend")).otherwise(F.col("altpos").cast("string"))
    info = F.concat(
        F.lit("END="), F.col("sv_end").cast("string"), F.lit(";SVTYPE="), "svtype", F.lit(";SVLEN="), F.col("svlen").cast("string"), F.lit(";HOMAPPLEN="), F.col("repeat_bases").cast("string"),
        F.lit(";REFWIDENED="), "chrom", F.lit(":"), _span("wide_from", "wide_to"), F.lit(";CONTIGALTPOS="), "query_entry", F.lit(":"), at,
        F.lit(";CONTIGWIDENED="), "query_entry", F.lit(":"), _span("altwide_from", "altwide_to"), comp,
    )
    return variants.select("chrom", "pos", "sv_end", F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), "refseq", "altseq", F.lit("."), F.lit("PASS"), info).alias("line"))


#: Fixed values of the flat file: the letter of each type behind a position.
POLYMORPHISM_LETTERS = {"SNP": "", "Deletion": "D", "Insertion": "I"}


def _polymorphism_name() -> Column:
    letter = F.coalesce(F.create_map(*(F.lit(x) for pair in POLYMORPHISM_LETTERS.items() for x in pair))[F.col("type")], F.lit("ID"))
    return F.concat(F.coalesce("amplimer_id", F.lit("NA")), F.lit(":"), F.col("position").cast("string"), letter)


def polymorphism_strings(polymorphisms: DataFrame) -> DataFrame:
    """``line``, one for each polymorphism: name, project, analysis, AMPLIMER, amplimer, flanks, type, both alleles, score.

    ``amplimer_id, project_id, analysis_id, position, left_flank_end, right_flank_start, type, allele1,
    allele2, score``; missing ids print as NA, empty alleles as ``-``.
    """
    id_ = lambda c: F.coalesce(F.col(c), F.lit("NA"))
    allele = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("-"))
    return polymorphisms.select(F.concat_ws("\t", _polymorphism_name(), id_("project_id"), id_("analysis_id"), F.lit("AMPLIMER"), id_("amplimer_id"), *(F.col(c).cast("string") for c in ("left_flank_end", "right_flank_start")), "type", allele("allele1"), allele("allele2"), F.col("score").cast("string")).alias("line"))


def polymorphism_genotype_strings(genotypes: DataFrame, polymorphisms: DataFrame) -> DataFrame:
    """``line``, one for each genotype (``amplimer_id, position, read_name, allele1, allele2, score`` and the four ends on the trace).

    Reads of the reference (``.REF.``) and genotypes with an allele W are left out; ends that aren't known print as 0.
    """
    rows = genotypes.join(polymorphisms.select("amplimer_id", "position", "type", "analysis_id"), ["amplimer_id", "position"])
    shown = rows.where(~F.col("read_name").contains(".REF.") & ~F.coalesce(F.col("allele1") == "W", F.lit(False)) & ~F.coalesce(F.col("allele2") == "W", F.lit(False)))
    allele = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("-"))
    ends = ("allele1_left_end", "allele1_right_start", "allele2_left_end", "allele2_right_start")
    end = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    return shown.select(F.concat_ws("\t", _polymorphism_name(), "read_name", F.coalesce("analysis_id", F.lit("NA")), allele("allele1"), allele("allele2"), F.col("score").cast("string"), *(end(c) for c in ends)).alias("line"))


def plot_script(segments: list[tuple[int, int, int, int]], ref: str, query: str, extent: tuple[int, int, int, int], path: str, kind: str = "pdf", title: str = "Alignments") -> list[str]:
    """An R script that draws segments (reference start and end, query start and end) within ``extent``; a plotted region has few."""
    columns = [", ".join(str(s[i]) for s in segments) for i in range(4)]
    return [
        f'{kind}("{path}.{kind}")', f'ref <- "{ref}"', f'query <- "{query}"',
        *(f"{name} <- c({values})" for name, values in zip(("x0", "x1", "y0", "y1"), columns)),
        f'plot(NULL, xlab=ref, ylab=query, xlim=c({extent[0]}, {extent[1]}), ylim=c({extent[2]}, {extent[3]}), main="{title}")',
        "segments(x0, y0, x1, y1)", "dev.off()",
    ]


def coverage_bed(rows: DataFrame) -> DataFrame:
    """Homozygous-reference stretches, with starts as they are (from 1)."""
    return rows.select("chrom", "r_start", "r_end", F.concat_ws("\t", "chrom", F.col("r_start").cast("string"), F.col("r_end").cast("string"), "query_entry", F.col("query_start").cast("string"), F.col("query_end").cast("string")).alias("line"))


def uncovered_bed(regions: DataFrame) -> DataFrame:
    """Regions without coverage, with starts from 1."""
    return regions.select("chrom", "start", "end", F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string")).alias("line"))


def delta_bed(alignments: DataFrame) -> DataFrame:
    """BED rows of alignments: start from 0, identity in per cent with one digit, and ``+`` for reversed ones, as the format has it."""
    ops = C.parse(F.col("cigar"))
    identity = 100 * (1 - F.try_divide(F.col("mismatches"), C.total(ops, "MID")))
    return alignments.select(F.col("ref_entry").alias("chrom"), (F.col("ref_start") - 1).alias("start"), F.col("ref_end").alias("end"), F.col("query_entry").alias("name"), F.format_string("%3.1f", identity).alias("score"), F.when(F.col("comp") == 1, "+").otherwise("-").alias("strand"))


def sam_lines(alignments: DataFrame) -> DataFrame:
    """SAM lines of alignments with the query's bases ``seq``, on the reference's strand."""
    columns = sam_rows(alignments, keep=("seq",))
    rest = (F.lit("*"), F.lit("0"), F.lit("0"), F.coalesce("seq", F.lit("*")), F.lit("*"))
    return columns.select("ref_entry", "pos", F.concat_ws("\t", *(F.col(c).cast("string") for c in columns.columns if c != "seq"), *rest).alias("line"))


def sam_rows(alignments: DataFrame, mapq: int = 40, keep: tuple[str, ...] = ()) -> DataFrame:
    """The first six SAM columns of alignments; what the alignment leaves of the query is clipped (H). ``keep`` are columns to add."""
    head = F.when(F.col("comp") == 1, F.col("query_len") - F.col("query_start")).otherwise(F.col("query_start") - 1)
    tail = F.when(F.col("comp") == 1, F.col("query_end") - 1).otherwise(F.col("query_len") - F.col("query_end"))
    clipped = lambda n: F.when(n > 0, F.concat(n.cast("string"), F.lit("H"))).otherwise("")
    return alignments.select("query_entry", F.when(F.col("comp") == 1, 16).otherwise(0).alias("flag"), "ref_entry", F.col("ref_start").alias("pos"), F.lit(mapq).alias("mapq"), F.concat(clipped(head), "cigar", clipped(tail)).alias("cigar"), *keep)


def sam_header(contigs: list[tuple[str, int]]) -> list[str]:
    return ["@HD\tVN:1.6\tSO:coordinate", *(f"@SQ\tSN:{n}\tLN:{k}" for n, k in contigs), "@PG\tID:strandline"]


def flat_table(records: DataFrame, keys: list[str], sequences: bool = False, keep: list[str] | None = None) -> DataFrame:
    """One column for each INFO key beside the core columns (and those to ``keep``); alleles as lengths or as sequences."""
    allele = lambda c: F.col(c) if sequences else F.length(c).cast("bigint")
    return records.select(*(keep or []), "chrom", "pos", "id", allele("ref").alias("ref"), allele("alt").alias("alt"), "qual", "filter", *(info_value(F.col("info"), k).alias(k) for k in keys))


def fasta_lines(sequences: DataFrame, width: int = 50) -> DataFrame:
    """``name, line``: the header and the wrapped sequence of ``name, seq``."""
    return sequences.select("name", F.concat(F.lit(">"), "name", F.lit("\n"), wrap(F.col("seq"), width)).alias("line"))


def write_lines(spark: SparkSession, lines: DataFrame, path: str, order: list, header: list[str] | None = None) -> None:
    """Stores lines in order below ``path`` as text parts whose names sort in that order; the header is the part before them."""
    body = lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line") if order else lines.select("line")
    if header:
        spark.createDataFrame([(x,) for x in header], "line string").coalesce(1).write.mode("overwrite").text(f"{path}/00-header")
    body.write.mode("overwrite").text(f"{path}/01-records")

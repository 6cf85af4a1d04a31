"""VCF text as tables: raw scan, headers, and the record forms that the commands work on.

All scans keep the file and a line number; nothing is dropped silently, a ``status`` column tells
why a record takes no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import info as I
from strandline.functions.sequence import IUPAC
from strandline.session import durable

CORE = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info")


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Numbers rows of files by their place: ``file``, ``block`` (where the piece of the file begins) and ``seq`` (monotonically increasing, as read) become ``name``, from 1.

    The rows of a piece stand together, so a row's number is its distance from the piece's first row
    and the rows of the pieces before it: only the pieces are counted and summed, nothing is sorted.
    """
    pieces = rows.groupBy("file", "block").agg(F.min("seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    known = pieces.select("file", "block", "_first", F.coalesce(earlier, F.lit(0)).alias("_before"))
    return rows.join(known, ["file", "block"]).withColumn(name, F.col("seq") - F.col("_first") + F.col("_before") + 1).drop("block", "seq", "_first", "_before")


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file, line_no, line`` of text files; ``.gz`` and ``.bz2`` are decompressed. Line numbers count within a file; plain files are read in pieces."""
    where = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    raw = spark.read.text(paths).select(*where, F.col("value").alias("line"), F.monotonically_increasing_id().alias("seq"))
    return numbered(raw, "line_no").select("file", "line_no", "line")


def split_records(lines: DataFrame) -> DataFrame:
    """The columns of data lines with eight columns at least; ``status`` is ``short`` for the others."""
    cells = F.split(F.regexp_replace("line", r"\r\z", ""), "\t")
    rows = lines.where(~F.col("line").startswith("#") & (F.trim("line") != "")).withColumn("c", cells)
    at = lambda i: F.get(F.col("c"), F.lit(i))
    status = F.when(F.size("c") < 8, "short").when(~at(1).rlike(r"^\d+\z"), "pos").otherwise("ok")
    return rows.select(
        "file", "line_no", "line",
        at(0).alias("chrom"), F.when(at(1).rlike(r"^\d+\z"), at(1)).try_cast("bigint").alias("pos"), *(at(i).alias(n) for i, n in enumerate(CORE) if i > 1),
        at(8).alias("format"), F.slice("c", 10, 1 << 20).alias("samples"), status.alias("status"),
    )


def headers(lines: DataFrame) -> DataFrame:
    """``file, line_no, line, key, id`` of the header lines."""
    return lines.where(F.col("line").startswith("#")).select(
        "file", "line_no", "line",
        F.regexp_extract("line", r"^##([^=]+)=", 1).alias("key"), F.regexp_extract("line", r"^##[^=]+=<ID=([^,>]+)", 1).alias("id"),
    )


def first_file_header(lines: DataFrame, first: str) -> DataFrame:
    """The header lines of the first of several files."""
    return headers(lines.where(F.col("file") == first))


def from_calls(calls: DataFrame) -> DataFrame:
    """The records of a table of delivered calls under the names of the scans here."""
    return calls.select(
        F.col("callset").alias("file"), "line_no", "row_id", F.regexp_replace("chrom", "^chr", "").alias("chrom"), "pos", F.col("call_id").alias("id"),
        F.trim("ref_allele").alias("ref"), F.trim("alt_allele").alias("alt"), "qual", F.col("filter_tag").alias("filter"), "info",
        F.col("format_keys").alias("format"), F.array("genotype").alias("samples"),
    )


def normalized(records: DataFrame, min_size: int = 0, ref_base_count: Column | None = None) -> DataFrame:
    """The sequence-specific form: adds ``ref, alt`` in capitals, ``start, end, reflength, altlength`` and ``status``.

    ``ok`` – both alleles are spelled out, ``<INS>`` with SEQ becomes its sequence, ``<DEL>`` with END
    gets the length of its bases (the bases themselves come from :func:`with_deleted_bases`);
    ``bnd`` – breakends and unknown types; ``symbolic`` – anything else that isn't spelled out;
    ``small`` – below ``min_size``.
    """
    ref, alt = F.upper("ref"), F.upper("alt")
    spelled = ref.rlike(r"^[ACGTN]+\z") & alt.rlike(r"^[ACGTN]+\z")
    kind = I.svtype_tag(F.col("info"))
    inserted = I.seq_tag(F.col("info"))
    end = I.end_tag(F.col("info"))
    as_ins = (alt == "<INS>") & inserted.isNotNull()
    as_del = (alt == "<DEL>") & end.isNotNull()
    # A deletion given by END spans the base before POS to END, its start stays at POS.
    reflength = F.when(as_del & ~spelled, end - F.col("pos") + 2).otherwise(F.length(ref)).cast("bigint")
    altlength = F.when(spelled, F.length(alt)).when(as_ins, F.length(inserted)).when(as_del, F.lit(1)).cast("bigint")
    status = (
        F.when(F.coalesce(spelled, F.lit(False)), "ok")
        .when(kind.isin("BND", "UNK"), "bnd")
        .when(as_ins | as_del, "ok")
        .otherwise("symbolic")
    )
    out = records.withColumns({"altlength": altlength, "reflength": reflength, "status": status, "ref": ref, "alt": F.when(~spelled & as_ins, inserted).otherwise(alt), "deleted_to": F.when(as_del & ~spelled, end)})
    out = out.withColumns({"start": F.col("pos"), "end": F.when(F.col("deleted_to").isNotNull(), F.col("deleted_to")).otherwise(F.col("pos") + F.col("reflength") - 1)})
    small = F.abs(F.col("altlength") - F.col("reflength")) < min_size
    return out.withColumn("status", F.when((F.col("status") == "ok") & small, "small").otherwise(F.col("status")))


def with_deleted_bases(svs: DataFrame, slices) -> DataFrame:
    """Spells out ``<DEL>`` alleles; ``slices(df, chrom, start, end, name)`` adds reference bases."""
    wanted = slices(svs, "chrom", F.col("pos") - 1, F.col("deleted_to"), "deleted")
    have = F.col("deleted_to").isNotNull() & F.col("deleted").isNotNull()
    return wanted.withColumns({"ref": F.when(have, F.upper("deleted")).otherwise(F.col("ref")), "alt": F.when(have, F.upper(F.substring("deleted", 1, 1))).otherwise(F.col("alt"))}).drop("deleted")


def comparable(records: DataFrame, ignore_length: bool = False) -> DataFrame:
    """The form of the positional comparison: A, C, G, T only or END; ``status`` is ``no_end`` or ``length`` where it fails."""
    ref, alt = F.upper("ref"), F.upper("alt")
    spelled = ref.rlike(r"^[ACGT]+\z") & alt.rlike(r"^[ACGT]+\z")
    end = I.end_tag(F.col("info"), anchored=False)
    wrong = ~F.coalesce(spelled, F.lit(False)) & (F.length(ref) != end - F.col("pos") + 1)
    status = F.when(spelled, "ok").when(end.isNull(), "no_end").when(F.lit(not ignore_length) & wrong, "length").otherwise("ok")
    return records.withColumns({"ref": ref, "alt": alt, "end": F.when(spelled, F.col("pos") + F.length(ref) - 1).otherwise(end), "status": status})


def widenable(records: DataFrame) -> DataFrame:
    """The form of widening: the first ALT, alleles in IUPAC letters, else ``status`` ``symbolic``."""
    letters = "".join(IUPAC) + "U"
    alt = F.upper(F.regexp_replace("alt", ",.*", ""))
    ok = F.upper("ref").rlike(rf"^[{letters}]+\z") & alt.rlike(rf"^[{letters}]+\z")
    return records.withColumns({"ref": F.upper("ref"), "alt": alt, "end": F.col("pos") + F.length("ref") - 1, "status": F.when(F.coalesce(ok, F.lit(False)), "ok").otherwise("symbolic")})


def genotypable(records: DataFrame) -> DataFrame:
    """The form of back-genotyping: ``widened, altwidened, svtype, svlen, widemean``; records lacking REFWIDENED, SVTYPE or SVLEN have the status ``untagged``."""
    row = records.withColumns({"widened": I.widened_tag(F.col("info"), "REFWIDENED"), "altwidened": I.widened_tag(F.col("info"), "ALTWIDENED"), "svtype": I.svtype_tag(F.col("info")), "svlen": I.svlen_tag(F.col("info"))})
    has = F.col("widened").isNotNull() & F.col("svtype").isNotNull() & F.col("svlen").isNotNull()
    return row.withColumns({"widemean": (F.col("widened.start") + F.col("widened.end")) / 2, "status": F.when(has, "ok").otherwise("untagged")})


def with_running_ids(records: DataFrame, prefix: str, order: list) -> DataFrame:
    """Gives missing ids (null or ``.``) ``prefix`` and a running number over ``order``.

    Numbers run over the records without an id. They are counted by range partitions, so no single
    task sorts the whole table. The partitions are stored, as ranges drawn anew could differ.
    """
    missing = F.col("id").isNull() | (F.col("id") == ".")
    ranged = records.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id(), "_lacks": missing})
    ranged = durable(ranged, "ranges")
    counts = ranged.where("_lacks").groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.sum(F.col("_lacks").cast("bigint")).over(Window.partitionBy("_part").orderBy("_seq"))
    joined = ranged.join(before, "_part", "left").withColumn("_rank", rank + F.coalesce("_before", F.lit(0)))
    return joined.withColumn("id", F.when(F.col("_lacks"), F.concat(F.lit(f"{prefix}_"), F.col("_rank").cast("string"))).otherwise(F.col("id"))).drop("_part", "_seq", "_lacks", "_rank", "_before")


def natural_order(name: str) -> list[Column]:
    """Sort columns for chromosome names: numbers as numbers, the others after them as text."""
    number = F.col(name).try_cast("int")
    return [number.isNull(), number, F.col(name)]


def in_region(records: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Records that touch a region, as an indexed read would return them."""
    stop = F.coalesce(I.end_tag(F.col("info")), F.col("pos") + F.length("ref") - 1)
    return records.where((F.col("chrom") == chrom) & (F.col("pos") <= end) & (F.greatest(stop, F.col("pos")) >= start))


def info_keys(records: DataFrame) -> DataFrame:
    """The distinct keys of ``key=value`` entries."""
    return records.select(F.explode(I.info_pairs(F.col("info"))).alias("p")).select(F.col("p.key").alias("info_key")).distinct()

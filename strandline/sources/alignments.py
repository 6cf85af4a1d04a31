"""Alignments from delta files and from SAM and BAM, all in the columns of SCHEMA."""

from __future__ import annotations

import gzip
import io
import struct
from collections.abc import Iterator
from itertools import islice
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import cigar as C
from strandline.session import durable
from strandline.sources.vcf import numbered

SCHEMA = "file string, align_no bigint, ref_entry string, query_entry string, ref_len bigint, query_len bigint, ref_start bigint, ref_end bigint, query_start bigint, query_end bigint, comp int, mismatches bigint, nonpos bigint, nonalpha bigint, cigar string"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


_PARTS = _NAMES[2:]


def parse_entry(text: str, file: str = "", ignore_unequal: bool = False) -> Iterator[tuple]:
    """The alignments of one pair of entries of a delta file (the text after its ``>``): the columns of SCHEMA but for file and number."""
    lines = iter(text.splitlines())
    head = next(lines, "").split()
    if len(head) != 4:
        raise ValueError(f"{file}: not the head of a pair of entries: {' '.join(head)[:80]!r}")
    entry = (head[0], head[1], int(head[2]), int(head[3]))
    for line in lines:
        head = line.split()
        if len(head) != 7:
            if head:
                raise ValueError(f"{file}: not the head of an alignment: {line[:80]!r}")
            continue
        offsets = []
        for distance in lines:
            if distance.strip() == "0":
                break
            offsets.append(int(distance))
        rs, re_, qs, qe, mismatches, nonpos, nonalpha = map(int, head)
        ops = C.from_delta(offsets, rs, re_, qs, qe)
        if ops is None and not ignore_unequal:
            raise ValueError(f"{file}: an alignment of {entry[0]} and {entry[1]} leaves unequal numbers of bases")
        yield (*entry, rs, re_, qs, qe, int(qs > qe), mismatches, nonpos, nonalpha, ops)


def read_delta(spark: SparkSession, paths: list[str], ref_entry: str | None = None, query_entry: str | None = None, ignore_unequal: bool = False) -> DataFrame:
    """Delta files, cut into their pairs of entries while they are read, so one file is read by many tasks; ``align_no`` counts the alignments of a file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, block, text in zip(frame["file"], frame["block"], frame["text"]):
                kind = text.split("\n", 2)
                if len(kind) > 1 and kind[1].strip() in ("NUCMER", "PROMER"):  # the two lines at the begin of the file
                    continue
                rows = pd.DataFrame(list(parse_entry(text, file, ignore_unequal)), columns=_PARTS)
                if len(rows):
                    yield rows.assign(file=file, block=block)[["file", "block", *_PARTS]]

    where = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    entries = spark.read.option("lineSep", "\n>").text(paths).select(*where, F.regexp_replace("value", "^>", "").alias("text"))
    parts = ", ".join(x for x in SCHEMA.split(", ")[2:])
    found = entries.mapInPandas(run, f"file string, block bigint, {parts}").withColumn("seq", F.monotonically_increasing_id())
    rows = numbered(durable(found, "delta"), "align_no").select(*_NAMES)
    for name, wanted in (("ref_entry", ref_entry), ("query_entry", query_entry)):
        rows = rows if wanted is None else rows.where(F.col(name) == wanted)
    return rows


def from_sam(lines: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """SAM lines (``file, line_no, line``): secondary alignments and those without a CIGAR are left out."""
    cells = F.split("line", "\t")
    rows = lines.where(~F.col("line").startswith("@")).select("file", "line_no", *(cells[i].alias(n) for i, n in enumerate(("query_entry", "flag", "ref_entry", "pos", "mapq", "cigar"))))
    flag = F.col("flag").cast("int")
    rows = rows.where((flag.bitwiseAND(F.lit(256)) == 0) & (F.col("cigar") != "*"))
    ops = C.parse(F.col("cigar"))
    reverse = flag.bitwiseAND(F.lit(16)) != 0
    ends = C.endpoints(F.col("pos").cast("bigint"), ops, reverse)
    none = F.lit(None).cast("bigint")
    out = rows.withColumns({"_e": ends, "_ops": ops}).select(
        "file", F.col("line_no").alias("align_no"), "ref_entry", "query_entry", none.alias("ref_len"),
        (C.total(F.col("_ops"), "MISH")).alias("query_len"), "_e.*", reverse.cast("int").alias("comp"),
        none.alias("mismatches"), none.alias("nonpos"), none.alias("nonalpha"),
        F.array_join(F.transform(F.filter("_ops", lambda x: x["op"].isin("M", "D", "I")), lambda x: F.concat(x["n"].cast("string"), x["op"])), "").alias("cigar"),
    )
    if lengths is None:
        return out.select(*_NAMES)
    return out.drop("ref_len").join(lengths.select(F.col("chrom").alias("ref_entry"), F.col("contig_len").alias("ref_len")), "ref_entry", "left").select(*_NAMES)


_BAM_OPS = "MIDNSHP=X"


def bam_lines(source: BinaryIO) -> Iterator[str]:
    """The first six SAM columns of the records of a BAM file (a series of gzip members), read as it goes on."""
    file = io.BufferedReader(gzip.GzipFile(fileobj=source))
    if file.read(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    file.read(struct.unpack("<i", file.read(4))[0])
    names = []
    for _ in range(struct.unpack("<i", file.read(4))[0]):
        size = struct.unpack("<i", file.read(4))[0]
        names.append(file.read(size)[:-1].decode())
        file.read(4)
    while head := file.read(4):
        record = file.read(struct.unpack("<i", head)[0])
        ref, pos, name_len, mapq, _, n_ops, flag = struct.unpack("<iiBBHHH", record[:16])
        at = 32 + name_len
        ops = struct.unpack(f"<{n_ops}I", record[at : at + 4 * n_ops])
        text = "".join(f"{x >> 4}{_BAM_OPS[x & 15]}" for x in ops) or "*"
        yield "\t".join((record[32 : at - 1].decode(), str(flag), names[ref] if ref >= 0 else "*", str(pos + 1), str(mapq), text))


def read_bam(spark: SparkSession, paths: list[str]) -> DataFrame:
    """BAM files, one task for each, which holds a batch of records at a time; the paths have to be reachable by all executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open(path, "rb") as source:
                    lines = enumerate(bam_lines(source), 1)
                    while part := list(islice(lines, 10_000)):
                        yield pa.RecordBatch.from_pydict({"file": [path] * len(part), "line_no": [n for n, _ in part], "line": [x for _, x in part]})

    files = spark.createDataFrame([(str(p),) for p in paths], "path string").repartition(max(1, len(paths)))
    return from_sam(files.mapInArrow(run, "file string, line_no bigint, line string"))

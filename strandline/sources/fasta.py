"""FASTA: an index of the contigs, sequences in chunks, and random access as a join on chunks."""

from __future__ import annotations

import bz2
import gzip
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.sequence import reverse_complement

CHUNK = 1 << 16
ENDINGS = ("", ".fa", ".fasta", ".mfa", ".fa.gz", ".mfa.gz")
Slices = Callable[..., DataFrame]


def resolve(name: str, folders: list[str] | None = None) -> str:
    """A path from a path or a genome's name, looked up beside the known endings and in ``GENOME_FASTA``."""
    places = ["", *(folders if folders is not None else os.environ.get("GENOME_FASTA", "").split(os.pathsep))]
    for place in places:
        for ending in ENDINGS:
            path = os.path.join(place, name + ending) if place else name + ending
            if os.path.isfile(path):
                return path
    raise FileNotFoundError(f"no sequence file for {name}")


def _index(path: str) -> list[tuple[str, int, int, int, int]]:
    """``name, length, offset, bases by line, bytes by line`` in file order, from the ``.fai`` file unless it is older."""
    fai = f"{path}.fai"
    if os.path.exists(fai) and os.path.getmtime(fai) >= os.path.getmtime(path):
        with open(fai) as lines:
            return [(a, *map(int, rest)) for a, *rest in (line.rstrip("\n").split("\t")[:5] for line in lines if line.strip())]
    out: list[list] = []
    with open(path, "rb") as file:
        at = 0
        for line in file:
            at += len(line)
            if line.startswith(b">"):
                out.append([line[1:].split()[0].decode() if line[1:].split() else "", 0, at, 0, 0])
            elif out and (bases := len(line.strip())):
                if not out[-1][3]:
                    out[-1][3:] = [bases, len(line)]
                out[-1][1] += bases
    return [tuple(x) for x in out]


def _is_packed(path: str) -> bool:
    return path.endswith((".gz", ".bgz", ".rz", ".bz2"))


_INDEX = "chrom string, contig_len bigint, offset bigint, per_line bigint, line_bytes bigint, ord int"


def _indexed(spark: SparkSession, path: str) -> DataFrame:
    """The index of a file, made by a task: a file without an index is read once, but not by the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = [(n, len(s), 0, 0, 0) for n, s in _packed(path)] if _is_packed(path) else _index(path)
                columns = list(zip(*rows)) or [()] * 5
                kinds = [pa.string(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array(range(len(rows)), pa.int32())], ["chrom", "contig_len", "offset", "per_line", "line_bytes", "ord"])

    return spark.range(1, numPartitions=1).mapInArrow(run, _INDEX)


def contigs(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, contig_len, ord`` in file order."""
    return _indexed(spark, path).select("chrom", "contig_len", "ord")


def _packed(path: str) -> Iterator[tuple[str, str]]:
    opener = bz2.open if path.endswith(".bz2") else gzip.open
    name, parts = None, []
    with opener(path, "rt") as lines:
        for line in lines:
            if line.startswith(">"):
                if name is not None:
                    yield name, "".join(parts)
                name, parts = (line[1:].split() or [""])[0], []
            else:
                parts.append(line.strip())
    if name is not None:
        yield name, "".join(parts)


def _read_chunks(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as file:
            for batch in batches:
                names, numbers, seqs = [], [], []
                for name, no, length, offset, per_line, line_bytes in zip(*(c.to_pylist() for c in batch.columns)):
                    a, b = no * CHUNK, min(length, (no + 1) * CHUNK)
                    begin = offset + a // per_line * line_bytes + a % per_line
                    end = offset + (b - 1) // per_line * line_bytes + (b - 1) % per_line + 1
                    file.seek(begin)
                    names.append(name)
                    numbers.append(no)
                    seqs.append(file.read(end - begin).translate(None, b"\r\n ").decode())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(numbers, pa.int64()), pa.array(seqs, pa.string())], ["chrom", "chunk", "seq"])

    return run


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, chunk, seq``: every contig in pieces of CHUNK bases.

    A plain file is read by seeking, in parallel; the path has to be reachable by all executors. A
    packed file has to be read from its begin, by one task.
    """
    if _is_packed(path):

        def whole(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for name, seq in _packed(path):
                pieces = [seq[i : i + CHUNK] for i in range(0, len(seq), CHUNK)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(pieces), pa.string()), pa.array(range(len(pieces)), pa.int64()), pa.array(pieces, pa.string())], ["chrom", "chunk", "seq"])

        return spark.range(1, numPartitions=1).mapInArrow(whole, "chrom string, chunk bigint, seq string")
    tasks = _indexed(spark, path).where("contig_len > 0")
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("contig_len") - 1) / CHUNK))).alias("chunk")
    pieces = tasks.select("chrom", each, F.col("contig_len").alias("length"), "offset", "per_line", "line_bytes")
    return pieces.repartition("chrom", "chunk").mapInArrow(_read_chunks(path), "chrom string, chunk bigint, seq string")


def chunk_text(df: DataFrame, name: str, seq: str, chunk: int = CHUNK) -> DataFrame:
    """Chunks of ``chunk`` bases of sequences that are a column of a table."""
    pieces = F.sequence(F.lit(0).cast("bigint"), F.floor((F.length(seq) - 1) / chunk))
    rows = df.where(F.length(seq) > 0).select(F.col(name).alias("chrom"), F.col(seq).alias("_s"), F.explode(pieces).alias("chunk"))
    return rows.select("chrom", "chunk", F.substring("_s", (F.col("chunk") * chunk + 1).cast("int"), F.lit(chunk)).alias("seq"))


def slicer(sequence_chunks: DataFrame, chunk: int = CHUNK) -> Slices:
    """A function ``(df, chrom, start, end, name)`` that adds the bases ``start..end`` (1-based, inclusive).

    A start above the end gives the reverse complement; the end is cut at the contig's end; a start
    beyond it gives an empty text; an unknown contig is tried with or without ``chr`` and gives null;
    positions below 1 give null. Every distinct window is fetched once, by an equi-join on its chunks.
    """
    bare = lambda c: F.regexp_replace(c, "^chr", "")
    pieces = sequence_chunks.select(bare(F.col("chrom")).alias("_sc"), F.col("chunk").alias("_sk"), F.col("seq").alias("_ss")).withColumnRenamed("_sk", "_sn")

    def slices(df: DataFrame, chrom: str, start: Column | str, end: Column | str, name: str) -> DataFrame:
        a, b = (F.col(x) if isinstance(x, str) else x for x in (start, end))
        asked = df.withColumns({"_wc": bare(F.col(chrom)), "_wa": a.cast("bigint"), "_wb": b.cast("bigint")})
        windows = asked.select("_wc", "_wa", "_wb").where("_wa >= 1 and _wb >= 1").distinct().withColumns({"_lo": F.least("_wa", "_wb"), "_hi": F.greatest("_wa", "_wb")})
        looked = windows.withColumn("_sk", F.explode(F.sequence(F.floor((F.col("_lo") - 1) / chunk), F.floor((F.col("_hi") - 1) / chunk))))
        looked = looked.withColumnRenamed("_sk", "_k")
        first = F.greatest(F.col("_lo") - F.col("_k") * chunk, F.lit(1)).cast("int")
        last = F.least(F.col("_hi") - F.col("_k") * chunk, F.lit(chunk)).cast("int")
        part = looked.join(pieces, (F.col("_wc") == F.col("_sc")) & (F.col("_k") == F.col("_sn")), "left").select("_wc", "_wa", "_wb", "_k", F.substring("_ss", first, last - first + 1).alias("_p"))
        known = pieces.select(F.col("_sc").alias("_wc")).distinct().withColumn("_known", F.lit(True))
        whole = part.groupBy("_wc", "_wa", "_wb").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_p").isNotNull(), F.struct("_k", "_p")))), lambda x: x["_p"]), "").alias("_t"))
        found = whole.join(known, "_wc", "left").select(
            F.col("_wc").alias("_fc"), F.col("_wa").alias("_fa"), F.col("_wb").alias("_fb"),
            F.when(F.col("_known"), F.when(F.col("_wa") > F.col("_wb"), reverse_complement(F.col("_t"))).otherwise(F.col("_t"))).alias(name),
        )
        same = (F.col("_wc") == F.col("_fc")) & (F.col("_wa") == F.col("_fa")) & (F.col("_wb") == F.col("_fb"))
        return asked.join(found, same, "left").drop("_wc", "_wa", "_wb", "_fc", "_fa", "_fb")

    return slices

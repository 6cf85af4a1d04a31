"""Near-duplicate sequences by min-max hashing (problem 1).

Plan
----
1. Exact copies collapse first: one ``groupBy`` on the text with map-side combine, so a text that
   holds a third of all rows is one row from here on.
2. Each distinct text is cut into ``k``-base windows. Under each permutation of the window codes
   both the smallest and the largest value are kept (min-max hashing): half the hash evaluations of
   plain minhash for the same number of signature values. The (minimum, maximum) pair of one
   permutation is one band of two rows, so two texts of likeness J share a band with a probability
   of about J squared, and miss all of them with (1 - J^2)^bands.
3. Texts that share a band are candidates: a sort-merge self join on the band key, which spills and
   which adaptive execution splits where a key is hot.
4. Candidates are verified exactly on their window sets.
5. Pairs of distinct texts are expanded to pairs of records, or, without expanding anything, linked to
   groups by the grid of problem 6, with the class of copies of each record.

Defined results: rows whose id or either allele is null, and alleles with other letters than
A, C, G, T, N, take no part; an empty table gives an empty result; ids are compared as numbers, the
smaller first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.components import component_parents
from strandline.session import durable

K = 12  # bases in a window
BANDS = 48  # permutations; at a likeness of 0.5 a pair is missed with 0.75 ** 48 = 1e-6
LIKENESS = 0.5
MIN_BASES = 150
SEED = 20240229
CHUNK = 1 << 20  # bases worked on at once, so that the arrays stay in the processor's cache

_CODE = np.zeros(256, np.uint32)
for _i, _base in enumerate(b"ACGTN"):
    _CODE[_base] = _i


def _text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets into them, without copying."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def _chunks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``most`` bytes each (one row at least)."""
    at, n = 0, len(offsets) - 1
    while at < n:
        upto = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        upto = min(n, max(at + 1, upto))
        yield at, upto
        at = upto


def window_codes(data: np.ndarray, offsets: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Base-5 codes of all ``k``-base windows of the texts, text after text, and their number by text.

    Windows grow by doubling, so a window costs log2(k) steps. Windows across two texts are dropped.
    """
    digits = _CODE[data[offsets[0] : offsets[-1]]]
    lengths = np.diff(offsets)
    counts = np.maximum(lengths - (k - 1), 0)
    if len(digits) < k:
        return np.zeros(0, np.uint32), counts
    width, codes = 1, digits
    done, rest = None, k
    while rest:
        if rest & width:
            if done is None:
                done, have = codes, width
            else:
                n = min(len(done), len(codes) - have)
                done = done[:n] * np.uint32(5**width) + codes[have : have + n]
                have += width
            rest -= width
        if rest:
            codes = codes[:-width] * np.uint32(5**width) + codes[width:]
            width *= 2
    keep = np.ones(len(digits), bool)
    ends = offsets[1:] - offsets[0]
    for back in range(1, k):
        at = ends - back
        keep[at[(at >= 0) & (lengths >= back)]] = False
    return done[keep[: len(done)]], counts


def _mixed(codes: np.ndarray) -> np.ndarray:
    """A fixed bijection of the 32-bit numbers that scatters neighbouring codes."""
    x = codes * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    x ^= x >> np.uint32(13)
    return x


def _permutations(bands: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**32, bands, dtype=np.uint32), rng.integers(0, 2**31, bands, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def minmax_signature(codes: np.ndarray, counts: np.ndarray, bands: int = BANDS, seed: int = SEED) -> np.ndarray:
    """Texts x bands array: minimum in the upper, maximum in the lower half of a 64-bit value.

    All texts must have a window.
    """
    flips, factors = _permutations(bands, seed)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    out = np.empty((len(counts), bands), np.uint64)
    scattered = _mixed(codes)
    for band in range(bands):
        h = (scattered ^ flips[band]) * factors[band]
        low, high = np.minimum.reduceat(h, starts), np.maximum.reduceat(h, starts)
        out[:, band] = (low.astype(np.uint64) << np.uint64(32)) | high
    return out


def _band_rows(bands: int, k: int, seed: int):
    tags = (np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _text_arrays(batch.column(1))
            ids = batch.column(0).to_numpy()
            for a, b in _chunks(offsets, CHUNK):
                codes, counts = window_codes(data, offsets[a : b + 1], k)
                has = counts > 0
                if not has.any():
                    continue
                keys = (minmax_signature(codes, counts[has], bands, seed) ^ tags).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids[a:b][has], bands))], ["band", "rep"])

    return run


def _set_sizes(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (text, window) keys and the number of distinct windows by text."""
    keys = np.repeat(np.arange(len(counts), dtype=np.int64) << 32, counts) | codes
    keys.sort()
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return keys, np.bincount(keys >> 32, minlength=len(counts))


def _verify(k: int, likeness: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (da, oa), (db, ob) = _text_arrays(batch.column(2)), _text_arrays(batch.column(3))
            keep = []
            for a, b in _chunks(oa + ob, CHUNK):
                ka, na = _set_sizes(*window_codes(da, oa[a : b + 1], k))
                kb, nb = _set_sizes(*window_codes(db, ob[a : b + 1], k))
                both = np.concatenate([ka, kb])
                both.sort()
                shared = np.bincount(both[1:][both[1:] == both[:-1]] >> 32, minlength=b - a)
                keep.append((shared > 0) & (shared >= likeness * (na + nb - shared) - 1e-9))
            if keep:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["rep_1", "rep_2"]).filter(pa.array(np.concatenate(keep)))

    return run


def sequence_records(calls: DataFrame, min_bases: int = MIN_BASES) -> DataFrame:
    """``row_id, allele`` of the calls that spell out a long enough allele.

    Trimmed and upper-cased, REF and ALT must consist of A, C, G, T, N; the allele is the longer of
    both, ALT if they are equally long.
    """
    ref, alt = F.upper(F.trim("ref_allele")), F.upper(F.trim("alt_allele"))
    return (
        calls.select("row_id", ref.alias("r"), alt.alias("a"))
        .where(F.col("row_id").isNotNull() & (F.greatest(F.length("r"), F.length("a")) >= min_bases))
        .where(F.col("r").rlike(r"^[ACGTN]+\z") & F.col("a").rlike(r"^[ACGTN]+\z"))
        .select("row_id", F.when(F.length("r") > F.length("a"), F.col("r")).otherwise(F.col("a")).alias("allele"))
    )


def near_duplicate_texts(texts: DataFrame, k: int = K, bands: int = BANDS, likeness: float = LIKENESS, seed: int = SEED) -> DataFrame:
    """``rep_1, rep_2`` of the distinct texts (columns ``rep, allele``) with at least this likeness.

    ``texts`` is read several times, so it should be a stored table.
    """
    keys = texts.select("rep", "allele").mapInArrow(_band_rows(bands, k, seed), "band bigint, rep bigint")
    left, right = keys.select("band", F.col("rep").alias("rep_1")), keys.select("band", F.col("rep").alias("rep_2"))
    candidates = left.join(right.hint("merge"), "band").where("rep_1 < rep_2").select("rep_1", "rep_2").distinct()
    return (
        candidates.join(texts.select(F.col("rep").alias("rep_1"), F.col("allele").alias("x")), "rep_1")
        .join(texts.select(F.col("rep").alias("rep_2"), F.col("allele").alias("y")), "rep_2")
        .select("rep_1", "rep_2", "x", "y")
        .mapInArrow(_verify(k, likeness), "rep_1 bigint, rep_2 bigint")
    )


def distinct_texts(records: DataFrame) -> DataFrame:
    """``allele, rep, n``: every distinct text with its least id and its number of rows, as a stored table."""
    return durable(records.groupBy("allele").agg(F.min("row_id").alias("rep"), F.count(F.lit(1)).alias("n")), "texts")


def copies(records: DataFrame, texts: DataFrame) -> DataFrame:
    """``rep, row_id`` of all rows of texts that came more than once, found by a 128-bit digest instead of the text."""
    copied = texts.where("n > 1").select("rep", F.unhex(F.md5("allele")).alias("digest"))
    return records.select("row_id", F.unhex(F.md5("allele")).alias("digest")).join(copied, "digest").select("rep", "row_id")


def near_duplicate_groups(calls: DataFrame, k: int = K, bands: int = BANDS, likeness: float = LIKENESS, min_bases: int = MIN_BASES) -> DataFrame:
    """``row_id, class_id, group_id, links``, one row for each record that takes part.

    ``class_id`` is the least id among the records of the same allele, ``links`` the number of other
    alleles that are near it, and ``group_id`` the least id of all records that are linked directly or
    through others. Nothing here grows with the square of the copies.
    """
    records = sequence_records(calls, min_bases)
    texts = distinct_texts(records)
    pairs = durable(near_duplicate_texts(texts, k, bands, likeness), "links")
    text = lambda c: F.col(c).cast("string")
    parents = component_parents(pairs.select(text("rep_1").alias("u"), text("rep_2").alias("v"))).select(F.col("v").cast("bigint").alias("rep"), F.col("m").alias("tree"))
    links = pairs.select(F.explode(F.array("rep_1", "rep_2")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    classes = texts.select("rep", "n").join(parents, "rep", "left").join(links, "rep", "left").withColumns({"tree": F.coalesce("tree", text("rep")), "links": F.coalesce("links", F.lit(0).cast("bigint"))})
    classes = durable(classes, "classes")
    least = classes.groupBy("tree").agg(F.min("rep").alias("group_id"))
    grouped = classes.join(least, "tree")
    alone = grouped.where("n = 1").select(F.col("rep").alias("row_id"), F.col("rep").alias("class_id"), "group_id", "links")
    several = copies(records, texts).join(grouped.where("n > 1"), "rep").select("row_id", F.col("rep").alias("class_id"), "group_id", "links")
    return alone.unionByName(several)


def near_duplicate_calls(calls: DataFrame, k: int = K, bands: int = BANDS, likeness: float = LIKENESS, min_bases: int = MIN_BASES) -> DataFrame:
    """``row_id_1, row_id_2``: all pairs of records whose alleles have at least this likeness.

    The pairs of records are what is asked for here; :func:`near_duplicate_groups` has one row a record.
    """
    records = sequence_records(calls, min_bases)
    texts = distinct_texts(records)
    pairs = near_duplicate_texts(texts, k, bands, likeness)
    members = copies(records, texts)
    one, two = (members.select(F.col("rep").alias(f"rep_{i}"), F.col("row_id").alias(f"m_{i}")) for i in (1, 2))
    spread = (
        pairs.join(one, "rep_1", "left")
        .join(two, "rep_2", "left")
        .select(F.coalesce("m_1", "rep_1").alias("i"), F.coalesce("m_2", "rep_2").alias("j"))
        .select(F.least("i", "j").alias("row_id_1"), F.greatest("i", "j").alias("row_id_2"))
    )
    inside = one.withColumnRenamed("rep_1", "rep").join(two.withColumnRenamed("rep_2", "rep"), "rep").where("m_1 < m_2").select(F.col("m_1").alias("row_id_1"), F.col("m_2").alias("row_id_2"))
    return spread.unionByName(inside)

"""Continuous periods and gaps of intervals (problem 2).

The aggregate is a list of sorted, disjoint, non-adjacent closed intervals; two lists combine by a
linear merge. It is kept by (group, tile), a tile being ``2 ** TILE_BITS`` bases in which an interval
begins, so a list has a bound that does not grow with the rows, and a crowded locus or a group with
a third of all rows is merged by many tasks:

* every scan task folds its rows into lists (a tree of merges of lists of like size);
* lists meet by (group, tile, slice of the tasks), then, sorted, by (group, tile): the reduction tree;
  a task holds a bounded number of intervals at either step;
* one row a tile (first base, last base) is enough to carry the end of earlier tiles into the later
  ones; a group has as many tiles as its chromosome is long.

A period begins where an interval lies beyond everything before it; the run between is a gap.

Defined results: rows with a null chromosome, start or end, a start below 1 or an end below the
start are left out; a null owner is a group of its own; repeated rows change nothing; an empty table
gives no row; a single period gives no gap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import durable

TILE_BITS = 20
MOST_HELD = 1 << 22  # intervals of a task that are merged at once
SLICES = 8  # branches of the reduction tree that meet in one list
_SEP, _NULL = "\x1f", "\x01"
_STATE = "g string, tile bigint, s bigint, e bigint"
_NAMES = ["g", "tile", "s", "e"]
_WIDE = 1 << 40
_LOW = (1 << 44) - 1


def merge_lists(group: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of intervals by group as sorted disjoint lists. Sorted runs in the input merge linearly."""
    if not len(s):
        return group, s, e
    order = np.lexsort((s, group))
    group, s, e = group[order], s[order], e[order]
    first = np.concatenate([[True], group[1:] != group[:-1]])
    if int(e.max()) < _WIDE and len(s) < 1 << 22:
        block = np.cumsum(first) - 1
        reach = np.maximum.accumulate(e + block * _WIDE) - block * _WIDE
    else:  # coordinates too large to put the groups side by side on one axis
        reach = e.copy()
        begins = np.append(np.flatnonzero(first), len(s))
        for a, b in zip(begins[:-1], begins[1:]):
            np.maximum.accumulate(reach[a:b], out=reach[a:b])
    opens = first.copy()
    opens[1:] |= s[1:] - 1 > reach[:-1]
    at = np.flatnonzero(opens)
    last = np.append(at[1:], len(s)) - 1
    return group[at], s[at], reach[last]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of what a task holds, of any order. Beyond MOST_HELD intervals they are emitted and begun anew: lists of lists merge alike."""
    run: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        run.append(batch)
        held += batch.num_rows
        if held >= MOST_HELD:
            yield from _lists(run)
            run, held = [], 0
    yield from _lists(run)


def _fold_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole list of each (group, tile), of rows sorted by both: a list is emitted as soon as another key comes, so a task holds one batch and one list."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        groups, tiles = batch.column(0), batch.column(1)
        last = pc.and_(pc.equal(groups, groups[-1]), pc.equal(tiles, tiles[-1]))
        cut = batch.num_rows - pc.sum(last).as_py()
        if cut or (rest and (rest[-1].column(0)[-1], rest[-1].column(1)[-1]) != (groups[-1], tiles[-1])):
            yield from _lists([*rest, batch[:cut]])
            rest = []
        rest = [*_lists([*rest, batch[cut:]])]
    yield from rest


def _lists(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names: dict[tuple[str, int], int] = {}
    tree: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = []

    def add(state: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        level = 0
        while level < len(tree) and tree[level] is not None:
            state = merge_lists(*(np.concatenate(x) for x in zip(tree[level], state)))
            tree[level] = None
            level += 1
        if level == len(tree):
            tree.append(None)
        tree[level] = state

    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        codes, tiles = coded.indices.to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
        pairs, inverse = np.unique((codes.astype(np.int64) << 44) | tiles, return_inverse=True)
        words = coded.dictionary.to_pylist()
        ids = np.fromiter((names.setdefault((words[x >> 44], x & _LOW), len(names)) for x in pairs.tolist()), np.int64, len(pairs))
        add(merge_lists(ids[inverse], batch.column(2).to_numpy(), batch.column(3).to_numpy()))
    whole = None
    for state in tree:
        if state is not None:
            whole = state if whole is None else merge_lists(*(np.concatenate(x) for x in zip(whole, state)))
    if whole is None:
        return
    keys = list(names)
    words, tiles = pa.array([k for k, _ in keys]), np.array([t for _, t in keys], np.int64)
    for at in range(0, len(whole[0]), 100_000):
        g, s, e = (x[at : at + 100_000] for x in whole)
        yield pa.RecordBatch.from_arrays([words.take(pa.array(g)), pa.array(tiles[g]), pa.array(s), pa.array(e)], _NAMES)


def merged_lists(intervals: DataFrame, tile_bits: int = TILE_BITS, slices: int = SLICES) -> DataFrame:
    """``g, tile, s, e``: disjoint intervals by group and tile of ``g, s, e`` (none of them null)."""
    tiled = intervals.select("g", F.shiftright("s", tile_bits).alias("tile"), "s", "e")
    partial = tiled.mapInArrow(_fold, _STATE).withColumn("slice", F.pmod(F.spark_partition_id(), F.lit(slices)))
    middle = partial.repartition("g", "tile", "slice").select(*_NAMES).mapInArrow(_fold, _STATE)
    return middle.repartition("g", "tile").sortWithinPartitions("g", "tile").mapInArrow(_fold_sorted, _STATE)


def periods_and_gaps(intervals: DataFrame, tile_bits: int = TILE_BITS) -> DataFrame:
    """``g, kind, first_base, last_base`` of ``g, s, e``."""
    lists = durable(merged_lists(intervals, tile_bits), "lists")
    ordered = Window.partitionBy("g").orderBy("tile")
    tiles = lists.groupBy("g", "tile").agg(F.max("e").alias("top"))
    carried = tiles.select(
        "g", "tile",
        F.max("top").over(ordered.rowsBetween(Window.unboundedPreceding, -1)).alias("carry"),
        F.max("top").over(Window.partitionBy("g")).alias("final"),
    )
    inside = Window.partitionBy("g", "tile").orderBy("s")
    before = F.greatest("carry", F.lag("e").over(inside))  # greatest() passes over nulls
    starts = lists.join(carried, ["g", "tile"]).withColumn("before", before).where("before is null or s - 1 > before")
    starts = durable(starts.select("g", "tile", "s", "before", "final"), "starts")
    heads = starts.groupBy("g", "tile").agg(F.min_by("before", "s").alias("head"))
    nexts = heads.select("g", "tile", F.lead("head").over(ordered).alias("next_head"))
    ends = F.coalesce(F.lead("before").over(inside), "next_head", "final")
    rows = starts.join(nexts, ["g", "tile"]).withColumn("end", ends)
    period = F.struct(F.lit("period").alias("kind"), F.col("s").alias("first_base"), F.col("end").alias("last_base"))
    gap = F.struct(F.lit("gap").alias("kind"), (F.col("before") + 1).alias("first_base"), (F.col("s") - 1).alias("last_base"))
    return rows.select("g", F.explode(F.when(F.col("before").isNull(), F.array(period)).otherwise(F.array(period, gap))).alias("x")).select("g", "x.*")


def overlapping(intervals: DataFrame, group: str, start: str, end: str, tile_bits: int = TILE_BITS) -> DataFrame:
    """``group, start, end``: the unions of intervals that share a base; neighbours without a common base stay apart.

    On doubled coordinates neighbours do not touch, so the lists above serve here too. An interval
    that ends before its start counts as if both were exchanged; nulls and starts below 0 are left out.
    """
    low, high = F.least(start, end), F.greatest(start, end)
    rows = intervals.where(F.col(group).isNotNull() & (low >= 0) & F.col(start).isNotNull() & F.col(end).isNotNull())
    doubled = rows.select(F.col(group).alias("g"), (low * 2).cast("bigint").alias("s"), (high * 2).cast("bigint").alias("e"))
    found = periods_and_gaps(doubled, tile_bits + 1).where("kind = 'period'")
    return found.select(F.col("g").alias(group), F.expr("first_base div 2").alias(start), F.expr("last_base div 2").alias(end))


def without_prefix(column):
    """A chromosome name without a leading ``chr``."""
    return F.regexp_replace(column, "^chr", "")


def _source(df: DataFrame, origin: str, owner: str, start: str, end: str) -> DataFrame:
    good = F.col("chrom").isNotNull() & (F.col(start) >= 1) & (F.col(end) >= F.col(start))
    name = F.concat_ws(_SEP, F.lit(origin), F.coalesce(owner, F.lit(_NULL)), without_prefix(F.col("chrom")))
    return df.where(good).select(name.alias("g"), F.col(start).alias("s"), F.col(end).alias("e"))


def coverage(calls: DataFrame, regions: DataFrame) -> DataFrame:
    """``origin, owner_name, chrom, kind, first_base, last_base`` of the calls of each callset and the regions of each sample."""
    both = _source(calls, "svcalls", "callset", "pos", "end_pos").unionByName(_source(regions, "hr_regions", "sample_name", "hr_start", "hr_end"))
    part = F.split("g", _SEP)
    return periods_and_gaps(both).select(
        part[0].alias("origin"), F.when(part[1] != _NULL, part[1]).alias("owner_name"), part[2].alias("chrom"), "kind", "first_base", "last_base"
    )

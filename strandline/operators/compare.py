"""Differences between two copies of a keyed table (problem 4).

Both copies keep the latest row of each key (map-side combine, so repeated rows of a hot key vanish
before the shuffle). The rows of both copies are laid out in the same ranges of hashed keys, about
``RANGE_ROWS`` rows each, and sorted by key within. Chunks are content-defined: one ends where the rolling hash over the last ``WINDOW``
keys meets a condition, so an inserted or missing row moves the cuts of its own chunk only. A chunk's
fingerprint is its row count and two folded 64-bit hashes of its rows. Chunks whose fingerprints the
other copy has too are equal and drop out by an anti-join; only the rows of the rest are compared.

Defined results: rows with a null key are left out; of rows with the same key and time the one that
is greatest by its values counts; a null time is older than any; null differs from a value, null
equals null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import durable

RANGE_ROWS = 20_000  # rows in a range of hashed keys, about; a range is sorted by one task
WINDOW = 4
CUT_MASK = 31  # a chunk ends at one row in 32
MISSING = ("", ".", "NA")  # fixed values of the data: spellings of a missing value


def whole_number(text: Column) -> Column:
    """A signed whole number from its spellings: blanks around, a plus sign, thousands commas, ``.0``.

    Missing values and other texts give null.
    """
    bare = F.regexp_replace(F.trim(text), ",", "")
    return F.when(bare.rlike(r"^[+-]?[0-9]+(\.0*)?$"), F.regexp_extract(bare, r"^([+-]?[0-9]+)", 1).try_cast("bigint"))


def _tidy(text: Column) -> Column:
    word = F.upper(F.trim(text))
    return F.when(~word.isin(*MISSING), word)


def latest(df: DataFrame, key: str, time: str, values: dict[str, Column]) -> DataFrame:
    """The row of the latest time by key, with the given value columns."""
    named = F.struct(F.col(time).alias("t"), *(v.alias(k) for k, v in values.items()))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(named).alias("x")).select(key, *(F.col(f"x.{k}").alias(k) for k in values))


def chunked(rows: DataFrame, key: str, fields: list[str], ranges: int) -> DataFrame:
    """The rows with the number of their chunk within their range. Both copies must have the same number of ranges."""
    hashed = rows.withColumns({"range": F.pmod(F.xxhash64(key), F.lit(ranges)), "kh": F.xxhash64(key, F.lit(7)), "h1": F.xxhash64(key, *(F.coalesce(F.col(f).cast("string"), F.lit("\0")) for f in fields))})
    hashed = hashed.withColumn("h2", F.xxhash64(F.col("h1"), F.lit(11), *(F.col(f) for f in fields), F.col(key)))
    ordered = Window.partitionBy("range").orderBy(key)
    rolling = F.bit_xor(F.shiftright("kh", 3)).over(ordered.rowsBetween(-(WINDOW - 1), 0))
    ends = (rolling.bitwiseAND(F.lit(CUT_MASK)) == 0).cast("int")
    marked = hashed.withColumn("ends", ends)
    return marked.withColumn("chunk", F.coalesce(F.sum("ends").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("kh", "ends")


def fingerprints(rows: DataFrame) -> DataFrame:
    return rows.groupBy("range", "chunk").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h1").alias("f1"), F.bit_xor("h2").alias("f2"))


def differences(a: DataFrame, b: DataFrame, key: str, fields: list[str], rows: int) -> DataFrame:
    """``key, kind, diff_field`` of two tables with the key and the same value columns, one row a key; ``rows`` is about how many either has."""
    ranges = max(1, math.ceil(rows / RANGE_ROWS))
    sides = [durable(chunked(x, key, fields, ranges), "chunks") for x in (a, b)]
    prints = [fingerprints(x) for x in sides]
    seal = ["range", "n", "f1", "f2"]
    loose = []
    for i in (0, 1):
        unmatched = prints[i].join(prints[1 - i].select(*seal), seal, "left_anti")
        loose.append(sides[i].join(unmatched.select("range", "chunk"), ["range", "chunk"], "left_semi").select(key, F.struct(*fields).alias(f"side_{i}")))
    both = loose[0].join(loose[1], key, "full")
    kinds = F.when(F.col("side_1").isNull(), F.array(F.lit("none"))).when(F.col("side_0").isNull(), F.array(F.lit("none"))).otherwise(
        F.filter(F.array(*(F.when(~F.col(f"side_0.{f}").eqNullSafe(F.col(f"side_1.{f}")), F.lit(f.upper())) for f in fields)), lambda x: x.isNotNull())
    )
    kind = F.when(F.col("side_1").isNull(), F.lit("only_a")).when(F.col("side_0").isNull(), F.lit("only_b")).otherwise(F.lit("differs"))
    return both.select(key, kind.alias("kind"), F.explode(kinds).alias("diff_field"))


def call_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Differences of POS, SVTYPE and SVLEN between the typed copy ``a`` and the text export ``b``."""
    left = latest(a, "call_id", "updated_at", {"pos": F.col("pos"), "svtype": _tidy(F.col("svtype")), "svlen": F.col("svlen")})
    right = latest(b, "call_id", "updated_at", {"pos": whole_number(F.col("pos")), "svtype": _tidy(F.col("svtype")), "svlen": whole_number(F.col("svlen"))})
    return differences(left, right, "call_id", ["pos", "svtype", "svlen"], max(a.count(), b.count()))

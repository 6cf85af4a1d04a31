"""Mixing sources to target shares of the tokens (problem 8).

Every document of a source gets the same expected number of uses, ``rate`` = tokens wanted of the
source / tokens it has. Unless a total is given, the mix is the largest whose shares can all be met:
its total is the least of ``tokens * max_repeats / target_share`` over the sources that have tokens.
With a given total a source that would need more than ``max_repeats`` uses is held at that.

A document is used ``floor(rate)`` times for certain; the fractional rest is rounded by the pivotal
method: two fractional documents meet, and mass moves at random from the one to the other until one
of them is integral (0 or 1 more use). A bucket holds about ``BUCKET_DOCS`` documents of one source
and one class of sizes (each class ``1 / CLASSES`` of a factor e wide), so a source that holds most
rows is settled by many tasks. Within it the documents meet in pairs, neighbours by size, then the
residuals of the pairs meet, and so on: mass moves between documents of nearly one size, and the
token sum hardly changes; all pairs of a round are one array operation. The one document of a bucket
that stays fractional goes up a reduction tree, ``FAN_IN`` buckets of like sizes to a node, and a
single coin decides about the last one of each source. Randomness is a hash of the two ids and the
seed, so a task that runs again after a loss decides alike.

Defined results: documents without tokens (null or empty text) have no use; documents of sources
without a target don't come out; sources without documents are reported with 0; a target share that
is null or not above 0 and ``max_repeats`` that is null or below 1 give no uses.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.bpe import VOCABULARY, token_counts
from strandline.session import durable

BUCKET_DOCS = 4_096
CLASSES = 16
FAN_IN = 32
SEED = 8

_SCHEMA = "doc_id bigint, source string, n_tokens bigint, base bigint, p double, bucket bigint, open boolean"


def _coins(seed: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Uniform numbers, one for each pair of ids."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) + np.uint64(seed) * np.uint64(0xD1B54A32D192ED03)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / 2.0**53


def pivotal_step(p: np.ndarray, q: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Meetings of fractional probabilities; ``u`` is uniform. Keeps their sums and expectations."""
    total = p + q
    rest = np.clip(total - 1, 0, 1)
    low, high = np.minimum(total, 1.0), np.where(total < 1, 0.0, rest)
    # The first gets the greater part with a probability that keeps its expectation.
    first = np.where(total < 1, u * total < p, u * (2 - total) < 1 - q)
    return np.where(first, low, high), np.where(first, high, low)


def _settled(p: np.ndarray) -> np.ndarray:
    return np.where((p > 1e-12) & (p < 1 - 1e-12), p, np.round(p))


def pivotal(p: np.ndarray, ids: np.ndarray, seed: int) -> np.ndarray:
    """Rounds probabilities in the given order until one at most is fractional."""
    p = _settled(p)
    left = np.flatnonzero((p > 0) & (p < 1))
    with np.errstate(over="ignore"):
        while len(left) > 1:
            half = len(left) // 2
            a, b = left[0 : 2 * half : 2], left[1 : 2 * half : 2]
            mine, theirs = (_settled(x) for x in pivotal_step(p[a], p[b], _coins(seed, ids[a], ids[b])))
            p[a], p[b] = mine, theirs
            open_a, open_b = (mine > 0) & (mine < 1), (theirs > 0) & (theirs < 1)
            left = np.concatenate([np.where(open_a, a, b)[open_a | open_b], left[2 * half :]])
    return p


def _bucket(seed: int):
    """Settles the documents of one bucket of a source; a bucket is small."""

    def run(rows: pa.Table) -> pa.Table:
        ids, sizes = (rows.column(c).fill_null(-1).to_numpy() for c in ("doc_id", "n_tokens"))
        order = np.lexsort((ids, -sizes))
        p = pivotal(rows.column("p").to_numpy()[order], ids[order], seed)
        done = rows.take(pa.array(order))
        at = done.schema.get_field_index
        done = done.set_column(at("p"), "p", pa.array(p))
        return done.set_column(at("open"), "open", pa.array((p > 0) & (p < 1)))

    return run


def rates(available: dict[str, int], targets: list[tuple[str, float, int]], total: int | None = None) -> dict[str, float]:
    """Expected uses of a document for each source that has tokens and a target."""
    usable = [(s, t, m) for s, t, m in targets if s is not None and t and t > 0 and m and m >= 1 and available.get(s)]
    if not usable:
        return {}
    whole = total if total is not None else min(available[s] * m / t for s, t, m in usable)
    return {s: min(float(m), whole * t / available[s]) for s, t, m in usable}


def mixed_uses(sizes: DataFrame, targets: DataFrame, total: int | None = None, seed: int = SEED) -> DataFrame:
    """``doc_id, source, n_tokens, uses`` of every document (``doc_id, source, n_tokens``) whose source has a target.

    ``sizes`` is read several times, so it should be a stored table. The driver sees one row for
    each source of ``targets`` and class of sizes.
    """
    spark = sizes.sparkSession
    wanted = [tuple(r) for r in targets.select("source", "target_share", "max_repeats").collect()]
    sized = sizes.join(targets.select("source").distinct(), "source", "left_semi").withColumn("class", F.when(F.col("n_tokens") > 0, F.floor(F.log("n_tokens") * CLASSES)))
    have = sized.where("n_tokens > 0").groupBy("source", "class").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs")).collect()
    available: dict[str, int] = {}
    for r in have:
        available[r["source"]] = available.get(r["source"], 0) + r["n"]
    rate = rates(available, wanted, total)
    plan, first = [], dict.fromkeys(rate, 0)
    for r in sorted(have, key=lambda r: (r["source"], -r["class"])):
        if (f := rate.get(r["source"])) is not None:
            whole, buckets = math.floor(f + 1e-9), math.ceil(r["docs"] / BUCKET_DOCS)
            plan.append((r["source"], r["class"], whole, max(0.0, f - whole), first[r["source"]], buckets))
            first[r["source"]] += buckets
    plan_df = spark.createDataFrame(plan, "source string, class bigint, base bigint, p double, first bigint, buckets bigint")
    joined = sized.join(plan_df, ["source", "class"], "left").select(
        "doc_id", "source", "n_tokens", F.coalesce("base", F.lit(0)).cast("bigint").alias("base"), F.when(F.col("p") > 1e-9, F.col("p")).otherwise(F.lit(0.0)).alias("p"),
        (F.col("first") + F.pmod(F.xxhash64("doc_id"), F.col("buckets"))).cast("bigint").alias("bucket"), F.lit(True).alias("open"),
    )
    settled, now, left = joined.where("p = 0"), joined.where("p > 0"), max([1, *first.values()])
    while True:
        level = now.groupBy("source", "bucket").applyInArrow(_bucket(seed), _SCHEMA)
        if left == 1:
            last = level.withColumn("p", F.when(F.col("open"), (_uniform(seed) < F.col("p")).cast("double")).otherwise(F.col("p")))
            settled = settled.unionByName(last)
            break
        level = durable(level, "mix")
        settled = settled.unionByName(level.where(~F.col("open")))
        now = level.where("open").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        left = math.ceil(left / FAN_IN)
    return settled.select("doc_id", "source", "n_tokens", (F.col("base") + F.round("p").cast("bigint")).alias("uses"))


def _uniform(seed: int):
    return F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30)).cast("double") / float(1 << 30)


def source_shares(uses: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, max_repeats, available_tokens, used_tokens, actual_share`` of every target source."""
    by = uses.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"), F.sum(F.col("n_tokens") * F.col("uses")).alias("used_tokens"))
    zero = F.lit(0).cast("bigint")
    shares = targets.select("source", "target_share", "max_repeats").join(by, "source", "left").withColumns({c: F.coalesce(c, zero) for c in ("available_tokens", "used_tokens")})
    whole = F.sum("used_tokens").over(Window.partitionBy(F.lit(0)))  # over one row a source
    return shares.select(
        "source", "target_share", "max_repeats", "available_tokens", "used_tokens",
        F.when(whole > 0, F.col("used_tokens") / whole).otherwise(F.lit(0.0)).alias("actual_share"),
    )


def document_sizes(documents: DataFrame, targets: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, n_tokens`` of the documents whose source has a target, as a stored table."""
    wanted = documents.join(targets.select("source").distinct(), "source", "left_semi")
    return durable(token_counts(wanted.select("doc_id", "source", "text"), ["doc_id", "source"], path), "sizes")


def mix(documents: DataFrame, targets: DataFrame, path: str = VOCABULARY, total: int | None = None) -> DataFrame:
    """``doc_id, source, n_tokens, uses, target_share, actual_share`` of every document whose source has a target."""
    uses = durable(mixed_uses(document_sizes(documents, targets, path), targets, total), "uses")
    return uses.join(source_shares(uses, targets).select("source", "target_share", "actual_share"), "source").select("doc_id", "source", "n_tokens", "uses", "target_share", "actual_share")


def mix_shares(documents: DataFrame, targets: DataFrame, path: str = VOCABULARY, total: int | None = None) -> DataFrame:
    """The report of :func:`source_shares` for the mix."""
    return source_shares(durable(mixed_uses(document_sizes(documents, targets, path), targets, total), "uses"), targets)

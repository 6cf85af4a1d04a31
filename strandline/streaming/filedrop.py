"""Structured Streaming over dropped files: any query on each batch of new files, and a running count of loaded and rejected lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.operators import quarantine

CALLS_SCHEMA = "row_id bigint, callset string, line_no bigint, chrom string, pos bigint, end_pos bigint, call_id string, ref_allele string, alt_allele string, altlength bigint, qual double, filter_tag string, info string, format_keys string, genotype string, called_at timestamp_ntz, loaded_at timestamp_ntz"


def watch(spark: SparkSession, folder: str, schema: str = CALLS_SCHEMA, files_at_once: int = 16) -> DataFrame:
    """A stream of the parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def each_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Applies ``work`` to every batch of new files and stores its rows by batch.

    A batch that runs again after a loss replaces its own folder, so rows come once.
    """

    def store(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def line_outcomes(raw: DataFrame) -> DataFrame:
    """``outcome, n`` of a batch of raw lines: how many load, and how many are rejected for each reason."""
    kept = quarantine.strict_load(raw).select(F.lit("loaded").alias("outcome"))
    return kept.unionByName(quarantine.rejected(raw).select(F.col("reason").alias("outcome"))).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def running_outcomes(spark: SparkSession, out: str) -> DataFrame:
    """The sums over all batches so far that :func:`each_batch` stored with :func:`line_outcomes`."""
    return spark.read.parquet(out).groupBy("outcome").agg(F.sum("n").alias("n"))

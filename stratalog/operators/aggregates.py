"""Counts, sums and roll-ups; each is one aggregation, which Spark splits into map-side and final parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import TIERS

SMALL_FILE = 16 << 20


def status_rollup(files: DataFrame) -> DataFrame:
    """In-progress and excluded files count in the total only."""
    n = lambda s: F.count_if(F.col("status") == s)
    return files.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_size"), n(2).alias("completed"), n(0).alias("pending"), n(3).alias("failed"))


def backup_statistics(files: DataFrame, pending: DataFrame) -> DataFrame:
    """Two rows of one line each put side by side."""
    return status_rollup(files).crossJoin(pending.agg(F.count("*").alias("pending_changes")))


def live_reference_counts(refs: DataFrame) -> DataFrame:
    """Reference rows of each chunk: a chunk used twice by a file counts twice."""
    return refs.groupBy("chunk_hash").agg(F.count("*").alias("live_count"))


def index_summary(index: DataFrame) -> DataFrame:
    rc, size = F.col("reference_count"), F.col("size_bytes")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return index.agg(
        F.count("*").alias("total_chunks"),
        total(size).alias("total_bytes"),
        F.count_if(rc == 0).alias("orphan_chunks"),
        total(F.when(rc == 0, size)).alias("orphan_bytes"),
        F.count_if(rc > 1).alias("shared_chunks"),
        total(F.when(rc > 1, size * (rc - 1))).alias("saved_bytes"),
    )


def tier_breakdown(index: DataFrame) -> DataFrame:
    """All four tiers, zero-filled."""
    tiers = index.sparkSession.createDataFrame(list(TIERS), "current_tier int, tier string")
    by = index.groupBy("current_tier").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("b"))
    return tiers.join(by, "current_tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("chunks"), F.coalesce("b", F.lit(0)).alias("bytes"))


def totals(df: DataFrame, size: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))


def failures_by_tier(failures: DataFrame) -> DataFrame:
    return failures.groupBy("failure_tier").agg(F.count("*").alias("n")).orderBy(F.desc("failure_tier"))


def preview_totals(actions: DataFrame) -> DataFrame:
    """By action: all, included, and the bytes of the included ones."""
    return actions.groupBy("action").agg(F.count("*").alias("n"), F.count_if("included").alias("n_included"), F.coalesce(F.sum(F.when(F.col("included"), F.col("size"))), F.lit(0)).cast("long").alias("bytes"))


def files_by_tier(files: DataFrame) -> DataFrame:
    """Without a tier a file counts as hot."""
    return files.groupBy(F.coalesce("tier", F.lit(0)).alias("tier")).agg(F.count("*").alias("files"), F.sum("file_size").cast("long").alias("bytes"))


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("file_id").agg(F.count("*").alias("chunks"), F.min("length").alias("chunk_min"), F.max("length").alias("chunk_max"), F.sum("length").cast("long").alias("bytes"))


def small_large_split(files: DataFrame, threshold: int = SMALL_FILE) -> DataFrame:
    small = F.col("file_size") <= threshold
    return files.agg(
        F.count_if(small).alias("small_files"), F.coalesce(F.sum(F.when(small, F.col("file_size"))), F.lit(0)).cast("long").alias("small_bytes"),
        F.count_if(~small).alias("large_files"), F.coalesce(F.sum(F.when(~small, F.col("file_size"))), F.lit(0)).cast("long").alias("large_bytes"),
    )


def failure_reasons(failures: DataFrame) -> DataFrame:
    """Distinct `reason@Ttier` of each file, in alphabetical order."""
    label = F.concat("failure_reason", F.lit("@T"), F.col("failure_tier").cast("string"))
    return failures.groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_set(label)), ", ").alias("reasons"))


def benchmark_summary(results: DataFrame, noisy: float = 0.05) -> DataFrame:
    """Mean, deviation and standard error of each benchmark's samples; noisy above five per cent."""
    s = results.groupBy("benchmark").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev("value"), F.lit(0.0)).alias("deviation"))
    return s.withColumn("error", F.col("deviation") / F.sqrt("n")).withColumn("noisy", F.col("error") / F.col("mean") > noisy)

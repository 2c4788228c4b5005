"""Analyses over telemetry records (see `sources.readers.telemetry` for their schema)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formats import adaptive_concurrency


def skipped_files(records: DataFrame) -> DataFrame:
    """Of each operation: succeeded files less those with a record of their own."""
    files = F.count_if(F.col("type") == "file")
    return records.groupBy("operation").agg((F.coalesce(F.sum(F.when(F.col("type") == "op", F.col("succeeded"))), F.lit(0)) - files).cast("long").alias("skipped"))


def below_average(records: DataFrame) -> DataFrame:
    """Files slower than their operation's average, by power of two of their size in MB."""
    files = records.where("type = 'file'")
    mean = files.groupBy("operation").agg(F.avg("throughput_mbytes_per_sec").alias("mean"))
    slow = files.join(mean, "operation").where(F.col("throughput_mbytes_per_sec") < F.col("mean"))
    bucket = F.when(F.col("bytes") < 1 << 20, 0).otherwise(F.floor(F.log2(F.col("bytes") / (1 << 20))) + 1).cast("int")
    return slow.groupBy("operation", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def concurrency_check(records: DataFrame) -> DataFrame:
    f = records.where("type = 'file'")
    return f.select("operation", "path", "effective_concurrency", adaptive_concurrency(F.col("chunk_max")).alias("expected"))


def stall_parity(records: DataFrame) -> DataFrame:
    """Budget stalls as the files and as the operation count them."""
    of = lambda t: F.coalesce(F.sum(F.when(F.col("type") == t, F.col("budget_stalls"))), F.lit(0)).cast("long")
    return records.groupBy("operation").agg(of("file").alias("of_files"), of("op").alias("of_operation"))


def corruption_patterns(records: DataFrame) -> DataFrame:
    """How often each chunk index failed, and in how many files."""
    c = records.where("type = 'corruption'").select("path", F.explode("crc_failed_indices").alias("index"))
    return c.groupBy("index").agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"))


def budget_comparison(records: DataFrame) -> DataFrame:
    o = records.where("type = 'op'")
    return o.groupBy("memory_budget_mb").agg(F.sum("budget_stalls").cast("long").alias("stalls"), F.avg("throughput_mbytes_per_sec").alias("throughput"))


def least_budget(records: DataFrame) -> DataFrame:
    b = budget_comparison(records)
    return b.agg(F.min(F.when(F.col("stalls") == 0, F.col("memory_budget_mb"))).alias("least_budget"))


def parity(records: DataFrame, a: str, b: str, within: float = 0.2) -> DataFrame:
    mean = lambda n: F.avg(F.when(F.col("operation") == n, F.col("throughput_mbytes_per_sec")))
    m = records.where("type = 'op'").agg(mean(a).alias("a"), mean(b).alias("b"))
    return m.withColumn("parity", F.abs(F.col("a") - F.col("b")) <= within * F.col("b"))


def phase_counts(diagnostics: DataFrame) -> DataFrame:
    odd = ~F.col("crc_valid") & F.col("plain_size").isNotNull() & (F.col("plain_size") > 0)
    return diagnostics.groupBy("phase").agg(F.count("*").alias("n"), F.count_if(F.coalesce(odd, F.lit(False))).alias("crc_bad_but_readable"))

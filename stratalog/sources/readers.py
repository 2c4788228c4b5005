"""Sources and sinks: file listings, blob listings, telemetry lines, chunk diagnostics, benchmark results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TELEMETRY = (
    "type string, timestamp timestamp, operation string, path string, bytes long, chunks int, chunk_min int, chunk_max int, elapsed_seconds double, throughput_mbytes_per_sec double, "
    "throughput_mbps double, new_chunks int, dedup_chunks int, tier string, effective_concurrency int, budget_stalls int, reorder_max int, retries int, files int, succeeded int, failed int, "
    "file_concurrency int, memory_budget_mb int, crc_fail_count int, crc_retry_count int, processors int, total_ram_mb int, memory_budget_enabled boolean, is64_bit boolean, is_64_bit boolean, os string, "
    "total_chunks int, recovered_chunks int, unrecoverable_chunks int, crc_failed_indices array<int>, unrecoverable_indices array<int>, trigger_error string, diag_file string, recovered_path string, "
    "file_bytes long, reason string, context map<string,string>"
)
DIAGNOSTICS = "phase string, index int, hash string, plain_size long, encrypted_size long, crc_valid boolean, extra string"


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Files below a folder; contents are not read unless a plan uses them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", F.col("modificationTime").alias("modified"))


def contents(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)


def blob_listing(spark: SparkSession, root: str, tier: int = 0) -> DataFrame:
    """A blob store as a folder: name below the root, size, tier and MD5 (which reads the content, if a plan uses it)."""
    c = contents(spark, root)
    name = F.regexp_replace("path", r"^.*?(chunks|metadata|index)/", "$1/")
    return c.select(name.alias("blob_name"), F.col("length").alias("size_bytes"), F.lit(tier).alias("tier"), F.md5("content").alias("content_md5"))


def telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Telemetry lines of all types under one schema. Left-out numbers are zero; both spellings of two keys are read."""
    t = spark.read.schema(TELEMETRY).json(path)
    t = t.withColumn("throughput_mbytes_per_sec", F.coalesce("throughput_mbytes_per_sec", "throughput_mbps")).withColumn("is64_bit", F.coalesce("is64_bit", "is_64_bit")).drop("throughput_mbps", "is_64_bit")
    zero = [c for c, k in t.dtypes if k in ("int", "bigint", "double")]
    return t.fillna(0, subset=zero)


def write_telemetry(records: DataFrame, path: str) -> None:
    """One folder per day."""
    records.withColumn("date", F.to_date("timestamp")).write.mode("append").partitionBy("date").json(path)


def diagnostics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DIAGNOSTICS).json(path)


def benchmark_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)

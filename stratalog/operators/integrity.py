"""Integrity verification in tiers: what the listing says, what the body says, what the local file says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import envelope_ok, unseal
from ..sources.catalog import ENVELOPE_OVERHEAD

#: Reasons that writing the chunk again repairs.
REPAIRABLE = ["missing-blob", "wrong-size", "md5-mismatch", "crc-mismatch", "decrypt-failed", "byte-differ", "download-error"]


def _listed(chunks: DataFrame, blobs: DataFrame, index: DataFrame) -> DataFrame:
    there = blobs.select(F.substring("blob_name", 8, 1000).alias("hash"), "size_bytes", "content_md5")
    base = index.select(F.col("chunk_hash").alias("hash"), "expected_md5")
    return chunks.join(there, "hash", "left").join(base, "hash", "left")


def _tier1() -> Column:
    """Reasons of a chunk row: a chunk without length fails alone, a missing blob fails alone, size and digest may both fail."""
    wrong_size = F.when(F.col("size_bytes") != F.col("length") + ENVELOPE_OVERHEAD, "wrong-size")
    wrong_md5 = F.when(F.col("expected_md5") != F.col("content_md5"), "md5-mismatch")
    none = F.lit(None).cast("string")
    return F.array_compact(
        F.when(F.col("length") <= 0, F.array(F.lit("invalid-chunk-length"), none)).when(F.col("size_bytes").isNull(), F.array(F.lit("missing-blob"), none)).otherwise(F.array(wrong_size, wrong_md5))
    )


def listing_failures(files: DataFrame, chunks: DataFrame, blobs: DataFrame, index: DataFrame) -> DataFrame:
    """Tier 1, from the listing alone; one row per failure."""
    j = _listed(chunks, blobs, index).join(files.select("file_id", "local_path"), "file_id")
    return j.select("file_id", "local_path", "chunk_index", F.col("hash").alias("chunk_hash"), F.explode(_tier1()).alias("failure_reason")).withColumn("failure_tier", F.lit(1))


def baseline(chunks: DataFrame, blobs: DataFrame, index: DataFrame, deep: bool = False) -> DataFrame:
    """Digests to trust on first use: listed, none stored yet. A deep check defers them until the body is verified."""
    j = _listed(chunks, blobs, index).where("length > 0 AND expected_md5 IS NULL AND content_md5 IS NOT NULL")
    return j.groupBy(F.col("hash").alias("chunk_hash")).agg(F.min("content_md5").alias("expected_md5")).withColumn("deferred", F.lit(deep))


def body_failures(suspects: DataFrame, bodies: DataFrame, key: bytes, local: DataFrame | None = None) -> DataFrame:
    """Tiers 2 and 3 for ``suspects`` (file_id, local_path, chunk_index, offset, length, chunk_hash, t1_failed) with ``bodies`` (chunk_hash, sealed) and ``local`` (local_path, content)."""
    plain = unseal(F.col("sealed"), F.lit(bytearray(key)))
    j = suspects.join(bodies, "chunk_hash", "left").withColumn("plain", plain)
    tier2 = F.when(F.col("sealed").isNull(), "download-error").when(~envelope_ok(F.col("sealed")), "crc-mismatch").when(F.col("plain").isNull(), "decrypt-failed")
    j = j.withColumn("t2", tier2)
    if local is None:
        return j.where("t2 IS NOT NULL").select("file_id", "local_path", "chunk_index", "chunk_hash", F.lit(2).alias("failure_tier"), F.col("t2").alias("failure_reason"))
    j = j.join(local.select("local_path", "content"), "local_path", "left")
    piece = F.substring("content", (F.col("offset") + 1).cast("int"), F.col("length"))
    tier3 = F.when(F.col("content").isNull(), "local-file-missing").when(F.octet_length(piece) != F.col("length"), "local-short-read").when(piece != F.col("plain"), "byte-differ")
    reason = F.coalesce("t2", F.when(F.col("t1_failed"), tier3))
    return j.withColumn("failure_reason", reason).where("failure_reason IS NOT NULL").select("file_id", "local_path", "chunk_index", "chunk_hash", F.when(F.col("t2").isNotNull(), 2).otherwise(3).alias("failure_tier"), "failure_reason")


def unknown_files(requested: DataFrame, files: DataFrame) -> DataFrame:
    """A requested id that the catalog lacks is a failure of its own."""
    return requested.join(files, "file_id", "left_anti").select("file_id", F.concat(F.lit("<unknown file id "), F.col("file_id").cast("string"), F.lit(">")).alias("local_path"), F.lit(1).alias("failure_tier"), F.lit("missing-file-record").alias("failure_reason"))


def file_verdicts(files: DataFrame, failures: DataFrame) -> DataFrame:
    """Worst tier of each file: T3 before T2 before T1; passed without a failure. `size-disagreement` alone is a warning."""
    rank = F.when(F.col("failure_reason") == "size-disagreement", 0).otherwise(F.col("failure_tier"))
    worst = failures.groupBy("file_id").agg(F.max(rank).alias("worst"))
    verdict = F.when(F.col("worst").isNull(), "Passed").when(F.col("worst") == 0, "Warning").otherwise(F.concat(F.lit("FailedT"), F.col("worst").cast("string")))
    return files.select("file_id").join(worst, "file_id", "left").select("file_id", verdict.alias("verdict"))


def run_rollup(verdicts: DataFrame) -> DataFrame:
    n = lambda v: F.count_if(F.col("verdict") == v)
    return verdicts.agg(F.count("*").alias("checked"), n("Passed").alias("passed"), n("Warning").alias("warnings"), n("FailedT1").alias("t1"), n("FailedT2").alias("t2"), n("FailedT3").alias("t3"))


def repairable(failures: DataFrame) -> DataFrame:
    """Files all of whose failures can be repaired."""
    return failures.groupBy("file_id").agg(F.min(F.col("failure_reason").isin(REPAIRABLE)).alias("repairable"))


def after_repair(first: DataFrame, second: DataFrame, repaired: DataFrame) -> DataFrame:
    """The second pass replaces the first for files that were repaired; a clean one counts as repaired."""
    out = first.join(repaired, "file_id", "left_anti").unionByName(second.join(repaired, "file_id", "left_semi"))
    return out


def sequence_errors(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files whose chunks don't follow one another from index 0 and offset 0 on, or don't add up to the size."""
    w = Window.partitionBy("file_id").orderBy("chunk_order")
    c = chunks.withColumn("place", F.row_number().over(w) - 1).withColumn("end_before", F.coalesce(F.lag(F.col("offset") + F.col("length")).over(w), F.lit(0)))
    g = c.groupBy("file_id").agg(F.count_if(F.col("chunk_index") != F.col("place")).alias("bad_index"), F.count_if(F.col("offset") != F.col("end_before")).alias("bad_offset"), F.sum("length").cast("long").alias("total"))
    j = files.select("file_id", "file_size").join(g, "file_id", "left")
    return j.select("file_id", F.coalesce("bad_index", F.lit(0)).alias("bad_index"), F.coalesce("bad_offset", F.lit(0)).alias("bad_offset"), (F.coalesce("total", F.lit(0)) != F.col("file_size")).alias("bad_size"))


def verified_restore(chunks: DataFrame, bodies: DataFrame) -> DataFrame:
    """Whether each restored chunk (chunk_hash, plain) has the length and hash it should have."""
    ok = (F.octet_length("plain") == F.col("length")) & (F.upper(F.sha2("plain", 256)) == F.col("hash"))
    return chunks.join(bodies.withColumnRenamed("chunk_hash", "hash"), "hash", "left").select("file_id", "chunk_index", F.coalesce(ok, F.lit(False)).alias("ok"))


def best_effort(chunks: DataFrame, bodies: DataFrame) -> DataFrame:
    """Restored content of each file with unreadable chunks zero-filled; given up if none of three or more could be read."""
    j = chunks.join(bodies.withColumnRenamed("chunk_hash", "hash"), "hash", "left")
    piece = F.coalesce("plain", F.unhex(F.repeat(F.lit("00"), F.col("length"))))
    g = j.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("chunk_order", piece.alias("p")))).alias("ps"), F.count("plain").alias("recovered"), F.count("*").alias("chunks"))
    content = F.unhex(F.array_join(F.transform("ps", lambda x: F.hex(x["p"])), ""))  # each piece is copied once
    return g.select("file_id", "recovered", "chunks", F.when(~((F.col("recovered") == 0) & (F.col("chunks") >= 3)), content).alias("content"))


def collisions(bodies: DataFrame) -> DataFrame:
    """Hashes with different contents."""
    return bodies.groupBy("chunk_hash").agg(F.countDistinct(F.sha2("plain", 512)).alias("contents")).where("contents > 1")

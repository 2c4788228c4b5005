"""Composites that keep the chunk index in step with files and references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import path_key
from .aggregates import live_reference_counts
from .joins import collectable_orphans, incomplete_ids
from .mutations import upsert_refs


def add_references(index: DataFrame, refs: DataFrame, uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``uploads``: (file_path, chunk_hash, chunk_index, referenced_at, size_bytes, tier, is_new). References are upserted and recounted; an entry that is there keeps its size and uploader, and changes tier only on a new upload."""
    new_refs = upsert_refs(refs, uploads.select(*refs.columns))
    counts = live_reference_counts(new_refs)
    fresh = uploads.groupBy("chunk_hash").agg(F.min_by("file_path", F.struct("file_path", "chunk_index")).alias("_path"), F.max("size_bytes").alias("_size"), F.max("tier").alias("_tier"), F.max("is_new").alias("_new"))
    j = index.join(fresh, "chunk_hash", "full_outer").join(counts, "chunk_hash", "left")
    touched = F.col("_path").isNotNull()
    out = j.select(
        "chunk_hash",
        F.coalesce("original_uploader_path", "_path").alias("original_uploader_path"),
        F.coalesce("size_bytes", "_size").alias("size_bytes"),
        F.when(touched, F.coalesce("live_count", F.lit(0))).otherwise(F.col("reference_count")).cast("int").alias("reference_count"),
        F.when(F.col("current_tier").isNull() | (touched & F.col("_new")), F.col("_tier")).otherwise(F.col("current_tier")).alias("current_tier"),
        "expected_md5",
    )
    return out, new_refs


def remove_file_references(index: DataFrame, refs: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """References of the given files go and their chunks are recounted. Returns the index without chunks that nobody uses now, the references, and those chunks."""
    gone = refs.join(paths, "file_path", "left_semi").select("chunk_hash").distinct().withColumn("touched", F.lit(True))
    left = refs.join(paths, "file_path", "left_anti")
    j = index.join(gone, "chunk_hash", "left").join(live_reference_counts(left), "chunk_hash", "left")
    j = j.withColumn("n", F.when(F.col("touched"), F.coalesce("live_count", F.lit(0))).otherwise(F.col("reference_count")))
    dead = F.coalesce(F.col("touched") & (F.col("n") == 0), F.lit(False))
    kept = j.where(~dead).withColumn("reference_count", F.col("n").cast("int")).select(*index.columns)
    return kept, left, j.where(dead).select("chunk_hash")


def cleanup_orphans(orphans: DataFrame, refs: DataFrame) -> DataFrame:
    """Each orphan is counted again: what a file uses now is skipped."""
    j = orphans.join(live_reference_counts(refs), "chunk_hash", "left")
    return j.select("chunk_hash", "size_bytes", F.when(F.coalesce("live_count", F.lit(0)) > 0, "skipped").otherwise("deleted").alias("outcome"))


def cleanup_tally(outcomes: DataFrame) -> DataFrame:
    deleted = F.col("outcome") == "deleted"
    return outcomes.agg(F.count_if(deleted).alias("deleted"), F.coalesce(F.sum(F.when(deleted, F.col("size_bytes"))), F.lit(0)).cast("long").alias("bytes"), F.count_if(~deleted).alias("skipped"))


def rebuild_references(files: DataFrame, chunks: DataFrame) -> DataFrame:
    return files.join(chunks, "file_id").select(F.col("local_path").alias("file_path"), F.col("hash").alias("chunk_hash"), "chunk_index", F.col("backed_up_at").alias("referenced_at"))


def rebuilt_index(files: DataFrame, chunks: DataFrame, blobs: DataFrame) -> DataFrame:
    """The index out of files and the blob listing: incomplete files don't count; size and tier come from the listing, else from the chunk; the first uploader is the first path."""
    whole = files.join(incomplete_ids(chunks, blobs), "file_id", "left_anti")
    own = whole.select("file_id", "local_path").join(chunks, "file_id")
    g = own.groupBy(F.col("hash").alias("chunk_hash")).agg(F.count("*").cast("int").alias("reference_count"), F.min("local_path").alias("original_uploader_path"), F.max("length").alias("length"))
    there = blobs.where(F.col("blob_name").startswith("chunks/")).select(F.substring("blob_name", 8, 1000).alias("chunk_hash"), F.col("size_bytes").alias("stored"), "tier")
    return g.join(there, "chunk_hash", "left").select("chunk_hash", "original_uploader_path", F.coalesce("stored", F.col("length").cast("long")).alias("size_bytes"), "reference_count", F.coalesce("tier", F.lit(0)).alias("current_tier"))


def rebuild_deletions(files: DataFrame, chunks: DataFrame, blobs: DataFrame) -> DataFrame:
    """Blobs that a rebuild removes: metadata of incomplete files, and chunks that only they use; with labels."""
    bad = files.join(incomplete_ids(chunks, blobs), "file_id", "left_semi")
    meta = bad.select("blob_name", F.regexp_extract("local_path", r"([^/\\]*)$", 1).alias("label"))
    orphan = collectable_orphans(chunks, blobs)
    return meta.unionByName(orphan.select(F.concat(F.lit("chunks/"), "hash").alias("blob_name"), F.concat(F.left("hash", F.lit(8)), F.lit("...")).alias("label")))


def consistency_errors(files: DataFrame, chunks: DataFrame, index: DataFrame, refs: DataFrame) -> DataFrame:
    """Chunks of files that the index lacks, and files with chunks that no reference names (ignoring case)."""
    lost = chunks.select("hash").distinct().join(index.select(F.col("chunk_hash").alias("hash")), "hash", "left_anti").select(F.lit("hash").alias("kind"), F.col("hash").alias("name"))
    with_chunks = files.join(chunks.select("file_id"), "file_id", "left_semi")
    known = refs.select(path_key(F.col("file_path")).alias("k"))
    unnamed = with_chunks.join(known, path_key(F.col("local_path")) == F.col("k"), "left_anti").select(F.lit("file").alias("kind"), F.col("local_path").alias("name"))
    return lost.unionByName(unnamed)


def backfill_md5(index: DataFrame, blobs: DataFrame) -> DataFrame:
    """Digests for entries without one, out of the listing, and whether that was possible."""
    there = blobs.select(F.substring("blob_name", 8, 1000).alias("chunk_hash"), "content_md5")
    j = index.where("expected_md5 IS NULL").select("chunk_hash").join(there, "chunk_hash", "left")
    return j.withColumn("outcome", F.when(F.col("content_md5").isNotNull(), "promoted").otherwise("failed"))


def refreshed_tiers(index: DataFrame, blobs: DataFrame) -> DataFrame:
    there = blobs.select(F.substring("blob_name", 8, 1000).alias("chunk_hash"), "tier")
    return index.join(there, "chunk_hash", "left").withColumn("current_tier", F.coalesce("tier", "current_tier")).select(*index.columns)


#: Findings about an index alone, which a rebuild of that index repairs.
REPAIRABLE = [r"(?i)^wrong\s+#\s+of\s+entries\s+in\s+index\s+(\S+)\s*$", r"(?i)^row\s+\d+\s+missing\s+from\s+index\s+(\S+)\s*$", r"(?i)^non-unique\s+entry\s+in\s+index\s+(\S+)\s*$"]


def classified_findings(messages: DataFrame) -> DataFrame:
    """``messages``: (ordinal, message). Index names that can be repaired, in order of first mention, and other findings; blank lines and `ok` are none."""
    line = F.trim("message")
    m = messages.select("ordinal", line.alias("line")).where((F.col("line") != "") & (F.col("line") != "ok"))
    name = F.coalesce(*[F.nullif(F.regexp_extract("line", p, 1), F.lit("")) for p in REPAIRABLE])
    m = m.withColumn("name", name)
    good = m.where("name IS NOT NULL").groupBy("name").agg(F.min("ordinal").alias("ordinal")).select("ordinal", F.lit("repairable").alias("kind"), "name")
    return good.unionByName(m.where("name IS NULL").select("ordinal", F.lit("unrepairable").alias("kind"), F.col("line").alias("name"))).orderBy("ordinal")


def recovered_settings(fresh: DataFrame, quarantined: DataFrame) -> DataFrame:
    """Settings of a fresh catalog with the salt of the quarantined one and no failed logins. Without a salt nothing was ever encrypted, and there is nothing to rebuild from: an error. Keys and verification digests are not derived here."""
    salt = quarantined.agg(F.max("password_salt").alias("_salt"))
    had = F.when(F.col("_salt").isNull(), F.raise_error(F.lit("the quarantined catalog has no salt"))).otherwise(F.col("_salt"))
    out = fresh.crossJoin(salt).withColumn("password_salt", had).withColumn("failed_logins", F.lit(0)).withColumn("lockout_until", F.lit(None).cast("timestamp_ntz"))
    return out.select(*fresh.columns)


def rebuilt_from_quarantine(fresh: DataFrame, quarantined: DataFrame, files: DataFrame, chunks: DataFrame, blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A fresh catalog in place of a quarantined one: its settings, reseeded, and the index out of the metadata."""
    return recovered_settings(fresh, quarantined), rebuilt_index(files, chunks, blobs)


def update_file_chunks(index: DataFrame, refs: DataFrame, paths: DataFrame, new_chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New versions of the files ``paths`` (file_path), as their chunks (file_path, chunk_hash, chunk_index, referenced_at, size_bytes, tier, is_new): references to hashes that a file no longer has go first, then the new ones are added."""
    old = refs.join(paths.select("file_path"), "file_path", "left_semi")
    gone = old.join(new_chunks.select("file_path", "chunk_hash"), ["file_path", "chunk_hash"], "left_anti").select("file_path", "chunk_hash").distinct()
    left = refs.join(gone, ["file_path", "chunk_hash"], "left_anti")
    index, left = add_references(index, left, new_chunks)
    touched = gone.select("chunk_hash").distinct().withColumn("touched", F.lit(True))
    j = index.join(touched, "chunk_hash", "left").join(live_reference_counts(left), "chunk_hash", "left")
    n = F.when(F.col("touched"), F.coalesce("live_count", F.lit(0))).otherwise(F.col("reference_count")).cast("int")
    out = j.withColumn("reference_count", n).where(~F.coalesce(F.col("touched") & (F.col("reference_count") == 0), F.lit(False)))
    return out.select(*index.columns), left

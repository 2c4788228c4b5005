"""Plans out of two listings: what to create, update, delete or leave. Five notions of "unchanged" coexist and are kept apart.

Paths meet by upper case. Times are compared in microseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import path_key, relative_path
from ..sources.catalog import COMPLETED, EXCLUDED, FAILED


def _micros(a: Column) -> Column:
    return F.unix_micros(a.cast("timestamp"))


def within_two_seconds(a: Column, b: Column) -> Column:
    return F.abs(_micros(a) - _micros(b)) < 2_000_000


def _sides(local: DataFrame, files: DataFrame, how: str) -> DataFrame:
    here = local.select(path_key(F.col("path")).alias("key"), "path", "length", "modified", *(["sha256"] if "sha256" in local.columns else []))
    return here.join(files.withColumn("key", path_key(F.col("local_path"))), "key", how)


def _changed() -> Column:
    return (F.col("modified") > F.col("last_modified")) | (F.col("length") != F.col("file_size"))


def backup_preview(local: DataFrame, files: DataFrame, remote_paths: DataFrame | None = None) -> DataFrame:
    """Action and reason of each local file. With ``remote_paths`` (local_path), records that are gone remotely count as never backed up."""
    if remote_paths is not None:
        files = files.join(remote_paths.select(path_key(F.col("local_path")).alias("k")), path_key(F.col("local_path")) == F.col("k"), "left_semi")
    j = _sides(local, files, "left")
    status = F.col("status")
    sized = F.col("length") != F.col("file_size")
    action = F.when(status.isNull(), "Create").when(status == COMPLETED, F.when(_changed(), "Update").otherwise("Skip")).when(status == FAILED, "Create").otherwise("Skip")
    reason = (
        F.when(status.isNull(), "New file - never backed up")
        .when((status == COMPLETED) & sized, F.concat(F.lit("Size changed ("), F.col("file_size").cast("string"), F.lit(" → "), F.col("length").cast("string"), F.lit(")")))
        .when((status == COMPLETED) & _changed(), "Modified since last backup")
        .when(status == COMPLETED, "Already backed up and unchanged")
        .when(status == FAILED, "Retrying previously failed backup")
        .otherwise("Excluded or in-progress")
    )
    return j.select("path", F.col("length").alias("size"), action.alias("action"), reason.alias("reason"))


def initial_sync(local: DataFrame, files: DataFrame, pending: DataFrame) -> DataFrame:
    """Class of each local file and the change to queue (null: none); what is pending already wins."""
    waiting = pending.select(path_key(F.col("file_path")).alias("key")).distinct().withColumn("waiting", F.lit(True))
    j = _sides(local, files, "left").join(waiting, "key", "left")
    status = F.col("status")
    kind = (
        F.when(F.col("waiting"), "pending").when(status.isNull(), "new")
        .when(status == COMPLETED, F.when(_changed(), "modified").otherwise("unchanged"))
        .when(status == FAILED, "retried").otherwise("skipped")
    )
    return j.select("path", kind.alias("class")).withColumn("change_type", F.when(F.col("class") == "new", 0).when(F.col("class").isin("modified", "retried"), 1))


def unchanged_fast(local: DataFrame, files: DataFrame, force: bool = False) -> DataFrame:
    """Files that a backup may pass over: completed, same size, times less than two seconds apart."""
    same = (F.col("status") == COMPLETED) & (F.col("length") == F.col("file_size")) & within_two_seconds(F.col("modified"), F.col("last_modified"))
    return _sides(local, files, "inner").select("path", (same & F.lit(not force)).alias("unchanged"))


def mirror_to_remote(local: DataFrame, files: DataFrame, prefix: str) -> DataFrame:
    """Transfer, unchanged or delete, both directions; only catalog rows under the (plain) prefix can be deleted. Status doesn't matter."""
    j = _sides(local, files.where(path_key(F.col("local_path")).startswith(prefix.upper())), "full_outer")
    same = (F.col("length") == F.col("file_size")) & within_two_seconds(F.col("modified"), F.col("last_modified"))
    action = F.when(F.col("path").isNull(), "Delete").when(F.coalesce(same, F.lit(False)), "Unchanged").otherwise("Transfer")
    return j.select(F.coalesce("path", "local_path").alias("path"), action.alias("action"))


def mirror_to_local(files: DataFrame, target: DataFrame, source_base: str, target_base: str) -> DataFrame:
    """Create, overwrite, skip or delete in a target directory: same size, time and SHA-256 is identical."""
    wanted = files.withColumn("target", F.concat(F.lit(target_base.rstrip("/") + "/"), relative_path(F.col("local_path"), F.lit(source_base))))
    here = target.select(path_key(F.col("path")).alias("key"), "path", "length", "modified", "sha256")
    j = wanted.withColumn("key", path_key(F.col("target"))).join(here, "key", "full_outer")
    same = (F.col("length") == F.col("file_size")) & within_two_seconds(F.col("modified"), F.col("last_modified")) & (F.col("sha256") == F.col("file_hash"))
    action = F.when(F.col("local_path").isNull(), "Delete").when(F.col("path").isNull(), "Create").when(same, "Skip").otherwise("Overwrite")
    reason = (
        F.when(F.col("local_path").isNull(), "Not in backup").when(F.col("path").isNull(), "File does not exist locally").when(same, "File is identical")
        .when(F.col("length") != F.col("file_size"), F.concat(F.lit("Size differs (local: "), F.col("length").cast("string"), F.lit(", backup: "), F.col("file_size").cast("string"), F.lit(")")))
        .otherwise("Content differs")
    )
    return j.select(F.coalesce("target", "path").alias("path"), action.alias("action"), reason.alias("reason"))


def local_status(local: DataFrame, files: DataFrame) -> DataFrame:
    """BackedUp, Modified, New, Failed or Excluded. A valid backup is completed, hashed and not empty; times don't matter."""
    valid = (F.col("status") == COMPLETED) & (F.col("file_hash") != "") & (F.col("file_size") > 0)
    kind = (
        F.when(F.col("status").isNull(), "New").when(F.col("status") == EXCLUDED, "Excluded")
        .when(~valid, F.when((F.col("status") == FAILED) & (F.col("blob_name") != ""), "Failed").otherwise("New"))
        .when(F.col("length") != F.col("file_size"), "Modified").otherwise("BackedUp")
    )
    return _sides(local, files, "left").select("path", "length", kind.alias("state"))


def restore_preview(files: DataFrame, target: DataFrame) -> DataFrame:
    here = target.select(path_key(F.col("path")).alias("key")).distinct().withColumn("there", F.lit(True))
    return files.withColumn("key", path_key(F.col("local_path"))).join(here, "key", "left").select("local_path", F.when(F.col("there"), "Overwrite").otherwise("Create").alias("action"))


def delete_worklist(files: DataFrame, chunks: DataFrame, file_ids: DataFrame) -> DataFrame:
    """Blobs to delete for the chosen files: those of their chunks and their metadata."""
    chosen = files.join(file_ids, "file_id", "left_semi")
    blobs = chosen.select("file_id").join(chunks, "file_id").select("file_id", F.concat(F.lit("chunks/"), "hash").alias("blob_name"), F.lit("chunk").alias("label"))
    return blobs.unionByName(chosen.where("blob_name <> ''").select("file_id", "blob_name", F.lit("metadata").alias("label")))


def deleted_files(worklist: DataFrame, failed: DataFrame) -> DataFrame:
    """Files of which no blob failed to go."""
    bad = worklist.join(failed, "blob_name", "left_semi").select("file_id")
    return worklist.select("file_id").distinct().join(bad, "file_id", "left_anti")


def drain(pending: DataFrame) -> DataFrame:
    """What becomes of each change: deletions exclude the file and drop its references, others are backed up; deletions come first."""
    return pending.withColumn("step", F.when(F.col("change_type") == 2, "exclude").otherwise("backup")).orderBy((F.col("change_type") != 2), "detected_at", "id")


def warning(operation: Column, creates: Column, overwrites: Column, deletes: Column, store: str = "remote storage") -> Column:
    """The text to show before an operation: on delete_remote, mirror_local, overwriting, backup; else null."""
    n = lambda c: c.cast("string")
    return (
        F.when((deletes > 0) & (operation == "delete_remote"), F.concat(F.lit("⚠️ WARNING: "), n(deletes), F.lit(f" file(s) will be PERMANENTLY deleted from {store}. This cannot be undone!")))
        .when((deletes > 0) & (operation == "mirror_local"), F.concat(F.lit("⚠️ WARNING: "), n(deletes), F.lit(" local file(s) will be deleted to match the backup.")))
        .when(overwrites > 0, F.concat(F.lit("⚠️ "), n(overwrites), F.lit(" existing file(s) will be overwritten.")))
        .when((operation == "backup") & (creates > 0), F.concat(F.lit("ℹ️ "), n(creates), F.lit(f" file(s) will be uploaded to {store}.")))
    )

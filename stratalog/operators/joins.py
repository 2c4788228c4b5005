"""Joins of catalog, listings and references. Existence tests are semi and anti joins, written as such."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import path_key


MAX_FOLDERS = 1_000


def chunk_entries_of_file(index: DataFrame, refs: DataFrame, path: str) -> DataFrame:
    """A chunk that a file uses twice is one entry."""
    return index.join(refs.where(F.col("file_path") == path), "chunk_hash", "left_semi")


def files_missing_refs(files: DataFrame, chunks: DataFrame, refs: DataFrame) -> DataFrame:
    """Chunk rows of files that no reference names; as reference rows."""
    known = refs.select(F.col("file_path").alias("local_path"))
    return files.select("file_id", "local_path", "backed_up_at").join(known, "local_path", "left_anti").join(chunks, "file_id").select(
        F.col("local_path").alias("file_path"), F.col("hash").alias("chunk_hash"), "chunk_index", F.col("backed_up_at").alias("referenced_at")
    )


def blob_hash(blobs: DataFrame) -> DataFrame:
    """Chunk blobs with their hash; a collision suffix `_vN` is part of the name, not of the hash."""
    c = blobs.where(F.col("blob_name").startswith("chunks/"))
    return c.withColumn("chunk_hash", F.regexp_extract("blob_name", r"^chunks/(.*?)(?:_v\d+)?$", 1))


def remote_orphans(blobs: DataFrame, index: DataFrame, strip_versions: bool = True) -> DataFrame:
    """Chunk blobs that the index doesn't know or counts no reference for."""
    c = blob_hash(blobs) if strip_versions else blobs.where(F.col("blob_name").startswith("chunks/")).withColumn("chunk_hash", F.substring("blob_name", 8, 1000))
    live = index.where(F.col("reference_count") != 0).select("chunk_hash")
    return c.join(live, "chunk_hash", "left_anti")


def orphan_totals(blobs: DataFrame, index: DataFrame) -> DataFrame:
    """Chunk blobs looked at, orphans among them, and the bytes of these."""
    live = index.where(F.col("reference_count") != 0).select("chunk_hash").withColumn("live", F.lit(True))
    own = blob_hash(blobs).join(live, "chunk_hash", "left")
    orphan = F.col("live").isNull()
    return own.agg(F.count("*").alias("scanned"), F.count_if(orphan).alias("orphans"), F.coalesce(F.sum(F.when(orphan, F.col("size_bytes"))), F.lit(0)).cast("long").alias("orphan_bytes"))


def missing_chunks(chunks: DataFrame, blobs: DataFrame) -> DataFrame:
    """Hashes that files need and no blob holds."""
    there = blobs.where(F.col("blob_name").startswith("chunks/")).select(F.substring("blob_name", 8, 1000).alias("hash"))
    return chunks.select("hash").distinct().join(there, "hash", "left_anti")


def incomplete_files(files: DataFrame, chunks: DataFrame, missing: DataFrame) -> DataFrame:
    return files.join(chunks.join(missing, "hash", "left_semi"), "file_id", "left_semi")


def incomplete_ids(chunks: DataFrame, blobs: DataFrame) -> DataFrame:
    """Ids of files with a chunk that no blob holds; the chunk table is read once."""
    there = blobs.where(F.col("blob_name").startswith("chunks/")).select(F.substring("blob_name", 8, 1000).alias("hash"))
    return chunks.join(there, "hash", "left_anti").select("file_id").distinct()


def collectable_orphans(chunks: DataFrame, blobs: DataFrame) -> DataFrame:
    """Blobs in store that only incomplete files use: whether all users of a hash are incomplete is one aggregation."""
    bad = incomplete_ids(chunks, blobs).withColumn("bad", F.lit(True))
    there = blobs.where(F.col("blob_name").startswith("chunks/")).select(F.substring("blob_name", 8, 1000).alias("hash"))
    users = chunks.select("file_id", "hash").join(bad, "file_id", "left").groupBy("hash").agg(F.min(F.coalesce("bad", F.lit(False))).alias("all_bad"))
    return users.where("all_bad").select("hash").join(there, "hash", "left_semi")


def removed_hashes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunk rows of the old version whose hash the new one lacks; repeats stay."""
    return old.join(new.select("hash"), "hash", "left_anti")


def folder_of_file(files: DataFrame, folders: DataFrame, default_tier: int = 0) -> DataFrame:
    """First enabled folder in order whose path is a prefix (not the deepest), and its tier. Each file row is a row of the result.

    The folder table is the configuration of one installation: at most ``MAX_FOLDERS`` rows, which become an array in the
    plan, so that files are matched where they are read. More rows than that are no configuration and an error."""
    own = folders.where("enabled").orderBy("ordinal").select("path", "tier").take(MAX_FOLDERS + 1)
    if len(own) > MAX_FOLDERS:
        raise ValueError(f"more than {MAX_FOLDERS} watched folders")
    key = path_key(F.col("local_path"))
    first = F.coalesce(*[F.when(key.startswith(r.path.upper()), F.struct(F.lit(r.path).alias("path"), F.lit(r.tier).alias("tier"))) for r in own], F.lit(None).cast("struct<path:string,tier:int>"))
    hit = files.select("file_id", "local_path", first.alias("folder"))
    return hit.select("file_id", "local_path", F.col("folder.path").alias("folder"), F.coalesce("folder.tier", F.lit(default_tier)).alias("tier"))


def stale_pending(pending: DataFrame, files: DataFrame, local: DataFrame) -> DataFrame:
    """Changes to drop: the file is completed and locally there in the same size; or it is not completed, the change a deletion and the file excluded."""
    f = files.select(F.col("local_path").alias("p"), "status", "file_size")
    here = local.select(path_key(F.col("path")).alias("k"), "length")
    j = pending.join(f, F.col("file_path") == F.col("p")).join(here, path_key(F.col("file_path")) == F.col("k"), "left")
    done = (F.col("status") == 2) & F.col("length").isNotNull() & (F.col("length") == F.col("file_size"))
    gone = (F.col("status") != 2) & (F.col("change_type") == 2) & (F.col("status") == 4)
    return j.where(done | gone).select("id", "file_path", "change_type", "detected_at")


def newest_pair(databases: DataFrame, salts: DataFrame) -> DataFrame:
    """Quarantined database and salt of one stamp, the newest."""
    return databases.join(salts, "stamp").orderBy(F.desc("stamp")).limit(1)

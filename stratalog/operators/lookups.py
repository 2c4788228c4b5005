"""Scans, lookups, filters, sorts and top-k over catalog relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import path_key


CHUNK = ("chunk_order", "chunk_index", "offset", "length", "hash")


def nested_files(files: DataFrame, chunks: DataFrame, columns: tuple[str, ...] = CHUNK) -> DataFrame:
    """Every file with its chunks in order as an array; chunks of no file are left out. ``columns``, the order first: what a query needs of a chunk; the planner can't see into the array, and other columns would be read and shuffled for nothing."""
    own = chunks.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("chunks"))
    empty = F.filter(F.array(F.lit(None).cast(own.schema["chunks"].dataType.elementType)), lambda x: x.isNotNull())
    return files.join(own, "file_id", "left").withColumn("chunks", F.coalesce("chunks", empty))


def where_equal(df: DataFrame, column: str, value) -> DataFrame:
    """Point lookup; the comparison reaches the Parquet scan."""
    return df.where(F.col(column) == F.lit(value))


def chunks_of_file(chunks: DataFrame, file_id: int) -> DataFrame:
    return chunks.where(F.col("file_id") == file_id).orderBy("chunk_order")


def referencing_files(refs: DataFrame, chunk_hash: str) -> DataFrame:
    return refs.where(F.col("chunk_hash") == chunk_hash).select("file_path", "chunk_index")


def unverified(index: DataFrame) -> DataFrame:
    return index.where(F.col("expected_md5").isNull())


def index_orphans(index: DataFrame) -> DataFrame:
    return index.where(F.col("reference_count") == 0)


def search(files: DataFrame, text: str | None, column: str = "local_path") -> DataFrame:
    """Substring ignoring case; blank text finds everything."""
    return files if not text or not text.strip() else files.where(F.upper(column).contains(text.strip().upper()))


def in_folder(files: DataFrame, prefix: str, column: str = "local_path") -> DataFrame:
    """Plain prefix, ignoring case."""
    return files.where(path_key(F.col(column)).startswith(prefix.upper()))


def since(files: DataFrame, cutoff: str, column: str = "backed_up_at") -> DataFrame:
    return files.where(F.col(column) >= F.lit(cutoff).cast("timestamp_ntz"))


def failed_in_last_run(files: DataFrame, failures: DataFrame, runs: DataFrame) -> DataFrame:
    last = runs.orderBy(F.desc("started_at"), F.desc("id")).limit(1).select(F.col("id").alias("run_id"))
    return files.join(failures.join(F.broadcast(last), "run_id", "left_semi"), "file_id", "left_semi")


def in_scope(files: DataFrame, failures: DataFrame, runs: DataFrame, preset: str, now: str, session_start: str) -> DataFrame:
    """Files of a preset: session, 24h, 7d, all, or failed_last_run."""
    hours = {"24h": 24, "7d": 168}
    if preset == "all":
        return files
    if preset == "failed_last_run":
        return failed_in_last_run(files, failures, runs)
    if preset == "session":
        return since(files, session_start)
    return files.where(F.col("backed_up_at") >= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(hours[preset])))


def any_row(df: DataFrame) -> DataFrame:
    """Whether there is a row at all; reads no more than it takes to find one."""
    return df.limit(1).agg((F.count("*") > 0).alias("found"))


def oldest_pending(pending: DataFrame, n: int) -> DataFrame:
    """Oldest first, ties by id; without a positive n, 100."""
    return pending.orderBy("detected_at", "id").limit(n if n > 0 else 100)


def newest_runs(runs: DataFrame, n: int) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("id")).limit(n)


def failures_of_run(failures: DataFrame, run_id: int) -> DataFrame:
    return failures.where(F.col("run_id") == run_id).orderBy(F.desc("failure_tier"), "local_path")


def largest_first(files: DataFrame) -> DataFrame:
    return files.orderBy(F.desc("file_size"), "local_path")


def by_path(df: DataFrame, column: str = "local_path") -> DataFrame:
    return df.orderBy(path_key(F.col(column)))


def folders_first(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy(F.desc("is_folder"), path_key(F.col("name")))


def listed(blobs: DataFrame, prefix: str) -> DataFrame:
    """Blobs under a prefix, with the rest of the name."""
    return blobs.where(F.col("blob_name").startswith(prefix)).withColumn("name", F.substring("blob_name", len(prefix) + 1, 2**31 - 1))


def blob_properties(wanted: DataFrame, blobs: DataFrame) -> DataFrame:
    """Existence, size and digest of each wanted blob name."""
    return wanted.join(blobs.select("blob_name", "size_bytes", "content_md5"), "blob_name", "left").withColumn("found", F.col("size_bytes").isNotNull())


def decoded_metadata(raw: DataFrame, column: str = "json") -> DataFrame:
    """Nested files out of metadata JSON: chunk indexes must be 0 to n-1, names come from hashes, status is completed; others are dropped."""
    schema = "LocalPath string, FileSize long, LastModified timestamp, FileHash string, Version int, MetadataVersion int, Chunks array<struct<Index:int,Hash:string,Offset:bigint,Length:int>>"
    f = raw.select(F.from_json(column, schema).alias("f")).select("f.*").where(F.col("LocalPath").isNotNull())
    right = F.transform("Chunks", lambda c: c["Index"]) == F.transform("Chunks", lambda c, i: i)
    f = f.where(F.coalesce(right | (F.size("Chunks") == 0), F.lit(False)))
    chunk = lambda c: F.struct(c["Index"].alias("chunk_index"), c["Offset"].alias("offset"), c["Length"].alias("length"), c["Hash"].alias("hash"), F.concat(F.lit("chunks/"), c["Hash"]).alias("blob_name"))
    return f.select(
        F.col("LocalPath").alias("local_path"),
        F.col("FileSize").alias("file_size"),
        F.col("LastModified").alias("last_modified"),
        F.col("FileHash").alias("file_hash"),
        F.lit(2).alias("status"),
        F.coalesce("Version", F.lit(1)).alias("metadata_version"),
        F.transform("Chunks", chunk).alias("chunks"),
    )


def read_range(content: Column, offset: Column, length: Column) -> Column:
    return F.substring(content, (offset + 1).cast("int"), length.cast("int"))


def configuration(settings: DataFrame, folders: DataFrame, excludes: DataFrame, globs: DataFrame) -> DataFrame:
    """One row: the settings, the folders in order with both kinds of excludes, the global globs in order."""
    own = lambda k: F.transform(F.array_sort(F.filter(F.collect_list(F.struct("exclude_id", "kind", "pattern")), lambda x: x["kind"] == k)), lambda x: x["pattern"])
    e = excludes.select(F.col("id").alias("exclude_id"), F.col("folder_id").alias("id"), "kind", "pattern").groupBy("id").agg(own(0).alias("exclude_patterns"), own(1).alias("exclude_subfolders"))
    f = folders.join(e, "id", "left").agg(F.array_sort(F.collect_list(F.struct(*folders.columns, "exclude_patterns", "exclude_subfolders"))).alias("folders"))
    g = globs.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "pattern"))), lambda x: x["pattern"]).alias("global_patterns"))
    return settings.crossJoin(f).crossJoin(g)

"""State transitions of catalog tables: (old state, change) to new state, as plans.

Parquet has no row-level changes; a new state is written beside the old one and a pointer is swapped (see
`sources.versions`). "Last wins" always follows an explicit ordinal column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import path_key


def last_of(delta: DataFrame, keys: list, ordinal: str) -> DataFrame:
    """The last row of each key; by aggregation, so repeats of a key are combined where they are read."""
    other = [c for c in delta.columns if c != ordinal]
    last = delta.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(F.struct(*other), F.col(ordinal)).alias("r"))
    return last.select("r.*")


def upsert(old: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(delta.select(*keys), keys, "left_anti").unionByName(delta)


def upsert_files(files: DataFrame, chunks: DataFrame, refs: DataFrame, new_files: DataFrame, new_chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files by path; a file's chunks and references are replaced whole. A reference is dated by its file's backup."""
    files_out = upsert(files, new_files, ["local_path"])
    changed = files.join(new_files.select("local_path"), "local_path", "left_semi").select("file_id").union(new_files.select("file_id"))
    chunks_out = chunks.join(changed, "file_id", "left_anti").unionByName(new_chunks)
    new_refs = new_chunks.join(new_files.select("file_id", "local_path", "backed_up_at"), "file_id").select(F.col("local_path").alias("file_path"), F.col("hash").alias("chunk_hash"), "chunk_index", F.col("backed_up_at").alias("referenced_at"))
    refs_out = refs.join(new_files.select(F.col("local_path").alias("file_path")), "file_path", "left_anti").unionByName(new_refs)
    return files_out, chunks_out, refs_out


def bulk_insert(files: DataFrame, chunks: DataFrame, refs: DataFrame, new_files: DataFrame, new_chunks: DataFrame, with_refs: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Append files with their chunks and, unless an index is being rebuilt, their references; a path that is there already stops the job."""
    files_out = insert_unique(files, new_files, "local_path")
    if with_refs:
        own = new_chunks.join(new_files.select("file_id", "local_path", "backed_up_at"), "file_id")
        refs = refs.unionByName(own.select(F.col("local_path").alias("file_path"), F.col("hash").alias("chunk_hash"), "chunk_index", F.col("backed_up_at").alias("referenced_at")))
    return files_out, chunks.unionByName(new_chunks), refs


def insert_unique(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Append; a key that is there already (or twice in the new rows) stops the job."""
    both = old.unionByName(new)
    counts = both.groupBy(key).agg(F.count("*").alias("_n"))
    ok = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate key: "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)
    return both.join(counts, key).where(ok).drop("_n")


def upsert_index(index: DataFrame, delta: DataFrame, ordinal: str | None = None) -> DataFrame:
    """Chunk entries by hash, the last of a batch wins; a stamped digest stays."""
    if ordinal:
        delta = last_of(delta, [F.col("chunk_hash")], ordinal)
    old = index.select("chunk_hash", F.col("expected_md5").alias("_md5"))
    delta = delta.drop("expected_md5").join(old, "chunk_hash", "left").withColumnRenamed("_md5", "expected_md5")
    return upsert(index, delta.select(*index.columns), ["chunk_hash"])


def stamp_md5(index: DataFrame, stamps: DataFrame) -> DataFrame:
    """Digests by hash; a hash the index lacks gets a placeholder of size and count zero."""
    j = index.join(stamps.select("chunk_hash", F.col("expected_md5").alias("_md5")), "chunk_hash", "full_outer")
    blank = {"original_uploader_path": F.lit(""), "size_bytes": F.lit(0), "reference_count": F.lit(0), "current_tier": F.lit(0)}
    return j.select("chunk_hash", *[F.coalesce(c, v).alias(c) for c, v in blank.items()], F.coalesce("_md5", "expected_md5").alias("expected_md5"))


def delete_by(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys, on, "left_anti")


def deleted_count(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys, on, "left_semi").agg(F.count("*").alias("deleted"))


def cleared(df: DataFrame) -> DataFrame:
    return df.limit(0)


def upsert_refs(refs: DataFrame, delta: DataFrame) -> DataFrame:
    return upsert(refs, delta, ["file_path", "chunk_hash", "chunk_index"])


def queue_changes(pending: DataFrame, batch: DataFrame, ordinal: str) -> DataFrame:
    """Batch of changes: of each path, ignoring case, the last wins and replaces what was queued."""
    last = last_of(batch, [path_key(F.col("file_path"))], ordinal)
    keys = last.select(path_key(F.col("file_path")).alias("_k"))
    kept = pending.join(keys, path_key(F.col("file_path")) == F.col("_k"), "left_anti")
    return kept.unionByName(last.select(*pending.columns))


def remove_pending(pending: DataFrame, paths: DataFrame) -> DataFrame:
    return pending.join(paths.select(path_key(F.col("file_path")).alias("_k")), path_key(F.col("file_path")) == F.col("_k"), "left_anti")


def replace_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Delete all, insert again (configuration)."""
    return new.select(*old.columns)


def next_id(df: DataFrame) -> DataFrame:
    return df.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))


def insert_run(runs: DataFrame, run: DataFrame) -> DataFrame:
    """``run``: one row without an id; it gets the next one."""
    return runs.unionByName(run.crossJoin(next_id(runs)).select(*runs.columns))


def update_runs(runs: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows of ``changed`` replace those of their id; an id that isn't there changes nothing."""
    return upsert(runs, changed.join(runs.select("id"), "id", "left_semi").select(*runs.columns), ["id"])


def keep_run_failures(failures: DataFrame, run_id: int) -> DataFrame:
    return failures.where(F.col("run_id") == run_id)


def prune_runs(runs: DataFrame, keep: int = 30) -> DataFrame:
    """The newest runs; a top-k, of which each task sends k rows."""
    newest = runs.orderBy(F.desc("started_at"), F.desc("id")).limit(keep).select("id")
    return runs.join(newest, "id", "left_semi")


def retain_days(records: DataFrame, today: str, days: int = 30) -> DataFrame:
    return records.where(F.to_date("timestamp") > F.date_sub(F.lit(today).cast("date"), days))


def exported_index(index: DataFrame, refs: DataFrame, summary: DataFrame) -> DataFrame:
    """Version 2 of the snapshot, one JSON line per entry and reference and one for the summary, so that no line grows with the corpus."""
    line = lambda kind, df: df.select(F.to_json(F.struct(F.lit(kind).alias("kind"), F.lit(2).alias("version"), F.struct("*").alias("row"))).alias("value"))
    return line("summary", summary).union(line("entry", index)).union(line("ref", refs))


def imported_refs(entries: DataFrame, reverse: DataFrame) -> DataFrame:
    """References of a snapshot: its list if it has one, else out of the entries' nested files."""
    nested = entries.select("chunk_hash", F.explode("referencing_files").alias("f")).select(F.col("f.file_path").alias("file_path"), "chunk_hash", F.col("f.chunk_index").alias("chunk_index"))
    has = reverse.agg((F.count("*") > 0).alias("has"))
    return reverse.unionByName(nested.crossJoin(F.broadcast(has)).where(~F.col("has")).drop("has"))


def upload_names(uploads: DataFrame, stored: DataFrame) -> DataFrame:
    """Name of each upload (hash, content): new, reused when a version has the same bytes, else the lowest free version from 2 to 1000."""
    v = stored.select(F.regexp_extract("blob_name", r"^chunks/(.*?)(?:_v\d+)?$", 1).alias("hash"), F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("blob_name", r"_v(\d+)$", 1), F.lit("")), F.lit("9999")).cast("int"), F.lit(1)).alias("version"), "content")
    digest = lambda c: F.sha2(c, 256)
    taken = v.groupBy("hash").agg(F.collect_set("version").alias("taken"))
    same = v.groupBy("hash", digest(F.col("content")).alias("digest")).agg(F.min("version").alias("same"))
    u = uploads.withColumn("digest", digest(F.col("content"))).join(same, ["hash", "digest"], "left").join(taken, "hash", "left")
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.lit(1000)), F.coalesce("taken", F.array().cast("array<int>"))))
    version = F.coalesce("same", free, F.raise_error(F.concat(F.lit("no free version of chunks/"), F.col("hash"))).cast("int"))
    name = F.concat(F.lit("chunks/"), "hash", F.when(version > 1, F.concat(F.lit("_v"), version.cast("string"))).otherwise(""))
    return u.select("hash", "content", name.alias("blob_name"), F.col("same").isNotNull().alias("reused"))


def blob_action(blobs: DataFrame, wanted_tier: int) -> DataFrame:
    """What a tier change does to each blob: archived ones can't be written in place."""
    return blobs.withColumn("action", F.when(F.col("tier") == wanted_tier, "Unchanged").when(F.col("tier") == 3, "SkippedArchived").otherwise("SetTier"))


def tier_migration(files: DataFrame, chunks: DataFrame, file_ids: DataFrame) -> DataFrame:
    """Chunks that move with the chosen files, and how many other files each of them drags along."""
    moved = chunks.join(file_ids, "file_id", "left_semi").select("hash").distinct()
    others = chunks.join(file_ids, "file_id", "left_anti").join(moved, "hash", "left_semi").groupBy("hash").agg(F.countDistinct("file_id").alias("other_files"))
    return moved.join(others, "hash", "left").select("hash", F.coalesce("other_files", F.lit(0)).alias("other_files"))


def bundle_members(files: DataFrame, limit: int = 256 << 20) -> DataFrame:
    """Which files a diagnostic bundle takes: logs, diagnostics and metrics, no secrets, none above the limit."""
    path = F.lower(F.replace("path", F.lit("\\"), F.lit("/")))
    wanted = path.rlike(r"(^|/)(logs?|diagnostics|metrics)/") | path.rlike(r"\.(log|jsonl)$")
    secret = path.rlike(r"\.(db|key|salt|pfx|pem)$|secret|password|recovery")
    return files.withColumn("included", wanted & ~secret & (F.col("length") <= limit))


def numbered(df: DataFrame, partition: list[str], order: list) -> DataFrame:
    """Position of each row in its list, from 0."""
    return df.withColumn("chunk_order", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1)

"""All catalog queries over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, hashing, paths
from ..operators import aggregates as ag
from ..operators import chunking as cd
from ..operators import integrity as it
from ..operators import joins as jo
from ..operators import lookups as lo
from ..operators import maintenance as mx
from ..operators import mutations as mu
from ..operators import reconcile as rc
from ..operators import telemetry as tm
from ..operators import tree
from ..sources.catalog import GLOBS, SQL, Catalog, hash_of
from ..streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a function of a `Catalog`; the SQL goes on after the common relations."""

    def register(fn: Callable[[Catalog], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Catalog(spark, sf_dir))
        if sql:
            ORACLE_SQL[fn.__name__] = f"{SQL.rstrip()}{sql}" if sql.lstrip().startswith(",") else f"{SQL}{sql}"
        return fn

    return register


def sql_hash(key: str) -> str:
    return f"upper(sha256(CAST({key} AS VARCHAR)))"


# --- scans, lookups, filters ---


@query("SELECT file_id, local_path, status, file_size, coalesce(n, 0) AS n_chunks, coalesce(orders_of, '') AS chunk_orders FROM files LEFT JOIN (SELECT file_id, count(*) AS n, string_agg(chunk_order, ',' ORDER BY chunk_order) AS orders_of FROM file_chunks GROUP BY file_id) USING (file_id)")
def files_with_chunks(c):
    """SC1, JO4, ST7"""
    return lo.nested_files(c.files, c.file_chunks, ("chunk_order",)).select("file_id", "local_path", "status", "file_size", F.size("chunks").cast("long").alias("n_chunks"), F.array_join(F.transform("chunks", lambda x: x["chunk_order"].cast("string")), ",").alias("chunk_orders"))


@query("SELECT file_id, local_path, file_size, status FROM files WHERE file_id = 100")
def file_lookup(c):
    """SC2, FI1"""
    return lo.where_equal(c.files, "file_id", 100).select("file_id", "local_path", "file_size", "status")


@query('SELECT chunk_order, "offset", length, hash FROM file_chunks WHERE file_id = 100')
def chunks_of_file(c):
    """SC3, SO8, WI1"""
    return lo.chunks_of_file(c.file_chunks, 100).select("chunk_order", "offset", "length", "hash")


@query(f"SELECT chunk_hash, size_bytes, reference_count, current_tier FROM chunk_index WHERE chunk_hash = {sql_hash('77')}")
def chunk_entry(c):
    """SC4"""
    h = hash_of(F.lit(77))
    return c.chunk_index.where(F.col("chunk_hash") == h).select("chunk_hash", "size_bytes", "reference_count", "current_tier")


@query("SELECT chunk_hash, original_uploader_path, size_bytes, reference_count, current_tier FROM chunk_index")
def chunk_index_scan(c):
    """SC5, SC6"""
    return c.chunk_index.select("chunk_hash", "original_uploader_path", "size_bytes", "reference_count", "current_tier")


@query("SELECT * FROM chunk_file_refs")
def reference_scan(c):
    """SC7"""
    return c.chunk_file_refs


@query("SELECT substr(blob_name, 8) AS name, size_bytes, tier FROM remote_blobs WHERE starts_with(blob_name, 'chunks/')")
def blob_listing(c):
    """SC11, SC12, FI16"""
    return lo.listed(c.remote_blobs, "chunks/").select("name", "size_bytes", "tier")


@query("SELECT 'chunks/' || chunk_hash AS blob_name, size_bytes, content_md5, size_bytes IS NOT NULL AS found FROM (SELECT chunk_hash FROM chunk_index) LEFT JOIN remote_blobs ON blob_name = 'chunks/' || chunk_hash")
def blob_properties(c):
    """SC13"""
    return lo.blob_properties(c.chunk_index.select(F.concat(F.lit("chunks/"), "chunk_hash").alias("blob_name")), c.remote_blobs)


@query("SELECT local_path, file_size, file_hash, n_chunks FROM files JOIN (SELECT file_id, count(*) AS n_chunks FROM file_chunks GROUP BY file_id) USING (file_id) WHERE status = 2 AND file_id % 10 <> 0")
def metadata_decode(c):
    """SC14, SC15: catalog rows to metadata JSON and back; of every tenth file the chunk indexes have a hole."""
    nested = lo.nested_files(c.files.where("status = 2"), c.file_chunks).where(F.size("chunks") > 0)
    chunk = lambda x: F.struct((x["chunk_index"] + F.when((F.col("file_id") % 10 == 0), 1).otherwise(0)).alias("Index"), x["hash"].alias("Hash"), x["offset"].alias("Offset"), x["length"].alias("Length"))
    raw = nested.select(F.to_json(F.struct(F.col("local_path").alias("LocalPath"), F.col("file_size").alias("FileSize"), F.col("file_hash").alias("FileHash"), F.transform("chunks", chunk).alias("Chunks"))).alias("json"))
    return lo.decoded_metadata(raw).select("local_path", "file_size", "file_hash", F.size("chunks").cast("long").alias("n_chunks"))


@query("SELECT chunk_hash FROM chunk_index WHERE expected_md5 IS NULL")
def unverified_chunks(c):
    """FI2"""
    return lo.unverified(c.chunk_index).select("chunk_hash")


@query("SELECT chunk_hash, size_bytes FROM chunk_index WHERE reference_count = 0")
def orphans_in_index(c):
    """FI3"""
    return lo.index_orphans(c.chunk_index).select("chunk_hash", "size_bytes")


@query("SELECT file_id FROM files WHERE starts_with(upper(local_path), 'C:/DATA/1-URGENT/C1')")
def files_in_folder(c):
    """FI7"""
    return lo.in_folder(c.files, "c:/data/1-urgent/c1").select("file_id")


@query("SELECT file_id FROM files WHERE starts_with(upper(local_path), 'C:/DATA/1-URGENT/C10/')")
def files_below_folder(c):
    """FI8"""
    return c.files.where(paths.under_prefix(F.col("local_path"), F.lit("c:/data/1-urgent/c10/"), strict=True)).select("file_id")


@query("SELECT file_id FROM files WHERE regexp_matches(regexp_extract(local_path, '([^/]*)$', 1), '(?i)^.*7\\.dat$') OR regexp_matches(regexp_extract(local_path, '([^/]*)$', 1), '(?i)^f1.\\.dat$')")
def glob_filter(c):
    """FI9, FI10"""
    return c.files.where(paths.matches_any(paths.file_name(F.col("local_path")), ["*7.DAT", "f1?.dat", " "])).select("file_id")


@query("""SELECT file_id FROM (SELECT *, regexp_extract(local_path, '([^/]*)$', 1) AS n, CASE WHEN starts_with(upper(local_path), 'C:/DATA') THEN substr(local_path, 9) ELSE regexp_extract(local_path, '([^/]*)$', 1) END AS r FROM files)
WHERE NOT (n ILIKE '%7.dat' OR r ILIKE '%7.dat' OR n ILIKE 'c1_' OR r ILIKE 'c1_' OR starts_with(upper(r), '2-HIGH/C1') OR n ILIKE '%.bak')""")
def exclusion_filter(c):
    """FI11"""
    return c.files.where(~paths.excluded(F.col("local_path"), F.lit("c:/data/"), GLOBS, ["*.BAK"], ["2-high/c1/"])).select("file_id")


@query("SELECT file_id FROM files WHERE contains(upper(local_path), 'SPECIFIED/C7')")
def search_files(c):
    """FI12"""
    return lo.search(c.files, " specified/c7 ").select("file_id")


@query("SELECT file_id FROM files WHERE backed_up_at >= TIMESTAMP '1998-01-01'")
def files_since(c):
    """FI13"""
    return lo.since(c.files, "1998-01-01").select("file_id")


@query("SELECT file_id FROM files WHERE file_id IN (SELECT file_id FROM failures WHERE run_id = (SELECT id FROM runs ORDER BY started_at DESC, id DESC LIMIT 1))")
def failed_last_run(c):
    """FI13, FI6"""
    return lo.failed_in_last_run(c.files, c.failures, c.runs).select("file_id")


@query("SELECT blob_name, regexp_matches(substr(blob_name, 8), '^[0-9A-Fa-f]{64}$') AS valid FROM remote_blobs")
def hash_validity(c):
    """FI14"""
    return c.remote_blobs.select("blob_name", paths.valid_hash(F.substring("blob_name", 8, 1000)).alias("valid"))


@query("SELECT file_id, file_id % 4 = 0 OR starts_with(upper(local_path), 'C:/DATA/5-LOW/') AS unsafe FROM files")
def restore_path_safety(c):
    """FI15"""
    target = F.when(F.col("file_id") % 4 == 0, F.concat(F.lit("C:/x/../"), "local_path")).otherwise(F.col("local_path"))
    return c.files.select("file_id", paths.unsafe_target(target, ["C:/data/5-LOW"]).alias("unsafe"))


@query("SELECT id, file_path, change_type FROM pending_changes ORDER BY detected_at, id LIMIT 50")
def oldest_pending_50(c):
    """SO1"""
    return lo.oldest_pending(c.pending_changes, 50).select("id", "file_path", "change_type")


@query("SELECT id, started_at FROM runs ORDER BY started_at DESC, id DESC LIMIT 10")
def recent_runs_topk(c):
    """SO2"""
    return lo.newest_runs(c.runs, 10).select("id", "started_at")


@query("SELECT local_path, failure_tier, failure_reason, chunk_hash FROM failures WHERE run_id = 3")
def failures_ordered(c):
    """SO3"""
    return lo.failures_of_run(c.failures, 3).select("local_path", "failure_tier", "failure_reason", "chunk_hash")


@query("SELECT file_id, file_size FROM files ORDER BY file_size DESC, local_path LIMIT 20")
def largest_files(c):
    """SO7, SO9"""
    return lo.largest_first(c.files).limit(20).select("file_id", "file_size")


# --- joins ---


@query("SELECT chunk_hash, size_bytes FROM chunk_index WHERE chunk_hash IN (SELECT chunk_hash FROM chunk_file_refs WHERE file_path = (SELECT min(local_path) FROM files WHERE local_path IN (SELECT file_path FROM chunk_file_refs)))")
def chunk_entries_for_file(c):
    """JO1"""
    first = c.files.join(c.chunk_file_refs, F.col("local_path") == F.col("file_path"), "left_semi").agg(F.min("local_path").alias("file_path"))
    return c.chunk_index.join(c.chunk_file_refs.join(F.broadcast(first), "file_path", "left_semi"), "chunk_hash", "left_semi").select("chunk_hash", "size_bytes")


@query("SELECT local_path AS file_path, hash AS chunk_hash, chunk_index FROM files JOIN file_chunks USING (file_id) WHERE local_path NOT IN (SELECT file_path FROM chunk_file_refs)")
def files_missing_refs(c):
    """JO2, FI5, IX5"""
    return jo.files_missing_refs(c.files, c.file_chunks, c.chunk_file_refs).drop("referenced_at")


@query("SELECT count(DISTINCT local_path) AS n FROM files JOIN file_chunks USING (file_id) WHERE local_path NOT IN (SELECT file_path FROM chunk_file_refs)")
def files_missing_refs_count(c):
    """AG4"""
    return jo.files_missing_refs(c.files, c.file_chunks, c.chunk_file_refs).agg(F.countDistinct("file_path").alias("n"))


@query(f"SELECT file_path, chunk_index FROM chunk_file_refs WHERE chunk_hash = {sql_hash('5')}")
def referencing_files(c):
    """JO3"""
    return c.chunk_file_refs.where(F.col("chunk_hash") == hash_of(F.lit(5))).select("file_path", "chunk_index")


@query("SELECT blob_name, size_bytes FROM remote_blobs WHERE regexp_extract(blob_name, '^chunks/([^_]*)', 1) NOT IN (SELECT chunk_hash FROM chunk_index WHERE reference_count <> 0)")
def remote_orphans(c):
    """JO7, AG7"""
    return jo.remote_orphans(c.remote_blobs, c.chunk_index).select("blob_name", "size_bytes")


@query("SELECT DISTINCT hash FROM file_chunks WHERE 'chunks/' || hash NOT IN (SELECT blob_name FROM remote_blobs)")
def missing_chunks(c):
    """JO8, SE2"""
    return jo.missing_chunks(c.file_chunks, c.remote_blobs)


@query("SELECT file_id FROM files WHERE file_id IN (SELECT file_id FROM file_chunks WHERE 'chunks/' || hash NOT IN (SELECT blob_name FROM remote_blobs))")
def incomplete_files(c):
    """JO9, IN9"""
    return jo.incomplete_files(c.files, c.file_chunks, jo.missing_chunks(c.file_chunks, c.remote_blobs)).select("file_id")


@query(", bad AS (SELECT DISTINCT file_id FROM file_chunks WHERE 'chunks/' || hash NOT IN (SELECT blob_name FROM remote_blobs)) SELECT DISTINCT hash FROM file_chunks WHERE file_id IN (SELECT file_id FROM bad) AND hash NOT IN (SELECT hash FROM file_chunks WHERE file_id NOT IN (SELECT file_id FROM bad)) AND 'chunks/' || hash IN (SELECT blob_name FROM remote_blobs)")
def collectable_orphans(c):
    """JO10, SE3"""
    return jo.collectable_orphans(c.file_chunks, c.remote_blobs)


@query("SELECT file_id, chunk_order, hash FROM file_chunks WHERE file_id % 2 = 0 AND hash NOT IN (SELECT hash FROM file_chunks WHERE file_id % 2 = 1)")
def removed_hashes(c):
    """JO11"""
    return jo.removed_hashes(c.file_chunks.where("file_id % 2 = 0"), c.file_chunks.where("file_id % 2 = 1")).select("file_id", "chunk_order", "hash")


@query('SELECT file_id, (SELECT arg_min(path, "ordinal") FROM folders WHERE enabled AND starts_with(upper(local_path), upper(path))) AS folder, coalesce((SELECT arg_min(tier, "ordinal") FROM folders WHERE enabled AND starts_with(upper(local_path), upper(path))), 0) AS tier FROM files')
def folder_for_file(c):
    """JO14"""
    return jo.folder_of_file(c.files, c.folders).select("file_id", "folder", "tier")


@query("SELECT o.file_id FROM (SELECT file_id, local_path, status, file_size, file_id % 4 AS change_type FROM files WHERE file_id % 2 = 0) o LEFT JOIN local_files l ON upper(l.path) = upper(local_path) WHERE (status = 2 AND l.length = file_size) OR (status <> 2 AND change_type = 2 AND status = 4)")
def stale_pending(c):
    """JO15, RC9, SO10"""
    pending = c.files.where("file_id % 2 = 0").select(F.col("file_id").alias("id"), F.col("local_path").alias("file_path"), (F.col("file_id") % 4).alias("change_type"), F.col("last_modified").alias("detected_at"))
    return jo.stale_pending(pending, c.files, c.local_files).select(F.col("id").alias("file_id"))


# --- aggregates ---


@query("SELECT count(*) AS total_files, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS total_size, count(*) FILTER (status = 2) AS completed, count(*) FILTER (status = 0) AS pending, count(*) FILTER (status = 3) AS failed, (SELECT count(*) FROM pending_changes) AS pending_changes FROM files")
def backup_statistics(c):
    """AG1, AG2, AG5"""
    return ag.backup_statistics(c.files, c.pending_changes)


@query("SELECT chunk_hash, count(*) AS live_count FROM chunk_file_refs GROUP BY chunk_hash")
def live_refcount(c):
    """AG3, DD1"""
    return ag.live_reference_counts(c.chunk_file_refs)


@query("SELECT count(*) AS total_chunks, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, count(*) FILTER (reference_count = 0) AS orphan_chunks, CAST(coalesce(sum(size_bytes) FILTER (reference_count = 0), 0) AS BIGINT) AS orphan_bytes, count(*) FILTER (reference_count > 1) AS shared_chunks, CAST(coalesce(sum(size_bytes * (reference_count - 1)) FILTER (reference_count > 1), 0) AS BIGINT) AS saved_bytes FROM chunk_index")
def chunk_index_summary(c):
    """AG6, DD2"""
    return ag.index_summary(c.chunk_index)


@query("SELECT tier, count(chunk_hash) AS chunks, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes FROM (VALUES (0, 'Hot'), (1, 'Cool'), (2, 'Cold'), (3, 'Archive')) t(k, tier) LEFT JOIN chunk_index ON current_tier = k GROUP BY tier")
def tier_breakdown(c):
    """AG6"""
    return ag.tier_breakdown(c.chunk_index)


@query("SELECT count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM remote_blobs")
def stored_bytes(c):
    """AG16"""
    return ag.totals(c.remote_blobs, "size_bytes")


@query("SELECT failure_tier, count(*) AS n FROM failures GROUP BY failure_tier")
def failures_by_tier(c):
    """AG8"""
    return ag.failures_by_tier(c.failures)


@query("SELECT file_id, count(*) AS chunks, min(length) AS chunk_min, max(length) AS chunk_max, CAST(sum(length) AS BIGINT) AS bytes FROM file_chunks GROUP BY file_id")
def chunk_statistics(c):
    """AG12"""
    return ag.chunk_statistics(c.file_chunks)


@query("SELECT count(*) FILTER (file_size <= 100000) AS small_files, CAST(sum(file_size) FILTER (file_size <= 100000) AS BIGINT) AS small_bytes, count(*) FILTER (file_size > 100000) AS large_files, CAST(sum(file_size) FILTER (file_size > 100000) AS BIGINT) AS large_bytes FROM files")
def small_large_split(c):
    """AG13"""
    return ag.small_large_split(c.files, 100_000)


@query("SELECT file_id, string_agg(r, ', ' ORDER BY r) AS reasons FROM (SELECT DISTINCT file_id, failure_reason || '@T' || failure_tier AS r FROM failures) GROUP BY file_id")
def failure_reasons(c):
    """AG17"""
    return ag.failure_reasons(c.failures)


@query("SELECT tier, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes FROM (SELECT CASE WHEN file_id % 3 = 0 THEN 0 ELSE file_id % 4 END AS tier, file_size FROM files) GROUP BY tier")
def files_by_tier(c):
    """AG11"""
    return ag.files_by_tier(c.files.withColumn("tier", F.when(F.col("file_id") % 3 != 0, (F.col("file_id") % 4).cast("int"))))


@query("SELECT l_shipmode AS benchmark, n, mean, error, noisy FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev(l_quantity) / sqrt(count(*)), 6) AS error, stddev(l_quantity) / sqrt(count(*)) / avg(l_quantity) > 0.05 AS noisy FROM lineitem GROUP BY 1)")
def benchmark_summary(c):
    """AG19"""
    r = c.table("lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("benchmark"), F.col("l_quantity").alias("value"))
    return ag.benchmark_summary(r).select("benchmark", "n", F.round("mean", 6).alias("mean"), F.round("error", 6).alias("error"), "noisy")


# --- reconciliation ---

_SIDES = "(SELECT l.path, l.length, l.modified, l.sha256, f.* FROM local_files l LEFT JOIN files f ON upper(l.path) = upper(f.local_path))"
_CHANGED = "(modified > last_modified OR length <> file_size)"
_NEAR = "length = file_size AND abs(epoch_us(modified) - epoch_us(last_modified)) < 2000000"


@query(f"""SELECT path, length AS size, CASE WHEN status IS NULL THEN 'Create' WHEN status = 2 THEN CASE WHEN {_CHANGED} THEN 'Update' ELSE 'Skip' END WHEN status = 3 THEN 'Create' ELSE 'Skip' END AS action,
CASE WHEN status IS NULL THEN 'New file - never backed up' WHEN status = 2 AND length <> file_size THEN 'Size changed (' || file_size || ' → ' || length || ')' WHEN status = 2 AND {_CHANGED} THEN 'Modified since last backup' WHEN status = 2 THEN 'Already backed up and unchanged'
WHEN status = 3 THEN 'Retrying previously failed backup' ELSE 'Excluded or in-progress' END AS reason FROM (SELECT l.path, l.length, l.modified, f.* FROM local_files l LEFT JOIN (SELECT * FROM files WHERE file_id % 6 <> 0) f ON upper(l.path) = upper(f.local_path))""")
def backup_preview(c):
    """RC1, JO5"""
    return rc.backup_preview(c.local_files, c.files, c.files.where("file_id % 6 <> 0").select("local_path"))


@query(f"""SELECT class, count(*) AS n FROM (SELECT CASE WHEN p.path IS NOT NULL THEN 'pending' WHEN status IS NULL THEN 'new' WHEN status = 2 THEN CASE WHEN {_CHANGED} THEN 'modified' ELSE 'unchanged' END WHEN status = 3 THEN 'retried' ELSE 'skipped' END AS class
FROM {_SIDES} s LEFT JOIN (SELECT local_path AS path FROM files WHERE file_id % 8 = 0) p ON upper(p.path) = upper(s.path)) GROUP BY class""")
def initial_sync_counts(c):
    """RC2, AG14"""
    pending = c.files.where("file_id % 8 = 0").select(F.upper("local_path").alias("file_path"))
    return rc.initial_sync(c.local_files, c.files, pending).groupBy("class").agg(F.count("*").alias("n"))


@query(f"SELECT path, status = 2 AND {_NEAR} AS unchanged FROM {_SIDES} WHERE status IS NOT NULL")
def fast_skip(c):
    """RC3"""
    return rc.unchanged_fast(c.local_files, c.files)


@query(f"SELECT coalesce(path, local_path) AS path, CASE WHEN path IS NULL THEN 'Delete' WHEN coalesce({_NEAR}, false) THEN 'Unchanged' ELSE 'Transfer' END AS action FROM local_files l FULL OUTER JOIN (SELECT * FROM files WHERE starts_with(upper(local_path), 'C:/DATA/2')) f ON upper(l.path) = upper(f.local_path)")
def mirror_to_remote_plan(c):
    """RC4, JO6"""
    return rc.mirror_to_remote(c.local_files, c.files, "c:/data/2")


@query(f"""SELECT coalesce(target, path) AS path, CASE WHEN local_path IS NULL THEN 'Delete' WHEN path IS NULL THEN 'Create' WHEN {_NEAR} AND sha256 = file_hash THEN 'Skip' ELSE 'Overwrite' END AS action,
CASE WHEN local_path IS NULL THEN 'Not in backup' WHEN path IS NULL THEN 'File does not exist locally' WHEN {_NEAR} AND sha256 = file_hash THEN 'File is identical' WHEN length <> file_size THEN 'Size differs (local: ' || length || ', backup: ' || file_size || ')' ELSE 'Content differs' END AS reason
FROM (SELECT *, 'C:/data/' || substr(local_path, 9) AS target FROM files) f FULL OUTER JOIN local_files l ON upper(l.path) = upper(target)""")
def mirror_to_local_plan(c):
    """RC5, JO12"""
    return rc.mirror_to_local(c.files, c.local_files, "c:/DATA", "C:/data")


@query(f"""SELECT path, CASE WHEN status IS NULL THEN 'New' WHEN status = 4 THEN 'Excluded' WHEN NOT (status = 2 AND file_hash <> '' AND file_size > 0) THEN CASE WHEN status = 3 AND blob_name <> '' THEN 'Failed' ELSE 'New' END WHEN length <> file_size THEN 'Modified' ELSE 'BackedUp' END AS state FROM {_SIDES}""")
def local_tree_status(c):
    """RC6"""
    return rc.local_status(c.local_files, c.files).select("path", "state")


@query("SELECT local_path, CASE WHEN upper(local_path) IN (SELECT upper(path) FROM local_files) THEN 'Overwrite' ELSE 'Create' END AS action FROM files")
def restore_preview(c):
    """RC7"""
    return rc.restore_preview(c.files, c.local_files)


@query("SELECT file_id, 'chunks/' || hash AS blob_name, 'chunk' AS label FROM file_chunks JOIN files USING (file_id) WHERE file_id % 50 = 0 UNION ALL SELECT file_id, blob_name, 'metadata' FROM files WHERE file_id % 50 = 0 AND blob_name <> ''")
def delete_worklist(c):
    """RC8, SE1, SE5"""
    return rc.delete_worklist(c.files, c.file_chunks, c.files.where("file_id % 50 = 0").select("file_id"))


@query("SELECT action, count(*) AS n, count(*) FILTER (length % 2 = 0) AS n_included, CAST(coalesce(sum(length) FILTER (length % 2 = 0), 0) AS BIGINT) AS bytes FROM (SELECT length, CASE WHEN status IS NULL THEN 'Create' WHEN status = 2 THEN CASE WHEN (modified > last_modified OR length <> file_size) THEN 'Update' ELSE 'Skip' END WHEN status = 3 THEN 'Create' ELSE 'Skip' END AS action FROM " + _SIDES + ") GROUP BY action")
def preview_totals(c):
    """AG10"""
    return ag.preview_totals(rc.backup_preview(c.local_files, c.files).withColumn("included", F.col("size") % 2 == 0))


@query("SELECT id, CASE WHEN change_type = 2 THEN 'exclude' ELSE 'backup' END AS step FROM (SELECT * FROM pending_changes ORDER BY detected_at, id LIMIT 50)")
def microbatch_drain(c):
    """ST4, RC10"""
    return changes.next_batch(c.pending_changes, 50).select("id", "step")


# --- mutations and index maintenance ---


@query("SELECT file_id, local_path, file_size, status FROM files WHERE file_id % 10 <> 3 UNION ALL SELECT file_id + 1000000, local_path, file_size + 5, 2 FROM files WHERE file_id % 10 = 3")
def upsert_files(c):
    """MU1"""
    new = c.files.where("file_id % 10 = 3").withColumn("file_id", F.col("file_id") + 1000000).withColumn("file_size", F.col("file_size") + 5).withColumn("status", F.lit(2))
    none = c.file_chunks.limit(0)
    return mu.upsert_files(c.files, c.file_chunks, c.chunk_file_refs, new, none)[0].select("file_id", "local_path", "file_size", "status")


@query("SELECT chunk_hash, CASE WHEN k % 10 = 1 THEN size_bytes + 2 ELSE size_bytes END AS size_bytes, expected_md5 FROM chunk_index JOIN (SELECT p_partkey AS k, upper(sha256(CAST(p_partkey AS VARCHAR))) AS chunk_hash FROM part) USING (chunk_hash)")
def bulk_upsert_chunks_last_wins(c):
    """MU5, MU6"""
    ks = c.table("part").where("p_partkey % 10 = 1").select(hash_of(F.col("p_partkey")).alias("chunk_hash"))
    own = c.chunk_index.join(ks, "chunk_hash", "left_semi")
    delta = own.withColumn("o", F.lit(2)).withColumn("size_bytes", F.col("size_bytes") + 2).unionByName(own.withColumn("o", F.lit(1)).withColumn("size_bytes", F.col("size_bytes") + 1))
    return mu.upsert_index(c.chunk_index, delta, "o").select("chunk_hash", "size_bytes", "expected_md5")


@query("SELECT chunk_hash, size_bytes, coalesce(content_md5, expected_md5) AS expected_md5 FROM chunk_index LEFT JOIN (SELECT substr(blob_name, 8) AS chunk_hash, content_md5 FROM remote_blobs) USING (chunk_hash) UNION ALL SELECT substr(blob_name, 8), 0, content_md5 FROM remote_blobs WHERE substr(blob_name, 8) NOT IN (SELECT chunk_hash FROM chunk_index)")
def stamp_md5(c):
    """MU7, ST6"""
    return mu.stamp_md5(c.chunk_index, c.remote_blobs.select(F.substring("blob_name", 8, 1000).alias("chunk_hash"), F.col("content_md5").alias("expected_md5"))).select("chunk_hash", "size_bytes", "expected_md5")


@query("SELECT count(*) AS deleted FROM chunk_file_refs WHERE file_path IN (SELECT local_path FROM files WHERE file_id % 9 = 0)")
def delete_refs_count(c):
    """MU11, MU8"""
    return mu.deleted_count(c.chunk_file_refs, c.files.where("file_id % 9 = 0").select(F.col("local_path").alias("file_path")), ["file_path"])


@query("SELECT upper(file_path) AS path_key, arg_max(change_type, id) AS change_type, max(id) AS id FROM pending_changes GROUP BY 1")
def queue_batch_lww(c):
    """MU12, MU13, ST3, SE4"""
    p = c.pending_changes
    queued = mu.queue_changes(p.where("id % 2 = 0").limit(0), p.withColumn("o", F.col("id")), "o")
    return queued.select(F.upper("file_path").alias("path_key"), "change_type", "id")


@query("SELECT id FROM pending_changes WHERE upper(file_path) NOT IN ('/U1', '/U2')")
def remove_pending(c):
    """MU14"""
    return mu.remove_pending(c.pending_changes, c.spark.createDataFrame([("/u1",), ("/U2",)], "file_path string")).select("id")


@query("SELECT id FROM runs ORDER BY started_at DESC, id DESC LIMIT 30")
def prune_runs(c):
    """MU19, FI4"""
    return mu.prune_runs(c.runs, 30).select("id")


@query("SELECT run_id, count(*) AS n FROM failures WHERE run_id = 5 GROUP BY run_id")
def keep_run_failures(c):
    """MU17, MU18"""
    return mu.keep_run_failures(c.failures, 5).groupBy("run_id").agg(F.count("*").alias("n"))


@query("SELECT tier, CASE WHEN tier = 1 THEN 'Unchanged' WHEN tier = 3 THEN 'SkippedArchived' ELSE 'SetTier' END AS action, count(*) AS n FROM remote_blobs GROUP BY ALL")
def tier_change_actions(c):
    """MU24"""
    return mu.blob_action(c.remote_blobs, 1).groupBy("tier", "action").agg(F.count("*").alias("n"))


@query(", m AS (SELECT DISTINCT hash FROM file_chunks WHERE file_id % 40 = 0) SELECT hash, (SELECT count(DISTINCT file_id) FROM file_chunks f WHERE f.hash = m.hash AND file_id % 40 <> 0) AS other_files FROM m")
def tier_migration(c):
    """MU27"""
    return mu.tier_migration(c.files, c.file_chunks, c.files.where("file_id % 40 = 0").select("file_id"))


@query("SELECT chunk_hash, CAST(coalesce(n, 0) AS INT) AS reference_count FROM chunk_index LEFT JOIN (SELECT chunk_hash, count(*) AS n FROM chunk_file_refs WHERE file_path NOT IN (SELECT local_path FROM files WHERE file_id % 3 = 0) GROUP BY 1) USING (chunk_hash) WHERE coalesce(n, 0) > 0 OR chunk_hash NOT IN (SELECT chunk_hash FROM chunk_file_refs)")
def remove_file_refs(c):
    """IX2"""
    return mx.remove_file_references(c.chunk_index, c.chunk_file_refs, c.files.where("file_id % 3 = 0").select(F.col("local_path").alias("file_path")))[0].select("chunk_hash", "reference_count")


@query(", o AS (SELECT chunk_hash, size_bytes FROM chunk_index WHERE reference_count < 2) SELECT count(*) FILTER (chunk_hash NOT IN (SELECT chunk_hash FROM chunk_file_refs)) AS deleted, CAST(coalesce(sum(size_bytes) FILTER (chunk_hash NOT IN (SELECT chunk_hash FROM chunk_file_refs)), 0) AS BIGINT) AS bytes, count(*) FILTER (chunk_hash IN (SELECT chunk_hash FROM chunk_file_refs)) AS skipped FROM o")
def cleanup_with_recheck(c):
    """IX4"""
    return mx.cleanup_tally(mx.cleanup_orphans(c.chunk_index.where("reference_count < 2").select("chunk_hash", "size_bytes"), c.chunk_file_refs))


@query(""", bad AS (SELECT DISTINCT file_id FROM file_chunks WHERE 'chunks/' || hash NOT IN (SELECT blob_name FROM remote_blobs)),
g AS (SELECT hash AS chunk_hash, CAST(count(*) AS INT) AS reference_count, min(local_path) AS original_uploader_path, max(length) AS length FROM file_chunks JOIN files USING (file_id) WHERE file_id NOT IN (SELECT file_id FROM bad) GROUP BY hash)
SELECT chunk_hash, original_uploader_path, coalesce(size_bytes, length) AS size_bytes, reference_count, coalesce(tier, 0) AS current_tier FROM g LEFT JOIN remote_blobs ON blob_name = 'chunks/' || chunk_hash""")
def rebuild_index(c):
    """IX6, AG15, DD5"""
    return mx.rebuilt_index(c.files, c.file_chunks, c.remote_blobs)


@query("SELECT 'hash' AS kind, hash AS name FROM (SELECT DISTINCT hash FROM file_chunks) WHERE hash NOT IN (SELECT chunk_hash FROM chunk_index) UNION ALL SELECT 'file', local_path FROM files WHERE file_id IN (SELECT file_id FROM file_chunks) AND upper(local_path) NOT IN (SELECT upper(file_path) FROM chunk_file_refs)")
def consistency_errors(c):
    """IX7"""
    return mx.consistency_errors(c.files, c.file_chunks, c.chunk_index, c.chunk_file_refs)


@query("SELECT chunk_hash, CASE WHEN 'chunks/' || chunk_hash IN (SELECT blob_name FROM remote_blobs) THEN 'promoted' ELSE 'failed' END AS outcome FROM chunk_index WHERE expected_md5 IS NULL")
def backfill_md5(c):
    """IX8"""
    return mx.backfill_md5(c.chunk_index, c.remote_blobs).select("chunk_hash", "outcome")


# --- integrity ---

_T1 = """(SELECT file_id, local_path, chunk_index, hash, length, size_bytes, content_md5, expected_md5 FROM file_chunks JOIN files USING (file_id) LEFT JOIN remote_blobs ON remote_blobs.blob_name = 'chunks/' || hash LEFT JOIN chunk_index ci ON chunk_hash = hash)""".replace("chunk_index, hash", "file_chunks.chunk_index, hash").replace("size_bytes", "remote_blobs.size_bytes")
_FAIL = f"""(SELECT file_id, chunk_index, hash AS chunk_hash, 'invalid-chunk-length' AS failure_reason FROM t1 WHERE length <= 0 UNION ALL SELECT file_id, chunk_index, hash, 'missing-blob' FROM t1 WHERE length > 0 AND size_bytes IS NULL
UNION ALL SELECT file_id, chunk_index, hash, 'wrong-size' FROM t1 WHERE length > 0 AND size_bytes <> length + 37 UNION ALL SELECT file_id, chunk_index, hash, 'md5-mismatch' FROM t1 WHERE length > 0 AND size_bytes IS NOT NULL AND expected_md5 <> content_md5)"""


@query(f", t1 AS {_T1} SELECT * FROM {_FAIL}")
def integrity_t1_failures(c):
    """IN1"""
    return it.listing_failures(c.files, c.file_chunks, c.remote_blobs, c.chunk_index).select("file_id", "chunk_index", "chunk_hash", "failure_reason")


@query("SELECT chunk_hash, content_md5 AS expected_md5 FROM chunk_index JOIN remote_blobs ON blob_name = 'chunks/' || chunk_hash WHERE expected_md5 IS NULL AND chunk_hash IN (SELECT hash FROM file_chunks WHERE length > 0)")
def trusted_baseline(c):
    """IN2"""
    return it.baseline(c.file_chunks, c.remote_blobs, c.chunk_index).select("chunk_hash", "expected_md5")


@query("SELECT CAST(-1 - r_regionkey AS BIGINT) AS file_id, '<unknown file id ' || (-1 - r_regionkey) || '>' AS local_path, 'missing-file-record' AS failure_reason FROM region")
def unknown_file_ids(c):
    """IN3"""
    wanted = c.table("region").select((-1 - F.col("r_regionkey")).cast("long").alias("file_id")).union(c.files.where("file_id < 10").select("file_id"))
    return it.unknown_files(wanted, c.files).select("file_id", "local_path", "failure_reason")


@query("SELECT file_id, coalesce('FailedT' || w, 'Passed') AS verdict FROM files LEFT JOIN (SELECT file_id, max(failure_tier) AS w FROM failures GROUP BY file_id) USING (file_id)")
def integrity_file_verdicts(c):
    """IN4, AG9"""
    return it.file_verdicts(c.files, c.failures)


@query(", v AS (SELECT file_id, coalesce('FailedT' || w, 'Passed') AS verdict FROM files LEFT JOIN (SELECT file_id, max(failure_tier) AS w FROM failures GROUP BY file_id) USING (file_id)) SELECT count(*) AS checked, count(*) FILTER (verdict = 'Passed') AS passed, CAST(0 AS BIGINT) AS warnings, count(*) FILTER (verdict = 'FailedT1') AS t1, count(*) FILTER (verdict = 'FailedT2') AS t2, count(*) FILTER (verdict = 'FailedT3') AS t3 FROM v")
def integrity_run_rollup(c):
    """IN6"""
    return it.run_rollup(it.file_verdicts(c.files, c.failures))


@query("SELECT file_id, bool_and(failure_reason IN ('missing-blob', 'wrong-size', 'md5-mismatch', 'crc-mismatch', 'decrypt-failed', 'byte-differ', 'download-error')) AS repairable FROM failures GROUP BY file_id")
def repairable_files(c):
    """IN5"""
    return it.repairable(c.failures)


@query('SELECT file_id, count(*) FILTER (chunk_index <> p) AS bad_index, count(*) FILTER ("offset" <> coalesce(b, 0)) AS bad_offset, coalesce(sum(length), 0) <> any_value(file_size) AS bad_size FROM files LEFT JOIN (SELECT *, row_number() OVER w - 1 AS p, lag("offset" + length) OVER w AS b FROM file_chunks WINDOW w AS (PARTITION BY file_id ORDER BY chunk_order)) USING (file_id) GROUP BY file_id')
def chunk_sequence_check(c):
    """IN7, WI2"""
    return it.sequence_errors(c.files, c.file_chunks)


# --- chunking and dedup ---


#: Least 256, most 4096 bytes and 10 bits, which is all of the hash that counts: sums of bytes times powers of the inverse
#: of 31 modulo 1024 (991; its 64th power is 1) over 48 bytes. Cuts follow one another, so they are a recursion.
_CUTS = """WITH RECURSIVE d AS (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents WHERE text IS NOT NULL),
w AS (SELECT 0 AS k, 1 AS p UNION ALL SELECT k + 1, p * 991 % 1024 FROM w WHERE k < 63),
b AS (SELECT doc_id, unnest(regexp_extract_all(h, '..')) AS x, unnest(range(n)) AS i FROM d),
s AS (SELECT doc_id, i, sum((16 * (instr('0123456789ABCDEF', x[1]) - 1) + instr('0123456789ABCDEF', x[2]) - 1) * p) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM b JOIN w ON k = i % 64),
z AS (SELECT doc_id, i FROM (SELECT doc_id, i, s - coalesce(lag(s, 48) OVER (PARTITION BY doc_id ORDER BY i), 0) AS v FROM s) WHERE i >= 47 AND v % 1024 = 0),
c AS (SELECT doc_id, 0 AS chunk_index, CAST(0 AS BIGINT) AS start, n, least(coalesce((SELECT min(i) + 1 FROM z WHERE z.doc_id = d.doc_id AND i >= 255), n), 4096, n) AS stop FROM d
UNION ALL SELECT doc_id, chunk_index + 1, stop, n, least(coalesce((SELECT min(i) + 1 FROM z WHERE z.doc_id = c.doc_id AND i >= stop + 255), n), stop + 4096, n) FROM c WHERE stop < n)
SELECT 'd' || doc_id || '.txt' AS path, chunk_index, start AS "offset", CAST(stop - start AS INT) AS length, upper(sha256(unhex(substr(h, 2 * start + 1, 2 * (stop - start))))) AS hash FROM c JOIN d USING (doc_id)"""


@query(None)
def cdc_chunks(c):
    """CD1, CD4: small chunks, so that texts have several; tests hold it against golden vectors and a plain loop besides."""
    d = c.table("documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"))
    return cd.chunk_files(d, 256, 4096, 10, file_hash=False)


ORACLE_SQL["cdc_chunks"] = _CUTS


@query("SELECT 'd' || doc_id || '.txt' AS path, upper(sha256(text)) AS file_hash, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents")
def cdc_file_hash(c):
    """CD1: chunks add up to their file"""
    d = c.table("documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"))
    return cd.chunk_files(d, 256, 4096, 10).groupBy("path").agg(F.max("file_hash").alias("file_hash"), F.sum("length").cast("long").alias("bytes"))


@query("SELECT file_id, CASE WHEN file_id % 3 = 0 THEN 16384 WHEN file_id % 3 = 1 THEN 65536 ELSE 1048576 END AS least FROM files")
def chunk_profiles(c):
    """CD2"""
    path = F.concat(F.lit("a/b."), F.when(F.col("file_id") % 3 == 0, "TXT").when(F.col("file_id") % 3 == 1, "unknown").otherwise("mp4"))
    return c.files.select("file_id", cd.profile(path, F.col("file_size"))["least"].alias("least"))


@query("SELECT DISTINCT hash FROM file_chunks WHERE hash NOT IN (SELECT chunk_hash FROM chunk_index WHERE reference_count > 0)")
def new_chunks(c):
    """CD3, DD3"""
    return cd.new_chunks(c.file_chunks, c.chunk_index.where("reference_count > 0").select(F.col("chunk_hash").alias("hash"))).select("hash")


@query("SELECT CAST(sum(n) AS BIGINT) AS chunks, count(*) AS unique_chunks, CAST(sum(n * length) AS BIGINT) AS bytes, CAST(sum((n - 1) * length) AS BIGINT) AS saved FROM (SELECT hash, count(*) AS n, max(length) AS length FROM file_chunks GROUP BY hash)")
def dedup_savings(c):
    """DD2"""
    return cd.dedup_savings(c.file_chunks)


@query("SELECT file_id, count(*) FILTER (NOT k) AS new_chunks, count(*) FILTER (k) AS reused_chunks FROM (SELECT file_id, chunk_order > 1 OR hash IN (SELECT hash FROM file_chunks o WHERE o.file_id = n.file_id AND o.chunk_order > 1) AS k FROM file_chunks n) GROUP BY file_id")
def version_reuse(c):
    """DD3, DD4"""
    return cd.version_reuse(c.file_chunks.where("chunk_order > 1"), c.file_chunks)


@query("SELECT hash, min(local_path) AS first_path FROM file_chunks JOIN files USING (file_id) GROUP BY hash")
def first_uploaders(c):
    """DD5"""
    return cd.first_uploaders(c.files, c.file_chunks)


@query("SELECT upper(sha256(text)) AS hash, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_dedup(c):
    """IN10 over contents"""
    return c.table("documents").groupBy(F.upper(F.sha2(F.col("text").cast("binary"), 256)).alias("hash")).agg(F.count("*").alias("copies")).where("copies > 1")


# --- scalars ---

_UNITS = "CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) || ' B' WHEN n < 1048576 THEN rtrim(rtrim(CAST(CAST(round(CAST(n AS DECIMAL(38, 12)) / 1024, 2) AS DECIMAL(38, 2)) AS VARCHAR), '0'), '.') || ' KB' ELSE rtrim(rtrim(CAST(CAST(round(CAST(n AS DECIMAL(38, 12)) / 1048576, 2) AS DECIMAL(38, 2)) AS VARCHAR), '0'), '.') || ' MB' END"


@query(f"SELECT file_id, {_UNITS} AS shown FROM (SELECT file_id, CASE WHEN file_id % 2 = 0 THEN file_size * 7 ELSE file_id END AS n FROM files)")
def format_bytes(c):
    """SF5"""
    return c.files.select("file_id", formats.format_bytes(F.when(F.col("file_id") % 2 == 0, F.col("file_size") * 7).otherwise(F.col("file_id"))).alias("shown"))


@query("""SELECT file_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' WHEN s < 86400 THEN (s // 3600) || 'h ' || (s // 60 % 60) || 'm' ELSE (s // 86400) || 'd ' || (s // 3600 % 24) || 'h ' || (s // 60 % 60) || 'm' END AS shown FROM (SELECT file_id, file_id * 13 AS s FROM files)""")
def format_duration(c):
    """SF6"""
    return c.files.select("file_id", formats.format_duration((F.col("file_id") * 13 + 0.5).cast("double")).alias("shown"))


@query("SELECT file_id, upper(sha256(local_path)) AS sha, md5(local_path) AS md5, regexp_extract(local_path, '([^/]*)$', 1) AS name, regexp_extract(local_path, '^(.*)/[^/]*$', 1) AS directory, substr(local_path, 9) AS relative FROM files")
def path_functions(c):
    """SF1, SF2, SF7, SF8, SF10"""
    p = F.col("local_path")
    return c.files.select("file_id", hashing.sha256_hex(p).alias("sha"), F.md5(p.cast("binary")).alias("md5"), paths.file_name(p).alias("name"), paths.directory_name(p).alias("directory"), paths.relative_path(p, F.lit("c:/DATA/")).alias("relative"))


# --- trees and telemetry ---

_FOLDERS = "(SELECT file_id, file_size, upper(array_to_string(string_split(local_path, '/')[1:i], '/')) AS k, array_to_string(string_split(local_path, '/')[1:i], '/') AS folder FROM (SELECT *, unnest(range(1, len(string_split(local_path, '/')))) AS i FROM files))"


@query(f", f AS {_FOLDERS}, g AS (SELECT k, min(folder) AS folder, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes FROM f GROUP BY k) SELECT folder, files, bytes, (SELECT count(*) FROM g h WHERE starts_with(h.k, g.k || '/')) AS folders FROM g")
def folder_rollup(c):
    """TR1, TR2, TR3"""
    return tree.folder_rollup(c.files)


@query("SELECT file_id FROM files WHERE starts_with(upper(local_path), 'C:/DATA/5-LOW/')")
def descendants(c):
    """TR5"""
    return tree.descendants(c.files, "c:\\data\\5-low").select("file_id")


@query(f"""SELECT folder_key, count(*) AS total, count(*) FILTER (state = 'BackedUp') AS backed_up, count(*) FILTER (state = 'Modified') AS modified, count(*) FILTER (state = 'New') AS new FROM (SELECT state, upper(array_to_string(string_split(path, '/')[1:i], '/')) AS folder_key FROM (SELECT state, path, unnest(range(1, len(string_split(path, '/')))) AS i FROM (
SELECT path, CASE WHEN status IS NULL THEN 'New' WHEN status = 4 THEN 'Excluded' WHEN NOT (status = 2 AND file_hash <> '' AND file_size > 0) THEN CASE WHEN status = 3 AND blob_name <> '' THEN 'Failed' ELSE 'New' END WHEN length <> file_size THEN 'Modified' ELSE 'BackedUp' END AS state FROM {_SIDES}))) GROUP BY folder_key""")
def folder_status(c):
    """TR4"""
    return tree.status_rollup(rc.local_status(c.local_files, c.files))


@query("SELECT file_id FROM files WHERE NOT regexp_matches(local_path, '(?i)/c1[0-9]?/')")
def pruned_files(c):
    """TR6"""
    return tree.pruned(c.files, paths.glob_match(F.col("part"), "C1") | paths.glob_match(F.col("part"), "c1?")).select("file_id")


@query("SELECT local_path, CASE WHEN starts_with(local_path, 'C:/data/1-URGENT/c1/') THEN 'D:/deep' WHEN starts_with(local_path, 'C:/data/1-URGENT/') THEN 'D:/top' END AS target FROM files")
def effective_targets(c):
    """TR7"""
    return tree.effective_target(c.files, c.spark.createDataFrame([("c:/data/1-urgent", "D:/top"), ("C:/data/1-URGENT/c1", "D:/deep")], "folder string, target string"))


@query("SELECT operation, CAST(coalesce(sum(succeeded) FILTER (type = 'op'), 0) - count(*) FILTER (type = 'file') AS BIGINT) AS skipped FROM telemetry GROUP BY operation")
def skipped_files(c):
    """TM1"""
    return tm.skipped_files(c.telemetry)


@query(", f AS (SELECT * FROM telemetry WHERE type = 'file'), m AS (SELECT operation, avg(throughput_mbytes_per_sec) AS mean FROM f GROUP BY operation) SELECT operation, CASE WHEN bytes < 1048576 THEN 0 ELSE CAST(floor(log2(bytes / 1048576)) AS INT) + 1 END AS bucket, count(*) AS n FROM f JOIN m USING (operation) WHERE throughput_mbytes_per_sec < mean GROUP BY ALL")
def throughput_below_avg(c):
    """TM2, AG18"""
    return tm.below_average(c.telemetry)


@query("SELECT path, effective_concurrency, CAST(least(greatest(402653184 // greatest(chunk_max, 1), 4), 24) AS INT) AS expected FROM telemetry WHERE type = 'file'")
def concurrency_check(c):
    """TM3, SF11"""
    return tm.concurrency_check(c.telemetry).drop("operation")


@query("SELECT operation, CAST(coalesce(sum(budget_stalls) FILTER (type = 'file'), 0) AS BIGINT) AS of_files, CAST(coalesce(sum(budget_stalls) FILTER (type = 'op'), 0) AS BIGINT) AS of_operation FROM telemetry GROUP BY operation")
def budget_stalls_parity(c):
    """TM4"""
    return tm.stall_parity(c.telemetry)


@query("SELECT memory_budget_mb, CAST(sum(budget_stalls) AS BIGINT) AS stalls, round(avg(throughput_mbytes_per_sec), 6) AS throughput FROM telemetry WHERE type = 'op' GROUP BY memory_budget_mb")
def budget_comparison(c):
    """TM6"""
    return tm.budget_comparison(c.telemetry).withColumn("throughput", F.round("throughput", 6))


@query("SELECT round(a, 6) AS a, round(b, 6) AS b, abs(a - b) <= 0.2 * b AS parity FROM (SELECT avg(throughput_mbytes_per_sec) FILTER (operation = 'op1') AS a, avg(throughput_mbytes_per_sec) FILTER (operation = 'op2') AS b FROM telemetry WHERE type = 'op')")
def mirror_parity(c):
    """TM7"""
    return tm.parity(c.telemetry, "op1", "op2").select(F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), "parity")


# --- change stream ---


@query(", g AS (SELECT upper(file_path) AS path_key, detected_at, id, CASE WHEN epoch_us(detected_at) - epoch_us(lag(detected_at) OVER w) > 2000000 THEN 1 ELSE 0 END AS b FROM pending_changes WINDOW w AS (PARTITION BY upper(file_path) ORDER BY detected_at, id)), s AS (SELECT *, sum(b) OVER (PARTITION BY path_key ORDER BY detected_at, id) AS burst FROM g) SELECT path_key, max(detected_at) AS last_change, count(*) AS changes FROM s GROUP BY path_key, burst")
def debounce_bursts(c):
    """ST2"""
    return changes.bursts(c.pending_changes).drop("burst")


@query("SELECT file_path, change_type FROM pending_changes WHERE change_type <> 3 UNION ALL SELECT '/old' || file_path, 2 FROM pending_changes WHERE change_type = 3 UNION ALL SELECT file_path, 0 FROM pending_changes WHERE change_type = 3")
def split_renames(c):
    """ST1"""
    return changes.split_renames(c.pending_changes.withColumn("old_path", F.concat(F.lit("/old"), "file_path"))).drop("detected_at")


@query("SELECT upper(path) AS path_key FROM local_files UNION SELECT upper(file_path) FROM pending_changes")
def rescan_after_overflow(c):
    """ST5, RC12"""
    queued = changes.rescan(c.local_files, mu.queue_changes(c.pending_changes.limit(0), c.pending_changes.withColumn("o", F.col("id")), "o"), "2024-06-01")
    return queued.select(F.upper("file_path").alias("path_key"))


@query("""SELECT o_custkey, CAST(last.mean AS FLOAT) AS ewma, CAST(last.n AS INT) AS connections FROM (SELECT o_custkey, list_reduce(list_prepend({'x': CAST(0 AS DOUBLE), 'mean': CAST(0 AS DOUBLE), 'n': CAST(4 AS BIGINT)}, list({'x': CAST(o_totalprice AS DOUBLE), 'mean': CAST(0 AS DOUBLE), 'n': CAST(0 AS BIGINT)} ORDER BY o_orderdate, o_orderkey, o_totalprice)), lambda a, b: {'x': b.x,
'mean': CASE WHEN a.mean = 0 THEN b.x ELSE 0.3 * b.x + (1 - 0.3::DOUBLE) * a.mean END, 'n': CASE WHEN a.mean = 0 OR b.x = 0 THEN a.n WHEN (b.x - a.mean) / a.mean > 0.05 THEN least(64, a.n + CASE WHEN (b.x - a.mean) / a.mean > 0.2 THEN 2 ELSE 1 END) WHEN (b.x - a.mean) / a.mean < -0.05 THEN greatest(1, a.n // 2) ELSE a.n END}) AS last FROM orders GROUP BY o_custkey)""")
def ewma(c):
    """WI3: smoothed order values of each customer, in order of date, and the connections that a controller would come to"""
    o = c.table("orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_totalprice"))), lambda x: x["o_totalprice"]).alias("samples"))
    return o.select("o_custkey", formats.ewma(F.col("samples")).cast("float").alias("ewma"), formats.connections(F.col("samples"), 4, 1, 64).alias("connections"))


# --- more mutations, composites and texts ---


@query("SELECT file_id, local_path FROM files UNION ALL SELECT file_id + 2000000, local_path || '.new' FROM files WHERE file_id % 5 = 0")
def bulk_insert_files(c):
    """MU2, MU3"""
    new = c.files.where("file_id % 5 = 0").withColumn("file_id", F.col("file_id") + 2000000).withColumn("local_path", F.concat("local_path", F.lit(".new")))
    return mu.insert_unique(c.files, new, "local_path").select("file_id", "local_path")


@query("SELECT count(*) AS n FROM files WHERE false")
def clear_files(c):
    """MU4"""
    return mu.cleared(c.files).agg(F.count("*").alias("n"))


@query("SELECT file_path, chunk_hash, chunk_index, CASE WHEN chunk_index = 3 THEN TIMESTAMP '2000-01-01' ELSE referenced_at END AS referenced_at FROM (SELECT file_path, chunk_hash, chunk_index, max(referenced_at) AS referenced_at FROM chunk_file_refs GROUP BY ALL)")
def upsert_refs(c):
    """MU9"""
    refs = c.chunk_file_refs.groupBy("file_path", "chunk_hash", "chunk_index").agg(F.max("referenced_at").alias("referenced_at"))
    delta = refs.where("chunk_index = 3").withColumn("referenced_at", F.lit("2000-01-01").cast("timestamp_ntz"))
    return mu.upsert_refs(refs, delta)


@query("SELECT file_path, count(*) AS n FROM (SELECT * FROM chunk_file_refs UNION ALL SELECT * FROM chunk_file_refs WHERE chunk_index = 1) GROUP BY file_path")
def append_refs(c):
    """MU10"""
    return c.chunk_file_refs.unionByName(c.chunk_file_refs.where("chunk_index = 1")).groupBy("file_path").agg(F.count("*").alias("n"))


@query("SELECT n_name AS key, CASE WHEN n_nationkey % 2 = 0 THEN 'new' ELSE CAST(n_regionkey AS VARCHAR) END AS value FROM nation")
def metadata_upsert(c):
    """SC9, MU16"""
    old = c.table("nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    return mu.upsert(old, c.table("nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("key"), F.lit("new").alias("value")), ["key"])


@query("SELECT kind, count(*) AS n FROM (SELECT 'entry' AS kind FROM chunk_index UNION ALL SELECT 'ref' FROM chunk_file_refs UNION ALL SELECT 'summary') GROUP BY kind")
def export_index(c):
    """MU21"""
    out = mu.exported_index(c.chunk_index, c.chunk_file_refs, ag.index_summary(c.chunk_index))
    return out.groupBy(F.get_json_object("value", "$.kind").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT local_path AS file_path, hash AS chunk_hash, chunk_index FROM files JOIN file_chunks USING (file_id)")
def import_index(c):
    """MU22: a snapshot without a reference list"""
    own = c.files.select("file_id", "local_path").join(c.file_chunks, "file_id")
    nested = own.groupBy(F.col("hash").alias("chunk_hash")).agg(F.collect_list(F.struct(F.col("local_path").alias("file_path"), "chunk_index")).alias("referencing_files"))
    none = c.chunk_file_refs.select("file_path", "chunk_hash", "chunk_index").limit(0)
    return mu.imported_refs(nested, none).select("file_path", "chunk_hash", "chunk_index")


@query("SELECT 'chunks/' || p_brand || CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN '_v2' ELSE '_v3' END AS blob_name, p_partkey % 3 < 2 AS reused FROM part")
def upload_names(c):
    """MU23: two versions of each brand are stored, the third content is new"""
    content = lambda k: (k % 3).cast("string").cast("binary")
    p = c.table("part")
    stored = p.select("p_brand").distinct()
    stored = stored.select(F.concat(F.lit("chunks/"), "p_brand").alias("blob_name"), F.lit("0").cast("binary").alias("content")).union(stored.select(F.concat(F.lit("chunks/"), "p_brand", F.lit("_v2")), F.lit("1").cast("binary")))
    up = p.select(F.col("p_brand").alias("hash"), content(F.col("p_partkey")).alias("content"))
    return mu.upload_names(up, stored).select("blob_name", "reused")


@query(""", up AS (SELECT local_path AS file_path, hash AS chunk_hash, chunk_index FROM files JOIN file_chunks USING (file_id) WHERE file_id % 20 = 7),
r AS (SELECT file_path, chunk_hash, chunk_index FROM chunk_file_refs WHERE (file_path, chunk_hash, chunk_index) NOT IN (SELECT file_path, chunk_hash, chunk_index FROM up) UNION ALL SELECT * FROM up)
SELECT chunk_hash, CASE WHEN chunk_hash IN (SELECT chunk_hash FROM up) THEN CAST((SELECT count(*) FROM r WHERE r.chunk_hash = i.chunk_hash) AS INT) ELSE reference_count END AS reference_count FROM chunk_index i""")
def add_references(c):
    """IX1, IX3"""
    up = c.files.where("file_id % 20 = 7").join(c.file_chunks, "file_id").select(
        F.col("local_path").alias("file_path"), F.col("hash").alias("chunk_hash"), "chunk_index", F.col("backed_up_at").alias("referenced_at"), F.col("length").cast("long").alias("size_bytes"), F.lit(0).alias("tier"), F.lit(False).alias("is_new")
    )
    return mx.add_references(c.chunk_index, c.chunk_file_refs, up)[0].select("chunk_hash", "reference_count")


@query("SELECT chunk_hash, coalesce(tier, current_tier) AS current_tier FROM chunk_index LEFT JOIN remote_blobs ON blob_name = 'chunks/' || chunk_hash")
def refresh_tiers(c):
    """IX6: tiers after a migration"""
    return mx.refreshed_tiers(c.chunk_index, c.remote_blobs).select("chunk_hash", "current_tier")


@query("SELECT 'repairable' AS kind, 'ix_' || n_regionkey AS name FROM nation WHERE n_regionkey < 3 GROUP BY n_regionkey UNION ALL SELECT 'unrepairable', 'page ' || n_nationkey || ' is corrupt' FROM nation WHERE n_regionkey >= 3")
def classify_findings(c):
    """IX9, IX10"""
    m = c.table("nation").select(F.col("n_nationkey").alias("ordinal"), F.when(F.col("n_regionkey") < 3, F.concat(F.lit("row 7 missing from index ix_"), F.col("n_regionkey").cast("string"))).otherwise(F.concat(F.lit("page "), F.col("n_nationkey").cast("string"), F.lit(" is corrupt"))).alias("message"))
    return mx.classified_findings(m).select("kind", "name")


@query("SELECT file_id FROM files WHERE file_id % 50 = 0 AND (file_id IN (SELECT file_id FROM file_chunks) OR blob_name <> '') AND file_id NOT IN (SELECT file_id FROM file_chunks WHERE 'chunks/' || hash NOT IN (SELECT blob_name FROM remote_blobs))")
def delete_outcome(c):
    """RC8: files of which no blob failed"""
    work = rc.delete_worklist(c.files, c.file_chunks, c.files.where("file_id % 50 = 0").select("file_id"))
    failed = work.where("label = 'chunk'").select("blob_name").join(c.remote_blobs, "blob_name", "left_anti")
    return rc.deleted_files(work, failed)


@query("SELECT o_orderstatus AS s, CASE o_orderstatus WHEN 'F' THEN '⚠️ WARNING: ' || n || ' file(s) will be PERMANENTLY deleted from remote storage. This cannot be undone!' WHEN 'O' THEN '⚠️ ' || n || ' existing file(s) will be overwritten.' ELSE 'ℹ️ ' || n || ' file(s) will be uploaded to remote storage.' END AS warning FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)")
def operation_warnings(c):
    """RC11, SF22"""
    s, zero = F.col("o_orderstatus"), F.lit(0)
    n = c.table("orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    text = rc.warning(F.when(s == "F", "delete_remote").otherwise("backup"), F.when(s == "P", F.col("n")).otherwise(zero), F.when(s == "O", F.col("n")).otherwise(zero), F.when(s == "F", F.col("n")).otherwise(zero))
    return n.select(s.alias("s"), text.alias("warning"))


@query("SELECT doc_id, sha256(text) AS digest, true AS ok FROM documents")
def envelope_round_trip(c):
    """SF3, SF13, SF14: sealed with a random nonce and read again"""
    key = F.lit(bytearray(b"0123456789abcdef0123456789abcdef"))
    d = c.table("documents").select("doc_id", hashing.seal(F.col("text"), key).alias("sealed"))
    return d.select("doc_id", F.sha2(hashing.unseal(F.col("sealed"), key), 256).alias("digest"), hashing.envelope_ok(F.col("sealed")).alias("ok"))


@query("SELECT doc_id, CAST(ceil(octet_length(encode(text)) / 1000.0) AS BIGINT) AS pieces, upper(sha256(text)) AS hash FROM documents")
def restore_from_pieces(c):
    """SC17, IN7, IN8: contents cut into pieces, read as ranges, put together again"""
    d = c.table("documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    n = F.ceil(F.octet_length("content") / 1000).cast("int")
    p = d.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: lo.read_range(F.col("content"), i * 1000, F.lit(1000)))).alias("chunk_order", "plain"))
    p = p.withColumn("hash", hashing.sha256_hex(F.col("plain")))
    chunks = p.select(F.col("doc_id").alias("file_id"), "chunk_order", F.octet_length("plain").alias("length"), "hash")
    bodies = p.groupBy(F.col("hash").alias("chunk_hash")).agg(F.first("plain").alias("plain"))
    return it.best_effort(chunks, bodies).select(F.col("file_id").alias("doc_id"), F.col("chunks").alias("pieces"), hashing.sha256_hex(F.col("content")).alias("hash"))


@query("SELECT i AS index, count(*) AS n, count(DISTINCT file_id) AS files FROM (SELECT file_id, chunk_index AS i FROM file_chunks WHERE length % 3 = 0) GROUP BY i")
def corruption_patterns(c):
    """TM5"""
    r = c.file_chunks.where("length % 3 = 0").groupBy("file_id").agg(F.collect_list("chunk_index").alias("crc_failed_indices"))
    return tm.corruption_patterns(r.select(F.lit("corruption").alias("type"), F.col("file_id").cast("string").alias("path"), "crc_failed_indices"))


@query("SELECT l_returnflag AS phase, count(*) AS n, count(*) FILTER (l_linestatus = 'F' AND l_quantity > 25) AS crc_bad_but_readable FROM lineitem GROUP BY 1")
def diagnostic_phases(c):
    """TM8"""
    return tm.phase_counts(c.table("lineitem").select(F.col("l_returnflag").alias("phase"), (F.col("l_linestatus") != "F").alias("crc_valid"), F.greatest(F.col("l_quantity") - 25, F.lit(0)).alias("plain_size")))


@query("SELECT local_path AS node, false AS is_folder FROM files UNION ALL SELECT min(folder), true FROM " + _FOLDERS + " GROUP BY k")
def tree_nodes(c):
    """TR1, SO5, SO6"""
    return tree.tree_nodes(c.files).select("node", "is_folder")


@query("SELECT min(CASE WHEN stalls = 0 THEN memory_budget_mb END) AS least_budget FROM (SELECT memory_budget_mb, sum(budget_stalls) AS stalls FROM telemetry WHERE type = 'op' GROUP BY 1)")
def least_budget(c):
    """TM6"""
    return tm.least_budget(c.telemetry)


# --- configuration, retention, small texts ---


@query("SELECT 'stamp' || k AS stamp, db, salt FROM (SELECT s_suppkey AS k, 'db' || s_suppkey AS db, 'salt' || s_suppkey AS salt FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 2 = 0) ORDER BY 'stamp' || k DESC LIMIT 1")
def newest_quarantined_pair(c):
    """JO13"""
    k = F.col("s_suppkey")
    side = lambda name, n: c.table("supplier").where(k % n == 0).select(F.concat(F.lit("stamp"), k.cast("string")).alias("stamp"), F.concat(F.lit(name), k.cast("string")).alias(name))
    return jo.newest_pair(side("db", 3), side("salt", 2))


@query("SELECT count(*) AS folders, string_agg(CASE WHEN path LIKE '%URGENT%' THEN path END, ',' ORDER BY \"ordinal\") AS urgent, '*.x' AS first_pattern FROM folders")
def configuration(c):
    """SC8, MU15: saved whole, read as one row"""
    f = c.folders.withColumnRenamed("ordinal", "id")
    excludes = c.spark.createDataFrame([(2, 1, "*.y", 0), (1, 1, "*.x", 0), (3, 2, "sub", 1)], "id int, folder_id int, pattern string, kind int")
    globs = c.spark.createDataFrame([(1, "*.tmp")], "id int, pattern string")
    cfg = lo.configuration(c.spark.createDataFrame([(1,)], "sid int"), mu.replace_rows(f.limit(0), f), excludes, globs)
    urgent = F.filter("folders", lambda x: x["path"].contains("URGENT"))
    return cfg.select(F.size("folders").cast("long").alias("folders"), F.array_join(F.transform(urgent, lambda x: x["path"]), ",").alias("urgent"), F.col("folders")[0]["exclude_patterns"][0].alias("first_pattern"))


@query("SELECT event_id FROM events WHERE CAST(ts AS DATE) > DATE '2024-01-20' - 15")
def telemetry_retention(c):
    """MU20"""
    return mu.retain_days(c.table("events").withColumnRenamed("ts", "timestamp"), "2024-01-20", 15).select("event_id")


@query("SELECT file_id, file_id % 3 = 0 AND file_size <= 300000 AS included FROM files")
def bundle_members(c):
    """MU25"""
    path = F.when(F.col("file_id") % 3 == 0, F.concat(F.lit("x/logs/"), F.col("file_id").cast("string"), F.lit(".log"))).when(F.col("file_id") % 3 == 1, "x/logs/secret.log").otherwise("x/data.bin")
    return mu.bundle_members(c.files.select("file_id", path.alias("path"), F.col("file_size").alias("length")), 300_000).select("file_id", "included")


@query("SELECT file_id, last_modified FROM files WHERE status = 2 ORDER BY last_modified DESC, file_id LIMIT 25")
def newest_files(c):
    """SO4"""
    return c.files.where("status = 2").orderBy(F.desc("last_modified"), "file_id").limit(25).select("file_id", "last_modified")


@query("SELECT o_custkey, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN 'C:/data/' || min(o_orderpriority) || '/c' || o_custkey ELSE 'C:/data' END AS root FROM orders GROUP BY o_custkey")
def common_roots(c):
    """SF9"""
    f = c.files.select("local_path", F.regexp_extract("local_path", r"/c(\d+)/", 1).cast("long").alias("o_custkey"))
    return f.groupBy("o_custkey").agg(F.array_sort(F.collect_set("local_path")).alias("p")).select("o_custkey", paths.common_root(F.col("p")).alias("root"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END AS stamp FROM orders")
def quarantine_stamps(c):
    """SF15"""
    name = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "'db.'yyyyMMdd-HHmmss'.bad'")).otherwise("db.bad")
    return c.table("orders").select("o_orderkey", formats.stamp(name).cast("timestamp_ntz").alias("stamp"))


@query("""SELECT file_id, '{"chunkIndex":' || file_id || ',"hash":' || CASE WHEN status = 2 THEN '"' || file_hash || '"' ELSE 'null' END || '}' AS detail FROM files""")
def failure_details(c):
    """SF16"""
    return c.files.select("file_id", formats.detail_json(chunkIndex=F.col("file_id"), hash=F.when(F.col("status") == 2, F.col("file_hash"))).alias("detail"))


@query("SELECT p_partkey, p_size IN (8, 29, 42) AS transient, greatest(0, p_size - greatest(0, 20 - 5) - 3 - 1) AS unaccounted, CASE WHEN p_size / 50.0 <= 0.5 THEN 'Safe' WHEN p_size / 50.0 <= 0.8 THEN 'Aggressive' ELSE 'Dangerous' END AS severity FROM part")
def small_classifiers(c):
    """SF17, SF18, SF21"""
    s = F.col("p_size")
    code = F.when(s == 8, 408).when(s == 29, 429).when(s == 42, 503).otherwise(s + 200)
    return c.table("part").select("p_partkey", formats.transient_status(code).alias("transient"), formats.unaccounted_memory(s, F.lit(20), F.lit(5), F.lit(3), F.lit(1)).alias("unaccounted"), formats.memory_severity(s, F.lit(50)).alias("severity"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey = 0 THEN '' ELSE '1 KB/s, ' || (s_suppkey % 50 + 1) || 's remaining' END AS progress FROM supplier")
def progress_texts(c):
    """SF19, ST8"""
    k = F.col("s_suppkey")
    return c.table("supplier").select(k, formats.progress_text(k * 1024, (k + k % 50 + 1) * 1024, k.cast("double")).alias("progress"))


@query("SELECT c_custkey, c_custkey % 3 = 0 AS strong FROM customer")
def password_policy(c):
    """SF20"""
    k = F.col("c_custkey")
    p = F.when(k % 3 == 0, F.concat(F.lit("Abcdefghijk-"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("abcdefghijk-"), k.cast("string"))).otherwise(F.concat(F.lit("Ab-"), (k % 10).cast("string")))
    return c.table("customer").select(k, formats.strong_password(p).alias("strong"))


@query(f"SELECT file_id, sha256(unhex('{'37' * 32}{'5c' * 32}') || unhex(sha256(unhex('{'5d' * 32}{'36' * 32}') || encode(local_path)))) AS hmac FROM files")
def path_keyed_digests(c):
    """SF4: HMAC-SHA-256 of each path, under a key of 32 letters k"""
    return c.files.select("file_id", hashing.hmac_sha256_hex(b"k" * 32, F.col("local_path")).alias("hmac"))


from . import details  # noqa: E402,F401  registers its queries with `query` above

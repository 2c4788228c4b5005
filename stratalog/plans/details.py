"""More catalog queries and their SQL: what a state transition leaves in each table, bodies and restores, presets, round trips through files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import formats, hashing, paths
from ..operators import aggregates as ag
from ..operators import chunking as cd
from ..operators import integrity as it
from ..operators import joins as jo
from ..operators import lookups as lo
from ..operators import maintenance as mx
from ..operators import mutations as mu
from ..operators import tree
from ..sources import readers
from ..sources.catalog import hash_of
from ..sources.scratch import scratch_path
from ..streaming import changes
from .registry import query

KEY = b"0123456789abcdef0123456789abcdef"

# --- files with their chunks and references ---


def _new_versions(c):
    """Every tenth file anew, with its first two chunks."""
    new = c.files.where("file_id % 10 = 3").withColumn("file_id", F.col("file_id") + 1000000).withColumn("status", F.lit(2))
    chunks = c.file_chunks.where("file_id % 10 = 3 AND chunk_order < 2").withColumn("file_id", F.col("file_id") + 1000000)
    return new, chunks


@query("SELECT file_id, chunk_order, hash FROM file_chunks WHERE file_id % 10 <> 3 UNION ALL SELECT file_id + 1000000, chunk_order, hash FROM file_chunks WHERE file_id % 10 = 3 AND chunk_order < 2")
def upserted_chunks(c):
    """MU1: a file's chunks are replaced whole"""
    return mu.upsert_files(c.files, c.file_chunks, c.chunk_file_refs, *_new_versions(c))[1].select("file_id", "chunk_order", "hash")


@query("SELECT file_path, chunk_hash, chunk_index, referenced_at FROM chunk_file_refs WHERE file_path NOT IN (SELECT local_path FROM files WHERE file_id % 10 = 3) UNION ALL SELECT local_path, hash, chunk_index, backed_up_at FROM files JOIN file_chunks USING (file_id) WHERE file_id % 10 = 3 AND chunk_order < 2")
def upserted_refs(c):
    """MU1: so are its references"""
    return mu.upsert_files(c.files, c.file_chunks, c.chunk_file_refs, *_new_versions(c))[2].select("file_path", "chunk_hash", "chunk_index", "referenced_at")


def _inserted(c, with_refs):
    new = c.files.where("file_id % 5 = 0").withColumn("file_id", F.col("file_id") + 2000000).withColumn("local_path", F.concat("local_path", F.lit(".new")))
    chunks = c.file_chunks.where("file_id % 5 = 0").withColumn("file_id", F.col("file_id") + 2000000)
    return mu.bulk_insert(c.files, c.file_chunks, c.chunk_file_refs, new, chunks, with_refs)


_COUNTED = "SELECT 'file' AS kind, local_path AS name, count(*) AS n FROM {files} GROUP BY ALL UNION ALL SELECT 'chunk', hash, count(*) FROM {chunks} GROUP BY ALL UNION ALL SELECT 'ref', file_path, count(*) FROM {refs} GROUP BY ALL"
_NEW_FILES = "(SELECT local_path FROM files UNION ALL SELECT local_path || '.new' FROM files WHERE file_id % 5 = 0)"
_NEW_CHUNKS = "(SELECT hash FROM file_chunks UNION ALL SELECT hash FROM file_chunks WHERE file_id % 5 = 0)"


def _counted(files, chunks, refs):
    of = lambda kind, df, name: df.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    return of("file", files, "local_path").unionByName(of("chunk", chunks, "hash")).unionByName(of("ref", refs, "file_path"))


@query(_COUNTED.format(files=_NEW_FILES, chunks=_NEW_CHUNKS, refs="(SELECT file_path FROM chunk_file_refs UNION ALL SELECT local_path || '.new' FROM files JOIN file_chunks USING (file_id) WHERE file_id % 5 = 0)"))
def bulk_inserted_rows(c):
    """MU2: rows of files, chunks and references after a bulk insert"""
    return _counted(*_inserted(c, True))


@query(_COUNTED.format(files=_NEW_FILES, chunks=_NEW_CHUNKS, refs="chunk_file_refs"))
def bulk_inserted_without_refs(c):
    """MU3: the same while an index is rebuilt"""
    return _counted(*_inserted(c, False))


@query("SELECT chunk_hash, size_bytes FROM chunk_index WHERE reference_count <> 0")
def delete_chunk_entries(c):
    """MU8: entries that nothing uses are deleted"""
    return mu.delete_by(c.chunk_index, lo.index_orphans(c.chunk_index).select("chunk_hash"), ["chunk_hash"]).select("chunk_hash", "size_bytes")


@query("SELECT 'chunk_index' AS name, CAST(0 AS BIGINT) AS n, (SELECT count(*) FROM files) AS files_left UNION ALL SELECT 'chunk_file_refs', 0, (SELECT count(*) FROM files)")
def clear_index(c):
    """MU8: index and references are cleared together, files stay"""
    left = c.files.agg(F.count("*").alias("files_left"))
    of = lambda name, df: mu.cleared(df).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return of("chunk_index", c.chunk_index).unionByName(of("chunk_file_refs", c.chunk_file_refs)).crossJoin(left)


@query("SELECT id, CASE WHEN id % 4 = 1 THEN started_at + INTERVAL 1 HOUR ELSE started_at END AS started_at, id % 4 = 1 OR cancelled AS cancelled FROM runs UNION ALL SELECT max(id) + 1, TIMESTAMP '2025-01-01', false FROM runs")
def integrity_runs_written(c):
    """MU17: a run is inserted with the next id, others are updated by id, an unknown id changes nothing"""
    run = c.spark.range(1).select(F.lit("2025-01-01").cast("timestamp_ntz").alias("started_at"), F.lit(False).alias("cancelled"))
    changed = c.runs.where("id % 4 = 1").select("id", F.expr("started_at + INTERVAL 1 HOUR").alias("started_at"), F.lit(True).alias("cancelled"))
    unknown = changed.limit(1).withColumn("id", F.lit(-1).cast("long"))
    return mu.update_runs(mu.insert_run(c.runs, run), changed.unionByName(unknown)).select("id", "started_at", "cancelled")


@query("SELECT run_id, file_id, failure_reason, count(*) AS n FROM (SELECT run_id, file_id, failure_reason FROM failures UNION ALL SELECT id, CAST(-1 AS BIGINT), 'missing-file-record' FROM runs) GROUP BY ALL")
def failures_appended(c):
    """MU17: a failure is a row more"""
    more = c.runs.select(F.col("id").alias("run_id"), F.lit(-1).cast("long").alias("file_id"), F.lit("missing-file-record").alias("failure_reason"))
    return c.failures.select("run_id", "file_id", "failure_reason").unionByName(more).groupBy("run_id", "file_id", "failure_reason").agg(F.count("*").alias("n"))


# --- snapshot, telemetry and listing through files ---


@query("SELECT 'entry' AS kind, chunk_hash AS name, size_bytes AS number FROM chunk_index UNION ALL SELECT 'ref', file_path || '#' || chunk_hash, chunk_index FROM chunk_file_refs UNION ALL SELECT 'summary', 'total_chunks', count(*) FROM chunk_index")
def exported_lines(c):
    """MU21: the content of a snapshot, sealed line by line and read again"""
    key = F.lit(bytearray(KEY))
    sealed = mu.exported_index(c.chunk_index, c.chunk_file_refs, ag.index_summary(c.chunk_index)).select(hashing.seal(F.col("value"), key).alias("sealed"))
    row = "kind string, version int, row struct<chunk_hash:string,size_bytes:bigint,file_path:string,chunk_index:int,total_chunks:bigint>"
    r = sealed.select(F.from_json(hashing.unseal(F.col("sealed"), key).cast("string"), row).alias("r")).select("r.kind", "r.version", "r.row.*").where("version = 2")
    name = F.when(F.col("kind") == "entry", F.col("chunk_hash")).when(F.col("kind") == "ref", F.concat("file_path", F.lit("#"), "chunk_hash")).otherwise("total_chunks")
    return r.select("kind", name.alias("name"), F.coalesce("size_bytes", F.col("chunk_index").cast("long"), "total_chunks").alias("number"))


def _lines(c):
    """Telemetry records with a day, written as lines, one folder a day."""
    day = F.when(F.col("type") == "file", F.substring("path", 2, 20).cast("long") % 60).otherwise(59)
    at = F.make_timestamp(F.lit(2024), F.lit(1), F.lit(1), F.lit(12), F.lit(0), F.lit(0)) + F.make_dt_interval(days=day.cast("int"))
    path = scratch_path(c.spark, "telemetry")
    # numbers that are zero are left out of the lines, as their writer does
    t = c.telemetry.withColumn("timestamp", at).withColumn("budget_stalls", F.nullif("budget_stalls", F.lit(0)))
    readers.write_telemetry(t.withColumnRenamed("throughput_mbytes_per_sec", "throughput_mbps"), path)
    return path


_DAY = "CASE WHEN type = 'file' THEN CAST(substr(path, 2) AS BIGINT) % 60 ELSE 59 END"


@query(f"SELECT type, operation, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(budget_stalls) AS BIGINT) AS stalls, round(sum(throughput_mbytes_per_sec), 4) AS throughput FROM telemetry GROUP BY type, operation")
def telemetry_lines(c):
    """SC16, MU20: records are appended as JSON lines by day and read back; absent numbers are zero, an older key is understood"""
    t = readers.telemetry(c.spark, _lines(c))
    return t.groupBy("type", "operation").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.sum("budget_stalls").alias("stalls"), F.round(F.sum("throughput_mbytes_per_sec"), 4).alias("throughput"))


@query(f"SELECT day, count(*) AS n FROM (SELECT DATE '2024-01-01' + CAST({_DAY} AS INT) AS day FROM telemetry) WHERE day > DATE '2024-02-29' - 30 GROUP BY day")
def telemetry_kept(c):
    """MU20: of the days written the last thirty are kept"""
    t = mu.retain_days(readers.telemetry(c.spark, _lines(c)), "2024-02-29", 30)
    return t.groupBy(F.to_date("timestamp").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT r_name || '/' || n_name AS file, CAST(octet_length(encode(n_name)) + 1 AS BIGINT) AS length FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey <> 2 AND n_nationkey % 7 <> 3")
def folder_listing(c):
    """SC10: a folder listed recursively, with the exclusion of a subfolder and of files by glob"""
    root = scratch_path(c.spark, "listing")
    n = c.table("nation").join(F.broadcast(c.table("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    kind = F.when(F.col("n_nationkey") % 7 == 3, "tmp").otherwise("dat")
    n.select(F.col("n_name").alias("value"), F.col("r_name").alias("folder"), F.col("n_name").alias("file"), kind.alias("kind")).coalesce(1).write.partitionBy("folder", "file", "kind").text(root)
    names = r"folder=([^/]*)/file=([^/]*)/kind=([^/]*)/"
    part = lambda i: F.url_decode(F.regexp_extract("path", names, i))
    found = readers.listing(c.spark, root).select(part(1).alias("folder"), part(2).alias("file"), part(3).alias("kind"), "length")
    excluded = paths.glob_match(F.concat(F.col("file"), F.lit("."), F.col("kind")), "*.tmp") | paths.under_prefix(F.concat(F.lit("C:/"), F.col("folder")), F.lit("c:/asia"), strict=True)
    return found.where(~excluded).select(F.concat("folder", F.lit("/"), "file").alias("file"), "length")


# --- index upkeep ---


@query(""", p AS (SELECT file_id, local_path AS file_path FROM files WHERE file_id % 20 = 7), up AS (SELECT file_path, hash AS chunk_hash, chunk_index FROM p JOIN file_chunks USING (file_id) WHERE chunk_order >= 1),
gone AS (SELECT DISTINCT file_path, chunk_hash FROM chunk_file_refs WHERE file_path IN (SELECT file_path FROM p) AND (file_path, chunk_hash) NOT IN (SELECT file_path, chunk_hash FROM up)),
r AS (SELECT file_path, chunk_hash, chunk_index FROM chunk_file_refs WHERE (file_path, chunk_hash) NOT IN (SELECT file_path, chunk_hash FROM gone) AND (file_path, chunk_hash, chunk_index) NOT IN (SELECT file_path, chunk_hash, chunk_index FROM up) UNION ALL SELECT * FROM up),
live AS (SELECT chunk_hash, count(*) AS n FROM r GROUP BY chunk_hash)
SELECT i.chunk_hash, CASE WHEN i.chunk_hash IN (SELECT chunk_hash FROM up UNION SELECT chunk_hash FROM gone) THEN CAST(coalesce(n, 0) AS INT) ELSE reference_count END AS reference_count FROM chunk_index i LEFT JOIN live USING (chunk_hash)
WHERE i.chunk_hash NOT IN (SELECT chunk_hash FROM gone) OR coalesce(n, 0) > 0""")
def update_file_chunks(c):
    """IX3: files lose their first chunk; references to removed hashes go, chunks that nobody uses now leave the index"""
    own = c.files.where("file_id % 20 = 7")
    up = own.join(c.file_chunks.where("chunk_order >= 1"), "file_id").select(
        F.col("local_path").alias("file_path"), F.col("hash").alias("chunk_hash"), "chunk_index", F.col("backed_up_at").alias("referenced_at"), F.col("length").cast("long").alias("size_bytes"), F.lit(0).alias("tier"), F.lit(False).alias("is_new")
    )
    return mx.update_file_chunks(c.chunk_index, c.chunk_file_refs, own.select(F.col("local_path").alias("file_path")), up)[0].select("chunk_hash", "reference_count")


@query(""", bad AS (SELECT DISTINCT file_id FROM file_chunks WHERE 'chunks/' || hash NOT IN (SELECT blob_name FROM remote_blobs)), g AS (SELECT hash AS chunk_hash, count(*) AS n FROM file_chunks WHERE file_id NOT IN (SELECT file_id FROM bad) AND file_id IN (SELECT file_id FROM files) GROUP BY hash)
SELECT chunk_hash AS name, CAST(n AS VARCHAR) AS value FROM g UNION ALL SELECT 'password_salt', (SELECT max(n_name) FROM nation) UNION ALL SELECT 'failed_logins', '0' UNION ALL SELECT 'lockout_until', ''""")
def rebuilt_from_quarantine(c):
    """IX11: a fresh catalog takes the salt of the quarantined one, forgets failed logins, and rebuilds its index"""
    old = c.table("nation").agg(F.max("n_name").alias("password_salt"))
    fresh = c.spark.range(1).select(F.lit("throwaway").alias("password_salt"), F.lit(3).alias("failed_logins"), F.lit("2025-01-01").cast("timestamp_ntz").alias("lockout_until"))
    settings, index = mx.rebuilt_from_quarantine(fresh, old, c.files, c.file_chunks, c.remote_blobs)
    entries = F.array(*[F.struct(F.lit(k).alias("name"), F.coalesce(F.col(k).cast("string"), F.lit("")).alias("value")) for k in settings.columns])
    return index.select(F.col("chunk_hash").alias("name"), F.col("reference_count").cast("string").alias("value")).unionByName(settings.select(F.explode(entries).alias("e")).select("e.*"))


@query("SELECT count(*) AS scanned, count(*) FILTER (o) AS orphans, CAST(coalesce(sum(size_bytes) FILTER (o), 0) AS BIGINT) AS orphan_bytes FROM (SELECT size_bytes, regexp_extract(blob_name, '^chunks/([^_]*)', 1) NOT IN (SELECT chunk_hash FROM chunk_index WHERE reference_count <> 0) AS o FROM remote_blobs)")
def orphan_totals(c):
    """AG7"""
    return jo.orphan_totals(c.remote_blobs, c.chunk_index)


# --- presets and probes ---


@query(""", l AS (SELECT id FROM runs ORDER BY started_at DESC, id DESC LIMIT 1) SELECT 'session' AS preset, count(*) AS n, CAST(sum(file_size) AS BIGINT) AS bytes FROM files WHERE backed_up_at >= TIMESTAMP '1998-07-31'
UNION ALL SELECT '24h', count(*), CAST(sum(file_size) AS BIGINT) FROM files WHERE backed_up_at >= TIMESTAMP '1998-08-01' - INTERVAL 24 HOUR UNION ALL SELECT '7d', count(*), CAST(sum(file_size) AS BIGINT) FROM files WHERE backed_up_at >= TIMESTAMP '1998-08-01' - INTERVAL 168 HOUR
UNION ALL SELECT 'all', count(*), CAST(sum(file_size) AS BIGINT) FROM files UNION ALL SELECT 'failed_last_run', count(*), CAST(sum(file_size) AS BIGINT) FROM files WHERE file_id IN (SELECT file_id FROM failures WHERE run_id IN (SELECT id FROM l))""")
def scope_presets(c):
    """FI13"""
    out = None
    for preset in ("session", "24h", "7d", "all", "failed_last_run"):
        own = lo.in_scope(c.files, c.failures, c.runs, preset, "1998-08-01", "1998-07-31")
        own = own.agg(F.count("*").alias("n"), F.sum("file_size").alias("bytes")).select(F.lit(preset).alias("preset"), "n", "bytes")
        out = own if out is None else out.unionByName(own)
    return out


@query("SELECT 'refs' AS name, EXISTS (SELECT 1 FROM chunk_file_refs) AS found UNION ALL SELECT 'failures of no run', EXISTS (SELECT 1 FROM failures WHERE run_id < 0) UNION ALL SELECT 'failures of tier 3', EXISTS (SELECT 1 FROM failures WHERE failure_tier = 3)")
def emptiness_probes(c):
    """FI6"""
    of = lambda name, df: lo.any_row(df).select(F.lit(name).alias("name"), "found")
    return of("refs", c.chunk_file_refs).unionByName(of("failures of no run", c.failures.where("run_id < 0"))).unionByName(of("failures of tier 3", c.failures.where("failure_tier = 3")))


@query("SELECT id, file_path, change_type FROM (SELECT id, '/w' || id % 3 || file_path AS file_path, change_type FROM pending_changes WHERE change_type <> 3 UNION ALL SELECT id, '/w' || id % 3 || '/old' || file_path, 2 FROM pending_changes WHERE change_type = 3 UNION ALL SELECT id, '/w' || id % 3 || file_path, 0 FROM pending_changes WHERE change_type = 3) WHERE NOT starts_with(file_path, '/w2/') AND NOT regexp_matches(upper(file_path), '/U[0-9]*7$')")
def watched_changes(c):
    """ST1: renames are split, changes outside of the watched folders or of excluded names are left out"""
    root = F.concat(F.lit("/w"), (F.col("id") % 3).cast("string"))
    e = c.pending_changes.withColumn("old_path", F.concat(root, F.lit("/old"), "file_path")).withColumn("file_path", F.concat(root, "file_path"))
    split = changes.split_renames(e.select("old_path", "file_path", "change_type", F.col("id").alias("detected_at")))
    return changes.watched(split, ["/W0", "/w1/"], ["u*7", ""]).select(F.col("detected_at").alias("id"), "file_path", "change_type")


# --- orders, with the place of each row ---


@query("SELECT file_id, chunk_order, hash, row_number() OVER (PARTITION BY file_id ORDER BY chunk_order) - 1 AS place FROM file_chunks WHERE file_id % 100 = 0")
def chunk_places(c):
    """SC3, SO8: chunks in order, each with its place, out of the nested files"""
    nested = lo.nested_files(c.files.where("file_id % 100 = 0"), c.file_chunks, ("chunk_order", "hash"))
    return nested.select("file_id", F.posexplode("chunks").alias("place", "x")).select("file_id", "x.chunk_order", "x.hash", F.col("place").cast("long").alias("place"))


@query("SELECT local_path, failure_tier, chunk_hash, row_number() OVER (ORDER BY failure_tier DESC, local_path, chunk_hash) AS place FROM failures WHERE run_id = 3")
def failure_places(c):
    """SO3: the failures of one run in order, numbered"""
    w = Window.partitionBy("run_id").orderBy(F.desc("failure_tier"), "local_path", "chunk_hash")
    return lo.failures_of_run(c.failures, 3).withColumn("place", F.row_number().over(w).cast("long")).select("local_path", "failure_tier", "chunk_hash", "place")


@query(""", t AS (SELECT DISTINCT folder, k, true AS is_folder FROM (SELECT 'C:/data/' || o_orderpriority AS folder, upper('C:/data/' || o_orderpriority) AS k FROM orders UNION ALL SELECT 'C:/data/' || o_orderpriority || '/c' || o_custkey, upper('C:/data/' || o_orderpriority || '/c' || o_custkey) FROM orders UNION ALL SELECT 'C:/data', 'C:/DATA' UNION ALL SELECT 'C:', 'C:')
UNION ALL SELECT local_path, upper(local_path), false FROM files),
n AS (SELECT folder AS node, is_folder, regexp_extract(k, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(k, '([^/]*)$', 1) AS name FROM t)
SELECT node, is_folder, row_number() OVER (PARTITION BY parent ORDER BY is_folder DESC, name) AS place, row_number() OVER (PARTITION BY parent, is_folder ORDER BY name) AS place_by_path FROM n""")
def folder_contents(c):
    """SO5, SO6: what each folder holds, folders first, then by name ignoring case"""
    n = tree.tree_nodes(c.files).withColumn("parent", paths.path_key(paths.directory_name(F.col("node"))))
    key = paths.path_key(F.col("name"))
    place = F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("is_folder"), key)).cast("long")
    by_path = F.row_number().over(Window.partitionBy("parent", "is_folder").orderBy(paths.path_key(F.col("node")))).cast("long")
    return n.select("node", "is_folder", place.alias("place"), by_path.alias("place_by_path"))


# --- bodies and restores ---


@query("""SELECT doc_id AS file_id, CASE WHEN doc_id % 7 < 3 THEN 2 ELSE 3 END AS failure_tier, CASE doc_id % 7 WHEN 0 THEN 'crc-mismatch' WHEN 1 THEN 'decrypt-failed' WHEN 2 THEN 'download-error' WHEN 3 THEN 'local-file-missing' WHEN 4 THEN 'local-short-read' ELSE 'byte-differ' END AS failure_reason
FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents) WHERE doc_id % 7 < 3 OR (doc_id % 2 = 0 AND (doc_id % 7 = 3 OR (doc_id % 7 IN (4, 5) AND n > 0)))""")
def integrity_body_failures(c):
    """IN1: tiers 2 and 3, over sealed bodies that are cut short, sealed with another key or absent, and local files that are missing, short or different"""
    k, key = F.col("doc_id"), F.lit(bytearray(KEY))
    d = c.table("documents").select("doc_id", F.col("text").cast("binary").alias("plain"), hash_of(k).alias("chunk_hash"))
    suspects = d.select(k.alias("file_id"), F.concat(F.lit("d"), k.cast("string")).alias("local_path"), F.lit(0).alias("chunk_index"), F.lit(0).alias("offset"), F.octet_length("plain").alias("length"), "chunk_hash", (k % 2 == 0).alias("t1_failed"))
    whole = hashing.seal(F.col("plain"), key)
    short = F.transform(F.array(whole), lambda s: F.substring(s, F.lit(1), F.octet_length(s) - 1))[0]
    bodies = d.where(k % 7 != 2).select("chunk_hash", F.when(k % 7 == 0, short).when(k % 7 == 1, hashing.seal(F.col("plain"), F.lit(bytearray(KEY[::-1])))).otherwise(whole).alias("sealed"))
    content = F.when(k % 7 == 4, F.substring(F.col("plain"), F.lit(1), F.greatest(F.octet_length("plain") - 1, F.lit(0)))).when(k % 7 == 5, F.concat(F.lit(b"\x01"), "plain")).otherwise(F.col("plain"))
    local = d.where(k % 7 != 3).select(F.concat(F.lit("d"), k.cast("string")).alias("local_path"), content.alias("content"))
    return it.body_failures(suspects, bodies, KEY, local).select("file_id", "failure_tier", "failure_reason")


def _pieces(c):
    """Texts in pieces of 1,000 characters, and the bodies that are in store: of hashes that begin with 0 they are damaged, with 1 to 7 lost."""
    d = c.table("documents").where("text IS NOT NULL")
    n = F.greatest(F.ceil(F.length("text") / 1000), F.lit(1)).cast("int")
    p = d.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("text"), i * 1000 + 1, F.lit(1000)).cast("binary"))).alias("chunk_order", "plain"))
    p = p.withColumn("hash", hashing.sha256_hex(F.col("plain")))
    chunks = p.select(F.col("doc_id").alias("file_id"), "chunk_order", F.col("chunk_order").alias("chunk_index"), F.octet_length("plain").alias("length"), "hash")
    stored = p.where(~F.col("hash").rlike("^[1-7]")).groupBy(F.col("hash").alias("chunk_hash")).agg(F.min("plain").alias("plain"))
    return chunks, stored


_PIECES = """, p AS (SELECT doc_id, i, substr(text, i * 1000 + 1, 1000) AS s FROM (SELECT doc_id, text, unnest(range(greatest(CAST(ceil(length(text) / 1000.0) AS BIGINT), 1))) AS i FROM documents WHERE text IS NOT NULL)), h AS (SELECT *, upper(sha256(s)) AS hash FROM p)"""


@query(f"{_PIECES} SELECT doc_id AS file_id, CAST(i AS INT) AS chunk_index, NOT regexp_matches(hash, '^[0-7]') AS ok FROM h")
def verified_restore(c):
    """IN7: length and hash of each restored chunk; damaged and lost ones are not right"""
    chunks, stored = _pieces(c)
    damaged = stored.withColumn("plain", F.when(F.col("chunk_hash").startswith("0"), F.concat("plain", F.lit(b"x"))).otherwise(F.col("plain")))
    return it.verified_restore(chunks, damaged)


@query(f"""{_PIECES}, g AS (SELECT doc_id, count(*) AS chunks, count(*) FILTER (NOT regexp_matches(hash, '^[1-7]')) AS recovered, list(CASE WHEN regexp_matches(hash, '^[1-7]') THEN unhex(repeat('00', octet_length(encode(s)))) ELSE encode(s) END ORDER BY i) AS parts FROM h GROUP BY doc_id)
SELECT doc_id AS file_id, recovered, chunks, CASE WHEN recovered > 0 OR chunks < 3 THEN sha256(list_reduce(parts, lambda a, x: a || x)) END AS digest FROM g""")
def zero_filled_restore(c):
    """IN8: lost pieces are zeros; given up if none of three or more could be read"""
    out = it.best_effort(*_pieces(c))
    return out.select("file_id", "recovered", "chunks", F.sha2("content", 256).alias("digest"))


@query("SELECT lang || n_chars % 50 AS chunk_hash, count(DISTINCT text) AS contents FROM documents GROUP BY 1 HAVING count(DISTINCT text) > 1")
def hash_collisions(c):
    """IN10: one hash, different bytes"""
    d = c.table("documents").select(F.concat("lang", (F.col("n_chars") % 50).cast("string")).alias("chunk_hash"), F.col("text").cast("binary").alias("plain"))
    return it.collisions(d)


@query("SELECT file_id, count(*) FILTER (NOT k) AS new_chunks, round(count(*) FILTER (NOT k) / count(*), 6) AS ratio FROM (SELECT file_id, hash IN (SELECT hash FROM file_chunks o WHERE o.file_id = n.file_id AND o.chunk_order > 1) AS k FROM file_chunks n) GROUP BY file_id HAVING count(*) FILTER (NOT k) / count(*) > 0.5")
def poor_dedup(c):
    """DD4: files more than half of whose chunks are new"""
    out = cd.poor_dedup(cd.version_reuse(c.file_chunks.where("chunk_order > 1"), c.file_chunks))
    return out.select("file_id", "new_chunks", F.round("ratio", 6).alias("ratio"))


# --- arithmetic ---


@query("SELECT path, round(CASE WHEN s > 0 THEN bytes / s / 1048576 ELSE 0 END, 6) AS throughput FROM (SELECT path, bytes, elapsed_seconds - 1 AS s FROM telemetry WHERE type = 'file')")
def throughputs(c):
    """AG18: zero where no time has passed"""
    t = c.telemetry.where("type = 'file'")
    return t.select("path", F.round(formats.throughput_mb(F.col("bytes"), F.col("elapsed_seconds") - 1), 6).alias("throughput"))


@query("SELECT p_partkey, CASE WHEN p_partkey <= 1 THEN 1 ELSE (SELECT min(x) FROM (SELECT CAST(1 AS BIGINT) << unnest(range(40)) AS x) WHERE x >= p_partkey) END AS power, CAST(least(greatest(p_partkey // 512, 1), 16) AS INT) AS files FROM part")
def concurrency_arithmetic(c):
    """SF11: the next power of two, which is also the ceiling of a bucket, and files at a time for a budget in MB"""
    k = F.col("p_partkey")
    return c.table("part").select("p_partkey", formats.next_power_of_two(k).alias("power"), formats.file_concurrency(k).alias("files"))


@query("SELECT p_partkey, array_to_string(list_concat(list_filter([512 * (CAST(1 AS BIGINT) << i) FOR i IN range(31)], lambda x: x < t), [t]), ',') AS steps, least(coalesce(list_max(list_filter(list_concat(list_filter([512 * (CAST(1 AS BIGINT) << i) FOR i IN range(31)], lambda x: x < t), [t]), lambda x: x <= t // 4)), 512), 8192) AS default_mb FROM (SELECT p_partkey, p_size * 1000 AS t FROM part)")
def memory_limits(c):
    """SF18: the steps to choose from and the default"""
    t = (F.col("p_size") * 1000).cast("long")
    return c.table("part").select("p_partkey", F.array_join(formats.memory_steps(t).cast("array<string>"), ",").alias("steps"), formats.default_limit(t).cast("long").alias("default_mb"))


@query("""SELECT file_id, array_to_string([substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', CAST(1 + list_sum([CAST(substr(bits, 5 * k + 1 + j, 1) AS INT) * (16 >> j) FOR j IN range(5)]) AS BIGINT), 1) FOR k IN range(26)], '') AS body, true AS reads_back, true AS typo_found
FROM (SELECT file_id, array_to_string([array_to_string([CAST((instr('0123456789abcdef', substr(md5(local_path), i, 1)) - 1) >> b & 1 AS VARCHAR) FOR b IN [3, 2, 1, 0]], '') FOR i IN range(1, 33)], '') || '00' AS bits FROM files)""")
def recovery_codes(c):
    """SF12: salts as recovery codes (without the check symbols, which SQL has no CRC for), read back, and not with a symbol changed"""
    f = c.files.select("file_id", F.unhex(F.md5(F.col("local_path").cast("binary"))).alias("salt"))
    f = f.withColumn("code", hashing.recovery_code_of(F.col("salt")))
    typed = F.concat(F.lit(" "), F.replace(F.lower("code"), F.lit("1"), F.lit("l")))
    other = F.concat(F.translate(F.left("code", F.lit(1)), hashing.ALPHABET, hashing.ALPHABET[1:] + hashing.ALPHABET[0]), F.substring("code", 2, 40))
    return f.select("file_id", F.left(F.replace("code", F.lit("-"), F.lit("")), F.lit(26)).alias("body"), (hashing.salt_of(typed) == F.col("salt")).alias("reads_back"), hashing.salt_of(other).isNull().alias("typo_found"))


@query("SELECT operation, n, CAST(least(greatest(402653184 // greatest(m, 1), 4), 24) AS INT) AS expected FROM (SELECT operation, count(*) AS n, max(chunk_max) AS m FROM telemetry WHERE type = 'file' GROUP BY operation)")
def concurrency_by_operation(c):
    """TM3 by operation: what its largest chunk allows"""
    f = c.telemetry.where("type = 'file'").groupBy("operation").agg(F.count("*").alias("n"), F.max("chunk_max").alias("chunk_max"))
    return f.select("operation", "n", formats.adaptive_concurrency(F.col("chunk_max")).alias("expected"))

"""The relations of a file catalog as DataFrames over the star-schema test tables.

Each relation is a plan, nothing is read before it is needed, and only the columns that a query uses are
scanned. `SQL` holds the same relations for an SQL engine that has the tables as views.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PENDING, IN_PROGRESS, COMPLETED, FAILED, EXCLUDED = range(5)
HOT, COOL, COLD, ARCHIVE = range(4)
CREATED, MODIFIED, DELETED, RENAMED = range(4)
TIERS = ((HOT, "Hot"), (COOL, "Cool"), (COLD, "Cold"), (ARCHIVE, "Archive"))
ENVELOPE_OVERHEAD = 37  # bytes that encryption adds to a chunk
REFS_UNTIL = "1995-03-01"
FOLDERS = [  # ordinal, path, tier, enabled
    (1, "C:/data/1-URGENT/c1", COLD, True),
    (2, "C:/data/1-URGENT", COOL, True),
    (3, "c:/DATA/2", ARCHIVE, True),
    (4, "C:/data/3-MEDIUM", COOL, False),
    (5, "C:/data/4", COLD, True),
]
GLOBS = ["*7.dat", "c1?", "", "  "]


def hash_of(key: Column) -> Column:
    return F.upper(F.sha2(key.cast("string").cast("binary"), 256))


class Catalog:
    """Relations by name: files, file_chunks, chunk_index, chunk_file_refs, remote_blobs, local_files, pending_changes, runs, failures, folders."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def files(self) -> DataFrame:
        k = F.col("o_orderkey")
        status = (
            F.when(k % 29 == 0, EXCLUDED).when(k % 31 == 0, IN_PROGRESS).when(F.col("o_orderstatus") == "F", COMPLETED).when(F.col("o_orderstatus") == "O", PENDING).otherwise(FAILED)
        )
        path = F.concat(F.lit("C:/data/"), "o_orderpriority", F.lit("/c"), F.col("o_custkey").cast("string"), F.lit("/f"), k.cast("string"), F.lit(".dat"))
        f = self.table("orders").select(
            k.alias("file_id"), path.alias("local_path"), F.when(k % 37 == 0, 0).otherwise(F.round("o_totalprice")).cast("long").alias("file_size"), F.col("o_orderdate").alias("last_modified"), status.cast("int").alias("status")
        )
        done = F.col("status") == COMPLETED
        return f.select(
            "*",
            F.when(done, hash_of(F.col("file_id"))).otherwise("").alias("file_hash"),
            F.when(done | ((F.col("status") == FAILED) & (F.col("file_id") % 2 == 0)), F.concat(F.lit("metadata/"), F.col("file_id").cast("string"))).otherwise("").alias("blob_name"),
            F.expr("last_modified + INTERVAL 1 DAY").alias("backed_up_at"),
        )

    @cached_property
    def file_chunks(self) -> DataFrame:
        w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
        length = F.when(F.col("l_partkey") % 97 == 0, 0).otherwise(F.col("l_quantity") * 1024).cast("int")
        c = self.table("lineitem").select("*", (F.row_number().over(w) - 1).alias("chunk_order"), length.alias("length"))
        before = F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
        return c.select(F.col("l_orderkey").alias("file_id"), "chunk_order", F.col("chunk_order").alias("chunk_index"), before.alias("offset"), "length", hash_of(F.col("l_partkey")).alias("hash"))

    @cached_property
    def chunk_file_refs(self) -> DataFrame:
        lines = self.table("lineitem").where(F.col("l_shipdate") < F.lit(REFS_UNTIL).cast("timestamp_ntz"))
        paths = self.files.select("file_id", "local_path")
        return lines.join(paths, lines["l_orderkey"] == paths["file_id"]).select(
            F.col("local_path").alias("file_path"), hash_of(F.col("l_partkey")).alias("chunk_hash"), F.col("l_linenumber").alias("chunk_index"), F.col("l_shipdate").alias("referenced_at")
        )

    @cached_property
    def chunk_index(self) -> DataFrame:
        k = F.col("p_partkey")
        lines = self.table("lineitem").where(F.col("l_shipdate") < F.lit(REFS_UNTIL).cast("timestamp_ntz"))
        counts = lines.groupBy("l_partkey").agg(F.count("*").cast("int").alias("n"))
        parts = self.table("part").join(counts, k == F.col("l_partkey"), "left")
        return parts.select(
            hash_of(k).alias("chunk_hash"),
            F.concat(F.lit("C:/seed/p"), k.cast("string")).alias("original_uploader_path"),
            (F.col("p_size") * 1024).cast("long").alias("size_bytes"),
            F.coalesce("n", F.lit(0)).alias("reference_count"),
            (F.col("p_size") % 4).alias("current_tier"),
            F.when(k % 5 != 0, F.md5(F.concat(F.lit("blob"), k.cast("string")).cast("binary"))).alias("expected_md5"),
        )

    @cached_property
    def remote_blobs(self) -> DataFrame:
        k = F.col("p_partkey")
        parts = self.table("part").where(k % 17 != 0)
        own = parts.select(
            F.concat(F.lit("chunks/"), hash_of(k)).alias("blob_name"),
            (F.col("p_size") * 1024 + ENVELOPE_OVERHEAD + F.when(k % 23 == 0, 1).otherwise(0)).cast("long").alias("size_bytes"),
            (F.col("p_size") % 4).alias("tier"),
            F.md5(F.concat(F.when(k % 19 == 0, "bad").otherwise("blob"), k.cast("string")).cast("binary")).alias("content_md5"),
        )
        versions = parts.where(k % 101 == 0).select(F.concat(F.lit("chunks/"), hash_of(k), F.lit("_v2")).alias("blob_name"), F.lit(100).cast("long").alias("size_bytes"), F.lit(HOT).alias("tier"), F.lit("v").alias("content_md5"))
        extra = self.table("region").select(F.concat(F.lit("chunks/"), hash_of(-1 - F.col("r_regionkey"))).alias("blob_name"), F.lit(4096).cast("long").alias("size_bytes"), F.lit(COLD).alias("tier"), F.lit("x").alias("content_md5"))
        return own.unionByName(versions).unionByName(extra)

    @cached_property
    def local_files(self) -> DataFrame:
        k = F.col("file_id")
        shift = F.when(k % 11 == 0, 1).when(k % 11 == 1, 3).when(k % 11 == 2, -5).otherwise(0)
        known = self.files.where(k % 13 != 0).select(
            F.when(k % 3 == 0, F.upper("local_path")).otherwise(F.col("local_path")).alias("path"),
            (F.col("file_size") + F.when(k % 7 == 0, 1).otherwise(0)).alias("length"),
            (F.col("last_modified") + F.make_dt_interval(secs=shift.cast("decimal(18,6)"))).alias("modified"),
            F.when(k % 5 == 0, hash_of(-k)).otherwise(hash_of(k)).alias("sha256"),
        )
        new = self.table("customer").select(
            F.concat(F.lit("C:/data/new/c"), F.col("c_custkey").cast("string"), F.lit(".dat")).alias("path"), F.lit(10).cast("long").alias("length"), F.lit("1999-01-01").cast("timestamp_ntz").alias("modified"), hash_of(F.col("c_custkey") + 10_000_000).alias("sha256")
        )
        return known.unionByName(new)

    @cached_property
    def pending_changes(self) -> DataFrame:
        e = self.table("events")
        path = F.concat(F.when(F.col("event_id") % 2 == 0, "/U").otherwise("/u"), F.col("user_id").cast("string"))
        kind = F.when(F.col("event_type") == "signup", CREATED).when(F.col("event_type") == "error", DELETED).when(F.col("event_type") == "view", RENAMED).otherwise(MODIFIED)
        return e.select(F.col("event_id").alias("id"), path.alias("file_path"), kind.alias("change_type"), F.col("ts").alias("detected_at"))

    @cached_property
    def runs(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.table("supplier").select(
            (k + 1).alias("id"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=(k * 37) % 1009)).alias("started_at"), (k % 3 == 0).alias("cancelled")
        )

    @cached_property
    def failures(self) -> DataFrame:
        k = F.col("l_suppkey")
        reason = F.when(k % 4 == 0, "missing-blob").when(k % 4 == 1, "wrong-size").when(k % 4 == 2, "crc-mismatch").otherwise("byte-differ")
        tier = F.when(k % 4 < 2, 1).when(k % 4 == 2, 2).otherwise(3)
        lines = self.table("lineitem").where(F.col("l_tax") > 0.06)
        paths = self.files.select("file_id", "local_path")
        return lines.join(paths, lines["l_orderkey"] == paths["file_id"]).select((k + 1).alias("run_id"), "file_id", "local_path", tier.alias("failure_tier"), reason.alias("failure_reason"), hash_of(F.col("l_partkey")).alias("chunk_hash"))

    @cached_property
    def telemetry(self) -> DataFrame:
        k, op = F.col("o_orderkey"), F.concat(F.lit("op"), (F.col("o_custkey") % 50).cast("string"))
        o = self.table("orders").select(k, op.alias("operation"), F.round("o_totalprice").cast("long").alias("bytes"))
        zero = F.lit(0)
        files = o.select(
            F.lit("file").alias("type"), "operation", F.concat(F.lit("f"), k.cast("string")).alias("path"), (F.col("bytes") * (1 + k % 9)).alias("bytes"), (1 + k % 10).cast("double").alias("elapsed_seconds"),
            (F.col("bytes") * (1 + k % 9) / (1 + k % 10) / 1048576).alias("throughput_mbytes_per_sec"), F.shiftleft((k % 40).cast("int"), 20).alias("chunk_max"), (4 + k % 20).cast("int").alias("effective_concurrency"), (k % 3).cast("int").alias("budget_stalls"), zero.alias("succeeded"), zero.alias("memory_budget_mb"),
        )
        ops = o.groupBy("operation").agg(F.count("*").alias("n"), F.sum(k % 3).alias("stalls"), F.min(k).alias("k"), F.sum("bytes").alias("bytes"))
        ops = ops.select(
            F.lit("op").alias("type"), "operation", F.lit(None).cast("string").alias("path"), "bytes", F.lit(10.0).alias("elapsed_seconds"), (F.col("bytes") / 10 / 1048576).alias("throughput_mbytes_per_sec"), zero.alias("chunk_max"), zero.alias("effective_concurrency"),
            F.when(F.col("k") % 2 == 0, F.col("stalls")).otherwise(0).cast("int").alias("budget_stalls"), (F.col("n") + F.col("k") % 4).cast("int").alias("succeeded"), (256 * (1 + F.col("k") % 5)).cast("int").alias("memory_budget_mb"),
        )
        return files.unionByName(ops)

    @cached_property
    def folders(self) -> DataFrame:
        return self.spark.createDataFrame(FOLDERS, "ordinal int, path string, tier int, enabled boolean")


_H = "upper(sha256(CAST({0} AS VARCHAR)))"
SQL = f"""
WITH files AS (
  SELECT *, CASE WHEN status = 2 THEN {_H.format("file_id")} ELSE '' END AS file_hash,
         CASE WHEN status = 2 OR (status = 3 AND file_id % 2 = 0) THEN 'metadata/' || file_id ELSE '' END AS blob_name, last_modified + INTERVAL 1 DAY AS backed_up_at
  FROM (SELECT o_orderkey AS file_id, 'C:/data/' || o_orderpriority || '/c' || o_custkey || '/f' || o_orderkey || '.dat' AS local_path,
               CASE WHEN o_orderkey % 37 = 0 THEN 0 ELSE CAST(round(o_totalprice) AS BIGINT) END AS file_size, o_orderdate AS last_modified,
               CASE WHEN o_orderkey % 29 = 0 THEN 4 WHEN o_orderkey % 31 = 0 THEN 1 WHEN o_orderstatus = 'F' THEN 2 WHEN o_orderstatus = 'O' THEN 0 ELSE 3 END AS status FROM orders)),
file_chunks AS (
  SELECT file_id, chunk_order, chunk_order AS chunk_index, CAST(coalesce(sum(length) OVER (PARTITION BY file_id ORDER BY chunk_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", length, hash
  FROM (SELECT l_orderkey AS file_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS INT) AS chunk_order,
               CASE WHEN l_partkey % 97 = 0 THEN 0 ELSE CAST(l_quantity * 1024 AS INT) END AS length, {_H.format("l_partkey")} AS hash FROM lineitem)),
chunk_file_refs AS (
  SELECT local_path AS file_path, {_H.format("l_partkey")} AS chunk_hash, l_linenumber AS chunk_index, l_shipdate AS referenced_at
  FROM lineitem JOIN files ON l_orderkey = file_id WHERE l_shipdate < TIMESTAMP '{REFS_UNTIL}'),
chunk_index AS (
  SELECT {_H.format("p_partkey")} AS chunk_hash, 'C:/seed/p' || p_partkey AS original_uploader_path, CAST(p_size * 1024 AS BIGINT) AS size_bytes, CAST(coalesce(n, 0) AS INT) AS reference_count,
         p_size % 4 AS current_tier, CASE WHEN p_partkey % 5 <> 0 THEN md5('blob' || p_partkey) END AS expected_md5
  FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_shipdate < TIMESTAMP '{REFS_UNTIL}' GROUP BY l_partkey) ON p_partkey = l_partkey),
remote_blobs AS (
  SELECT 'chunks/' || {_H.format("p_partkey")} AS blob_name, CAST(p_size * 1024 + {ENVELOPE_OVERHEAD} + CASE WHEN p_partkey % 23 = 0 THEN 1 ELSE 0 END AS BIGINT) AS size_bytes, p_size % 4 AS tier,
         md5(CASE WHEN p_partkey % 19 = 0 THEN 'bad' ELSE 'blob' END || p_partkey) AS content_md5 FROM part WHERE p_partkey % 17 <> 0
  UNION ALL SELECT 'chunks/' || {_H.format("p_partkey")} || '_v2', 100, 0, 'v' FROM part WHERE p_partkey % 17 <> 0 AND p_partkey % 101 = 0
  UNION ALL SELECT 'chunks/' || {_H.format("-1 - r_regionkey")}, 4096, 2, 'x' FROM region),
local_files AS (
  SELECT CASE WHEN file_id % 3 = 0 THEN upper(local_path) ELSE local_path END AS path, file_size + CASE WHEN file_id % 7 = 0 THEN 1 ELSE 0 END AS length,
         last_modified + to_seconds(CASE file_id % 11 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN -5 ELSE 0 END) AS modified,
         CASE WHEN file_id % 5 = 0 THEN {_H.format("-file_id")} ELSE {_H.format("file_id")} END AS sha256 FROM files WHERE file_id % 13 <> 0
  UNION ALL SELECT 'C:/data/new/c' || c_custkey || '.dat', 10, TIMESTAMP '1999-01-01', {_H.format("c_custkey + 10000000")} FROM customer),
pending_changes AS (
  SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN '/U' ELSE '/u' END || user_id AS file_path,
         CASE event_type WHEN 'signup' THEN 0 WHEN 'error' THEN 2 WHEN 'view' THEN 3 ELSE 1 END AS change_type, ts AS detected_at FROM events),
runs AS (SELECT s_suppkey + 1 AS id, TIMESTAMP '2024-01-01' + to_hours(CAST((s_suppkey * 37) % 1009 AS INT)) AS started_at, s_suppkey % 3 = 0 AS cancelled FROM supplier),
failures AS (
  SELECT l_suppkey + 1 AS run_id, file_id, local_path, CASE WHEN l_suppkey % 4 < 2 THEN 1 WHEN l_suppkey % 4 = 2 THEN 2 ELSE 3 END AS failure_tier,
         CASE l_suppkey % 4 WHEN 0 THEN 'missing-blob' WHEN 1 THEN 'wrong-size' WHEN 2 THEN 'crc-mismatch' ELSE 'byte-differ' END AS failure_reason, {_H.format("l_partkey")} AS chunk_hash
  FROM lineitem JOIN files ON l_orderkey = file_id WHERE l_tax > 0.06),
tel0 AS (SELECT o_orderkey AS k, 'op' || (o_custkey % 50) AS operation, CAST(round(o_totalprice) AS BIGINT) AS bytes FROM orders),
telemetry AS (
  SELECT 'file' AS type, operation, 'f' || k AS path, bytes * (1 + k % 9) AS bytes, CAST(1 + k % 10 AS DOUBLE) AS elapsed_seconds, bytes * (1 + k % 9) / (1 + k % 10) / 1048576 AS throughput_mbytes_per_sec,
         (k % 40) * 1048576 AS chunk_max, 4 + k % 20 AS effective_concurrency, k % 3 AS budget_stalls, 0 AS succeeded, 0 AS memory_budget_mb FROM tel0
  UNION ALL SELECT 'op', operation, NULL, b, 10.0, b / 10 / 1048576, 0, 0, CASE WHEN k % 2 = 0 THEN stalls ELSE 0 END, n + k % 4, 256 * (1 + k % 5)
  FROM (SELECT operation, count(*) AS n, CAST(sum(k % 3) AS BIGINT) AS stalls, min(k) AS k, CAST(sum(bytes) AS BIGINT) AS b FROM tel0 GROUP BY operation)),
folders AS (SELECT * FROM (VALUES {", ".join(f"({o}, '{p}', {t}, {str(e).lower()})" for o, p, t, e in FOLDERS)}) v("ordinal", path, tier, enabled))
"""

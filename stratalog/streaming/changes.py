"""The change stream: renames, debouncing, last-write-wins queueing, draining in small batches.

A gap of more than two seconds without a change of a path ends a burst. The stream needs a watermark to bound
its state; changes later than that are dropped, which a replay of the batch form would not do.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.paths import file_name, matches_any, path_key, under_prefix
from ..operators.mutations import last_of, queue_changes, upsert
from ..operators.reconcile import drain
from ..sources import versions

QUIET = "2 seconds"


def split_renames(events: DataFrame) -> DataFrame:
    """A rename (old_path, file_path) is a deletion and a creation."""
    two = F.array(F.struct(F.col("old_path").alias("file_path"), F.lit(2).alias("change_type")), F.struct(F.col("file_path").alias("file_path"), F.lit(0).alias("change_type")))
    one = F.array(F.struct("file_path", F.col("change_type").alias("change_type")))
    return events.select(F.explode(F.when(F.col("change_type") == 3, two).otherwise(one)).alias("e"), "detected_at").select("e.*", "detected_at")


def watched(events: DataFrame, folders: list[str], globs: list[str]) -> DataFrame:
    """Changes below one of the watched folders whose name no exclusion matches; row by row, so for streams too. Folders and globs are the configuration of one installation."""
    below = reduce(Column.__or__, [under_prefix(F.col("file_path"), F.lit(f), strict=True) for f in folders], F.lit(False))
    return events.where(below & ~matches_any(file_name(F.col("file_path")), globs))


def debounced(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Bursts of each path, for streams and tables: when the last change was, and how many there were."""
    s = events.withWatermark("detected_at", watermark).groupBy(F.session_window("detected_at", QUIET), path_key(F.col("file_path")).alias("path_key"))
    return s.agg(F.max("detected_at").alias("last_change"), F.count("*").alias("changes")).select("path_key", "last_change", "changes")


def bursts(events: DataFrame) -> DataFrame:
    """The same over a table, by the gaps between changes."""
    w = Window.partitionBy("path_key").orderBy("detected_at", "id")
    e = events.select("id", path_key(F.col("file_path")).alias("path_key"), F.col("detected_at"))
    gap = F.unix_micros(F.col("detected_at").cast("timestamp")) - F.unix_micros(F.lag("detected_at").over(w).cast("timestamp"))
    e = e.withColumn("burst", F.sum(F.when(gap > 2_000_000, 1).otherwise(0)).over(w))
    return e.groupBy("path_key", "burst").agg(F.max("detected_at").alias("last_change"), F.count("*").alias("changes"))


def settled_kind(bursts_of: DataFrame, local: DataFrame) -> DataFrame:
    """What a burst comes to: modified if the file is there when it ends, else deleted."""
    here = local.select(path_key(F.col("path")).alias("path_key")).distinct().withColumn("there", F.lit(True))
    return bursts_of.join(here, "path_key", "left").withColumn("change_type", F.when(F.col("there"), 1).otherwise(2)).drop("there")


def queue_stream(events: DataFrame, root: str, checkpoint: str):
    """Write a stream of changes (id, file_path, change_type, detected_at) into a queue of buckets; a batch rewrites the buckets of its paths, and one that is repeated after a failure changes nothing."""

    def batch(df: DataFrame, _epoch: int) -> None:
        change = lambda old, new: queue_changes(old, new.withColumn("ordinal", F.struct("detected_at", "id")), "ordinal")
        versions.change_buckets(df.persist(), path_key(F.col("file_path")), root, df.schema, change)
        df.unpersist()

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("append")


def stamp_stream(stamps: DataFrame, root: str, checkpoint: str, ordinal: str):
    """Keyed digests (chunk_hash, expected_md5) into a table of buckets; of a batch the row of greatest ``ordinal`` wins, and a later batch wins over an earlier one."""
    columns = [c for c in stamps.columns if c != ordinal]

    def batch(df: DataFrame, _epoch: int) -> None:
        last = last_of(df, [F.col("chunk_hash")], ordinal).select(*columns).persist()
        versions.change_buckets(last, F.col("chunk_hash"), root, last.schema, lambda old, new: upsert(old, new, ["chunk_hash"]))
        last.unpersist()

    return stamps.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def next_batch(pending: DataFrame, n: int = 50) -> DataFrame:
    """The oldest changes, deletions first."""
    return drain(pending.orderBy("detected_at", "id").limit(n))


def drain_stream(ticks: DataFrame, queue: str, schema: StructType, work: Callable[[DataFrame], None], checkpoint: str, n: int = 50, every: str = "1 second"):
    """The drain loop: at each tick the ``n`` oldest changes of a queue go to ``work``, and then leave the queue, unless they were queued anew meanwhile.

    ``ticks`` is any stream that goes on (a rate source); what it says doesn't matter. ``work`` may see a batch again
    when it failed, or the stream did before the queue was written; the checkpoint retries it."""

    def batch(df: DataFrame, _epoch: int) -> None:
        spark = df.sparkSession
        todo = next_batch(versions.read_buckets(spark, queue, schema), n).persist()
        if not todo.isEmpty():
            work(todo)
            done = todo.select(F.col("id").alias("_id"), path_key(F.col("file_path")).alias("_k"))
            gone = lambda old, _: old.join(done, (F.col("id") == F.col("_id")) & (path_key(F.col("file_path")) == F.col("_k")), "left_anti")
            versions.change_buckets(todo.select(*schema.names), path_key(F.col("file_path")), queue, schema, gone)
        todo.unpersist()

    return ticks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every)


def rescan(local: DataFrame, pending: DataFrame, detected_at: str) -> DataFrame:
    """After an overflow every file of the folder is queued again."""
    all_of = local.select(F.xxhash64("path").alias("id"), F.col("path").alias("file_path"), F.lit(1).alias("change_type"), F.lit(detected_at).cast("timestamp_ntz").alias("detected_at"))
    return queue_changes(pending, all_of.withColumn("ordinal", F.lit(0)), "ordinal")

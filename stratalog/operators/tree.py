"""Roll-ups over path trees, by the folders above each path; no recursion, one aggregation for all levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, file_name, path_key


def _with_folders(files: DataFrame, path: str) -> DataFrame:
    return files.select("*", F.posexplode(ancestors(F.col(path))).alias("depth", "folder")).withColumn("folder_key", path_key(F.col("folder")))


def tree_nodes(files: DataFrame, path: str = "local_path") -> DataFrame:
    """Folders and files with depth, name and parent; folders that differ in case are one."""
    f = _with_folders(files, path).groupBy("folder_key").agg(F.min("folder").alias("node"), F.min("depth").alias("depth"))
    folders = f.select("node", "depth", F.lit(True).alias("is_folder"))
    leaves = files.select(F.col(path).alias("node"), (F.size(F.split(path, r"[/\\]")) - 1).alias("depth"), F.lit(False).alias("is_folder"))
    return folders.unionByName(leaves).withColumn("name", file_name(F.col("node")))


def folder_rollup(files: DataFrame, path: str = "local_path", size: str = "file_size") -> DataFrame:
    """Of every folder: files and bytes below, and folders below."""
    f = _with_folders(files, path)
    own = f.groupBy("folder_key").agg(F.min("folder").alias("folder"), F.count("*").alias("files"), F.sum(size).cast("long").alias("bytes"))
    folders = f.select("folder_key").distinct()
    # a folder counts for every folder above it
    above = folders.select(F.explode(F.filter(ancestors(F.concat("folder_key", F.lit("/"))), lambda a: a != F.col("folder_key"))).alias("folder_key"))
    below = above.groupBy("folder_key").agg(F.count("*").alias("folders"))
    return own.join(below, "folder_key", "left").select("folder", "files", "bytes", F.coalesce("folders", F.lit(0)).alias("folders"))


def status_rollup(states: DataFrame, path: str = "path") -> DataFrame:
    """Of every folder: files in all, backed up, modified, new."""
    n = lambda s: F.count_if(F.col("state") == s)
    return _with_folders(states, path).groupBy("folder_key").agg(F.count("*").alias("total"), n("BackedUp").alias("backed_up"), n("Modified").alias("modified"), n("New").alias("new"))


def descendants(files: DataFrame, folder: str, path: str = "local_path") -> DataFrame:
    return files.where(path_key(F.replace(path, F.lit("\\"), F.lit("/"))).startswith(folder.rstrip("/\\").upper().replace("\\", "/") + "/"))


def pruned(files: DataFrame, matches: Column, path: str = "local_path") -> DataFrame:
    """Files none of whose path components a predicate excludes; ``matches`` is over the column `part`. Folders without survivors have no row left."""
    parts = files.select("*", F.explode(F.array_distinct(F.split(path, r"[/\\]"))).alias("part"))
    bad = parts.where(matches).select(path).distinct()
    return files.join(bad, path, "left_anti")


def effective_target(files: DataFrame, overrides: DataFrame, path: str = "local_path") -> DataFrame:
    """Restore folder of each file: the override of its nearest folder (folder, target), else null."""
    f = _with_folders(files.select(path), path)
    o = overrides.select(path_key(F.col("folder")).alias("folder_key"), "target")
    return f.join(o, "folder_key", "left").groupBy(path).agg(F.max_by("target", F.when(F.col("target").isNotNull(), F.col("depth"))).alias("target"))

"""Versioned Parquet tables: a new state goes to a new folder, then one small pointer file is renamed into place.

All file access goes through Hadoop's file systems, so a table may be in any store that Spark reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def current(spark: SparkSession, root: str) -> str | None:
    """Folder of the current version; None before the first."""
    rows = None
    p, fs, _ = _fs(spark, f"{root}/CURRENT")
    if fs.exists(p):
        rows = spark.read.text(f"{root}/CURRENT").take(1)
    return f"{root}/{rows[0][0]}" if rows else None


def _point(spark: SparkSession, root: str, text: str) -> None:
    """Make ``text`` the content of the pointer file, in one rename."""
    fresh, fs, jvm = _fs(spark, f"{root}/CURRENT-{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    final = jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark.sparkContext._jsc.hadoopConfiguration()) if "://" in root else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fresh, final, options)


def write(df: DataFrame, root: str) -> str:
    """Write a new version and make it the current one. The frame may read the old version."""
    name = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{name}")
    _point(df.sparkSession, root, name)
    return f"{root}/{name}"


# --- tables of buckets: a change rewrites the buckets that it touches ---------------------------------------------

BUCKETS = 64


def _manifest(spark: SparkSession, root: str) -> dict[int, str]:
    """Folder of each bucket that has rows; at most one line each."""
    p, fs, _ = _fs(spark, f"{root}/CURRENT")
    if not fs.exists(p):
        return {}
    return {int(k): f for k, f in (r[0].split(" ", 1) for r in spark.read.text(f"{root}/CURRENT").collect() if r[0])}


def _read_buckets(spark: SparkSession, root: str, folders: Iterable[str], schema: StructType) -> DataFrame:
    paths = [f"{root}/{f}" for f in folders]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_buckets(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    return _read_buckets(spark, root, _manifest(spark, root).values(), schema)


def change_buckets(delta: DataFrame, key: Column, root: str, schema: StructType, change: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS) -> None:
    """Replace the buckets that ``delta`` touches by ``change(old rows of these, delta)``; ``key`` is over the columns of both.

    Rows of one key are in one bucket, so what a change costs follows the buckets that it touches, ``buckets`` at most.
    Folders that two changes ago were replaced are deleted: a reader of the version before still finds its files."""
    spark = delta.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    was = _manifest(spark, root)
    touched = [r[0] for r in delta.select(bucket.alias("b")).distinct().collect()]
    if not touched:
        return
    new = change(_read_buckets(spark, root, [was[b] for b in touched if b in was], schema), delta).select(*schema.names)
    name = f"v-{uuid.uuid4().hex}"
    new.withColumn("_bucket", bucket).repartition(min(len(touched), buckets), "_bucket").write.partitionBy("_bucket").parquet(f"{root}/{name}")
    p, fs, jvm = _fs(spark, f"{root}/{name}")
    there = {int(s.getPath().getName().removeprefix("_bucket=")) for s in fs.listStatus(p) if s.getPath().getName().startswith("_bucket=")}
    now = {b: f for b, f in was.items() if b not in touched} | {b: f"{name}/_bucket={b}" for b in there}
    _point(spark, root, "\n".join(f"{b} {f}" for b, f in sorted(now.items())) + "\n")
    _forget(spark, root, set(now.values()) | set(was.values()))


def _forget(spark: SparkSession, root: str, live: set[str]) -> None:
    """Delete bucket folders that neither the current version nor the one before has."""
    p, fs, _ = _fs(spark, root)
    for version in fs.listStatus(p):
        name = version.getPath().getName()
        if name.startswith("v-"):
            own = list(fs.listStatus(version.getPath()))
            parts = [s for s in own if s.getPath().getName().startswith("_bucket=")]
            dead = [s for s in parts if f"{name}/{s.getPath().getName()}" not in live]
            for s in dead:
                fs.delete(s.getPath(), True)
            if len(dead) == len(parts):
                fs.delete(version.getPath(), True)


def read(spark: SparkSession, root: str) -> DataFrame:
    path = current(spark, root)
    if path is None:
        raise FileNotFoundError(root)
    return spark.read.parquet(path)

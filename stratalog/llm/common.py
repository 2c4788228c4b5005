"""Shared pieces of the training-data operators: input tables, scratch tables, byte tables.

Scratch tables live in the folder that ``spark.checkpoint.dir`` names, which all executors share.
They are plain Parquet, so a lost executor costs a re-read and never a recomputation.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z, all other bytes as they are.
LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The white space of the contracts: 0x20 and 0x09 to 0x0D.
SPACES = bytes([0x20, *range(0x09, 0x0E)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; only where that is unset and driver and executors are one process, one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='stratalog-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_written: list[str] = []  # scratch tables; those that an operator doesn't release, since its result is read from them, go with the process


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a scratch table and read it back."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/stratalog-{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_at_exit, spark)
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    # the schema is known: no job to infer it, and an empty table stays readable
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(*frames: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "scratch_path", None):
            _delete(df.sparkSession, path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables that this process wrote: for the end of a job, when its results are stored."""
    while _written:
        _delete(spark, _written.pop())


def _at_exit(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None and _written:
        clear_scratch(spark)


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files go when the driver's objects for them do; a collection lets that happen now."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, whatever else the caller's table has."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def free_name(taken: list[str], name: str) -> str:
    """A column name of our own that the table doesn't have."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that tells its rows apart, and that column's name. The ids serve where none is null or
    repeated; else the rows are written once with numbers of their own, so that reading them again gives the same."""
    row = free_name(docs.columns, "_row")
    ids = docs.select(F.col("`doc_id`").alias("i"))
    if docs.schema["doc_id"].dataType.simpleString() in ("bigint", "int") and ids.groupBy("i").count().where("count > 1 or i is null").isEmpty():
        return docs.withColumn(row, F.col("`doc_id`").cast("long")), row
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def without(docs: DataFrame, row: str, dropped: DataFrame, label: str) -> DataFrame:
    """The rows of ``docs`` whose number is not in ``dropped`` (one column). The numbers are written first, so that Spark
    knows how many bytes they are and sends them to the texts while they are few, not the texts to them."""
    dropped = materialize(dropped.select(F.col(dropped.columns[0]).alias(row)), label)
    return docs.join(dropped, row, "left_anti").drop(row)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


_resident: list = []


def resident(key, build: Callable[[], object]):
    """What a Python worker holds on to from one task to the next: one thing at a time, so that what the operators of a pipeline
    need in turn doesn't add up. ``key`` tells it from others; what ``build`` gives keeps alive what the key names."""
    if not _resident or _resident[0] != key:
        _resident.clear()
        _resident.extend((key, build()))
    return _resident[1]


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` uses it."""
    return F.transform(F.array(value), then)[0]


def batches(fn: Callable[[dict[str, list]], dict[str, list]], schema: pa.Schema, *columns: str):
    """A mapInArrow function from lists of ``columns`` to lists of ``schema``; strings come as UTF-8 bytes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, max(batch.num_rows, 0), 2000):  # long texts: a few MB of Python objects at a time
                part = batch.slice(at, 2000)
                cols = {}
                for c in columns:
                    v = part.column(c)
                    cols[c] = (v.cast(pa.binary()) if pa.types.is_string(v.type) else v.cast(pa.large_binary()) if pa.types.is_large_string(v.type) else v).to_pylist()
                yield pa.RecordBatch.from_pydict(fn(cols), schema=schema)

    return run

import datetime as dt
import time
from datetime import timedelta

from pyspark.sql import functions as F

from stratalog.sources import versions
from stratalog.streaming import changes

T0 = dt.datetime(2026, 1, 1)
SCHEMA = "id long, file_path string, change_type int, detected_at timestamp"


def rows(*seconds, path="/a", first=0):
    return [(first + k, path if k % 2 else path.upper(), k % 3, T0 + dt.timedelta(seconds=s)) for k, s in enumerate(seconds)]


EVENTS = rows(0, 1.5, 3.4, 5.5, 9, 9.1) + rows(0, 2, 4.1, path="/b", first=100)


def test_bursts_by_gap(spark):
    got = sorted((r.path_key, (r.last_change - T0).total_seconds(), r.changes) for r in changes.bursts(spark.createDataFrame(EVENTS, SCHEMA)).collect())
    assert got == [("/A", 3.4, 3), ("/A", 5.5, 1), ("/A", 9.1, 2), ("/B", 2.0, 2), ("/B", 4.1, 1)]


def test_stream_debounce_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    df = spark.createDataFrame(EVENTS, SCHEMA)
    df.coalesce(1).write.json(str(src))
    # a late event of another path moves the watermark past all bursts
    spark.createDataFrame([(999, "/end", 0, T0 + dt.timedelta(hours=1)), (1000, "/end", 0, T0 + dt.timedelta(hours=2))], SCHEMA).coalesce(1).write.mode("append").json(str(src))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(src))
    q = changes.debounced(stream, "1 minute").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.path_key, r.last_change, r.changes) for r in spark.table("bursts").where("path_key <> '/END'").collect())
    want = sorted((r.path_key, r.last_change, r.changes) for r in changes.bursts(df).collect())
    assert got == want


def test_queue_stream_is_idempotent(spark, tmp_path):
    src, root = tmp_path / "in", f"file://{tmp_path}/queue"
    events = spark.createDataFrame(EVENTS, SCHEMA)
    events.repartition(3).write.json(str(src))
    for cp in ("cp1", "cp2"):  # the second run replays everything
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(src))
        q = changes.queue_stream(stream, root, str(tmp_path / cp)).start()
        q.processAllAvailable()
        q.stop()
        assert sorted(r.file_path.upper() for r in versions.read_buckets(spark, root, events.schema).collect()) == ["/A", "/B"]


def test_stamp_stream_keeps_the_last(spark, tmp_path):
    src, root, schema = tmp_path / "in", f"file://{tmp_path}/stamps", "chunk_hash string, expected_md5 string, at long"
    spark.createDataFrame([("h1", "a", 1), ("h2", "b", 2), ("h1", "c", 4), ("h1", "d", 3)], schema).repartition(4).write.json(str(src))
    stream = lambda: changes.stamp_stream(spark.readStream.schema(schema).json(str(src)), root, str(tmp_path / "cp"), "at")
    own = spark.createDataFrame([], "chunk_hash string, expected_md5 string").schema
    for more, want in (([], [("h1", "c"), ("h2", "b")]), ([("h2", "e", 5), ("h3", "f", 5)], [("h1", "c"), ("h2", "e"), ("h3", "f")])):
        if more:
            spark.createDataFrame(more, schema).write.mode("append").json(str(src))
        q = stream().start()
        q.processAllAvailable()
        q.stop()
        assert sorted(tuple(r) for r in versions.read_buckets(spark, root, own).collect()) == want


def test_drain_stream_empties_the_queue(spark, tmp_path):
    """Oldest first, a few at a time, deletions first within a batch; what fails is tried again and nothing is lost."""
    queue = f"file://{tmp_path}/queue"
    rows = [(i, f"/F{i}", 2 if i % 3 == 0 else 1, T0 + timedelta(seconds=100 - i)) for i in range(17)]
    pending = spark.createDataFrame(rows, SCHEMA)
    versions.change_buckets(pending, changes.path_key(F.col("file_path")), queue, pending.schema, lambda old, new: old.unionByName(new))
    seen = []
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 5).load()
    q = changes.drain_stream(ticks, queue, pending.schema, lambda df: seen.append([(r.id, r.step) for r in df.collect()]), str(tmp_path / "cp"), n=5, every="100 milliseconds").start()
    until = time.time() + 90
    while time.time() < until and sum(map(len, seen)) < 17:
        time.sleep(0.3)
    q.stop()
    assert [sorted(i for i, _ in b) for b in seen] == [[12, 13, 14, 15, 16], [7, 8, 9, 10, 11], [2, 3, 4, 5, 6], [0, 1]]
    assert all([s for _, s in b] == sorted((s for _, s in b), key=lambda s: s != "exclude") for b in seen)


def test_a_change_rewrites_only_its_buckets(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    rows = spark.range(200).withColumn("v", F.lit(0))
    change = lambda old, new: old.join(new.select("id"), "id", "left_anti").unionByName(new)
    versions.change_buckets(rows, F.col("id"), root, rows.schema, change)
    before = versions._manifest(spark, root)
    for v in (1, 2, 3):
        versions.change_buckets(spark.createDataFrame([(7, v)], rows.schema), F.col("id"), root, rows.schema, change)
    after = versions._manifest(spark, root)
    assert len(before) > 50 and sum(before[b] != after[b] for b in before) == 1
    got = {r.id: r.v for r in versions.read_buckets(spark, root, rows.schema).collect()}
    assert len(got) == 200 and got.pop(7) == 3 and set(got.values()) == {0}
    folders = [f for f in (tmp_path / "t").iterdir() if f.name.startswith("v-")]
    assert len(folders) == 3  # the first one with the other buckets, the current one, the one before


def test_versions_swap(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    assert versions.current(spark, root) is None
    versions.write(spark.range(3), root)
    old = versions.read(spark, root)
    versions.write(old.union(spark.range(2)), root)  # a new state may read the old one
    assert versions.read(spark, root).count() == 5 and old.count() == 3


def test_renames_rescan_and_kinds(spark):
    e = spark.createDataFrame([("/new", "/old", 3, T0), ("/x", None, 1, T0)], "file_path string, old_path string, change_type int, detected_at timestamp")
    assert sorted((r.file_path, r.change_type) for r in changes.split_renames(e).collect()) == [("/new", 0), ("/old", 2), ("/x", 1)]
    b = changes.bursts(spark.createDataFrame(EVENTS, SCHEMA))
    kinds = changes.settled_kind(b, spark.createDataFrame([("/A",)], "path string"))
    assert {(r.path_key, r.change_type) for r in kinds.collect()} == {("/A", 1), ("/B", 2)}
    pending = spark.createDataFrame(EVENTS, SCHEMA.replace("timestamp", "timestamp_ntz"))
    queued = changes.rescan(spark.createDataFrame([("/a",), ("/c",)], "path string"), pending.where("id < 2 OR id > 101"), "2026-02-01")
    assert sorted(r.file_path.upper() for r in queued.collect()) == ["/A", "/B", "/C"]
    steps = [(r.id, r.step) for r in changes.next_batch(pending, 4).collect()]
    assert len(steps) == 4 and [s for _, s in steps] == sorted((s for _, s in steps), key=lambda s: s != "exclude")


def test_watched_changes_of_a_stream(spark, tmp_path):
    rows_ = [(1, "/a/x.txt", 0, T0), (2, "/A/b/~x", 0, T0), (3, "/ab/x", 0, T0), (4, "/c/x.TMP", 2, T0), (5, "/c/y", 1, T0), (6, None, 1, T0)]
    spark.createDataFrame(rows_, SCHEMA).write.json(str(tmp_path / "in"))
    stream = changes.watched(spark.readStream.schema(SCHEMA).json(str(tmp_path / "in")), ["/a", "/C/"], ["*.tmp", "~*", " "])
    q = stream.writeStream.format("memory").queryName("watched").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.id for r in spark.table("watched").collect()) == [1, 5]
    assert changes.watched(spark.createDataFrame(rows_, SCHEMA), [], []).count() == 0

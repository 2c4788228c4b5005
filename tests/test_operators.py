import datetime as dt

import pytest
from pyspark.sql import functions as F

from stratalog.functions import hashing
from stratalog.operators import aggregates as ag
from stratalog.operators import integrity as it
from stratalog.operators import joins as jo
from stratalog.operators import lookups as lo
from stratalog.operators import maintenance as mx
from stratalog.operators import mutations as mu
from stratalog.operators import reconcile as rc
from stratalog.operators import telemetry as tm
from stratalog.operators import tree

T0 = dt.datetime(2026, 4, 17, 21, 30, 45)
INDEX = "chunk_hash string, original_uploader_path string, size_bytes long, reference_count int, current_tier int, expected_md5 string"
REFS = "file_path string, chunk_hash string, chunk_index int, referenced_at timestamp_ntz"
FILES = "file_id long, local_path string, file_size long, last_modified timestamp_ntz, status int, file_hash string, blob_name string, backed_up_at timestamp_ntz"
CHUNKS = "file_id long, chunk_order int, chunk_index int, offset long, length int, hash string"
BLOBS = "blob_name string, size_bytes long, tier int, content_md5 string"


@pytest.fixture(scope="module")
def make(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def file(i, path, size=1, status=2, when=T0, h=None):
    return (i, path, size, when, status, h or f"H{i}", f"metadata/{i}", when)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def ids(df, column):
    return sorted(r[column] for r in df.select(column).collect())


# --- aggregates ---


def test_status_rollup(make):
    files = make([file(i, f"p{i}", s, st) for i, (s, st) in enumerate([(1000, 2), (2000, 2), (3000, 0), (4000, 3), (5000, 4)])], FILES)
    assert one(ag.status_rollup(files)) == {"total_files": 5, "total_size": 15000, "completed": 2, "pending": 1, "failed": 1}
    assert one(ag.status_rollup(files.limit(0))) == {"total_files": 0, "total_size": 0, "completed": 0, "pending": 0, "failed": 0}
    big = make([file(1, "a", 2**40), file(2, "b", 2**40)], FILES)
    assert one(ag.status_rollup(big))["total_size"] == 2**41


def test_index_summary_and_tiers(make):
    index = make([("h1", "u", 1000, 2, 0, None), ("h2", "u", 2000, 1, 1, None), ("h3", "u", 500, 0, 2, None)], INDEX)
    assert one(ag.index_summary(index)) == {"total_chunks": 3, "total_bytes": 3500, "orphan_chunks": 1, "orphan_bytes": 500, "shared_chunks": 1, "saved_bytes": 1000}
    assert {r.tier: (r.chunks, r.bytes) for r in ag.tier_breakdown(index).collect()} == {"Hot": (1, 1000), "Cool": (1, 2000), "Cold": (1, 500), "Archive": (0, 0)}
    assert one(ag.index_summary(index.limit(0)))["total_bytes"] == 0


# --- joins ---


def test_repeated_chunk_is_one_entry(make):
    index = make([("h1", "u", 1, 2, 0, None), ("h2", "u", 1, 1, 0, None)], INDEX)
    refs = make([("f", "h1", 0, T0), ("f", "h1", 1, T0), ("g", "h2", 0, T0)], REFS)
    assert ids(jo.chunk_entries_of_file(index, refs, "f"), "chunk_hash") == ["h1"]


def test_missing_refs_are_added_once(make):
    files = make([file(1, "a"), file(2, "b")], FILES)
    chunks = make([(1, 0, 0, 0, 5, "x"), (1, 1, 1, 5, 5, "y"), (2, 0, 0, 0, 5, "x")], CHUNKS)
    refs = make([("b", "x", 0, T0)], REFS)
    new = jo.files_missing_refs(files, chunks, refs)
    assert sorted((r.file_path, r.chunk_hash, r.chunk_index) for r in new.collect()) == [("a", "x", 0), ("a", "y", 1)]
    assert jo.files_missing_refs(files, chunks, refs.unionByName(new)).count() == 0


def test_remote_orphans_and_versions(make):
    index = make([("h1", "u", 1, 1, 0, None), ("h2", "u", 1, 0, 0, None)], INDEX)
    blobs = make([(n, 1, 0, "m") for n in ("chunks/h1", "chunks/h1_v2", "chunks/h2", "chunks/h3", "metadata/x")], BLOBS)
    assert ids(jo.remote_orphans(blobs, index), "blob_name") == ["chunks/h2", "chunks/h3"]
    assert ids(jo.remote_orphans(blobs, index, strip_versions=False), "blob_name") == ["chunks/h1_v2", "chunks/h2", "chunks/h3"]


def test_first_folder_wins(make):
    files = make([file(1, "C:/a/b/x"), file(2, "c:/ab/x"), file(3, "D:/x")], FILES)
    folders = make([(1, "C:/A/B", 3, False), (2, "C:/a", 1, True), (3, "C:/a/b", 2, True)], "ordinal int, path string, tier int, enabled boolean")
    got = {r.file_id: (r.folder, r.tier) for r in jo.folder_of_file(files, folders).select("local_path", "folder", "tier").join(files, "local_path").collect()}
    assert got == {1: ("C:/a", 1), 2: ("C:/a", 1), 3: (None, 0)}


def test_stale_pending(make):
    files = make([file(1, "a", 5, 2), file(2, "b", 5, 2), file(3, "c", 5, 4), file(4, "d", 5, 3)], FILES)
    local = make([("A", 5), ("b", 6)], "path string, length long")
    pending = make([(i, p, t, T0) for i, (p, t) in enumerate([("a", 1), ("b", 1), ("c", 2), ("d", 2), ("e", 1)])], "id long, file_path string, change_type int, detected_at timestamp_ntz")
    assert ids(jo.stale_pending(pending, files, local), "file_path") == ["a", "c"]


def test_newest_pair(make):
    a = make([("s1", "d1"), ("s2", "d2"), ("s3", "d3")], "stamp string, db string")
    b = make([("s1", "k1"), ("s2", "k2")], "stamp string, salt string")
    assert one(jo.newest_pair(a, b)) == {"stamp": "s2", "db": "d2", "salt": "k2"}


# --- mutations ---


def test_queue_last_wins_ignoring_case(make):
    schema = "id long, file_path string, change_type int, detected_at timestamp_ntz"
    old = make([(1, "/A", 0, T0), (2, "/keep", 1, T0)], schema)
    batch = make([(3, "/a", 1, T0, 0), (4, "/B", 0, T0, 1), (5, "/b", 2, T0, 2)], schema + ", o int")
    assert ids(mu.queue_changes(old, batch, "o"), "id") == [2, 3, 5]


def test_oldest_first_and_default_limit(make):
    rows = [(i, f"p{i}", 0, T0 + dt.timedelta(seconds=-i)) for i in range(120)]
    p = make(rows, "id long, file_path string, change_type int, detected_at timestamp_ntz")
    assert [r.id for r in lo.oldest_pending(p, 3).collect()] == [119, 118, 117]
    assert lo.oldest_pending(p, 0).count() == lo.oldest_pending(p, -1).count() == 100


def test_prune_keeps_thirty(make):
    runs = make([(i, T0 + dt.timedelta(minutes=i % 31)) for i in range(35)], "id int, started_at timestamp_ntz")
    assert mu.prune_runs(runs).count() == 30
    assert ids(mu.prune_runs(runs, 1), "id") == [30]


def test_upsert_files_replaces_children(make):
    files, chunks = make([file(1, "a"), file(2, "b")], FILES), make([(1, 0, 0, 0, 5, "x"), (2, 0, 0, 0, 5, "y")], CHUNKS)
    refs = make([("a", "x", 0, T0), ("b", "y", 0, T0)], REFS)
    f, c, r = mu.upsert_files(files, chunks, refs, make([file(3, "a", 9)], FILES), make([(3, 0, 0, 0, 9, "z")], CHUNKS))
    assert ids(f, "file_id") == [2, 3] and ids(c, "hash") == ["y", "z"] and sorted((x.file_path, x.chunk_hash) for x in r.collect()) == [("a", "z"), ("b", "y")]


def test_insert_unique(make):
    a = make([("x", 1)], "k string, v int")
    assert mu.insert_unique(a, make([("y", 2)], "k string, v int"), "k").count() == 2
    with pytest.raises(Exception, match="duplicate key"):
        mu.insert_unique(a, make([("x", 2)], "k string, v int"), "k").collect()


def test_index_upsert_keeps_digest_and_stamp_makes_placeholder(make):
    index = make([("h1", "u", 1, 1, 0, "m1")], INDEX)
    delta = make([("h1", "v", 2, 3, 1, None, 0), ("h1", "w", 7, 3, 1, None, 1), ("h2", "v", 5, 1, 0, None, 0)], INDEX + ", o int")
    got = {r.chunk_hash: (r.original_uploader_path, r.size_bytes, r.expected_md5) for r in mu.upsert_index(index, delta, "o").collect()}
    assert got == {"h1": ("w", 7, "m1"), "h2": ("v", 5, None)}
    got = {r.chunk_hash: (r.size_bytes, r.reference_count, r.expected_md5) for r in mu.stamp_md5(index, make([("h1", "n"), ("h9", "q")], "chunk_hash string, expected_md5 string")).collect()}
    assert got == {"h1": (1, 1, "n"), "h9": (0, 0, "q")}


def test_upload_names(make):
    stored = make([("chunks/a", b"1"), ("chunks/a_v3", b"3"), ("chunks/b", b"1")], "blob_name string, content binary")
    up = make([("a", b"1"), ("a", b"2"), ("a", b"3"), ("c", b"9")], "hash string, content binary")
    got = {(r.hash, bytes(r.content)): (r.blob_name, r.reused) for r in mu.upload_names(up, stored).collect()}
    assert got == {("a", b"1"): ("chunks/a", True), ("a", b"2"): ("chunks/a_v2", False), ("a", b"3"): ("chunks/a_v3", True), ("c", b"9"): ("chunks/c", False)}


def test_import_prefers_the_list(make):
    entries = make([("h", [("f", 0), ("g", 1)])], "chunk_hash string, referencing_files array<struct<file_path:string,chunk_index:int>>")
    refs = make([("z", "h", 5)], "file_path string, chunk_hash string, chunk_index int")
    assert ids(mu.imported_refs(entries, refs), "file_path") == ["z"]
    assert ids(mu.imported_refs(entries, refs.limit(0)), "file_path") == ["f", "g"]


def test_bundle_and_retention(make):
    f = make([("x/logs/a.txt", 1), ("x/diagnostics/secret.json", 1), ("x/metrics/big.jsonl", 2**40), ("x/catalog.db", 1), ("m.jsonl", 5)], "path string, length long")
    assert ids(mu.bundle_members(f).where("included"), "path") == ["m.jsonl", "x/logs/a.txt"]
    r = make([(dt.datetime(2026, 4, d),) for d in (1, 15)], "timestamp timestamp")
    assert mu.retain_days(r, "2026-05-05").count() == 1


# --- maintenance ---


def test_add_and_remove_references(make):
    index = make([("h1", "old", 10, 1, 2, "m")], INDEX)
    refs = make([("a", "h1", 0, T0)], REFS)
    up = make([("b", "h1", 0, T0, 99, 0, False), ("b", "h2", 1, T0, 7, 1, True), ("b", "h2", 2, T0, 7, 1, True)], REFS + ", size_bytes long, tier int, is_new boolean")
    i, r = mx.add_references(index, refs, up)
    assert {x.chunk_hash: (x.original_uploader_path, x.size_bytes, x.reference_count, x.current_tier) for x in i.collect()} == {"h1": ("old", 10, 2, 2), "h2": ("b", 7, 2, 1)}
    kept, left, dead = mx.remove_file_references(i, r, make([("b",)], "file_path string"))
    assert {x.chunk_hash: x.reference_count for x in kept.collect()} == {"h1": 1} and ids(dead, "chunk_hash") == ["h2"] and left.count() == 1


def test_cleanup_skips_what_is_used_again(make):
    orphans = make([("h1", 5), ("h2", 7)], "chunk_hash string, size_bytes long")
    refs = make([("f", "h2", 0, T0)], REFS)
    assert one(mx.cleanup_tally(mx.cleanup_orphans(orphans, refs))) == {"deleted": 1, "bytes": 5, "skipped": 1}


def test_rebuild_leaves_out_incomplete_files(make):
    files = make([file(1, "b"), file(2, "a"), file(3, "c")], FILES)
    chunks = make([(1, 0, 0, 0, 5, "x"), (2, 0, 0, 0, 5, "x"), (2, 1, 1, 5, 6, "y"), (3, 0, 0, 0, 5, "gone"), (3, 1, 1, 5, 5, "only")], CHUNKS)
    blobs = make([("chunks/x", 42, 1, "m"), ("chunks/y", 43, 2, "m"), ("chunks/only", 44, 0, "m")], BLOBS)
    got = {r.chunk_hash: (r.original_uploader_path, r.size_bytes, r.reference_count, r.current_tier) for r in mx.rebuilt_index(files, chunks, blobs).collect()}
    assert got == {"x": ("a", 42, 2, 1), "y": ("a", 43, 1, 2)}
    assert sorted((r.blob_name, r.label) for r in mx.rebuild_deletions(files, chunks, blobs).collect()) == [("chunks/only", "only..."), ("metadata/3", "c")]


def test_classified_findings(make):
    lines = ["ok", " ", "wrong # of entries in index ix_a", "row 7 missing from index ix_b", "Row 9 Missing From Index ix_a", "non-unique entry in index ix_c ", "page 3 is corrupt", "row x missing from index ix_d"]
    got = [(r.kind, r.name) for r in mx.classified_findings(make(list(enumerate(lines)), "ordinal int, message string")).collect()]
    assert got == [("repairable", "ix_a"), ("repairable", "ix_b"), ("repairable", "ix_c"), ("unrepairable", "page 3 is corrupt"), ("unrepairable", "row x missing from index ix_d")]


# --- reconciliation: every notion of unchanged over one matrix ---


def matrix(make):
    shift = {"same": (0, 0), "size": (0, 1), "newer": (10, 0), "older": (-10, 0), "near": (1.9, 0), "over": (2.1, 0)}
    files, local = [], []
    i = 0
    for status in range(5):
        for name, (sec, size) in shift.items():
            i += 1
            files.append(file(i, f"C:/m/{status}/{name}", 100, status))
            local.append((f"c:/M/{status}/{name}", 100 + size, T0 + dt.timedelta(seconds=sec), f"H{i}" if name != "near" else "other"))
    local.append(("C:/m/new", 1, T0, "N"))
    return make(files, FILES), make(local, "path string, length long, modified timestamp_ntz, sha256 string")


def test_unchanged_in_five_ways(make):
    files, local = matrix(make)
    key = lambda p: tuple(p.lower().split("/")[2:])
    preview = {key(r.path): r.action for r in rc.backup_preview(local, files).collect()}
    assert [preview["2", n] for n in ("same", "size", "newer", "older", "near", "over")] == ["Skip", "Update", "Update", "Skip", "Update", "Update"]
    assert {preview["3", "same"], preview[("new",)]} == {"Create"} and {preview[s, "size"] for s in "014"} == {"Skip"}
    fast = {key(r.path): r.unchanged for r in rc.unchanged_fast(local, files).collect()}
    assert [fast["2", n] for n in ("same", "size", "newer", "older", "near", "over")] == [True, False, False, False, True, False] and not fast["0", "same"]
    assert not any(r.unchanged for r in rc.unchanged_fast(local, files, force=True).collect())
    mirror = {key(r.path): r.action for r in rc.mirror_to_remote(local, files, "c:/m").collect()}
    assert mirror["0", "near"] == "Unchanged" and mirror["4", "over"] == "Transfer" and mirror[("new",)] == "Transfer"
    back = {key(r.path): r.action for r in rc.mirror_to_local(files, local, "C:/m", "C:/m").collect()}
    assert back["1", "same"] == "Skip" and back["2", "near"] == "Overwrite" and back[("new",)] == "Delete"
    tree_state = {key(r.path): r.state for r in rc.local_status(local, files).collect()}
    assert [tree_state["2", n] for n in ("same", "size", "newer")] == ["BackedUp", "Modified", "BackedUp"]
    assert (tree_state["4", "same"], tree_state["3", "same"], tree_state["0", "same"], tree_state[("new",)]) == ("Excluded", "Failed", "New", "New")
    sync = {key(r.path): (r["class"], r.change_type) for r in rc.initial_sync(local, files, make([("C:/M/2/NEWER",)], "file_path string")).collect()}
    assert sync["2", "newer"] == ("pending", None) and sync["3", "same"] == ("retried", 1) and sync[("new",)] == ("new", 0) and sync["2", "older"] == ("unchanged", None)


def test_gone_remotely_is_new(make):
    files, local = matrix(make)
    got = {r.reason for r in rc.backup_preview(local, files, files.limit(0).select("local_path")).collect()}
    assert got == {"New file - never backed up"}


def test_zero_byte_file_is_new_forever(make):
    files = make([file(1, "z", 0)], FILES)
    assert one(rc.local_status(make([("z", 0, T0)], "path string, length long, modified timestamp_ntz"), files))["state"] == "New"


def test_mirror_deletes_in_prefix_only(make):
    files = make([file(1, "C:/foo/a"), file(2, "C:/foobar/b"), file(3, "D:/c")], FILES)
    none = make([], "path string, length long, modified timestamp_ntz")
    assert ids(rc.mirror_to_remote(none, files, "C:/foo"), "path") == ["C:/foo/a", "C:/foobar/b"]


def test_delete_worklist_and_outcome(make):
    files, chunks = make([file(1, "a"), file(2, "b")], FILES), make([(1, 0, 0, 0, 5, "x"), (2, 0, 0, 0, 5, "y")], CHUNKS)
    work = rc.delete_worklist(files, chunks, files.select("file_id"))
    assert work.count() == 4
    assert ids(rc.deleted_files(work, make([("chunks/y",)], "blob_name string")), "file_id") == [1]


def test_warnings(make):
    df = make([("delete_remote", 0, 0, 3), ("mirror_local", 1, 1, 2), ("backup", 1, 2, 0), ("backup", 4, 0, 0), ("backup", 0, 0, 0)], "o string, c int, u int, d int")
    got = [r[0] for r in df.select(rc.warning(*map(F.col, "ocud"))).collect()]
    assert [bool(g) for g in got] == [True] * 4 + [False] and "3 file(s) will be PERMANENTLY" in got[0] and "2 local" in got[1] and "2 existing" in got[2] and "4 file(s) will be uploaded" in got[3]


# --- integrity ---


def test_listing_tier(make):
    files = make([file(1, "f")], FILES)
    chunks = make([(1, k, k, 0, n, h) for k, (n, h) in enumerate([(5, "ok"), (0, "ok"), (5, "gone"), (6, "ok"), (5, "bad"), (6, "bad"), (5, "fresh")])], CHUNKS)
    blobs = make([("chunks/ok", 42, 0, "m"), ("chunks/bad", 42, 0, "other"), ("chunks/fresh", 42, 0, "q")], BLOBS)
    index = make([(h, "u", 5, 1, 0, m) for h, m in (("ok", "m"), ("bad", "m"), ("fresh", None))], INDEX)
    got = sorted((r.chunk_index, r.failure_reason) for r in it.listing_failures(files, chunks, blobs, index).collect())
    assert got == [(1, "invalid-chunk-length"), (2, "missing-blob"), (3, "wrong-size"), (4, "md5-mismatch"), (5, "md5-mismatch"), (5, "wrong-size")]
    assert one(it.baseline(chunks, blobs, index, deep=True)) == {"chunk_hash": "fresh", "expected_md5": "q", "deferred": True}


def test_body_and_local_tiers(make, spark):
    key = b"k" * 32
    k = F.lit(bytearray(key))
    plain = make([("good", b"hello"), ("differ", b"hello"), ("short", b"hello"), ("nolocal", b"hello")], "chunk_hash string, plain binary")
    bodies = plain.select("chunk_hash", hashing.seal(F.col("plain"), k).alias("sealed"))
    bad = [("crc", bodies.where("chunk_hash = 'good'").select(F.concat(F.expr("substring(sealed, 1, octet_length(sealed) - 1)"), F.lit(b"?")).alias("sealed")))]
    wrong = bodies.where("chunk_hash = 'good'").select(F.lit("key").alias("chunk_hash"), hashing.seal(F.lit(bytearray(b"hello")), F.lit(bytearray(b"x" * 32))).alias("sealed"))
    bodies = bodies.unionByName(bad[0][1].select(F.lit("crc").alias("chunk_hash"), "sealed")).unionByName(wrong)
    names = ["good", "differ", "short", "nolocal", "crc", "key", "absent"]
    suspects = make([(i, f"p-{n}", 0, 2, 5, n, True) for i, n in enumerate(names)], "file_id long, local_path string, chunk_index int, offset long, length int, chunk_hash string, t1_failed boolean")
    local = make([(f"p-{n}", c) for n, c in (("good", b"..hello.."), ("differ", b"..hellO.."), ("short", b"..he"), ("crc", b"x"), ("key", b"x"), ("absent", b"x"))], "local_path string, content binary")
    got = {r.chunk_hash: (r.failure_tier, r.failure_reason) for r in it.body_failures(suspects, bodies, key, local).collect()}
    assert got == {"differ": (3, "byte-differ"), "short": (3, "local-short-read"), "nolocal": (3, "local-file-missing"), "crc": (2, "crc-mismatch"), "key": (2, "decrypt-failed"), "absent": (2, "download-error")}
    intact = suspects.withColumn("t1_failed", F.lit(False))
    assert ids(it.body_failures(intact, bodies, key, local), "failure_tier") == [2, 2, 2]


def test_verdicts_and_repair(make):
    files = make([file(i, f"p{i}") for i in range(5)], FILES)
    fails = make([(0, 1, "wrong-size"), (0, 3, "byte-differ"), (1, 2, "crc-mismatch"), (2, 0, "size-disagreement"), (3, 1, "invalid-chunk-length")], "file_id long, failure_tier int, failure_reason string")
    v = it.file_verdicts(files, fails)
    assert {r.file_id: r.verdict for r in v.collect()} == {0: "FailedT3", 1: "FailedT2", 2: "Warning", 3: "FailedT1", 4: "Passed"}
    assert one(it.run_rollup(v)) == {"checked": 5, "passed": 1, "warnings": 1, "t1": 1, "t2": 1, "t3": 1}
    assert {r.file_id: r.repairable for r in it.repairable(fails).collect()} == {0: True, 1: True, 2: False, 3: False}
    after = it.after_repair(fails, fails.where("file_id = 1"), make([(0,), (1,)], "file_id long"))
    assert ids(after, "file_id") == [1, 2, 3]


def test_sequences_and_best_effort(make):
    files = make([file(1, "a", 10), file(2, "b", 11), file(3, "c", 0)], FILES)
    chunks = make([(1, 0, 0, 0, 4, "x"), (1, 1, 1, 4, 6, "y"), (2, 0, 0, 0, 4, "x"), (2, 1, 2, 5, 6, "y")], CHUNKS)
    got = {r.file_id: (r.bad_index, r.bad_offset, r.bad_size) for r in it.sequence_errors(files, chunks).collect()}
    assert got == {1: (0, 0, False), 2: (1, 1, True), 3: (0, 0, False)}
    bodies = make([("x", b"abcd")], "chunk_hash string, plain binary")
    lost = chunks.unionByName(make([(9, k, k, k, 1, "lost") for k in range(3)], CHUNKS))
    got = {r.file_id: r.content and bytes(r.content) for r in it.best_effort(lost, bodies).collect()}
    assert got == {1: b"abcd" + bytes(6), 2: b"abcd" + bytes(6), 9: None}
    assert ids(it.collisions(make([("x", b"1"), ("x", b"2"), ("y", b"1"), ("y", b"1")], "chunk_hash string, plain binary")), "chunk_hash") == ["x"]


# --- metadata, trees, telemetry ---


def test_metadata_needs_a_whole_sequence(make):
    j = lambda path, idx, **more: __import__("json").dumps({"LocalPath": path, "FileSize": 3, "FileHash": "F", "LastModified": "2026-04-17T21:30:45Z", "Chunks": [{"Index": i, "Hash": f"h{i}", "Offset": i, "Length": 1} for i in idx], **more})
    raw = make([(j("a", [0, 1, 2], MetadataVersion=7),), (j("b", [1, 0]),), (j("c", []),), ("{broken",), (j("d", [0], Version=2),)], "json string")
    got = {r.local_path: (r.status, r.metadata_version, [c.blob_name for c in r.chunks]) for r in lo.decoded_metadata(raw).collect()}
    assert got == {"a": (2, 1, ["chunks/h0", "chunks/h1", "chunks/h2"]), "c": (2, 1, []), "d": (2, 2, ["chunks/h0"])}


def test_configuration(make):
    settings = make([(1, True)], "sid int, auto boolean")
    folders = make([(2, "b"), (1, "a")], "id int, path string")
    excludes = make([(1, 1, "*.x", 0), (3, 1, "*.a", 0), (2, 1, "sub", 1)], "id int, folder_id int, pattern string, kind int")
    globs = make([(2, "q"), (1, "p")], "id int, pattern string")
    r = one(lo.configuration(settings, folders, excludes, globs))
    assert [(f.path, f.exclude_patterns, f.exclude_subfolders) for f in r["folders"]] == [("a", ["*.x", "*.a"], ["sub"]), ("b", None, None)] and r["global_patterns"] == ["p", "q"]


def test_folder_rollup(make):
    files = make([file(1, "C:/a/x", 1), file(2, "c:/A/b/y", 2), file(3, "D:/z", 4)], FILES)
    got = {r.folder.upper(): (r.files, r.bytes, r.folders) for r in tree.folder_rollup(files).collect()}
    assert got == {"C:": (2, 3, 2), "C:/A": (2, 3, 1), "C:/A/B": (1, 2, 0), "D:": (1, 4, 0)}
    nodes = tree.tree_nodes(files)
    assert nodes.where("is_folder").count() == 4 and nodes.where("NOT is_folder").count() == 3
    assert [r.name for r in lo.folders_first(nodes).collect()][4:] == ["x", "y", "z"]


def test_telemetry_reading_and_analyses(spark, tmp_path):
    from stratalog.sources import readers

    lines = [
        '{"type":"file","timestamp":"2026-04-17T21:30:45.1234567Z","operation":"o","path":"a","bytes":10,"throughput_mbps":2.5,"chunk_max":5}',
        '{"type":"op","timestamp":"2026-04-17T21:31:00Z","operation":"o","succeeded":3,"budget_stalls":1}',
        '{"type":"ctx","is_64_bit":true}', '{"type":"decision","reason":"r","context":{"a":"b"}}',
        '{"type":"corruption","path":"p","crc_failed_indices":[1,4]}', '{"type":"corruption","path":"q","crc_failed_indices":[4]}',
    ]
    (tmp_path / "t.jsonl").write_text("\n".join(lines))
    t = readers.telemetry(spark, str(tmp_path / "t.jsonl"))
    f = t.where("type = 'file'").collect()[0]
    assert f.throughput_mbytes_per_sec == 2.5 and f.retries == 0 and f.timestamp.microsecond == 123456
    assert t.where("type = 'ctx'").collect()[0].is64_bit and t.where("type = 'decision'").collect()[0].context == {"a": "b"}
    assert {r.operation: r.skipped for r in tm.skipped_files(t.where("operation = 'o'")).collect()} == {"o": 2}
    assert {r["index"]: (r.n, r.files) for r in tm.corruption_patterns(t).collect()} == {1: (1, 1), 4: (2, 2)}
    readers.write_telemetry(t.where("operation = 'o'").select("type", "timestamp", "operation"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    d = spark.createDataFrame([("T1", True, 5), ("T1", False, 5), ("T2", False, None)], "phase string, crc_valid boolean, plain_size long")
    assert {r.phase: (r.n, r.crc_bad_but_readable) for r in tm.phase_counts(d).collect()} == {"T1": (2, 1), "T2": (1, 0)}


def test_listings(spark, tmp_path):
    from stratalog.sources import readers

    (tmp_path / "store/chunks").mkdir(parents=True)
    (tmp_path / "store/metadata").mkdir()
    (tmp_path / "store/chunks/abc").write_bytes(b"12345")
    (tmp_path / "store/metadata/m").write_bytes(b"{}")
    b = {r.blob_name: (r.size_bytes, r.content_md5) for r in readers.blob_listing(spark, str(tmp_path / "store")).collect()}
    assert b == {"chunks/abc": (5, "827ccb0eea8a706c4c34a16891f84e7b"), "metadata/m": (2, "99914b932bd37a50b983c5e7c90ae93b")}
    assert readers.listing(spark, str(tmp_path / "store")).agg(F.sum("length")).collect()[0][0] == 7
    assert [bytes(r[0]) for r in readers.contents(spark, str(tmp_path / "store/chunks")).select(lo.read_range(F.col("content"), F.lit(1), F.lit(3))).collect()] == [b"234"]


# --- limits and errors of composites ---


def test_folder_table_is_bounded(make, monkeypatch):
    files = make([file(1, "C:/a/x", 1), file(2, "D:/b", 1), file(2, "D:/b", 1)], FILES)
    folders = make([(2, "c:/A", 2, True), (1, "C:/a/", 1, True), (3, "D:", 3, False)], "ordinal int, path string, tier int, enabled boolean")
    got = sorted((r.file_id, r.folder, r.tier) for r in jo.folder_of_file(files, folders).collect())
    assert got == [(1, "C:/a/", 1), (2, None, 0), (2, None, 0)]
    assert jo.folder_of_file(files, folders.limit(0)).count() == 3
    monkeypatch.setattr(jo, "MAX_FOLDERS", 1)
    with pytest.raises(ValueError):
        jo.folder_of_file(files, folders)


def test_no_free_version_is_an_error(make):
    stored = make([("chunks/h" + (f"_v{k}" if k > 1 else ""), f"{k}".encode()) for k in range(1, 1001)], "blob_name string, content binary")
    assert mu.upload_names(make([("h", b"7")], "hash string, content binary"), stored).collect()[0].blob_name == "chunks/h_v7"
    with pytest.raises(Exception, match="no free version"):
        mu.upload_names(make([("h", b"new")], "hash string, content binary"), stored).collect()


def test_quarantined_catalog_without_a_salt_is_an_error(make):
    fresh = make([("new", 3, None)], "password_salt string, failed_logins int, lockout_until timestamp_ntz")
    old = make([("old",)], "password_salt string")
    assert tuple(mx.recovered_settings(fresh, old).collect()[0]) == ("old", 0, None)
    with pytest.raises(Exception, match="no salt"):
        mx.recovered_settings(fresh, old.where("false")).collect()


def test_bulk_insert_stops_at_a_path_that_is_there(make):
    files = make([file(1, "a", 1), file(2, "b", 1)], FILES)
    chunks = make([(1, 0, 0, 0, 4, "x")], CHUNKS)
    refs = make([], "file_path string, chunk_hash string, chunk_index int, referenced_at timestamp_ntz")
    out = mu.bulk_insert(files.where("file_id = 1"), chunks, refs, files.where("file_id = 2"), chunks.limit(0), True)
    assert [df.count() for df in out] == [2, 1, 0]
    with pytest.raises(Exception, match="duplicate key"):
        mu.bulk_insert(files, chunks, refs, files.where("file_id = 2"), chunks, True)[0].collect()


def test_large_restore_is_put_together_once(make):
    n = 3000
    chunks = make([(1, k, k, 1000 * k, 1000, f"h{k % 7}") for k in range(n)], CHUNKS)
    bodies = make([(f"h{k}", bytes([65 + k]) * 1000) for k in range(6)], "chunk_hash string, plain binary")
    (r,) = it.best_effort(chunks, bodies).collect()
    assert bytes(r.content) == b"".join(bytes([65 + k % 7]) * 1000 if k % 7 < 6 else bytes(1000) for k in range(n))

import datetime as dt
import hashlib
import hmac
import zlib

import pytest
from pyspark.sql import functions as F

from stratalog.functions import formats, hashing, paths


def values(spark, rows, schema, *exprs):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*exprs).collect()]


GLOBS = [
    ("*.txt", "file.txt", True), ("*.txt", "FILE.TXT", True), ("*.txt", "file.doc", False), ("temp*", "tempfile", True), ("temp*", "nottemp", False),
    ("~*", "~tempfile", True), ("~*", "normal_file", False), ("file?.txt", "file1.txt", True), ("file?.txt", "file.txt", False), ("file?.txt", "file12.txt", False),
    ("???.dat", "abc.dat", True), ("???.dat", "ab.dat", False), ("thumbs.db", "Thumbs.db", True), ("thumbs.db", "thumbs.db.bak", False), ("", "file.txt", False),
    ("*.txt", "", False), ("", "", False), (None, "file.txt", False), ("*.txt", None, False), ("*", "x", True), ("file[1].txt", "file[1].txt", True),
    ("file(1).txt", "file(1).txt", True), ("file+data.txt", "file+data.txt", True), ("a\\Eb*", "a\\Ebc", True), ("*", "two\nlines", True),
]


def test_globs(spark):
    for pattern, name, want in GLOBS:
        assert values(spark, [(name,)], "n string", paths.glob_match(F.col("n"), pattern)) == [(want,)], (pattern, name)
    got = values(spark, [(p, n) for p, n, _ in GLOBS], "p string, n string", paths.glob_match_column(F.col("n"), F.col("p")))
    assert [g for (g,) in got] == [w for *_, w in GLOBS]
    assert values(spark, [("file.txt",), ("file.doc",)], "n string", paths.matches_any(F.col("n"), ["", " ", "  ", "*.txt"])) == [(True,), (False,)]


@pytest.mark.parametrize(
    "n, text",
    [(0, "0 B"), (1023, "1023 B"), (1024, "1 KB"), (1536, "1.5 KB"), (1048576, "1 MB"), (1073741824, "1 GB"), (1610612736, "1.5 GB"), (1099511627776, "1 TB"), (1100, "1.07 KB"), (2**60, "1 EB"), (2**63 - 1, "8 EB"), (10240, "10 KB"), (102400, "100 KB")],
)
def test_format_bytes(spark, n, text):
    assert values(spark, [(n,)], "n long", formats.format_bytes(F.col("n"))) == [(text,)]


@pytest.mark.parametrize("s, text", [(0.0, "0s"), (59.9, "59s"), (60.0, "1m 0s"), (150.0, "2m 30s"), (3599.0, "59m 59s"), (4500.0, "1h 15m"), (86399.0, "23h 59m"), (86400.0, "1d 0h 0m"), (176400.0, "2d 1h 0m")])
def test_format_duration(spark, s, text):
    assert values(spark, [(s,)], "s double", formats.format_duration(F.col("s"))) == [(text,)]


@pytest.mark.parametrize("s", [-1.0, float("nan"), float("inf")])
def test_bad_duration(spark, s):
    with pytest.raises(Exception, match="not a duration"):
        values(spark, [(s,)], "s double", formats.format_duration(F.col("s")))
    with pytest.raises(Exception, match="negative"):
        values(spark, [(-1,)], "n long", formats.format_bytes(F.col("n")))


def test_paths(spark):
    p = F.col("p")
    got = values(spark, [("C:\\a\\b.TXT",), ("/x/y/",), ("J:\\",), ("plain",)], "p string", paths.file_name(p), paths.directory_name(p), paths.extension(p), paths.display_name(p))
    assert got == [("b.TXT", "C:\\a", ".txt", "b.TXT"), ("", "/x/y", "", "y"), ("", "J:", "", "J:\\"), ("plain", "", "", "plain")]
    base = F.col("b")
    rows = [("C:\\foo\\x", "c:\\FOO"), ("C:\\foobar\\x", "C:\\foo"), ("C:\\foo", "C:\\foo\\"), ("D:\\q\\r", "C:\\foo")]
    got = values(spark, rows, "p string, b string", paths.relative_path(p, base), paths.under_prefix(p, base), paths.under_prefix(p, base, strict=True))
    assert got == [("x", True, True), ("bar\\x", True, False), ("foo", False, True), ("r", False, False)]
    got = values(spark, [(["C:/a/b/c.txt", "c:/A/b/d/e.txt", "C:/a/bx/f"],), ([],), (["x"],), (["C:/a/f", "D:/a/f"],)], "p array<string>", paths.common_root(p))
    assert [g.upper() for (g,) in got] == ["C:/A/B", "", "", ""]
    assert values(spark, [("a/b/c",), ("x",)], "p string", paths.ancestors(p)) == [(["a", "a/b"],), ([],)]
    unsafe = paths.unsafe_target(p, ["C:/Windows"])
    assert values(spark, [("C:/x/../y",), ("c:/windows/z",), ("C:/WindowsApps/z",), ("a<b",), ("ok/..x",)], "p string", unsafe) == [(True,), (True,), (False,), (True,), (False,)]


def test_exclusion(spark):
    rule = paths.excluded(F.col("p"), F.lit("C:/w"), ["*.iso"], ["sub/*.doc"], ["node_modules/"])
    rows = ["C:/w/a.iso", "C:/w/sub/a.doc", "C:/w/a.doc", "C:/w/node_modules/x.js", "C:/w/node_modules2/x.js", "C:/w/Thumbs.DB", "C:/w/~x", "C:/w/keep.txt"]
    assert [g for (g,) in values(spark, [(r,) for r in rows], "p string", rule)] == [True, True, False, True, True, True, True, False]


def test_hashes_and_envelope(spark):
    key, text = b"k" * 32, "some path é"
    row = values(spark, [(text,)], "t string", hashing.sha256_hex(F.col("t")), hashing.crc32_bytes(F.col("t").cast("binary")), hashing.hmac_sha256_hex(key, F.col("t")))[0]
    raw = text.encode()
    assert row[0] == hashlib.sha256(raw).hexdigest().upper()
    assert bytes(row[1]) == zlib.crc32(raw).to_bytes(4, "little")
    assert row[2] == hmac.new(key, raw, "sha256").hexdigest()
    k, wrong = F.lit(bytearray(key)), F.lit(bytearray(b"x" * 32))
    df = spark.createDataFrame([(b"",), (b"hello" * 50,)], "b binary").withColumn("s", hashing.seal(F.col("b"), k)).cache()
    for r in df.select("b", "s", hashing.envelope_ok(F.col("s")).alias("ok"), hashing.unseal(F.col("s"), k).alias("p"), hashing.unseal(F.col("s"), wrong).alias("w")).collect():
        assert len(r.s) == len(r.b) + 37 and bytes(r.s[:5]) == b"AZBK\x01" and r.ok and bytes(r.p) == bytes(r.b) and r.w is None
        assert bytes(r.s[-4:]) == zlib.crc32(bytes(r.s[:-4])).to_bytes(4, "little")
    sealed = bytes(df.collect()[1].s)
    broken_crc, broken_body = sealed[:-1] + bytes([sealed[-1] ^ 1]), sealed[:30] + bytes([sealed[30] ^ 1]) + sealed[31:]
    got = values(spark, [(broken_crc,), (broken_body,), (b"short",)], "s binary", hashing.envelope_ok(F.col("s")), hashing.unseal(F.col("s"), k), hashing.unseal(F.col("s"), k, check=False))
    assert [g[0] for g in got] == [False] * 3 and [g[1] for g in got] == [None] * 3
    assert bytes(got[0][2]) == b"hello" * 50 and got[1][2] is None and got[2][2] is None


def test_recovery_code():
    salt = bytes(range(16))
    code = hashing.recovery_code(salt)
    assert len(code.replace("-", "")) == 28 and hashing.read_recovery_code(code) == salt
    assert hashing.read_recovery_code(code.lower().replace("0", "o").replace("1", "l")) == salt
    typo = ("7" if code[3] != "7" else "8").join([code[:3], code[4:]])
    assert hashing.read_recovery_code(typo) is None and hashing.read_recovery_code("") is None and hashing.read_recovery_code(code + "0") is None


def test_small_arithmetic(spark):
    n = F.col("n")
    assert values(spark, [(1,), (2,), (3,), (1025,)], "n long", formats.next_power_of_two(n)) == [(1,), (2,), (4,), (2048,)]
    assert values(spark, [(0,), (1 << 20,), (64 << 20,), (1 << 30,)], "n long", formats.adaptive_concurrency(n)) == [(24,), (24,), (6,), (4,)]
    assert values(spark, [(100,), (2048,), (1 << 20,)], "n long", formats.file_concurrency(n)) == [(1,), (4,), (16,)]
    assert values(spark, [(429,), (404,)], "n int", formats.transient_status(n)) == [(True,), (False,)]
    assert values(spark, [("Abcdefghij1!",), ("Abcdefghij1",), ("abcdefghijk1!",)], "n string", formats.strong_password(n)) == [(True,), (False,), (False,)]
    assert values(spark, [("db.20260417-213045.bad",), ("db.20261317-213045",), ("x",)], "n string", formats.stamp(n)) == [(dt.datetime(2026, 4, 17, 21, 30, 45),), (None,), (None,)]
    assert values(spark, [(3, 0)], "a int, b int", formats.summary_text(create=F.col("a"), delete=F.col("b"))) == [("3 to create",)]
    assert values(spark, [(100, 80, 50, 10, 5)], "a long, b long, c long, d long, e long", formats.unaccounted_memory(*map(F.col, "abcde"))) == [(55,)]
    assert values(spark, [(0.0,), (2.0,)], "s double", formats.throughput_mb(F.lit(2 << 20), F.col("s"))) == [(0.0,), (1.0,)]


def plain_aimd(samples, start, least, most):
    mean, n = 0.0, start
    for x in samples:
        before, mean = mean, x if mean == 0 else 0.3 * x + 0.7 * mean
        if before == 0 or x == 0:
            continue
        delta = (x - before) / before
        if delta > 0.05:
            n = min(most, n + (2 if delta > 0.2 else 1))
        elif delta < -0.05:
            n = max(least, n // 2)
    return mean, n


def test_ewma_and_connections(spark):
    rows = [[100.0, 120.0, 90.0, 91.0, 300.0, 0.0, 20.0], [0.0, 5.0], [], [50.0] * 4]
    got = values(spark, [(r,) for r in rows], "s array<double>", formats.ewma(F.col("s")), formats.connections(F.col("s"), 4, 1, 6))
    for (mean, n), r in zip(got, rows):
        want = plain_aimd(r, 4, 1, 6)
        assert abs(mean - want[0]) < 1e-9 and n == want[1]


def test_memory_limits(spark):
    t = F.col("t")
    got = values(spark, [(0,), (512,), (16384,), (12000,), (65536,), (600,)], "t long", formats.memory_steps(t), formats.default_limit(t))
    assert got == [([512], 8192), ([512], 512), ([512, 1024, 2048, 4096, 8192, 16384], 4096), ([512, 1024, 2048, 4096, 8192, 12000], 2048), ([512 << k for k in range(8)], 8192), ([512, 600], 512)]
    assert values(spark, [(5, 10), (8, 10), (9, 10), (9, 0)], "l long, t long", formats.memory_severity(F.col("l"), t)) == [("Safe",), ("Aggressive",), ("Dangerous",), ("Safe",)]


def test_recovery_codes_as_columns(spark):
    import os

    salts = [bytes(16), b"\xff" * 16, *(os.urandom(16) for _ in range(20))]
    df = spark.createDataFrame([(bytearray(s),) for s in salts], "salt binary").withColumn("code", hashing.recovery_code_of(F.col("salt")))
    got = df.select("salt", "code", hashing.salt_of(F.lower("code")).alias("back"), hashing.salt_of(F.concat("code", F.lit("0"))).alias("long"), hashing.salt_of(F.lit("not a code")).alias("bad")).collect()
    assert [r.code for r in got] == [hashing.recovery_code(s) for s in salts]
    assert all(r.back == r.salt and r.long is None and r.bad is None for r in got)

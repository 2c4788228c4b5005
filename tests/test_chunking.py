import hashlib
import random

import pytest

from stratalog.operators import chunking as cd


def xorshift(n, seed):
    x, out = seed, bytearray(n)
    for i in range(n):
        x ^= x << 13 & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 7
        x ^= x << 17 & 0xFFFFFFFFFFFFFFFF
        out[i] = x >> 24 & 255
    return bytes(out)


GOLDEN = [  # extension, bytes, seed (None: constant 0xAB), chunks, file hash, fingerprint of the chunk lines
    (".bin", 4194304, 0xA1A1A1A1A1A1A1A1, 11, "B54BC3658D1C67FA", "488EEA5718D78F3BF5A39BD05CB20BE6A405939E6D6B400FD75783A588F5C3D2"),
    (".txt", 2097152, 0xB2B2B2B2B2B2B2B2, 28, "60A0CE8D3F668031", "D4954A49D5BAFADAA1F177A41B6EB8669934F5116E40FA5F5ABC78EC386402F4"),
    (".mp4", 8388608, 0xC3C3C3C3C3C3C3C3, 3, "3B1C07BBE6D4311C", "2FE60FB45CAFCFD78E7BDFFB747F5343B0BBE3EAD42ED185F64A4E4EA073391D"),
    (".bin", 4194304, None, 4, "304723FE1A4265D5", "E4648BBCE50FC16B3A4AF82A2F9AA5EAA7A36C08D5832704D263C1185313C011"),
    (".bin", 1024, 0xD4D4D4D4D4D4D4D4, 1, "13A0DF28698DC2C9", "334FD20E06328DA484A932DE0D1E29A9C0956FB64863A0C34BC081489D809BC1"),
]


def test_golden_vectors(spark):
    data = [b"\xab" * n if seed is None else xorshift(n, seed) for _, n, seed, *_ in GOLDEN]
    rows = [(f"{i}{ext}", d) for i, ((ext, *_), d) in enumerate(zip(GOLDEN, data))]
    got = {}
    for r in cd.chunk_files(spark.createDataFrame(rows, "path string, content binary")).collect():
        got.setdefault(r.path, []).append(r)
    for i, (ext, n, _, chunks, digest, print_) in enumerate(GOLDEN):
        mine = sorted(got[f"{i}{ext}"], key=lambda r: r.chunk_index)
        assert len(mine) == chunks and mine[0].file_hash[:16] == digest and sum(r.length for r in mine) == n
        lines = "".join(f"{r.chunk_index}:{r.offset}:{r.length}:{r.hash}\n" for r in mine)
        assert hashlib.sha256(lines.encode()).hexdigest().upper() == print_


def plain_cuts(data, least, most, bits):
    """The rolling hash byte by byte."""
    if len(data) <= least:
        return [len(data)]
    h, full, pos, window, start, out = 0, False, 0, [0] * 48, 0, []
    for i, b in enumerate(data):
        h = ((h - window[pos] * pow(31, 47, 1 << 32)) * 31 + b if full else h * 31 + b) % (1 << 32)
        window[pos] = b
        pos += 1
        if pos == 48:
            pos, full = 0, True
        n = i + 1 - start
        if n >= least and (h & (1 << bits) - 1 == 0 or n >= most):
            out.append(i + 1)
            h, full, pos, start = 0, False, 0, i + 1
    return out + ([len(data)] if start < len(data) else [])


@pytest.mark.parametrize("seed", range(4))
def test_against_plain_loop(seed):
    rng = random.Random(seed)
    data = bytes(rng.choice(b"abc \n") for _ in range(30_000)) + b"z" * 3000
    for least, most, bits in ((48, 400, 6), (256, 4096, 10), (100, 100, 4)):
        assert cd.cut_points(data, least, most, bits) == plain_cuts(data, least, most, bits)


def test_blocks_join_up(monkeypatch):
    data = xorshift(40_000, 99)
    want = cd.cut_points(data, 64, 2048, 8)
    monkeypatch.setattr(cd, "BLOCK", 1000)
    assert cd.cut_points(data, 64, 2048, 8) == want == plain_cuts(data, 64, 2048, 8)


def test_empty_and_null_files(spark):
    got = cd.chunk_files(spark.createDataFrame([("a.txt", b""), ("b.txt", None)], "path string, content binary")).collect()
    empty = hashlib.sha256(b"").hexdigest().upper()
    assert [(r.chunk_index, r.offset, r.length, r.hash, r.file_hash) for r in got] == [(0, 0, 0, empty, empty)] * 2


def test_profile_by_size_and_extension(spark):
    from pyspark.sql import functions as F

    rows = [("a.MP4", 10), ("a.docx", 10), ("a", 10), ("a.txt", 501 << 20)]
    got = [tuple(r[0]) for r in spark.createDataFrame(rows, "p string, n long").select(cd.profile(F.col("p"), F.col("n"))).collect()]
    assert got == [(1 << 20, 64 << 20, 22), (32 << 10, 256 << 10, 17), (64 << 10, 1 << 20, 18), (16 << 20, 128 << 20, 26)]


def test_small_files_together_as_one_by_one(spark, monkeypatch):
    """Files of several profiles, empty and long ones among them, in groups of any size."""
    rng = random.Random(9)
    rows = [(f"{i}{rng.choice(['.txt', '.pdf', '', '.TXT'])}", bytes(rng.choices(b"abcdefgh \n", k=rng.choice([0, 1, 47, 300, 2000, 70_000])))) for i in range(150)] + [("null.txt", None)]
    want = sorted((p, *x) for p, d in rows for x in cd.chunk_bytes(d or b"", 64, 500, 6))
    got = cd.chunk_files(spark.createDataFrame(rows, "path string, content binary").coalesce(2), 64, 500, 6).collect()
    assert sorted((r.path, r.chunk_index, r.offset, r.length, r.hash) for r in got) == want
    assert {r.path: r.file_hash for r in got} == {p: hashlib.sha256(d or b"").hexdigest().upper() for p, d in rows}
    profiles = cd.chunk_files(spark.createDataFrame(rows, "path string, content binary"), file_hash=False).collect()
    of = lambda p: (16 << 10, 128 << 10, 16) if p.lower().endswith(".txt") else (64 << 10, 512 << 10, 18) if p.endswith(".pdf") else (64 << 10, 1 << 20, 18)
    assert sorted((r.path, r.chunk_index, r.offset, r.length, r.hash) for r in profiles) == sorted((p, *x) for p, d in rows for x in cd.chunk_bytes(d or b"", *of(p)))

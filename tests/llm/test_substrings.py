import hashlib
import random
from collections import Counter

import pytest

from stratalog.llm import substrings as sub
from stratalog.llm.common import table

from .util import ODD, SF, empty_documents, odd_documents


def plain(rows, length):
    seen = Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        seen.update(b[s : s + length] for s in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = [True] * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((str(i), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check(spark, rows, length=200, **more):
    got = sub.repeated_substrings(spark.createDataFrame(rows, "doc_id long, text string"), length, **more).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == plain(rows, length)
    return got


def made(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    passages = [" ".join(word() for _ in range(rng.randint(3, 25))) for _ in range(6)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 12)):
            w += [rng.choice(passages)] if rng.random() < 0.4 else [word() for _ in range(rng.randint(1, 12))]
        t = " ".join(w)
        if rows and rng.random() < 0.25:
            t = rng.choice(rows)[1]
            if t and rng.random() < 0.7:
                k = rng.randrange(len(t))
                t = t[:k] + rng.choice(["", "X", "yy"]) + t[k + rng.randint(0, 2) :]
        rows.append((i, t))
    return rows + [(1000, "ab" * 300), (1001, "b" * 500), (1002, "abcab" * 90 + "x" + "abcab" * 90)]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("crowd", [3, 4000])
def test_against_brute_force(spark, seed, crowd):
    check(spark, made(seed), 40, trigger=8, crowd=crowd)


@pytest.mark.parametrize("segment", [150, 1000, 1 << 18])
def test_parse_covers_all_windows_alike(spark, monkeypatch, segment):
    """However texts are cut into segments, every window is in a phrase, and equal windows have one trigger."""
    import pyarrow as pa

    monkeypatch.setattr(sub, "SEGMENT", segment)
    texts = [t.encode() for _, t in made(7)]
    batch = pa.RecordBatch.from_pydict({"row": list(range(len(texts))), "text": pa.array([t.decode() for t in texts])})
    of: dict = {}
    trigger_of: dict = {}
    for out in sub._read_phrases(40, 8)(iter([batch])):
        for r in out.to_pylist():
            place, most, least = r["at"] >> 16, r["at"] >> 8 & 255, r["at"] & 255
            for start in range(place - most, place - least + 1):
                of.setdefault(r["row"], set()).add(start)
                window = texts[r["row"]][start : start + 40]
                assert len(window) == 40 and trigger_of.setdefault(window, (r["key"], place - start)) == (r["key"], place - start)
    assert of == {i: set(range(len(t) - 39)) for i, t in enumerate(texts) if len(t) >= 40}


def test_real_rows(spark):
    check(spark, [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").limit(120).collect()])


def test_odd_rows(spark):
    check(spark, [(i, t) for i, t in ODD if not t or len(t) < 5000] + [(None, "z" * 250), (9, "word " * 60), (9, "word " * 60)])
    assert sub.repeated_substrings(odd_documents(spark)).count() == len(ODD)
    assert sub.repeated_substrings(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("crowd", [2, 7])
def test_hot_triggers_are_dealt_out(spark, crowd):
    """A passage in many texts, with neighbours that differ, agree for a while, or are copies."""
    rng = random.Random(11)
    line = lambda n: "".join(rng.choice("pqrstuv ") for _ in range(n))
    passage, end, begin = line(150), line(30), line(35)
    rows = []
    for i in range(70):
        before = line(rng.randint(0, 60)) + (begin[-rng.randint(1, 35) :] if i % 3 else "")
        after = (end[: rng.randint(1, 30)] if i % 2 else "") + line(rng.randint(0, 60))
        rows.append((i, before + passage + after))
    check(spark, rows + rows[:5], 40, trigger=8, crowd=crowd)


def test_triggers_are_places_under_a_threshold():
    """Wherever a string stands, its triggers are the same; only windows without one take the place of the least hash."""
    import numpy as np

    rng = random.Random(2)
    core = bytes(rng.randrange(97, 105) for _ in range(3000))
    found = []
    for shift in (0, 17, 400):
        data = np.frombuffer(bytes(rng.randrange(97, 105) for _ in range(shift)) + core, np.uint8)
        _, at, lo, hi = sub.parse(data, np.full(len(data), len(data)), 200, 32)
        assert list(lo[1:]) == list(hi[:-1] + 1) and lo[0] == 0 and hi[-1] == len(data) - 200
        found.append({int(a) - shift for a, h in zip(at, hi) if h >= shift + 200})
    assert found[0] >= found[1] and found[1] >= found[2] - {x for x in found[2] if x < 200} and len(found[0]) > 15


def test_query_against_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(3)
    line = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = line(400)
    rows = [(i, line(rng.randint(0, 300)) + (shared[rng.randint(0, 150) :] if i % 3 == 0 else "") + line(rng.randint(0, 40))) for i in range(40)] + [(40, None), (41, ""), (42, "z" * 450)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in sub.op6_substrings(spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(sub.OP6_SQL).fetchall()) and sum(r[2] for r in got) > 2000

import hashlib
import random
import re

import numpy as np
import pytest

from stratalog.llm import bpe, components, decontaminate, exact_dedup, simhash
from stratalog.llm.common import table

from .util import ODD, SF, empty_documents, odd_documents


# --- exact duplicates ---


def test_rice_code_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        v = np.unique(rng.integers(2**62, 2**62 + 2**40, n, dtype=np.uint64))
        k = exact_dedup.rice_bits(2**40, n)
        code = exact_dedup.rice_encode(v, 2**62, k)
        assert (exact_dedup.rice_decode(code, 2**62, k) == v).all()
        assert len(code) < 20 + n * (40 - np.log2(n + 1) + 3) / 8
    v = np.uint64(2**62) + np.arange(500, dtype=np.uint64)
    assert (exact_dedup.rice_decode(exact_dedup.rice_encode(v, 2**62, 0), 2**62, 0) == v).all()


def test_exact_duplicates_of_odd_rows(spark):
    got = exact_dedup.exact_duplicates(odd_documents(spark), rows_per_owner=3).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    sha = lambda t: hashlib.sha256(norm(t).encode()).hexdigest()
    assert sorted((str(r.doc_id), r.text_sha256) for r in got) == sorted((str(i), sha(t)) for i, t in ODD)
    for r in got:
        ids = [i for i, t in ODD if sha(t) == r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == min((i for i in ids if i is not None), default=None)
    kept = [r.text_sha256 for r in got if r.kept]
    assert sorted(kept) == sorted({sha(t) for _, t in ODD})  # one of each text, repeated ids or not


def test_exact_dedup_keeps_columns_and_one_row(spark):
    docs = odd_documents(spark)
    out = exact_dedup.drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    assert sorted(norm(r.text) for r in out.collect()) == sorted({norm(t) for _, t in ODD})


def test_owner_finds_what_occurs_twice(spark):
    rows = [(p, f) for p in range(5) for f in (7, p, 100 + p)] + [(3, 103), (4, -5), (0, -5)]
    got = {r.fingerprint for r in exact_dedup.suspect_fingerprints(spark.createDataFrame(rows, "part int, fingerprint long"), len(rows), 4).collect()}
    values = [f for _, f in rows]
    assert got == {f for f in values if values.count(f) > 1}


# --- components and SimHash ---


def brute_components(nodes, linked):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            for x in (a, b):
                if label[x] != low:
                    label[x], changed = low, True
    return label


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, k) for k in range(900, 960)] + [(5000, 5001), (5001, 5000), (7, 7), (8000, 8000)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    edges = [e for e in edges if e[0] != e[1]]
    assert got == brute_components({x for e in edges for x in e}, edges)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def check_near(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(docs, **more).collect()
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(i), f"{p:016x}") for i, p in prints)
    values = {p for _, p in prints}
    linked = [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3]
    label = brute_components(values, linked)
    first = {}
    for i, p in prints:
        if i is not None:
            first[label[p]] = min(i, first.get(label[p], i))
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted((str(i), str(first.get(label[p]))) for i, p in prints)


def test_near_duplicates_of_odd_rows(spark):
    check_near(spark, ODD)


def test_near_duplicates_of_real_rows(spark):
    check_near(spark, [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()])


@pytest.mark.parametrize("most", [2, 2048])
def test_links_in_crowded_buckets(spark, most):
    """Thousands of neighbours that share segments: with small buckets all three levels are used."""
    rng = random.Random(3)
    prints = set()
    for base in (0, 0xFFFF_FFFF_0000_0000, rng.getrandbits(64)):
        for _ in range(250):
            x = base
            for b in rng.sample(range(64), rng.randint(0, 3)):
                x ^= 1 << b
            prints.add(x)
        prints |= {base ^ (rng.getrandbits(9) << 20) for _ in range(60)}
    prints |= {rng.getrandbits(64) for _ in range(300)}
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    edges = simhash.near_links(spark.createDataFrame(signed, "fp long"), most=most).collect()
    u = lambda x: x % 2**64
    assert all((u(e.a) ^ u(e.b)).bit_count() <= 3 for e in edges)
    linked = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3]
    assert brute_components(prints, [(u(e.a), u(e.b)) for e in edges]) == brute_components(prints, linked)


def test_drop_near_duplicates(spark):
    """One row of each component stays, whatever ids rows have; what has no relation stays whole."""
    docs = odd_documents(spark)
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    prints = [simhash.fingerprint(simhash.shingle_hashes(None if t is None else t.encode())) for _, t in ODD]
    linked = [(i, j) for i in range(len(ODD)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    label = brute_components(range(len(ODD)), linked)
    rank = lambda k: (ODD[k][0] is None, ODD[k][0] or 0)
    want = []
    for c in set(label.values()):
        best = min(rank(k) for k in label if label[k] == c)
        want.append(ODD[next(k for k in label if label[k] == c and rank(k) == best)][0])
    assert sorted(map(str, want)) == sorted(str(r.doc_id) for r in out.collect())


UNLIKE = ["rain falls on the old stone bridge at night", "seven ships left port before the first storm came", "her letters were kept in a tin box under the stairs", "prices of copper and zinc rose again in the third quarter", "the choir sang without a break until the candles went out"]


@pytest.mark.parametrize("drop", [simhash.drop_near_duplicates, exact_dedup.drop_exact_duplicates])
def test_unlike_rows_stay_whatever_their_ids(spark, drop):
    ids = [1, 1, None, None, 5]
    rows = [*zip(ids, UNLIKE), (7, UNLIKE[0]), (1, UNLIKE[0]), (None, UNLIKE[4])]
    got = drop(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(i), t) for i, t in zip(ids, UNLIKE))
    assert drop(empty_documents(spark)).count() == 0


# --- BPE ---


@pytest.fixture(scope="module")
def both():
    import tokenizers

    path = bpe.default_vocabulary()
    return bpe.loaded(path), tokenizers.Tokenizer.from_file(path)


def library(t, text):
    ids = t.encode(text, add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)


def test_bpe_matches_the_library(both, spark):
    own, lib = both
    rng = random.Random(5)
    texts = [t or "" for _, t in ODD] + [r.text for r in table(spark, SF, "documents").select("text").collect()]
    for kind in ("ab", "aab ", "abcdefghij  ", "éèüß中文", "'slld re", "0123 .", "\n\t   \x1c\x85", "꟎ͅa1²१", "thentionreing "):
        texts += ["".join(rng.choice(kind) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    for t in texts:
        ids, text = library(lib, t)
        assert own.encode(t) == ids, t
        assert own.decode(ids).decode() == text


def test_bpe_of_odd_rows(both, spark):
    own, lib = both
    got = bpe.bpe_encode(odd_documents(spark), bpe.default_vocabulary()).collect()
    want = []
    for i, t in ODD:
        ids, text = library(lib, t or "")
        want.append((str(i), len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), list(np.frombuffer(ids, "<u4"))))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256, list(r.ids)) for r in got) == sorted(want)
    assert bpe.bpe_encode(empty_documents(spark), bpe.default_vocabulary()).count() == 0


# --- decontamination ---


def plain_contamination(text, items, width):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    hit, ids = set(), set()
    for item_id, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    ids.add(item_id if item_id is None else str(item_id))
    return len(words), len(hit), len(ids), sorted(ids - {None})


@pytest.mark.parametrize("block_chars", [90, 4_000_000])
def test_decontaminate_against_brute_force(spark, block_chars):
    items = [(1, "The quick brown fox jumps"), (2, "quick BROWN"), (2, "quick brown"), (3, None), (4, ""), (5, "Straße 中文 x"), (10, "brown fox jumps over the lazy dog"), (None, "lazy dog"), (None, "no id"), (None, "pad pad")]
    docs = [(1, "a quick, brown fox jumps over the lazy dog; quick-brown!"), (2, None), (3, ""), (4, "Straße 中文 x straße"), (None, "quick"), (5, "QUICK brown quick brown " + "pad " * 100), (5, "The quick brown fox jumps"), (6, "foxquick brown"), (7, "an item with no id")]
    got = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), width=3, block_chars=block_chars).collect()
    want = []
    for i, t in docs:
        n, hit, n_items, ids = plain_contamination(t, items, 3)
        want.append((str(i), n, hit, n_items, hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0 and 20 * hit >= n))
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == sorted(want)
    first = next(r for r in got if r.doc_id == 1)
    assert [docs[0][1][s.start : s.end] for s in first.spans] == ["quick, brown fox jumps over the lazy dog; quick-brown"] or [docs[0][1][s.start : s.end] for s in first.spans]


def test_items_without_an_id_as_the_sql_has_them(spark, tmp_path):
    import duckdb

    items = [(None, "one two three four five six seven eight"), (None, "nine ten"), (4, "eight nine ten")]
    docs = [(1, "One two three four five six seven eight"), (2, "then nine ten " + "pad " * 50), (3, "eight NINE ten eleven")]
    con = duckdb.connect()
    for name, rows, key in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
        df = spark.createDataFrame(rows, f"{key} long, text string")
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(decontaminate.OP10_SQL).fetchall()
    got = [tuple(r) for r in decontaminate.op10_decontaminate(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and sorted(got)[0][2:4] == (8, 1) and sorted(got)[0][5]


def test_blocks_are_read_one_at_a_time(spark):
    items = spark.createDataFrame([(i, f"item number {i} of many") for i in range(20)], "item_id long, text string")
    blocks = list(decontaminate.item_blocks(items, 13, 60))
    assert len(blocks) > 5 and all(sum(map(len, b)) < 120 for b in blocks)
    assert [last for _, last in decontaminate._with_last(iter(blocks))] == [False] * (len(blocks) - 1) + [True]


def test_decontaminate_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(empty_documents(spark), none).count() == 0
    got = decontaminate.decontaminate(odd_documents(spark), none).collect()
    assert len(got) == len(ODD) and not any(r.contaminated for r in got)

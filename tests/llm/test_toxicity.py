import random
import zlib

import pytest

from stratalog.llm import toxicity as tox
from stratalog.llm.common import table

from .util import ODD, SF, empty_documents, odd_documents


def distance(a, b):
    """Optimal string alignment by the textbook table."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_against_edit_distance():
    terms = ["scum", "clown", "trash", "worthless", "disgusting", "abcab", "abcabcabc"]
    m = tox.Matcher(dict.fromkeys(terms, 1.0), {})
    rng = random.Random(2)
    for _ in range(6000):
        t = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(t) + 1)
            t[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "s", "t", "ab"])
        t = "".join(t)
        want = "exact" if t in terms else "fuzzy" if any(distance(t, w) <= tox.allowed_edits(len(w)) for w in terms) else None
        found = m.match(t)
        assert (found and found[0]) == want, t


def test_stems_and_signs():
    m = tox.Matcher({"idiot": 1.0, "loser": 0.9}, {"lowei": 0.8, "lose": 0.2})
    assert m.match("loweischaft") == ("stem", 0.8)
    assert m.match("loser") == ("exact", 0.9)
    assert m.match("1d1ot")[0] == "exact" and m.match("idoit")[0] == "fuzzy" and m.match("12345") is None


def test_weak_words_and_stems_are_found_misspelled():
    m = tox.Matcher({"worthless": 1.0, "maggot": 0.05}, {"lowei": 0.3}, ["loweringly"])
    assert m.match("magot") == ("fuzzy", 0.05) and m.match("wortless") == ("fuzzy", 1.0)
    assert m.match("lowieschaft") == ("near_stem", 0.3) and m.match("loweischaft") == ("stem", 0.3)
    assert m.match("loweringly") is None and m.match("maggot") == ("exact", 0.05)


def test_quotation_weighs_less_than_abuse():
    m = tox.Matcher({"idiot": 1.0}, {})
    quoted = tox.features_of('he said the word "idiot" was used', m, set())
    abuse = tox.features_of("you are an idiot", m, set())
    assert abuse[0] > 2 * quoted[0] and quoted[3] > abuse[3]
    assert tox.features_of("all is well", m, set()) is None


def made(spark, n=1500):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeionrst") for _ in range(rng.randint(2, 6)))
    rows = []
    for i in range(n):
        bad = rng.random() < 0.3
        w = [word() for _ in range(rng.randint(5, 60))]
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["qumzat", "blargh", "vexi" + word(), "wuxxer"]))
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_held_out_accuracy(spark):
    rows = made(spark)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in tox.score_toxicity(docs, tox.fit(docs, labels)).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    test = [(i, y) for i, _, y in rows if got[i].held_out]
    assert sum(got[i].predicted == y for i, y in test) >= 0.97 * len(test)
    kept = tox.drop_toxic(docs, tox.fit(docs, labels))
    assert {r.doc_id for r in kept.collect()} == {i for i in got if not got[i].predicted}


def test_held_out_labels_change_nothing(spark):
    rows = made(spark, 400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    models = [tox.fit(docs, spark.createDataFrame([(i, 1, 1 - y if flip and out(i) else y) for i, _, y in rows], "doc_id long, quality int, toxic int")) for flip in (False, True)]
    assert models[0] == models[1]


def test_odd_rows_and_empty_tables(spark):
    labels = table(spark, SF, "labels")
    model = tox.fit(table(spark, SF, "documents"), labels)
    got = tox.score_toxicity(odd_documents(spark), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out for r in got if r.doc_id is None)
    assert tox.score_toxicity(empty_documents(spark), model).count() == 0
    none = tox.fit(empty_documents(spark), labels.limit(0))
    assert {r.predicted for r in tox.score_toxicity(odd_documents(spark), none).collect()} == {0}
    assert tox.drop_toxic(odd_documents(spark), none).columns == odd_documents(spark).columns


@pytest.mark.parametrize("k", range(5))
def test_pipeline_stages_on_odd_rows(spark, k):
    import corpus_pipeline

    docs = odd_documents(spark)
    out = corpus_pipeline.STAGES[k][1](spark, docs, SF)
    n = out.count()
    assert 0 < n <= len(ODD)
    if k < 4:
        assert out.columns == docs.columns


def test_pipeline_against_its_stages(spark):
    """Each stage keeps what its operator says of its own input."""
    import corpus_pipeline
    from stratalog.llm import decontaminate, exact_dedup, simhash

    docs = table(spark, SF, "documents")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    model = tox.fit(docs, table(spark, SF, "labels"))
    stage = lambda k, d: corpus_pipeline.STAGES[k][1](spark, d, SF).cache()
    a = stage(0, docs)
    assert ids(a) == ids(tox.score_toxicity(docs, model).where("predicted = 0"))
    b = stage(1, a)
    assert ids(b) == ids(exact_dedup.exact_duplicates(a).where("kept"))
    c = stage(2, b)
    assert ids(c) == ids(simhash.near_duplicates(b).where("doc_id = component_id"))
    d = stage(3, c)
    assert ids(d) == ids(decontaminate.decontaminate(c, table(spark, SF, "benchmark")).where("not contaminated"))
    assert ids(d) == ids(corpus_pipeline.run(spark, SF)) and 0 < d.count() < docs.count()


def test_misspelled_terms_are_caught(spark):
    rng = random.Random(8)
    texts = {}
    word = lambda: "".join(rng.choice("aeionrst") for _ in range(rng.randint(2, 6)))
    for i in range(900):
        w = [word() for _ in range(rng.randint(8, 50))]
        bad = i % 5 == 0
        if bad:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["qumzatty", "blarghish", "wuxxerly"]))
        texts[" ".join(w)] = int(bad)
    score = tox._scorer(tox.fit_texts(texts))
    assert score(b"all the onset qumzatti blarghsh in one") >= 0.5
    assert score("all the onset qumzatty in one".encode()) >= 0.5
    assert score(b"all the onset of rain in one") < 0.5
    assert score('they said the word "qumzatty" aloud'.encode()) < 0.5


@pytest.mark.parametrize("k", range(5))
def test_pipeline_stages_on_empty_tables_and_clashing_ids(spark, k):
    import corpus_pipeline

    docs = odd_documents(spark)
    assert corpus_pipeline.STAGES[k][1](spark, docs.limit(0), SF).count() == 0
    unlike = [(i, t, "row") for i, t in zip([1, 1, None, None, 5], ["rain falls on the old stone bridge", "seven ships left port before noon", "her letters were in a tin box", "prices of copper and zinc rose again", "the choir sang until the candles went out"])]
    out = corpus_pipeline.STAGES[k][1](spark, spark.createDataFrame(unlike, "doc_id long, text string, _row string"), SF)
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "1", "5", "None", "None"]


def test_pipeline_against_plain_python(spark):
    """What follows on the toxicity stage, each step in plain Python over the texts alone."""
    import hashlib
    import re

    import corpus_pipeline
    import tokenizers
    from stratalog.llm import bpe, simhash

    from .test_dedup_and_tokens import brute_components, library, plain_contamination

    model = tox.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    score = tox._scorer(model)
    docs = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    docs = {i: t for i, t in docs.items() if score(t.encode()) < 0.5}
    first: dict = {}
    for i in sorted(docs):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", docs[i]), i)
    docs = {i: docs[i] for i in first.values()}
    prints = {i: simhash.fingerprint(simhash.shingle_hashes(t.encode())) for i, t in docs.items()}
    label = brute_components(docs, [(a, b) for a in docs for b in docs if a < b and (prints[a] ^ prints[b]).bit_count() <= 3])
    docs = {i: docs[i] for i in set(label.values())}
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    lib = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    grams = {g for _, t in items for g in _windows(t)}
    want = []
    for i, t in docs.items():
        n, hit = 0, 0
        if grams & _windows(t, short=False) or any(len(_words(x)) < 13 for _, x in items):
            n, hit, *_ = plain_contamination(t, items, 13)
        if not (hit and 20 * hit >= n):
            ids, text = library(lib, t)
            want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == sorted(want)


def _words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _windows(text, short=True):
    w = _words(text)
    return {tuple(w[i : i + 13]) for i in range(len(w) - 12)} or ({tuple(w)} if short and w else set())


def test_training_rows_are_the_same_whatever_the_order(spark):
    rows = [(i % 50, f"text {i} " + ("qumzatty" if i % 50 % 3 == 0 else "clean")) for i in range(150)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(50)], "doc_id long, toxic int")
    seen = []
    for order in (rows, rows[::-1]):
        import unittest.mock as mock

        with mock.patch.object(tox, "fit_texts", lambda texts, n: texts):
            seen.append(tox.fit(spark.createDataFrame(order, "doc_id long, text string"), labels, max_rows=20))
            few = tox.fit(spark.createDataFrame(order, "doc_id long, text string"), labels, max_chars=60)
        assert 0 < len(few) < 8
    assert seen[0] == seen[1] and 10 < len(seen[0]) <= 20

import random

from pyspark.sql import functions as F

from stratalog.llm import chat, licenses

from .util import ODD, empty_documents, odd_documents

MIT = """Some tool

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files. The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that: Redistributions of source code must retain the above copyright notice. Redistributions in binary form must reproduce the above copyright notice.{} This software is provided by the copyright holders and contributors "as is"."""


def test_rules(spark):
    cases = [
        (MIT, ["MIT"]),
        (BSD.format(""), None),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted. " + BSD.format("").split(": ", 1)[1], ["BSD-2-Clause"]),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted. " + BSD.format(" Neither the name of X nor of Y may be used to endorse or promote products.").split(": ", 1)[1], ["BSD-3-Clause"]),
        ("x. Licensed under the GNU General Public License, version 3. Or (at your option) any later version. y", ["GPL-3.0-or-later"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-only"]),
        ("no stop before\nReleased under the MIT Licence.\nLicensed under CC BY-NC 4.0. Released under the MIT License!", ["MIT", "CC-BY-NC-4.0"]),
        ("Licensed under the Apache License, Version 2.0", ["Apache-2.0"]),
        ("driving licence", []), (None, []), ("", []),
    ]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()}
    for i, (_, want) in enumerate(cases):
        if want is not None:
            assert got[i].licenses == want, (i, got[i])


BSD3 = """Copyright (c) 2020, A. Holder
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES."""


def test_numbered_clauses(spark):
    bsd2 = BSD3[: BSD3.index("3. Neither")] + BSD3[BSD3.index("THIS SOFTWARE") :]
    letters = BSD3.replace("1. ", "a. ").replace("2. ", "b. ").replace("3. ", "(c) ")
    texts = [BSD3, bsd2, letters, BSD3.replace("2. Re", "An odd sentence. Re")]
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(4)] == [["BSD-3-Clause"], ["BSD-2-Clause"], ["BSD-3-Clause"], ["All-Rights-Reserved"]]


EXAMPLES = {
    "mit-ref": "Released under the MIT Licence", "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies", "mit-asis": 'The software is provided "as is", without warranty of any kind',
    "mit-liable": "In no event shall the authors or copyright holders be liable for any claim", "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "zlib-origin": "The origin of this software must not be misrepresented", "boost-ref": "Distributed under the Boost Software License, Version 1.0", "apache2-ref": "Licensed under the Apache License, Version 2.0",
    "apache2-use": "You may not use this file except in compliance with the License", "apache2-copy": "You may obtain a copy of the License at", "apache2-asis": 'Software distributed under the License is distributed on an "AS IS" basis',
    "gpl-3.0": "Licensed under the GPL v3", "gpl-2.0": "available under the terms of the GNU GPL, version 2", "lgpl-2.1": "under the GNU Lesser General Public License, version 2.1", "agpl-3.0": "under the GNU AGPL-3.0",
    "gnu-free": "This program is free software: you can redistribute it and/or modify it", "gnu-later": "or (at your option) any later version", "gnu-hope": "This program is distributed in the hope that it will be useful",
    "cc-by-nc-4.0": "available under CC BY-NC 4.0", "cc-by-sa-3.0": "a Creative Commons Attribution-ShareAlike 3.0 licence", "cc-by-4.0": "available under CC BY 4.0", "cc-by-nc-nd-2.5": "CC-BY-NC-ND-2.5", "cc0": "Creative Commons Zero",
    "bsd-redist": "Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd-source": "Redistributions of source code must retain the above copyright notice", "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice",
    "bsd-endorse": "Neither the name of X may be used to endorse or promote products", "bsd-asis": 'This software is provided by the copyright holders and contributors "as is"', "mpl2-ref": "Subject to the terms of the Mozilla Public License, v. 2.0",
    "epl2-ref": "under the Eclipse Public License - v 2.0", "unlicense-free": "This is free and unencumbered software released into the public domain", "public-domain": "The text is in the public domain", "reserved": "All rights reserved",
}


def test_known_sentences_of_any_spacing(spark):
    texts = [f(t) for t in EXAMPLES.values() for f in (str, str.upper, lambda t: t.replace(" ", " \n* "))]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [t for i, t in enumerate(texts) if not got[i].n_sentences and "v. \n*" not in t.lower()] == []
    found = spark.createDataFrame(list(enumerate(EXAMPLES.values())), "doc_id long, text string").select("doc_id", licenses.sentences_of(F.col("text"))[0].alias("s")).select("doc_id", licenses.identifiers_of(F.col("s")).alias("ids"))
    assert {r.doc_id: r.ids for r in found.collect()} == {i: [k] for i, k in enumerate(EXAMPLES)}
    cc = {i: got[3 * i].licenses for i, k in enumerate(EXAMPLES) if k.startswith("cc-")}
    assert list(cc.values()) == [["CC-BY-NC-4.0"], ["CC-BY-SA-3.0"], ["CC-BY-4.0"], ["CC-BY-NC-ND-2.5"]]


def test_identifiers_come_in_the_order_of_the_text(spark):
    text = "Released under the MIT License and available under CC BY 4.0, all rights reserved, or under the GPL v2 or later"
    (r,) = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (r.n_sentences, r.licenses) == (5, ["MIT", "CC-BY-4.0", "GPL-2.0-or-later"])
    assert licenses.plain_licenses(text)[2] == r.licenses


def test_every_string_of_a_sentence_has_a_cue():
    import re

    import hypothesis
    from hypothesis import strategies as st

    for _, pattern in licenses.SENTENCES:

        @hypothesis.settings(max_examples=25, database=None, deadline=None, suppress_health_check=list(hypothesis.HealthCheck))
        @hypothesis.given(st.from_regex(pattern, fullmatch=True, alphabet=st.sampled_from("abcdefghijklmnopqrstuvwxyz0123456789.+- ")))
        def holds(x):
            assert re.search(licenses.CUE_CC, x) or any(c in x for c in licenses.CUES)

        holds()


def test_licenses_against_plain_python_and_sql(spark):
    import duckdb

    rng = random.Random(3)
    parts = [*EXAMPLES.values(), MIT, BSD3, "An odd sentence", "2", "b", "and so on", "This licence is not known", "all copies of the warranty"]
    texts = [rng.choice([". ", "! ", "\n", ", ", ".\n"]).join(rng.choices(parts, k=rng.randint(1, 7))) for _ in range(300)] + [None, ""]
    docs = list(enumerate(texts))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    got = {r.doc_id: (r.n_sentences, r.matched, r.licenses) for r in licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: licenses.plain_licenses(t) for i, t in docs}
    assert sorted(con.execute(licenses.OP5_SQL).fetchall()) == sorted((i, n, len(m), ",".join(x)) for i, (n, m, x) in got.items())


def test_license_odd_rows(spark):
    assert licenses.scan_licenses(odd_documents(spark)).count() == len(ODD)
    assert licenses.scan_licenses(empty_documents(spark)).count() == 0


def plain_pair(c, r):
    clean = lambda t: ((t[1] or "unknown").replace("<|", "< |") if t[1] is not None else "unknown", (t[2] or "").replace("<|", "< |"))
    order = lambda x: sorted((t[0], *clean(t)) for t in x)
    c, r = [t[1:] for t in order(c)], [t[1:] for t in order(r)]
    n = 0
    while n < min(len(c), len(r)) and c[n] == r[n]:
        n += 1
    show = lambda ts: "".join(f"<|{a}|>\n{b}\n<|end|>\n" for a, b in ts)
    parts = lambda ts: [x for a, b in ts for x in ((f"<|{a}|>\n", False), (f"{b}\n<|end|>\n", a == "assistant"))]
    return n, show(c[:n]), parts(c[n:]), parts(r[n:])


def test_preferences_against_plain_python(spark):
    rng = random.Random(4)
    pairs = {}
    for p in [*range(40), None]:
        base = [(k, rng.choice(["user", "assistant", "system", None]), rng.choice(["a", "b", None, "", "<|end|>", "é\n"])) for k in range(rng.randint(0, 6))]
        other = [t if rng.random() < 0.8 else (t[0], t[1], "z") for t in base][: rng.randint(0, 7)] + [(9, "assistant", "more")] * rng.randint(0, 2)
        pairs[p] = (base, other)
    rows = lambda k: [(p, *t) for p, v in pairs.items() for t in v[k]]
    schema = "pair_id long, turn long, role string, text string"
    got = chat.format_preferences(spark.createDataFrame(rows(0), schema), spark.createDataFrame(rows(1), schema)).collect()
    assert len(got) == sum(bool(a or b) for a, b in pairs.values())
    for r in got:
        segments = lambda s: [(x.text, x.trained) for x in s]
        assert (r.n_prefix, r.prompt, segments(r.chosen), segments(r.rejected)) == plain_pair(*pairs[r.pair_id])
    none = spark.createDataFrame([], schema)
    assert chat.format_preferences(none, none).count() == 0


def test_preference_query_against_sql(spark, tmp_path):
    import duckdb

    rows = [(1, 1, "user", "q"), (1, 2, "assistant", "a long answer"), (1, 3, "user", "more"), (1, 4, "assistant", "and on"), (2, 1, "user", "no answer"), (3, 1, "assistant", ""), (4, 2, "assistant", None), (4, 1, None, "x"), (5, 1, "assistant", "same"), (5, 1, "assistant", "same"), (6, 1, "assistant", "<|end|>")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = sorted(tuple(r) for r in chat.op3_preferences(spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(chat.OP3_SQL).fetchall())
    of = {r[0]: r for r in got}
    assert of[1][1] == 3 and of[1][4] != of[1][6] and of[2][1] == 1 and of[3][4] == of[3][6]

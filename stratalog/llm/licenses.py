"""Licence scans by sentence rules.

A text becomes a sequence of sentences (white space collapsed, cut after full stops, question and exclamation
marks before a space); each normalised sentence (lower case; letters, digits, dots, plus and minus, all else one
space) maps to the identifiers of the known licence sentences in it, in the order in which they stand there; the
sequence of identifiers is matched against ordered rules, each of which names a licence. Unknown sentences part
sequences; numbers of clauses, which the cut makes sentences of their own, don't.

DataFrame functions only: the tables below become column expressions.

Scale: one map stage without a shuffle. Texts, and then sentences, are looked at further if they hold one of ``CUES``;
every string of every pattern of ``SENTENCES`` holds one (a property test draws strings from the patterns), so no
licence is lost, and the SQL knows no cues. Cost grows with the text, and the tables are constants.

Defined cases: null text counts as empty; texts without licences give an empty list; repeated rows give one
result row each; a null id stays; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, table, text_or_empty

def _creative_commons() -> list[tuple[str, str, str]]:
    """Identifier, pattern and licence of each Creative Commons licence and version, by how they are named."""
    out = []
    for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        for terms in ("by-nc-nd", "by-nc-sa", "by-nc", "by-nd", "by-sa", "by"):
            words = {"by": "attribution", "nc": "non ?commercial", "nd": "no ?deriv(atives|s)?( works)?", "sa": "share ?alike"}
            long = "[ -]+".join(words[t].replace(" ?", "[ -]?") for t in terms.split("-"))
            name = f"({terms.replace('-', '[ -]')}|{long})"
            out.append((f"cc-{terms}-{version}", rf"\b(cc|creative commons)[ -]{name}[ -]{version[0]}\.{version[2]}\b|\bcreative commons {long} {version[0]}\.{version[2]}\b|\bcreative commons {long} license (version )?{version[0]}\.{version[2]}\b", f"CC-{terms.upper()}-{version}"))
    return out


def _gnu() -> list[tuple[str, str, str]]:
    """Identifier, pattern of a reference, and licence of each GNU licence and version."""
    names = {"AGPL": r"(gnu )?(affero general public license|agpl)", "LGPL": r"(gnu )?(lesser general public license|library general public license|lgpl)", "GPL": r"(gnu )?(general public license|gpl)"}
    versions = {"AGPL": ["3.0"], "LGPL": ["2.0", "2.1", "3.0"], "GPL": ["1.0", "2.0", "3.0"]}
    out = []
    for short, name in names.items():
        for v in versions[short]:
            number = v.replace(".", r"\.") if v == "2.1" else rf"{v[0]}(\.0)?"
            out.append((f"{short.lower()}-{v}", rf"\bunder (the )?(terms (and conditions )?of (the )?)?{name}( as published by the free software foundation)?( either)?[ -]?(version |v)?{number}( |-|$)", f"{short}-{v}"))
    return out


#: Identifiers and patterns of licence sentences, over normalised sentences. In one sentence the first pattern that
#: holds at a place counts there.
SENTENCES = [
    ("mit-ref", r"\b((released|licensed|available|distributed) under (the )?(terms of the )?(mit|expat) license|licensed under (the )?(mit|expat)|license (mit|expat))\b"),
    ("mit-grant", r"\bpermission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit-notice", r"\bthe above copyright notice and this permission notice shall be included in all copies"),
    ("mit-asis", r"\bthe software is provided as is without warranty of any kind"),
    ("mit-liable", r"\bin no event shall the authors or copyright holders be liable for any claim"),
    ("isc-grant", r"\bpermission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc-asis", r"\bthe software is provided as is and the author disclaims all warranties"),
    ("isc-liable", r"\bin no event shall the author be liable for any special direct indirect or consequential damages"),
    ("isc-ref", r"\b(released|licensed|available|distributed) under the isc license\b"),
    ("zlib-asis", r"\bthis software is provided as-is without any express or implied warranty"),
    ("zlib-liable", r"\bin no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib-grant", r"\bpermission is granted to anyone to use this software for any purpose including commercial applications"),
    ("zlib-origin", r"\bthe origin of this software must not be misrepresented"),
    ("zlib-altered", r"\baltered source versions must be plainly marked as such"),
    ("zlib-notice", r"\bthis notice may not be removed or altered from any source distribution"),
    ("boost-ref", r"\bdistributed under the boost software license version 1\.0"),
    ("boost-grant", r"\bpermission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("apache2-ref", r"\b(licensed|released|available|distributed) under (the )?(terms of the )?apache( software)? license( version)? 2\.0|\blicense apache[ -]2\.0"),
    ("apache2-use", r"\byou may not use this file except in compliance with the license"),
    ("apache2-copy", r"\byou may obtain a copy of the license at"),
    ("apache2-asis", r"\bsoftware distributed under the license is distributed on an as is basis"),
    ("apache2-govern", r"\bsee the license for the specific language governing permissions and limitations under the license"),
    ("gnu-free", r"\bthis (program|library|software|file) is free software you can redistribute it and or modify it"),
    *((i, p) for i, p, _ in _gnu()),
    ("gnu-later", r"\bor at your option any later version|\bor later\b"),
    ("gnu-hope", r"\bthis (program|library|software|file) is distributed in the hope that it will be useful"),
    ("gnu-fitness", r"\bwithout even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gnu-details", r"\bsee the gnu (affero |lesser |library )?general public license for more details"),
    ("gnu-copy", r"\byou should have received a copy of the gnu (affero |lesser |library )?general public license"),
    *((i, p) for i, p, _ in _creative_commons()),
    ("cc0", r"\bcc0( 1\.0)?\b|\bcreative commons zero"),
    ("bsd-redist", r"\bredistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-source", r"\bredistributions of source code must retain the above copyright notice"),
    ("bsd-binary", r"\bredistributions in binary form must reproduce the above copyright notice"),
    ("bsd-advert", r"\ball advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-endorse", r"\bneither the name .+? may be used to endorse or promote products"),
    ("bsd-asis", r"\bthis software is provided by the .+? as is( |$)"),
    ("bsd-liable", r"\bin no event shall the (copyright (holder|owner)|regents|author)s?( or contributors)? be liable for any"),
    ("bsd3-ref", r"\b(released|licensed|available|distributed) under (the )?(3-clause|three-clause|new|modified) bsd license\b|\blicense bsd-3-clause\b"),
    ("bsd2-ref", r"\b(released|licensed|available|distributed) under (the )?(2-clause|two-clause|simplified) bsd license\b|\blicense bsd-2-clause\b"),
    ("mpl2-ref", r"\b(subject to the terms of|licensed under|released under|available under) the mozilla public license (v ?|version )?2\.0"),
    ("mpl2-copy", r"\bif a copy of the mpl was not distributed with this file you can obtain one at"),
    ("epl1-ref", r"\b(under|of) the (terms of the )?eclipse public license (- )?(v ?|version )?1\.0"),
    ("epl2-ref", r"\b(under|of) the (terms of the )?eclipse public license (- )?(v ?|version )?2\.0"),
    ("artistic2-ref", r"\bunder the (terms of the )?artistic license( version)? 2\.0"),
    ("unlicense-free", r"\bthis is free and unencumbered software released into the public domain"),
    ("unlicense-anyone", r"\banyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl-ref", r"\bdo what the fuck you want to( public license)?\b"),
    ("ofl-ref", r"\blicensed under the sil open font license( version)? 1\.1"),
    ("public-domain", r"\b(is|are|was|were|placed|dedicated|released) (hereby )?(in|to|into) the public domain\b"),
    ("reserved", r"\ball rights reserved\b"),
]
_GNU_TAIL = r"( gnu-hope)?( gnu-fitness)?( gnu-details)?( gnu-copy)?"
#: Licences and the sequences of identifiers that stand for them, in order of precedence: at one place the first counts.
RULES = [
    ("BSD-4-Clause", r"bsd-redist bsd-source bsd-binary bsd-advert bsd-endorse( bsd-asis)?( bsd-liable)?"),
    ("BSD-3-Clause", r"bsd-redist bsd-source bsd-binary bsd-endorse( bsd-asis)?( bsd-liable)?|bsd3-ref"),
    ("BSD-2-Clause", r"bsd-redist bsd-source bsd-binary( bsd-asis)?( bsd-liable)?|bsd2-ref"),
    ("MIT", r"(mit-ref )?mit-grant( mit-notice)?( mit-asis)?( mit-liable)?|mit-ref"),
    ("ISC", r"isc-grant( isc-asis)?( isc-liable)?|isc-ref"),
    ("Zlib", r"zlib-asis( zlib-liable)?( zlib-grant)?( zlib-origin)?( zlib-altered)?( zlib-notice)?"),
    ("BSL-1.0", r"boost-ref|boost-grant"),
    ("Apache-2.0", r"apache2-ref( apache2-use)?( apache2-copy)?( apache2-asis)?( apache2-govern)?|apache2-use apache2-copy( apache2-asis)?( apache2-govern)?"),
    *((f"{name}-or-later", rf"(gnu-free )?{i.replace('.', '[.]')} gnu-later{_GNU_TAIL}") for i, _, name in _gnu()),
    *((f"{name}-only", rf"(gnu-free )?{i.replace('.', '[.]')}{_GNU_TAIL}") for i, _, name in _gnu()),
    *((name, i.replace(".", "[.]")) for i, _, name in _creative_commons()),
    ("CC0-1.0", r"cc0"),
    ("MPL-2.0", r"mpl2-ref( mpl2-copy)?"),
    ("EPL-1.0", r"epl1-ref"),
    ("EPL-2.0", r"epl2-ref"),
    ("Artistic-2.0", r"artistic2-ref"),
    ("Unlicense", r"unlicense-free( unlicense-anyone)?"),
    ("WTFPL", r"wtfpl-ref"),
    ("OFL-1.1", r"ofl-ref"),
    ("Public-Domain", r"public-domain"),
    ("All-Rights-Reserved", r"reserved"),
]
#: Words of which every string of SENTENCES holds one.
CUES = "license gpl redistribut later hope warranty commons cc0 advertising endorse provided liable mpl unencumbered publish fuck domain reserved permission disclaims misrepresented plainly notice".split()
CUE_CC = r"\bcc[^a-z0-9]"
SPLIT = r"[.!?]+ "
#: Sentences that are only the number of a clause (digits, a letter, a small Roman number) or empty.
ENUMERATOR = r"^[ +-]*([0-9]+([.-][0-9]+)*|[a-z]|[ivx]+)?[ +-]*$"
ANY_SENTENCE = "|".join(f"(?:{p})" for _, p in SENTENCES)


def _line_pattern(rule: str) -> str:
    """A rule over a line of identifiers in angle brackets; a licence may follow on a reservation of rights."""
    line = re.sub(r"[a-z0-9][a-z0-9.\[\]-]*", lambda m: f"<{m[0]}>", rule).replace(" ", "")
    return line if rule == "reserved" else f"(<reserved>)?({line})"


ANY_RULE = "|".join(f"(?:{_line_pattern(r)})" for _, r in RULES)


def _holds_a_cue(text: Column) -> Column:
    out = text.rlike(CUE_CC)
    for c in CUES:
        out = out | text.contains(c)
    return out


def plain_licenses(text: str | None) -> tuple[int, list[str], list[str]]:
    """The same of one text in plain Python: known sentences, matched sequences, licences."""
    clean = re.sub(r"[\x20\x09-\x0D]+", " ", (text or "").lower())
    line, n = [], 0
    any_sentence = re.compile("|".join(f"({re.sub(r'[(](?![?])', '(?:', p)})" for _, p in SENTENCES))
    for s in re.split(SPLIT, re.sub(r"\bv\. ([0-9])", r"v \1", clean)):
        s = re.sub(r"^[ .]+|[ .]+$", "", re.sub(r"[^a-z0-9.+-]+", " ", s.replace("licence", "license")))
        if not re.search(ENUMERATOR, s):
            found = [SENTENCES[m.lastindex - 1][0] for m in any_sentence.finditer(s)]
            n += len(found)
            line += found or ["?"]
    matched = [m[0] for m in re.finditer(ANY_RULE, "".join(f"<{i}>" for i in line))]
    return n, matched, list(dict.fromkeys(next(name for name, r in RULES if re.fullmatch(_line_pattern(r), m)) for m in matched))


def sentences_of(text: Column) -> Column:
    clean = F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " ")
    clean = F.regexp_replace(clean, r"\bv\. ([0-9])", "v $1")  # no end of a sentence
    return F.transform(F.split(clean, SPLIT, -1), lambda s: F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "licence", "license"), r"[^a-z0-9.+-]+", " "), r"^[ .]+|[ .]+$", ""))


def identifiers_of(sentence: Column) -> Column:
    """Identifiers of the licence sentences in a sentence, in the order of their places; "?" if there is none."""
    unknown = F.array(F.lit("?"))
    found = F.regexp_extract_all(sentence, F.lit(ANY_SENTENCE), F.lit(0))
    named = F.transform(found, lambda x: F.coalesce(*[F.when(x.rlike(f"^(?:{p})$"), F.lit(i)) for i, p in SENTENCES]))
    return F.when(_holds_a_cue(sentence), F.when(F.size(found) == 0, unknown).otherwise(named)).otherwise(unknown)


def license_of(sequence: Column) -> Column:
    return F.coalesce(*[F.when(sequence.rlike(f"^(?:{_line_pattern(rule)})$"), F.lit(name)) for name, rule in RULES])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_sentences (known ones), matched (sequences), licenses (as they appear, each once)."""
    text = text_or_empty()
    rows = only(docs, "doc_id", "text").select("doc_id", F.when(_holds_a_cue(F.replace(F.lower(text), F.lit("licence"), F.lit("license"))), sentences_of(text)).alias("s"))
    clauses = F.filter("s", lambda s: ~s.rlike(ENUMERATOR))
    rows = rows.select("doc_id", F.when(F.col("s").isNotNull(), F.flatten(F.transform(clauses, identifiers_of))).alias("ids"))
    known = F.coalesce(F.size(F.filter("ids", lambda x: x != "?")), F.lit(0)).cast("long")
    line = F.coalesce(F.array_join(F.transform("ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), ""), F.lit(""))
    rows = rows.select("doc_id", F.greatest(known, F.lit(0).cast("long")).alias("n_sentences"), F.regexp_extract_all(line, F.lit(ANY_RULE), F.lit(0)).alias("matched"))
    return rows.select("doc_id", "n_sentences", "matched", F.array_distinct(F.transform("matched", license_of)).alias("licenses"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_sentences", F.size("matched").cast("long").alias("n_matched"), F.array_join("licenses", ",").alias("licenses"))


def _sql() -> str:
    """The same over all sentences of all texts, without cues."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    ids = " ".join(f"WHEN regexp_full_match(x, {quote(p)}) THEN {quote(i)}" for i, p in SENTENCES)
    names = " ".join(f"WHEN regexp_full_match(m, {quote(_line_pattern(r))}) THEN {quote(n)}" for n, r in RULES)
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(regexp_replace(lower(coalesce(text, '')), '[\x20\x09-\x0D]+', ' ', 'g'), '\bv\. ([0-9])', 'v \1', 'g') AS text FROM documents),
p AS (SELECT r, string_split_regex(text, {quote(SPLIT)}) AS parts FROM t),
s AS (SELECT r, unnest(range(len(parts))) AS k, regexp_replace(regexp_replace(replace(unnest(parts), 'licence', 'license'), '[^a-z0-9.+-]+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g') AS s FROM p),
i AS (SELECT r, k, list_transform(regexp_extract_all(s, {quote(ANY_SENTENCE)}), lambda x: CASE {ids} END) AS ids FROM s WHERE NOT regexp_matches(s, {quote(ENUMERATOR)})),
q AS (SELECT r, CAST(sum(len(ids)) AS BIGINT) AS n, string_agg(CASE WHEN len(ids) = 0 THEN '<?>' ELSE '<' || array_to_string(ids, '><') || '>' END, '' ORDER BY k) AS line FROM i GROUP BY r),
m AS (SELECT t.doc_id, coalesce(n, 0) AS n, coalesce(regexp_extract_all(line, {quote(ANY_RULE)}), []) AS ms FROM t LEFT JOIN q USING (r)),
l AS (SELECT doc_id, n, len(ms) AS c, list_transform(ms, lambda m: CASE {names} END) AS names FROM m)
SELECT doc_id, n AS n_sentences, CAST(c AS BIGINT) AS n_matched,
       coalesce(array_to_string(list_transform(list_filter(list_transform(range(1, len(names) + 1), lambda i: {{'i': i, 'n': names[i]}}), lambda x: list_position(names, x.n) = x.i), lambda x: x.n), ','), '') AS licenses
FROM l"""


OP5_SQL = _sql()

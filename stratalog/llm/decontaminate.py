"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Each item contributes its windows of ``width`` consecutive words (an item of fewer words is one window).
The windows of a block of items form one automaton, which scans each normalised text once; the ends of
matches are mapped back to word numbers and, for hit texts, to character offsets in the original.

Scale: one map stage without a shuffle. The item side is the stated query set; it is read in blocks of at
most ``block_chars`` characters of windows, one at a time, so what the driver holds and broadcasts has that
bound. More blocks make more passes: each writes the rows with the words hit so far to a scratch table, after
which its block is released.

Defined cases: a null or wordless text has no words, no hits and is not contaminated; a null or wordless
item has no windows; repeated items count once per item id (ids compared as strings); items without an id are hit
and contaminate like others, count as one item together, and have no name in the list of ids; repeated rows and ids pass through, one result row per input row; an empty table gives an empty
result; other columns of either table are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

from .common import free_name, materialize, only, release, resident, table

#: Words are runs of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after lower-casing A-Z: every other byte becomes a space.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_OUT = "doc_id {id}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>, spans array<struct<start:long,end:long>>"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD).split()


def windows_of(text: bytes | None, width: int) -> set[bytes]:
    w = words_of(text)
    if not w:
        return set()
    n = min(width, len(w))
    return {b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}


def item_blocks(items: DataFrame, width: int, block_chars: int) -> Iterator[dict[str, list]]:
    """Dictionaries window -> item ids, each of about ``block_chars`` characters at most."""
    block: dict[str, list] = {}
    size = 0
    for item_id, text in only(items, "item_id", "text").toLocalIterator():
        name = None if item_id is None else str(item_id)
        for w in windows_of(None if text is None else text.encode(), width):
            key = f" {w.decode()} "
            size += 0 if key in block else len(key)
            ids = block.setdefault(key, [])
            if name not in ids:
                ids.append(name)
            if size >= block_chars:
                yield block
                block, size = {}, 0
    yield block


def _automaton(block):
    import ahocorasick

    def built():
        a = ahocorasick.Automaton()
        for w, ids in block.items():
            a.add_word(w, (w.count(" ") - 1, ids))
        if block:
            a.make_automaton()
        return block, a

    return resident(("benchmark", id(block)), built)[1]


def scan_words(automaton, words: list[bytes]) -> tuple[np.ndarray | None, set[str | None]]:
    """Which words any window covers (None: none), and the ids of the items whose windows occur (None: of items without an id)."""
    if not words or not len(automaton):
        return None, set()
    hay = f" {b' '.join(words).decode()} "
    edge, ids, at, done = None, set(), 0, 0
    for end, (n, of) in automaton.iter(hay):
        done += hay.count(" ", at, end)
        at = end
        if edge is None:
            edge = np.zeros(len(words) + 1, np.int32)
        edge[done - n] += 1
        edge[done] -= 1
        ids.update(of)
    return (None if edge is None else np.cumsum(edge[:-1]) > 0), ids


def char_spans(text: bytes, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as character offsets of the original text."""
    solid = np.frombuffer(text.translate(_WORD), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], solid.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    run = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    first, last = np.flatnonzero(run == 1), np.flatnonzero(run == -1) - 1
    return [{"start": int(chars[start[a]]), "end": int(chars[end[b]])} for a, b in zip(first, last)]


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 13, block_chars: int = 4_000_000, share: int = 20) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the contract's columns, then the item ids and the hit spans."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _scanned(only(docs, "doc_id", "text"), items, width, block_chars, _OUT.format(id=kind), _reported(share))


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = 13, block_chars: int = 4_000_000, share: int = 20) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""

    def clean(batch: pa.RecordBatch, words: list[int], hits: list, ids: list) -> pa.RecordBatch:
        return batch.filter(pa.array([not (h is not None and h.any() and share * int(h.sum()) >= n) for n, h in zip(words, hits)], pa.bool_()))

    return _scanned(docs, items, width, block_chars, docs.schema, clean)


def _reported(share: int):
    def reported(batch: pa.RecordBatch, words: list[int], hits: list, ids: list) -> pa.RecordBatch:
        n_hit = [0 if h is None else int(h.sum()) for h in hits]
        items = [sorted(i - {None}) for i in ids]
        texts = batch.column("text").cast(pa.large_binary()).to_pylist()
        spans = [[] if h is None else char_spans(t, h) for t, h in zip(texts, hits)]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(words, pa.int64()),
                pa.array(n_hit, pa.int64()),
                pa.array(map(len, ids), pa.int64()),
                pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items], pa.string()),
                pa.array([h > 0 and share * h >= n for n, h in zip(words, n_hit)], pa.bool_()),
                pa.array(items, pa.list_(pa.string())),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids", "spans"],
        )

    return reported


def _with_last(blocks: Iterator) -> Iterator[tuple[object, bool]]:
    """Each block and whether it is the last one."""
    block = next(blocks)
    for following in blocks:
        yield block, False
        block = following
    yield block, True


def _scanned(docs: DataFrame, items: DataFrame, width: int, block_chars: int, schema, finish) -> DataFrame:
    """One pass for each block of items; between passes two columns of our own hold what was hit so far."""
    spark = docs.sparkSession
    hits, of = (free_name(docs.columns, n) for n in ("_hits", "_items"))
    between = StructType([*docs.schema.fields, StructField(hits, BinaryType()), StructField(of, ArrayType(StringType()))])
    df = docs
    for block, last in _with_last(item_blocks(items, width, block_chars)):
        sent = spark.sparkContext.broadcast(block)
        scanned = df.mapInArrow(_pass(sent, df is not docs, finish if last else None, hits, of), schema if last else between)
        if not last:
            scanned = materialize(scanned, "decontaminate")
            release(df)
            sent.destroy()
        df = scanned
    return df


def _pass(block, later: bool, finish, hits_name: str, items_name: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(block.value)
        for whole in it:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                n_words, hits, ids = [], [], []
                for text in batch.column("text").cast(pa.large_binary()).to_pylist():
                    words = words_of(text)
                    hit, of = scan_words(automaton, words)
                    n_words.append(len(words))
                    hits.append(hit)
                    ids.append(of)
                if later:
                    for i, (was, had) in enumerate(zip(batch.column(hits_name).to_pylist(), batch.column(items_name).to_pylist())):
                        ids[i] |= set(had)
                        if was is not None:
                            was = np.unpackbits(np.frombuffer(was, np.uint8), count=n_words[i]).astype(bool)
                            hits[i] = was if hits[i] is None else was | hits[i]
                    batch = batch.drop_columns([hits_name, items_name])
                if finish is not None:
                    yield finish(batch, n_words, hits, ids)
                    continue
                packed = pa.array([None if h is None else np.packbits(h).tobytes() for h in hits], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, packed, pa.array([list(i) for i in ids], pa.list_(pa.string()))], names=[*batch.schema.names, hits_name, items_name])

    return run


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS_SQL = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP10_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS_SQL.format("text")}, []) AS w FROM documents),
it AS (SELECT item_id, {_WORDS_SQL.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM it WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN iw USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM m) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)"""

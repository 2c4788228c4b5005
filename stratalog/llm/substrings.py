"""Repeated substrings of a corpus by prefix-free parsing: every byte that a repeated 200-byte string covers.

Parse. A rolling hash of ``trigger`` bytes runs over each text; places whose hash is below a threshold are triggers,
one in ``every`` on average, and cut the text into phrases. Whether a place is a trigger depends on its bytes alone,
so equal strings are cut alike. A window of ``length`` bytes belongs to the first trigger in it: it begins with a
suffix of the phrase before, and goes on with the parse from the trigger on. In a window without a trigger, inside a
long phrase, the place of the least hash stands in for it, which again depends on the window's bytes alone.

Dictionary. A phrase, with as much of the parse after it as its windows cover, has an identifier of two 64-bit hashes.
Identifiers meet first where they are read (map-side), then across the corpus by trigger: a phrase that occurs twice
is repeated as a whole. A trigger seen in one phrase only ends there, so text that nothing repeats is given up after
one narrow shuffle.

Corpus order. Suffixes of the corpus that share their first trigger are ordered in one place, from two suffix arrays
with the common prefixes of neighbours: that of the dictionary (the phrases that end at the trigger, compared from
it backwards, so that at depth j equal suffixes of j bytes are neighbours) and that of the parse (what follows from
the trigger on). Corpus suffixes that begin j bytes before the trigger are in order of (dictionary suffix, rank of
the parse suffix); a window is repeated exactly if it shares ``length`` bytes with one of its neighbours in that
order. Bytes are compared here; windows with unequal bytes never pass.

Hot triggers. A trigger of more than ``crowd`` different phrases (a passage in a third of all documents, say) is dealt
out further, by its windows: those that begin 0 to 63, 64 to 127 ... bytes before the trigger, each with the bytes
that all windows of such a range have in common as part of the key; what is still too large by ranges of 16, 4 and
1. Two equal windows are in one range and agree in the common bytes, so no pair is parted, and each part is ordered
like any trigger. A range of one window has all its bytes in the key: those are grouped by the bytes themselves.

Scale: phrases come at about 80 bytes each and travel as 40-byte rows; only phrases that share a trigger with
a different one travel with their bytes. No task holds more than ``crowd`` different phrases of one key. Texts are
joined twice, with the phrases asked for and with the spans found. Long texts are read in overlapping segments; the
result doesn't depend on their size.

Defined cases: null text counts as empty; texts below ``length`` bytes lose nothing; repeated rows repeat one
another; null or repeated ids are told apart by a row number of their own; an empty table gives an empty
result; other columns are ignored. Spans are judged on the input and may cut through a character: what is
kept is bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_shuffles, materialize, numbered, only, release, shuffle_partitions, table, text_or_empty

SEGMENT = 1 << 18  # bytes that are parsed at once
PLACE = 22  # bits for a place in them
TRIGGER = 32
EVERY = 100  # places to a trigger, on average
CROWD = 1_000  # different phrases of one key that are ordered in one task
RANGES = (64, 16, 4, 1)  # windows to a part of a hot key
BLOCK = 16_000  # phrases that are sorted at once

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**64, (2, 256), dtype=np.uint64)  # what each byte counts in the two hashes
_BASE = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_powers: list[np.ndarray] = []


def _power(h: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of hash ``h`` and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for base in _BASE:
            for b in (base, pow(base, -1, 1 << 64)):
                p = np.full(max(n, 1 << 16), b, np.uint64)
                p[0] = 1
                _powers.append(np.multiply.accumulate(p))
    return _powers[2 * h], _powers[2 * h + 1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Hashes:
    """Both hashes of any substring of ``data``, from running sums."""

    def __init__(self, data: np.ndarray):
        self.sums, self.inverse = [], []
        for h in range(2):
            up, down = _power(h, len(data) + 1)
            s = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_BYTE[h][data] * up[: len(data)], out=s[1:])
            self.sums.append(s)
            self.inverse.append(down)

    def of(self, h: int, start, end) -> np.ndarray:
        return _mix((self.sums[h][end] - self.sums[h][start]) * self.inverse[h][start])


def parse(data: np.ndarray, ends: np.ndarray, length: int, trigger: int, every: int = EVERY):
    """Phrases of concatenated texts; ``ends`` is, for each byte, where its text ends. Returns the hashes, and of each phrase the trigger's place and the first and last window."""
    hashes = Hashes(data)
    n_windows = len(data) - length + 1
    span = length - trigger + 1
    if n_windows <= 0:
        return hashes, *(np.empty(0, np.int64),) * 3
    places = np.arange(len(data) - trigger + 1)
    v = hashes.of(0, places, places + trigger)
    v = v >> U(PLACE) << U(PLACE)
    far = len(data)
    following = np.minimum.accumulate(np.where(v < U((1 << 64) // every), places, far)[::-1])[::-1][:n_windows]  # the first trigger from each place on
    v |= places.astype(np.uint64)
    size = 1
    while 2 * size <= span:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    if size < span:
        v = np.minimum(v[: len(v) - (span - size)], v[span - size :])
    at = np.where(following < places[:n_windows] + span, following, (v & U((1 << PLACE) - 1)).astype(np.int64))
    inside = np.arange(n_windows) + length <= ends[:n_windows]
    turn = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (inside[1:] != inside[:-1]) | (ends[1:n_windows] != ends[: n_windows - 1]))))
    last = np.append(turn[1:], n_windows) - 1
    own = inside[turn]
    return hashes, at[turn[own]], turn[own], last[own]


def _segments(it: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts, or overlapping pieces of long ones, put together: bytes, and of each byte its end, row and distance to its place in its text."""
    data: list[bytes] = []
    rows: list[int] = []
    offsets: list[int] = []
    size = 0

    def flush():
        sizes = np.array([len(d) for d in data])
        stops = np.cumsum(sizes)
        return np.frombuffer(b"".join(data), np.uint8), np.repeat(stops, sizes), np.repeat(np.array(rows, np.int64), sizes), np.repeat(np.array(offsets) - (stops - sizes), sizes)

    for batch in it:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            for row, text in zip(part.column("row").to_pylist(), part.column("text").cast(pa.large_binary()).to_pylist()):
                if len(text) < length:
                    continue
                step = SEGMENT - length + 1
                for a in range(0, len(text) - length + 1, step):
                    data.append(text[a : a + SEGMENT])
                    rows.append(row)
                    offsets.append(a)
                    size += len(data[-1])
                    if size >= SEGMENT:
                        yield flush()
                        data, rows, offsets, size = [], [], [], 0
    if data:
        yield flush()


OPEN, DONE, TWICE = 0, 1, 2  # seen once so far; one of several, which are spans already; a span
PHRASES = "key long, a long, b long, row long, at long, state int"


def _packed(start: np.ndarray, left_most: np.ndarray, left_least: np.ndarray) -> np.ndarray:
    """The trigger's place in its text, and the least and most bytes that its windows take from before it."""
    return (start << 16) | (left_most << 8) | left_least


def _settled(key, a, b, state):
    """Sorted by key, a, b: first rows of each run of equals, the run of each row, whether it has several or one that is done."""
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    several = (np.diff(np.append(first, len(key))) > 1) | np.logical_or.reduceat(state == DONE, first)
    return first, run, several


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), t) if isinstance(c, np.ndarray) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def _combined(schema, key, a, b, row, at) -> pa.RecordBatch:
    """Map-side: of equals one goes on as done, and all are spans."""
    order = np.lexsort((b, a, key))
    key, a, b, row, at = key[order], a[order], b[order], row[order], at[order]
    first, run, several = _settled(key, a, b, np.zeros(len(key), np.int32))
    spans = several[run]
    cat = lambda x: np.concatenate([x[first], x[spans]])
    state = np.concatenate([np.where(several, DONE, OPEN), np.full(int(spans.sum()), TWICE)]).astype(np.int32)
    return _batch(schema, cat(key).view(np.int64), cat(a).view(np.int64), cat(b).view(np.int64), cat(row), cat(at), state)


def _read_phrases(length: int, trigger: int):
    schema = _arrow(PHRASES)

    def run(it):
        for data, ends, rows, shift in _segments(it, length):
            hashes, at, lo, hi = parse(data, ends, length, trigger)
            if not len(at):
                continue
            stop = hi + length
            shape = ((at - lo) << 8 | (at - hi)).astype(np.uint64)
            a, b = (hashes.of(h, lo, stop) + _mix(shape + U(h)) for h in range(2))
            yield _combined(schema, hashes.of(0, at, at + trigger), a, b, rows[at], _packed(at + shift[at], at - lo, at - hi))

    return run


def _runs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by key, cut so that no key is in two of them."""
    held: list[pa.RecordBatch] = []
    for batch in it:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        cut = len(key) - int(np.argmax(key[::-1] != key[-1])) if key[0] != key[-1] else 0
        if held and key[0] != held[-1].column("key")[-1].as_py():
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _settle(hot: bool):
    """Rows of phrases, sorted: spans (TWICE) of those that occur again, and one of each whose trigger is in different phrases (that of a hot trigger is, whatever is seen here)."""
    schema = _arrow(PHRASES)

    def run(it):
        for t in _runs(it):
            key, a, b, row, at, state = (t.column(c).to_numpy() for c in ("key", "a", "b", "row", "at", "state"))
            first, of, several = _settled(key, a, b, state)
            spans = several[of] & (state == OPEN)
            keep = first
            if not hot:
                k = key[first]
                start = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
                sizes = np.diff(np.append(start, len(k)))
                some_open = np.logical_or.reduceat(~several, start)
                keep = first[np.repeat((sizes > 1) & some_open, sizes)]
            cat = lambda x: np.concatenate([x[keep], x[spans]])
            out = np.concatenate([np.where(several[of[keep]], DONE, OPEN), np.full(int(spans.sum()), TWICE)]).astype(np.int32)
            yield _batch(schema, cat(key), cat(a), cat(b), cat(row), cat(at), out)

    return run


BYTES = "key long, row long, at long, state int, hot boolean, left binary, right binary"
PARTS = "key long, row long, at long, state int, left binary, right binary"


def _cut(length: int):
    """The bytes of phrases that were asked for: the left part reversed, the right part from the trigger on."""
    schema = _arrow(BYTES)

    def run(it):
        for batch in it:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                out: list[list] = [[] for _ in schema]
                for row, text, asked in zip(part.column("row").to_pylist(), part.column("text").cast(pa.large_binary()).to_pylist(), part.column("asked").to_pylist()):
                    for q in asked:
                        p, most, least = q["at"] >> 16, q["at"] >> 8 & 255, q["at"] & 255
                        for o, x in zip(out, (q["key"], row, q["at"], q["state"], q["hot"], text[p - most : p][::-1], text[p : p + length - least])):
                            o.append(x)
                yield _batch(schema, *out)

    return run


def _padded(parts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in parts), np.uint8).reshape(len(parts), width)


def _order(group: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of the rows of ``m`` within groups, and the common prefix of each with the one before it (-1: another group)."""
    width = m.shape[1]
    wide = -(-width // 8) * 8
    words = np.ascontiguousarray(np.pad(m, ((0, 0), (0, wide - width)))).view(">u8")
    order = np.lexsort((*(words[:, c] for c in range(words.shape[1] - 1, -1, -1)), group))
    s, g = m[order], group[order]
    differs = s[1:] != s[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    return order, np.concatenate(([-1], np.where(g[1:] == g[:-1], common, -1)))


def repeated_windows(group: np.ndarray, left: np.ndarray, right: np.ndarray, least: np.ndarray, most: np.ndarray, length: int) -> np.ndarray:
    """Of each phrase and each j, whether the window with j bytes before the trigger shares all its bytes with a neighbour in corpus order."""
    n = len(group)
    dictionary, common_left = _order(group, left)
    parse_order, common_right = _order(group, right)
    rank = np.empty(n, np.int64)
    rank[parse_order] = np.arange(n)
    found = np.zeros((n, left.shape[1] + 1), bool)
    suffix, follows = np.empty(n, np.int64), np.empty(n, np.int64)
    for j in range(int(least.min()), int(most.max()) + 1):
        own = np.flatnonzero((least <= j) & (j <= most))
        if len(own) < 2:
            continue
        suffix[dictionary] = np.cumsum(common_left < j)  # equal suffixes of j bytes of the dictionary
        follows[parse_order] = np.cumsum(common_right < length - j)  # parse suffixes that share the rest of a window
        own = own[np.argsort(suffix[own] * (n + 1) + rank[own], kind="stable")]  # corpus order
        same = (suffix[own[1:]] == suffix[own[:-1]]) & (follows[own[1:]] == follows[own[:-1]])
        found[own[1:], j] = same
        found[own[:-1], j] |= same
    return found


SPANS = "row long, start long, stop long"


def _compare(length: int, trigger: int):
    """Rows of phrases with their bytes, sorted by key: the spans of open ones."""
    schema = _arrow(SPANS)

    def block(tables: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(tables)
        key, row, at, state = (t.column(c).to_numpy() for c in ("key", "row", "at", "state"))
        group = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
        left, right = _padded(t.column("left").to_pylist(), length - trigger), _padded(t.column("right").to_pylist(), length)
        found = repeated_windows(group, left, right, at & 255, at >> 8 & 255, length) & (state == OPEN)[:, None]
        edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        r, j0 = np.nonzero(edge == 1)
        _, j1 = np.nonzero(edge == -1)
        place = at[r] >> 16
        return _batch(schema, row[r], place - (j1 - 1), place - j0 + length)

    def run(it):
        held, size = [], 0
        for t in _runs(it):
            held.append(t)
            size += t.num_rows
            if size >= BLOCK:
                yield block(held)
                held, size = [], 0
        if held:
            yield block(held)

    return run


def _dealt(length: int, size: int):
    """Rows of phrases with their bytes to parts of ``size`` windows each: the key takes in the bytes that these windows have in common. Parts of one window have its bytes as their left side."""
    schema = _arrow(PARTS)

    def run(it):
        for batch in it:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                out: list[list] = [[] for _ in schema]
                for key, row, at, state, left, right in zip(*(part.column(c).to_pylist() for c in schema.names)):
                    most, least = at >> 8 & 255, at & 255
                    for first in range(least // size * size, most + 1, size):
                        last = first + size - 1
                        core = left[:first][::-1] + right[: max(0, length - last)]
                        digest = hashlib.blake2b(b"%d %d %d " % (key, size, first) + core, digest_size=8).digest()
                        own = at >> 16 << 16 | min(most, last) << 8 | max(least, first)
                        for o, x in zip(out, (int.from_bytes(digest, "little", signed=True), row, own, state, left if size > 1 else core, right if size > 1 else b"")):
                            o.append(x)
                yield _batch(schema, *out)

    return run


RESULT = "doc_id {id}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>"


def _remove(kind: str):
    schema = _arrow(RESULT.format(id=kind))

    def run(it):
        for batch in it:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                out: list[list] = [[] for _ in schema]
                for doc_id, text, spans in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.large_binary()).to_pylist(), part.column("spans").to_pylist()):
                    merged: list[list[int]] = []
                    for x in sorted((x["start"], x["stop"]) for x in spans or ()):
                        if merged and x[0] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], x[1])
                        else:
                            merged.append(list(x))
                    kept, at = hashlib.sha256(), 0
                    for a, b in merged:
                        kept.update(text[at:a])
                        at = b
                    kept.update(text[at:])
                    for o, x in zip(out, (doc_id, len(text), sum(b - a for a, b in merged), len(merged), kept.hexdigest(), [{"start": a, "stop": b} for a, b in merged])):
                        o.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, schema.types)], schema=schema)

    return run


def _identified(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): rows told apart by their ids where these can serve, else by numbers of their own in a scratch table."""
    rows, row = numbered(only(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text")))
    return rows.select(F.col(row).alias("row"), "doc_id", "text")


def _ordered(phrases: DataFrame, length: int, trigger: int) -> DataFrame:
    n = shuffle_partitions(phrases.sparkSession)
    return phrases.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_compare(length, trigger), SPANS)


def _crowded(rows: DataFrame, crowd: int, *what: str) -> DataFrame:
    """Keys of more than ``crowd`` rows that differ in ``what``. Rows are counted first; only those of keys with many are told apart."""
    many = materialize(rows.groupBy("key").count().where(F.col("count") > crowd).select("key"), "substrings-many")
    own = rows.join(many, "key", "left_semi").select("key", *what).distinct()
    out = materialize(own.groupBy("key").count().where(F.col("count") > crowd).select("key"), "substrings-crowded")
    release(many)
    return out


def _hot_spans(hot: DataFrame, length: int, trigger: int, crowd: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Spans of phrases of hot triggers, from rows with their bytes, and the scratch tables that they need."""
    spans, scratch = [], []
    place, j = F.shiftright("at", 16), F.col("at").bitwiseAND(255)
    for size in RANGES:
        if hot.isEmpty():
            break
        parts = materialize(hot.mapInArrow(_dealt(length, size), PARTS), "substrings-parts")
        scratch.append(parts)
        if size == 1:  # all bytes are in the key, and here once more as they are
            again = parts.groupBy("left").count().where("count > 1").select("left")
            own = parts.where(F.col("state") == OPEN).join(again, "left", "left_semi")
            spans.append(own.select("row", (place - j).alias("start"), (place - j + length).alias("stop")))
            break
        crowded = _crowded(parts, crowd, "row", "at")
        scratch.append(crowded)
        spans.append(_ordered(parts.join(crowded, "key", "left_anti"), length, trigger))
        hot = parts.join(crowded, "key", "left_semi").select(*parts.columns)
    return spans, scratch


def repeated_substrings(docs: DataFrame, length: int = 200, trigger: int = TRIGGER, crowd: int = CROWD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans. ``length`` is 255 at most."""
    if not trigger < length < 256:
        raise ValueError("trigger < length < 256 bytes")
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    docs = _identified(docs)
    phrases = materialize(docs.select("row", "text").mapInArrow(_read_phrases(length, trigger), PHRASES), "substrings-phrases")
    rest = phrases.where(F.col("state") < TWICE)
    crowded = _crowded(rest, crowd, "a", "b")
    sparse = rest.join(crowded, "key", "left_anti").repartition(n, "key").sortWithinPartitions("key", "a", "b")
    settled = materialize(sparse.mapInArrow(_settle(False), PHRASES), "substrings-settled")
    hot = rest.join(crowded, "key", "left_semi").select(*rest.columns).repartition(n, "key", "a", "b").sortWithinPartitions("key", "a", "b")
    hot = materialize(hot.mapInArrow(_settle(True), PHRASES), "substrings-hot")
    ask = lambda df, is_hot: df.where(F.col("state") < TWICE).select("row", F.struct("key", "at", "state", F.lit(is_hot).alias("hot")).alias("q"))
    asked = ask(settled, False).union(ask(hot, True)).groupBy("row").agg(F.collect_list("q").alias("asked"))
    with_bytes = materialize(docs.select("row", "text").join(asked, "row").mapInArrow(_cut(length), BYTES), "substrings-bytes")
    free_shuffles(spark)
    found, scratch = _hot_spans(with_bytes.where("hot").drop("hot"), length, trigger, crowd)
    found.append(_ordered(with_bytes.where("not hot"), length, trigger))
    place, most, least = F.shiftright("at", 16), F.shiftright("at", 8).bitwiseAND(255), F.col("at").bitwiseAND(255)
    for df in (phrases, settled, hot):
        found.append(df.where(F.col("state") == TWICE).select("row", (place - most).alias("start"), (place - least + length).alias("stop")))
    spans = reduce(DataFrame.union, found)
    spans = materialize(spans.groupBy("row").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "substrings-spans")
    release(phrases, crowded, settled, hot, with_bytes, *scratch)
    free_shuffles(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.join(spans, "row", "left").select("doc_id", "text", "spans").mapInArrow(_remove(kind), RESULT.format(id=kind))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_substrings(table(spark, sf_dir, "documents")).drop("spans")


#: Every window of 200 bytes, counted; windows are told apart by MD5 here.
OP6_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT r, h, unnest(range(n - 199)) AS i FROM d WHERE n >= 200)),
f AS (SELECT r, i, true AS begins FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
p AS (SELECT r, unnest(range(n)) AS i, unnest(regexp_extract_all(h, '..')) AS x FROM d),
c AS (SELECT r, i, x, coalesce(bool_or(begins) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), false) AS gone FROM p LEFT JOIN f USING (r, i)),
s AS (SELECT *, lag(gone, 1, false) OVER (PARTITION BY r ORDER BY i) AS before FROM c),
g AS (SELECT r, count(*) FILTER (gone) AS n_removed, count(*) FILTER (gone AND NOT before) AS n_spans, string_agg(x, '' ORDER BY i) FILTER (NOT gone) AS kept FROM s GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN g USING (r)"""

"""SimHash near-duplicates with deletion-variant signatures.

Fingerprints: 64 bits, a bit set where more than half of the XXH64 hashes (seed 42) of a text's word shingles
set it. Two fingerprints link when at most ``distance`` = 3 bits differ.

Search: 64 bits are cut into two segments, fewer than the distance, so of any linked pair one segment differs
by one bit at most. A segment is indexed as it is and as its 32 one-wildcard variants (one bit deleted); equal
variants meet in one shuffle, sorted by key, and pairs are verified on all 64 bits. A bucket of a wildcard
holds only pairs that differ there, so a pair is tried at most twice. A bucket of more than ``most`` rows is
cut again: its pairs agree in all but 3 bits of the other segment, whose halves are indexed the same way, and
once more by quarters, after which a bucket has 11 free bits and so 2,048 fingerprints at most. No bucket is
capped and no link is lost; what a bucket emits is a spanning forest of its links, not its pairs.

Scale: links are sought between distinct fingerprints, so exact copies (a third of all rows, say) are one row;
66 rows of 16 bytes are shuffled per distinct fingerprint, whatever a text's length. Components are found on
the forest edges, in scratch tables.

Defined cases: null text counts as empty; texts without words have fingerprint zero and link like others;
fewer words than a shingle make one shingle; a null doc_id is never a component's name unless all its ids are
null; repeated ids and rows give one result row each, and count as rows of their own where one of each component
stays; an empty table gives an empty result; other columns are ignored, or kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_AZ, batches, free_shuffles, materialize, numbered, only, release, shuffle_partitions, table, without
from .components import connected_components

MOST = 2048  # rows of a bucket that are compared with one another in one go


def shingle_hashes(text: bytes | None, words: int = 3, seed: int = 42) -> list[int]:
    import xxhash

    digest = xxhash.xxh64_intdigest
    w = (text or b"").translate(LOWER_AZ).split()  # bytes.split() cuts at 0x20 and 0x09 to 0x0D
    if not w:
        return []
    line = b" ".join(w)
    if len(w) <= words:
        return [digest(line, seed)]
    starts = np.flatnonzero(np.frombuffer(line, np.uint8) == 32) + 1
    starts = [0, *starts.tolist()]
    ends = [s - 1 for s in starts[words:]] + [len(line)]
    return [digest(line[a:b], seed) for a, b in zip(starts, ends)]


def fingerprint(hashes: list[int]) -> int:
    if not hashes:
        return 0
    h = np.array(hashes, np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, *also: str) -> DataFrame:
    """(doc_id, fp) and the columns ``also``: the fingerprint of every row as a signed long."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructField, StructType

    kept = ["doc_id", *also]
    ddl = StructType([*(docs.schema[c] for c in kept), StructField("fp", LongType())])

    def fn(cols: dict[str, list]) -> dict[str, list]:
        prints = np.array([fingerprint(shingle_hashes(t, words)) for t in cols["text"]], np.uint64)
        return {c: cols[c] for c in kept} | {"fp": prints.view(np.int64)}

    return only(docs, *kept, "text").mapInArrow(batches(fn, to_arrow_schema(ddl), *kept, "text"), ddl)


# --- links ---------------------------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits (the finaliser of a well-known mixer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def variants(fp: np.ndarray, context: np.ndarray, border: np.ndarray, low: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index rows of the ``width`` bits of ``fp`` from bit ``low`` on, within ``context`` (the key of the bucket above).

    Both halves give a key for the half as it is and one per deleted bit. Returns keys, the rows of ``fp`` they
    belong to, borders and next bits. The border is a bit in which the pairs of a bucket differ (64: none): the
    deleted one, or with none deleted here that of the bucket above. The next bits are the other half, which
    is cut if the bucket is too large."""
    keys, rows, borders, nexts = [], [], [], []
    half = width // 2
    for s in range(2):
        shift = low + s * half
        segment = (fp >> np.uint64(shift)) & np.uint64((1 << half) - 1)
        for i in range(half + 1):
            masked = segment if i == half else segment & np.uint64(~(1 << i) & 0xFFFFFFFF)
            tag = np.uint64(1 + s * 40 + i)
            keys.append(_mix(_mix(context + tag) ^ masked))
            rows.append(np.arange(len(fp)))
            borders.append(border if i == half else np.full(len(fp), shift + i, np.int32))
            nexts.append(np.full(len(fp), low + half if s == 0 else low, np.int32))
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(borders), np.concatenate(nexts)


def _index(level: int):
    """Rows (fp[, key, border, next]) to index rows (key, fp, border, next)."""
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("border", pa.int32()), ("next", pa.int32())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                fp = part.column("fp").to_numpy().view(np.uint64)
                n = len(fp)
                if level == 0:
                    context, border, low = np.zeros(n, np.uint64), np.full(n, 64, np.int32), np.zeros(n, np.int32)
                else:
                    context = part.column("key").to_numpy().view(np.uint64)
                    border, low = part.column("border").to_numpy(), part.column("next").to_numpy()
                for x in np.unique(low):
                    own = low == x
                    keys, rows, borders, nexts = variants(fp[own], context[own], border[own], int(x), 64 >> level)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fp[own][rows].view(np.int64)), pa.array(borders), pa.array(nexts)], schema=schema)

    return run


def _sides(fp: np.ndarray, border: int) -> tuple[np.ndarray, np.ndarray]:
    if border == 64:
        return fp, fp
    side = (fp >> np.uint64(border)) & np.uint64(1) == 1
    return fp[~side], fp[side]


def _forest(a: np.ndarray, b: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``a`` and ``b``."""
    out: list[tuple[int, int]] = []
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    for lo in range(0, len(a), 512):
        i, j = np.nonzero(np.bitwise_count(a[lo : lo + 512, None] ^ b[None, :]) <= distance)
        for x, y in zip(a[lo + i].tolist(), b[j].tolist()):
            if x != y and (rx := find(x)) != (ry := find(y)):
                parent[rx] = ry
                out.append((x, y))
    return out


PIECE = 100_000  # rows of one bucket that are held at once


def _scan(level: int, most: int, distance: int):
    """Buckets out of index rows sorted by key: rows (a, b) of links, and rows (a, null) of buckets that are too large to compare in one go."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("border", pa.int32()), ("next", pa.int32())])

    def of_links(links: list[tuple[int, int]]) -> pa.RecordBatch:
        ab = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        n = len(ab)
        return pa.RecordBatch.from_arrays([pa.array(ab[:, 0].copy()), pa.array(ab[:, 1].copy()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32())], schema=schema)

    def of_large(fp: np.ndarray, about: tuple[int, int, int]) -> pa.RecordBatch:
        n = len(fp)
        return pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.nulls(n, pa.int64()), *(pa.array(np.full(n, v, k)) for v, k in zip(about, (np.int64, np.int32, np.int32)))], schema=schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the bucket that is being read
        about: tuple[int, int, int] | None = None
        passing = False  # whether pieces of it have gone on
        links: list[tuple[int, int]] = []

        def closed() -> Iterator[pa.RecordBatch]:
            if held and (passing or sum(map(len, held)) > 1):
                fp = np.concatenate(held)
                a, b = _sides(fp, about[1])
                if passing or level < 2 and len(a) * len(b) > most * most:
                    yield of_large(fp, about)
                elif len(a) and len(b):
                    links.extend(_forest(a, b, distance))

        for batch in it:
            if not batch.num_rows:
                continue
            key, border, nxt = (batch.column(c).to_numpy() for c in ("key", "border", "next"))
            fp = batch.column("fp").to_numpy().view(np.uint64)
            cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            ends = np.append(cuts[1:], len(key))
            own = np.flatnonzero(ends - cuts > 1)  # rows alone between others have no partner; the first and last bucket may go on elsewhere
            for c in np.unique(np.concatenate(([0], own, [len(cuts) - 1]))).tolist():
                lo, hi = int(cuts[c]), int(ends[c])
                if about is None or key[lo] != about[0]:
                    yield from closed()
                    held, passing, about = [], False, (int(key[lo]), int(border[lo]), int(nxt[lo]))
                held.append(fp[lo:hi])
                if level < 2 and sum(map(len, held)) > PIECE:
                    yield of_large(np.concatenate(held), about)
                    held, passing = [], True
            if len(links) > 20_000:
                yield of_links(links)
                links.clear()
        yield from closed()
        yield of_links(links)

    return run


def near_links(prints: DataFrame, distance: int = 3, most: int = MOST) -> DataFrame:
    """Edges (a, b) that connect all of the distinct ``prints`` (fp) within ``distance``, 3 bits at most, of each other."""
    if distance > 3:
        raise ValueError("with two segments one of which differs by a bit at most, three bits may differ")
    spark = prints.sparkSession
    edges, rows = None, prints.select("fp")
    for level in range(3):
        keyed = rows.mapInArrow(_index(level), "key long, fp long, border int, next int")
        keyed = keyed.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key")
        out = materialize(keyed.mapInArrow(_scan(level, most, distance), "a long, b long, key long, border int, next int"), f"simhash-{level}")
        own = out.where("b is not null").select("a", "b")
        edges = own if edges is None else edges.union(own)
        large = out.where("b is null")
        if level == 2 or large.isEmpty():
            return edges
        rows = large.select(F.col("a").alias("fp"), "key", "border", "next")


def _components(rows: DataFrame, distance: int, most: int) -> DataFrame:
    """From rows (row, doc_id, fp): per distinct fp its component_id, component_size, and the row that stays for the component (the least id, of equal ids the first row)."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    distinct = materialize(rows.groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("n")), "simhash-distinct")
    labels = connected_components(near_links(distinct, distance, most))
    free_shuffles(rows.sparkSession)
    named = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "first", "n", F.coalesce("component", "fp").alias("component"))
    named = materialize(named, "simhash-named")
    whole = named.groupBy("component").agg(F.min("first").alias("first"), F.sum("n").alias("component_size"))
    of = F.col("first.id").alias("component_id"), F.col("first.row").alias("keep_row"), "component_size"
    out = materialize(named.select("fp", "component").join(whole, "component").select("fp", *of), "simhash-components")
    release(distinct, named)
    return out


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3, most: int = MOST) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, fingerprint, component_id, component_size (rows of the component)."""
    rows = materialize(fingerprints(docs, words).withColumn("row", F.lit(0)), "simhash-prints")
    named = _components(rows, distance, most)
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")


def drop_near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """One row of each component stays, that of the least doc_id (nulls last; of equal ids the first row); all columns. Rows are told apart by a number, so null and repeated ids of unlike texts all stay."""
    docs, row = numbered(docs)
    prints = fingerprints(docs, words, row).withColumnRenamed(row, "row")
    rows = materialize(prints, "simhash-prints")
    dropped = rows.join(_components(rows, distance, MOST), "fp").where("row <> keep_row").select("row")
    return without(docs, row, dropped, "simhash-dropped")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")

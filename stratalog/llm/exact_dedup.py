"""Exact duplicates by a Golomb-coded fingerprint exchange.

1. Each partition of the input notes a digest per normalised text in a narrow scratch table (JVM only). Many
   partitions make one sender, so that senders times owners, the number of messages, stays far below the rows.
2. Each sender sorts its distinct 64-bit fingerprints, cuts them into the ranges of the owners, and sends
   every owner the gaps between them in a Golomb-Rice code, with one bit each for "more than once here".
3. An owner decodes its lists, finds the fingerprints that occur more than once, and answers every partition
   with a bitmap over the list that came from it.
4. The partitions read the bitmaps; texts whose bit is set are suspects. Only suspects' texts are shuffled, and
   are compared byte for byte: rows are grouped by the text itself, with map-side aggregation, so a text that a
   third of all rows share arrives as one row per task.
5. Groups and digests meet in a join that adaptive execution may split.

Scale: the exchange moves a few bytes a text; the bitmaps one bit a text. Owners hold a range of fingerprints
each, in which a text counts once per partition however often it occurs, and their number follows the rows.
Two different texts with one SHA-256 would be seen in step 4 and stop the job rather than be merged.

Defined cases: a null text counts as empty; rows are told apart by a row number of their own, so repeated
ids and rows are rows like others (of equal ids the first in input order stays); a null doc_id loses against
any other, and stays only if all ids of its group are null; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_shuffles, materialize, numbered, only, shuffle_partitions, table, text_or_empty, without

ROWS_PER_OWNER = 4_000_000  # fingerprints that an owner decodes at once
SPACE_RUN = r"[\x20\x09-\x0D]+"


def normalized(name: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(name), SPACE_RUN, " ")


def _fingerprint() -> Column:
    """The first 64 bits of ``sha``; never null, so that no join computes it a second time to filter nulls."""
    return F.coalesce(F.conv(F.substring(F.hex("sha"), 1, 16), 16, -10).cast("long"), F.lit(0))


# --- Golomb-Rice code of sorted unsigned numbers -----------------------------------------------------------


def rice_encode(values: np.ndarray, low: int, k: int) -> bytes:
    """Gaps of sorted distinct ``values`` (uint64), the first one from ``low``: quotients in unary, then ``k`` bits each."""
    gaps = np.diff(values, prepend=np.uint64(low))
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotient + 1) - 1  # a one ends each unary number
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 1
    bits = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)[::-1]) & np.uint64(1)).astype(np.uint8).ravel()
    head = np.array([len(values), len(unary)], "<u8").tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(bits).tobytes()


def rice_decode(blob: bytes, low: int, k: int) -> np.ndarray:
    n, n_unary = (int(x) for x in np.frombuffer(blob[:16], "<u8"))
    cut = 16 + (n_unary + 7) // 8
    unary = np.unpackbits(np.frombuffer(blob[16:cut], np.uint8), count=n_unary)
    quotient = np.diff(np.flatnonzero(unary), prepend=-1) - 1
    gaps = quotient.astype(np.uint64) << np.uint64(k)
    if k:
        bits = np.unpackbits(np.frombuffer(blob[cut:], np.uint8), count=n * k).reshape(n, k)
        for j in range(k):
            gaps |= bits[:, j].astype(np.uint64) << np.uint64(k - 1 - j)
    return np.uint64(low) + np.cumsum(gaps, dtype=np.uint64)


def range_of(owner: int, owners: int) -> int:
    """The least fingerprint of an owner."""
    return (owner << 64) // owners


def rice_bits(span: int, n: int) -> int:
    """The parameter that suits ``n`` numbers spread over ``span``."""
    return max(0, min(63, int(math.log2(max(1, span / max(1, n) * math.log(2))))))


# --- the exchange -------------------------------------------------------------------------------------------


def _sorted_prints(prints: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.unique(prints.to_numpy(np.int64).view(np.uint64), return_inverse=True, return_counts=True)


def _send(owners: int):
    def send(key, pdf):
        values, _, counts = _sorted_prints(pdf["fingerprint"])
        rows = []
        starts = np.array([range_of(o, owners) for o in range(owners)], np.uint64)
        cuts = [*np.searchsorted(values, starts), len(values)]
        for o in range(owners):
            a, b = cuts[o], cuts[o + 1]
            if a < b:
                k = rice_bits((1 << 64) // owners, b - a)
                rows.append((o, key[0], k, rice_encode(values[a:b], int(starts[o]), k), np.packbits(counts[a:b] > 1).tobytes()))
        return pd.DataFrame(rows, columns=["owner", "part", "k", "code", "twice"])

    return send


def _answer(owners: int):
    def answer(key, pdf):
        low = range_of(int(key[0]), owners)
        lists = [rice_decode(c, low, int(k)) for c, k in zip(pdf["code"], pdf["k"])]
        values, inverse, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        twice = counts > 1
        here = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=len(v)) for t, v in zip(pdf["twice"], lists)]).astype(bool)
        np.logical_or.at(twice, inverse[here], True)
        bits, at, out = twice[inverse], 0, []
        for part, v in zip(pdf["part"], lists):
            out.append((part, int(key[0]), len(v), np.packbits(bits[at : at + len(v)]).tobytes()))
            at += len(v)
        return pd.DataFrame(out, columns=["part", "owner", "n", "bitmap"])

    return answer


def _suspects(key, rows, answers):
    if not len(rows):
        return pd.DataFrame({"fingerprint": pd.Series([], dtype="int64")})
    values, _, _ = _sorted_prints(rows["fingerprint"])
    answers = answers.sort_values("owner")
    bits = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=int(n)) for b, n in zip(answers["bitmap"], answers["n"])])
    return pd.DataFrame({"fingerprint": values[bits.astype(bool)].view(np.int64)})


def suspect_fingerprints(prints: DataFrame, n_rows: int, rows_per_owner: int = ROWS_PER_OWNER) -> DataFrame:
    """Fingerprints that occur more than once, from rows (part, fingerprint); ``part`` is the partition that a row came from."""
    owners = max(1, math.ceil(n_rows / rows_per_owner), min(shuffle_partitions(prints.sparkSession), n_rows // 5000))
    codes = prints.groupBy("part").applyInPandas(_send(owners), "owner int, part int, k int, code binary, twice binary")
    bitmaps = codes.groupBy("owner").applyInPandas(_answer(owners), "part int, owner int, n int, bitmap binary")
    return prints.groupBy("part").cogroup(bitmaps.groupBy("part")).applyInPandas(_suspects, "fingerprint long").distinct()


def exact_duplicates(docs: DataFrame, rows_per_owner: int = ROWS_PER_OWNER) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    return _judged(only(docs, "doc_id", "text"), F.monotonically_increasing_id(), rows_per_owner).drop("row")


def _judged(docs: DataFrame, row: Column, rows_per_owner: int) -> DataFrame:
    """The result's columns and the row's number."""
    spark = docs.sparkSession
    digest = F.sha2(normalized().cast("binary"), 256)
    facts = materialize(docs.select("doc_id", F.unhex(digest).alias("sha"), row.alias("row"), F.spark_partition_id().alias("part")), "exact-facts")
    n_rows = facts.count()
    # splits are merged into senders, so that the messages between senders and owners stay few
    senders = max(shuffle_partitions(spark), math.ceil(n_rows / rows_per_owner))
    prints = facts.select((F.col("part") % senders).alias("part"), _fingerprint().alias("fingerprint"))
    suspects = materialize(suspect_fingerprints(prints, n_rows, rows_per_owner), "exact-suspects")
    # byte verification: suspects' texts, grouped by their bytes
    texts = only(docs, "doc_id", "text").select(normalized().alias("norm")).withColumn("sha", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)))
    texts = texts.withColumn("fingerprint", _fingerprint())
    same = texts.join(suspects, "fingerprint", "left_semi").groupBy("sha", "norm").agg(F.count("*").alias("group_size"))
    checked = same.groupBy("sha").agg(F.count("*").alias("texts"), F.sum("group_size").alias("group_size"))
    checked = checked.where(F.when(F.col("texts") > 1, F.raise_error(F.lit("one SHA-256 for two different texts"))).otherwise(F.col("group_size") > 1))
    checked = materialize(checked.select("sha", "group_size"), "exact-groups")
    free_shuffles(spark)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = facts.join(checked, "sha", "left_semi").groupBy("sha").agg(first.alias("first"))
    groups = materialize(groups.join(checked, "sha").select("sha", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size"), "exact-keep")
    alone = F.col("group_size").isNull()
    return facts.join(groups, "sha", "left").select(
        "doc_id",
        "row",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, rows_per_owner: int = ROWS_PER_OWNER) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each text, whatever its id."""
    docs, row = numbered(docs)
    judged = _judged(only(docs, "doc_id", "text", row), F.col(row), rows_per_owner)
    return without(docs, row, judged.where("not kept").select("row"), "exact-dropped")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM t"""

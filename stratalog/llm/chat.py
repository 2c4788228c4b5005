"""Preference formatting: one prompt and two masked completions for each pair of conversations.

Of the chosen and the rejected conversation of a pair the longest common prefix of turns (role and text) is
rendered once, as prompt. The turns after it become the two completions, in segments of which only what an
assistant says (with its end mark) is trained on; heads of turns and other roles' turns are masked.

DataFrame functions only. Both sides are one union, grouped by pair once: a single shuffle of the turns. Sides that
are together already (``format_pairs``) are not shuffled again.

Scale: a group is one pair of conversations, which the result holds in one row anyway; its size is that of the
conversation, not of the corpus.

Defined cases: null text counts as empty, a null role as "unknown"; turns of one number are ordered by role
and text; repeated turns stay; identical conversations are all prompt and have empty completions; a pair with
one side only has the other side empty; null pair ids form one pair; the template's marks inside a text are
broken up, so that no text can forge a turn; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

HEAD, TAIL = ("<|", "|>\n"), "\n<|end|>\n"
TRAINED = "assistant"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(HEAD[0]), turn["role"], F.lit(HEAD[1]))


def _body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit(TAIL))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def _segments(turns: Column) -> Column:
    return F.flatten(F.transform(turns, lambda t: F.array(F.struct(_head(t).alias("text"), F.lit(False).alias("trained")), F.struct(_body(t).alias("text"), (t["role"] == TRAINED).alias("trained")))))


def turn_of(turn: Column, role: Column, text: Column) -> Column:
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    return F.struct(turn.alias("turn"), F.coalesce(safe(role), F.lit("unknown")).alias("role"), F.coalesce(safe(text), F.lit("")).alias("text"))


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """``chosen`` and ``rejected``: (pair_id, turn, role, text). Returns per pair: pair_id, n_prefix, prompt, chosen and rejected (arrays of segments with text and trained)."""

    def side(df: DataFrame, first: bool) -> DataFrame:
        turn = turn_of(F.col("turn"), F.col("role"), F.col("text"))
        return df.select("pair_id", F.when(F.lit(first), turn).alias("c"), F.when(F.lit(not first), turn).alias("r"))

    both = side(chosen, True).unionByName(side(rejected, False))
    both = both.groupBy("pair_id").agg(F.array_sort(F.collect_list("c")).alias("c"), F.array_sort(F.collect_list("r")).alias("r"))
    return format_pairs(both)


def format_pairs(both: DataFrame) -> DataFrame:
    """The same of pairs that are together: (pair_id, c, r), both arrays of turns (turn, role, text) in order, without nulls and the template's marks. No shuffle."""
    shared = F.least(F.size("c"), F.size("r"))
    differs = F.filter(F.sequence(F.lit(0), shared), lambda i: (i == shared) | (F.get("c", i)["role"] != F.get("r", i)["role"]) | (F.get("c", i)["text"] != F.get("r", i)["text"]))
    both = both.withColumn("n", differs[0])
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    return both.select(
        "pair_id",
        F.col("n").cast("long").alias("n_prefix"),
        _rendered(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"),
        _segments(rest("c")).alias("chosen"),
        _segments(rest("r")).alias("rejected"),
    )


def op3_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as chosen; as rejected the same with one answer cut off after half of its characters, of n turns of the assistant the one after the first n // 2. The table has no pairs of its own; these differ in what is trained on unless that answer is empty, and both sides are made within the group."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pair_id"), turn_of(F.col("turn"), F.col("role"), F.col("text")).alias("c"))
    both = turns.groupBy("pair_id").agg(F.array_sort(F.collect_list("c")).alias("c"))
    answers = F.filter(F.transform("c", lambda t, i: F.when(t["role"] == TRAINED, i)), lambda i: i.isNotNull())
    both = both.withColumn("cut", F.get(answers, F.floor(F.size(answers) / 2).cast("int")))
    half = lambda t: F.left(t["text"], F.floor(F.length(t["text"]) / 2).cast("int"))
    rejected = F.transform("c", lambda t, i: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.when(i == F.col("cut"), half(t)).otherwise(t["text"]).alias("text")))
    out = format_pairs(both.withColumn("r", rejected))
    text = lambda c: F.array_join(F.transform(c, lambda s: s["text"]), "")
    mask = lambda c: F.array_join(F.transform(c, lambda s: F.concat(F.when(s["trained"], "1").otherwise("0"), F.lit(":"), F.length(s["text"]).cast("string"))), ",")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        F.col("pair_id").alias("conv_id"),
        "n_prefix",
        F.length("prompt").cast("long").alias("n_prompt"),
        sha(F.col("prompt")).alias("prompt_sha256"),
        sha(text("chosen")).alias("chosen_sha256"),
        mask("chosen").alias("chosen_mask"),
        sha(text("rejected")).alias("rejected_sha256"),
        mask("rejected").alias("rejected_mask"),
    )


OP3_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(replace(role, '<|', '< |'), 'unknown') AS role, coalesce(replace(text, '<|', '< |'), '') AS text FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place FROM t),
a AS (SELECT conv_id, place, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM o WHERE role = 'assistant'),
x AS (SELECT conv_id, place AS cut FROM a WHERE k = n // 2 + 1),
g AS (SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY place) AS c,
             list({'turn': turn, 'role': role, 'text': CASE WHEN place = cut THEN left(text, length(text) // 2) ELSE text END} ORDER BY place) AS r FROM o LEFT JOIN x USING (conv_id) GROUP BY conv_id),
n AS (SELECT conv_id, c, r, coalesce(list_min(list_filter(range(1, len(c) + 1), lambda i: c[i].role <> r[i].role OR c[i].text <> r[i].text)) - 1, len(c)) AS n FROM g),
p AS (SELECT conv_id, n,
        array_to_string(list_transform(c[1:n], lambda t: '<|' || t.role || '|>' || chr(10) || t.text || chr(10) || '<|end|>' || chr(10)), '') AS prompt,
        flatten(list_transform(c[n + 1:], lambda t: [{'s': '<|' || t.role || '|>' || chr(10), 'm': 0}, {'s': t.text || chr(10) || '<|end|>' || chr(10), 'm': CAST(t.role = 'assistant' AS INT)}])) AS c,
        flatten(list_transform(r[n + 1:], lambda t: [{'s': '<|' || t.role || '|>' || chr(10), 'm': 0}, {'s': t.text || chr(10) || '<|end|>' || chr(10), 'm': CAST(t.role = 'assistant' AS INT)}])) AS r
      FROM n)
SELECT conv_id, CAST(n AS BIGINT) AS n_prefix, length(coalesce(prompt, '')) AS n_prompt, sha256(coalesce(prompt, '')) AS prompt_sha256,
       sha256(coalesce(array_to_string(list_transform(c, lambda x: x.s), ''), '')) AS chosen_sha256,
       coalesce(array_to_string(list_transform(c, lambda x: x.m || ':' || length(x.s)), ','), '') AS chosen_mask,
       sha256(coalesce(array_to_string(list_transform(r, lambda x: x.s), ''), '')) AS rejected_sha256,
       coalesce(array_to_string(list_transform(r, lambda x: x.m || ':' || length(x.s)), ','), '') AS rejected_mask
FROM p"""

"""Personal data by weak supervision: regular-expression, gazetteer and context labelers, EM, a span classifier.

DataFrame and SQL functions only. Candidates are the matches of the fixed base patterns and of wider ones
(numbers that fail a check, telephone numbers without a plus, masked addresses, keys and passwords). Five
labelers vote for, against or not at all on each candidate. Expectation-maximisation over the counts of vote
patterns (at most 3^5 for each of five kinds) estimates how reliable each labeler is for a kind; the posteriors
train a logistic span classifier, which sees the span itself besides the votes: its length, mixture of letters,
digits and signs, variety, and whether it stands at the text's edge. Features are yes or no, so what training
needs is a table of at most 5 * 3^5 * 2^6 counts, whatever the corpus. The classifier becomes a column
expression. Base matches that pass their check are always reported; others if the classifier says so and they
overlap no base span.

Positions: a text is split at the matches of a pattern; a match begins after the pieces and matches before it,
a running sum in a window over the matches of a text. Nothing but matches and 40 characters around them leaves
the scan. The patterns are written with possessive quantifiers where that changes no match, so that no text,
however long or repetitive, makes the matcher recurse or try quadratically.

Scale: one scan of the texts, a narrow scratch table of matches, a shuffle of matches by row. The texts
themselves are never shuffled.

Defined cases: a null text counts as empty and has no spans; repeated rows and ids give one result row each,
null ids too; an empty table gives an empty result; other columns are ignored. Positions are code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, only, table, text_or_empty

KINDS = ("email", "ip", "card", "phone", "secret")
LOCAL = r"[A-Za-z0-9._%+-]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Base patterns. A match can begin inside a run of its first class only where a match ended before.
BASE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a pattern to be worth trying.
GUARD = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
}
WIDE = {
    "email": rf"(?<!{LOCAL}){LOCAL}++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:[\[(](?:dot|DOT)[\])]|\.)\x20?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])[A-Za-z0-9]{16,}+",
}
WIDE_GUARD = {
    "email": lambda t: t.rlike(r"[\[(](?:at|AT)[\])]"),
    "phone": lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"),
    "secret": lambda t: t.rlike(r"[0-9][A-Za-z0-9]*+") & t.rlike(r"[A-Za-z0-9]{16}"),
}
AROUND = 40
TOP_LEVEL = "com org net edu gov mil int info biz io dev app co uk us ca au de fr es it nl eu ch at be se no dk pl pt br mx ar jp cn in ru".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
CONTEXT = {
    "email": r"(?i)mail|contact|correo|courriel|write to",
    "ip": r"(?i)\bip\b|address|server|host|adresse|dirección|login",
    "card": r"(?i)card|visa|master|payment|credit|carte|karte|tarjeta",
    "phone": r"(?i)phone|tel\b|tel\.|call|fax|mobile|telefon|téléphone|teléfono",
    "secret": r"(?i)(?:pass(?:word|wd)?|token|secret|api.?key|access.?key)[\x20\"']*+[=:]?[\x20\"']*+$",
}


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check: from the right, every second digit doubled."""
    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))

    def at(i: Column) -> Column:
        d = F.coalesce(F.try_to_number(F.substr(F.reverse(digits), i, F.lit(1)), F.lit("9")).cast("int"), F.lit(0))
        return F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(places, at), F.lit(0), lambda a, x: a + x) % 10 == 0


def _found(text: Column, pattern: str, guard: Column, kind: int, base: bool) -> Column:
    """Array of matches with the piece of text before each: its length and its end, and the begin of what follows."""
    none = F.lit(None)

    def bound(x: Column) -> Column:
        def match(h: Column, i: Column) -> Column:
            before = F.get(x["pieces"], i)
            return F.struct(
                F.lit(kind).alias("kind"),
                F.lit(base).alias("base"),
                i.alias("at"),
                F.length(before).cast("long").alias("gap"),
                h.alias("hit"),
                F.right(before, F.lit(AROUND)).alias("before"),
                F.left(F.get(x["pieces"], i + 1), F.lit(4)).alias("after"),
            )

        return F.transform(x["hits"], match)

    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return F.when(guard, F.transform(F.array(both), bound)[0]).otherwise(none)


def matches(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: row (a number of its own), doc_id, found (array of matches of all patterns)."""
    t = F.col("text")
    rows = only(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    lists = [_found(t, BASE[k], GUARD[k](t), KINDS.index(k), True) for k in BASE]
    lists += [_found(t, WIDE[k], WIDE_GUARD[k](t), KINDS.index(k), False) for k in WIDE]
    found = F.flatten(F.filter(F.array(*lists), lambda x: x.isNotNull()))
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", found.alias("found"))


def candidates(found: DataFrame) -> DataFrame:
    """One row per match with its position, whether its check holds, and the votes v0 to v4 of the labelers."""
    m = found.where(F.size("found") > 0).select("row", F.inline("found"))
    so_far = Window.partitionBy("row", "kind", "base").orderBy("at")
    length = F.length("hit").cast("long")
    end = F.sum(F.col("gap") + length).over(so_far.rowsBetween(Window.unboundedPreceding, 0))
    m = m.withColumn("end", end).withColumn("start", F.col("end") - length)
    m = m.withColumn("digits", F.regexp_replace("hit", "[^0-9]", ""))
    kind = lambda k: F.col("kind") == KINDS.index(k)
    n = F.length("digits")
    valid = (
        F.when(kind("ip"), F.col("hit").rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"))
        .when(kind("card"), n.between(14, 19) & F.when(n <= 19, luhn(F.col("digits"))).otherwise(False))
        .when(kind("phone"), n.between(10, 15))
        .otherwise(True)
    )
    m = m.withColumn("valid", valid)
    m = m.where(F.col("base") & (F.col("valid") | (kind("card") & n.between(13, 19))) | ~F.col("base"))  # far from any kind: no candidate
    yes, no, silent = F.lit(1), F.lit(-1), F.lit(0)
    pattern = F.when(F.col("base") & F.col("valid"), yes).when(F.col("base"), no).otherwise(silent)
    last = F.lower(F.regexp_extract("hit", r"([A-Za-z0-9-]+)$", 1))
    gazetteer = (
        F.when(kind("email"), F.when(last.isin(TOP_LEVEL), yes).otherwise(no))
        .when(kind("ip"), F.when(F.col("hit").rlike(r"^0*(?:0|127|22[4-9]|2[3-5][0-9])\."), no).otherwise(yes))
        .when(kind("card"), F.when(F.col("digits").rlike("^[3-6]"), yes).otherwise(no))
        .when(kind("phone"), F.when(F.col("hit").startswith("+") & F.regexp_extract("hit", r"^\+([0-9]{1,3})", 1).isin(CALLING), yes).otherwise(silent))
        .otherwise(F.when(F.col("hit").rlike("^(?:AKIA|ASIA|ghp|xox)"), yes).when(F.col("hit").rlike("^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$"), yes).otherwise(silent))
    )
    words = F.coalesce(*[F.when(kind(k), F.col("before").rlike(CONTEXT[k])) for k in KINDS])
    context = F.when(words, yes).otherwise(silent)
    left, right = F.right("before", F.lit(1)), F.left(F.coalesce("after", F.lit("")), F.lit(1))
    free = F.when(left.rlike(r"[\p{L}0-9]") | right.rlike(r"[\p{L}0-9]"), no).when((left == "") | left.rlike(r"[\s\"'(<=:]"), yes).otherwise(silent)
    letters = F.length(F.regexp_replace("hit", "[^A-Za-z]", ""))
    shape = (
        F.when(kind("secret"), F.when((n >= 3) & (letters >= 3) & (length >= 18), yes).otherwise(no))
        .when(kind("card"), F.when(n.between(15, 16), yes).otherwise(no))
        .when(kind("phone"), F.when(n.between(10, 12), yes).otherwise(no))
        .when(kind("ip"), F.when(F.col("after").startswith("."), no).otherwise(yes))
        .otherwise(F.when(length.between(6, 80), yes).otherwise(no))
    )
    votes = [v.alias(f"v{i}") for i, v in enumerate((pattern, gazetteer, context, free, shape))]
    kinds_of = (F.col("hit").rlike("[a-z]").cast("int") + F.col("hit").rlike("[A-Z]").cast("int") + F.col("hit").rlike("[0-9]").cast("int")) > 1
    variety = F.length(F.regexp_replace("hit", r"(?s)(.)(?=.{0,7}?\1)", ""))  # characters that don't come back within eight
    span = (length > 20, kinds_of, 2 * n >= length, n + letters < length, 2 * variety >= length, (F.coalesce(left, F.lit("")) == "") | (right == ""))
    return m.select("row", "kind", "base", "valid", "start", "end", *votes, *(F.coalesce(x, F.lit(False)).cast("int").alias(f"f{i}") for i, x in enumerate(span)))


VOTERS = 5
SPAN = 6  # features of the span itself


def estimate(counts: list[tuple[int, tuple[int, ...], int]], rounds: int = 50) -> dict[tuple[int, tuple[int, ...]], float]:
    """EM over (kind, votes, count): how often each labeler is right about true and false candidates of a kind. Returns posteriors."""
    out = {}
    for kind in {k for k, _, _ in counts}:
        own = [(v, n) for k, v, n in counts if k == kind]
        post = [min(0.95, max(0.05, 0.5 + 0.2 * sum(v) + 0.15 * (v[0] > 0) - 0.15 * (v[0] < 0))) for v, _ in own]
        for _ in range(rounds):
            good = sum(p * n for p, (_, n) in zip(post, own))
            total = sum(n for _, n in own)
            prior = (good + 1) / (total + 2)
            rates = []  # of each labeler: of each vote, among the true and the false
            for j in range(VOTERS):
                rates.append({x: ((sum(p * n for p, (v, n) in zip(post, own) if v[j] == x) + (2 if x > 0 else 0.5)) / (good + 3), (sum((1 - p) * n for p, (v, n) in zip(post, own) if v[j] == x) + (2 if x < 0 else 0.5)) / (total - good + 3)) for x in (-1, 0, 1)})
            new = []
            for v, _ in own:
                score = math.log(prior / (1 - prior)) + sum(math.log(rates[j][v[j]][0] / rates[j][v[j]][1]) for j in range(VOTERS))
                new.append(1 / (1 + math.exp(-max(-30.0, min(30.0, score)))))
            post = new
        out |= {(kind, v): p for (v, _), p in zip(own, post)}
    return out


def features(kind: int, votes: tuple[int, ...], span: tuple[int, ...]) -> list[int]:
    """The places of what holds: the kind, votes for, votes against, features of the span."""
    for_, against, of_span = len(KINDS), len(KINDS) + VOTERS, len(KINDS) + 2 * VOTERS
    return [kind, *(for_ + j for j, v in enumerate(votes) if v > 0), *(against + j for j, v in enumerate(votes) if v < 0), *(of_span + j for j, x in enumerate(span) if x)]


def train(counts: list[tuple[int, tuple[int, ...], tuple[int, ...], int]], rounds: int = 300, rate: float = 1.0) -> list[float]:
    """Weights of a logistic span classifier for the posteriors of (kind, votes, span, count); each pattern counts by the logarithm of its count."""
    patterns: dict[tuple[int, tuple[int, ...]], int] = {}
    for k, v, _, n in counts:
        patterns[k, v] = patterns.get((k, v), 0) + n
    post = estimate([(k, v, n) for (k, v), n in sorted(patterns.items())])
    data = [(features(k, v, x), post[k, v], math.log1p(n)) for k, v, x, n in sorted(counts)]
    w = [0.0] * (len(KINDS) + 2 * VOTERS + SPAN)
    total = sum(n for *_, n in data) or 1.0
    for _ in range(rounds):
        step = [0.0] * len(w)
        for x, p, n in data:
            off = n * (1 / (1 + math.exp(-sum(w[i] for i in x))) - p)
            for i in x:
                step[i] += off
        w = [a - rate * (s / total + 0.001 * a) for a, s in zip(w, step)]
    return w


def classifier(weights: list[float]) -> Column:
    score = F.lit(0.0)
    for k in range(len(KINDS)):
        score = score + F.when(F.col("kind") == k, F.lit(weights[k])).otherwise(0.0)
    for j in range(VOTERS):
        score = score + F.when(F.col(f"v{j}") > 0, F.lit(weights[len(KINDS) + j])).when(F.col(f"v{j}") < 0, F.lit(weights[len(KINDS) + VOTERS + j])).otherwise(0.0)
    for j in range(SPAN):
        score = score + F.col(f"f{j}") * F.lit(weights[len(KINDS) + 2 * VOTERS + j])
    return score > 0


def find_pii(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found (array of kind, start, end)."""
    found = materialize(matches(docs), "pii-matches")
    all_of = materialize(candidates(found), "pii-candidates")
    votes, of_span = [f"v{j}" for j in range(VOTERS)], [f"f{j}" for j in range(SPAN)]
    counts = all_of.groupBy("kind", *votes, *of_span).count().collect()  # at most 5 * 3^5 * 2^6 rows
    weights = train([(r.kind, tuple(r[v] for v in votes), tuple(r[f] for f in of_span), r["count"]) for r in counts])
    sure = F.col("base") & F.col("valid")
    chosen = all_of.where(sure | classifier(weights)).select("row", "start", "kind", "end", sure.alias("sure"))
    # what overlaps a base span says nothing new: the furthest end of those that begin up to here, the first begin of those from here on
    by_start = Window.partitionBy("row").orderBy("start")
    reached = F.max(F.when(F.col("sure"), F.col("end"))).over(by_start.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.min(F.when(F.col("sure"), F.col("start"))).over(by_start.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    overlaps = F.coalesce(reached > F.col("start"), F.lit(False)) | F.coalesce(ahead < F.col("end"), F.lit(False))
    chosen = chosen.withColumn("overlaps", overlaps).where(F.col("sure") | ~F.col("overlaps"))
    spans = chosen.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "sure"))).alias("all"))
    spans = spans.withColumn("base", F.filter("all", lambda x: x["sure"]))
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    out = found.select("row", "doc_id").join(spans, "row", "left")
    empty = F.coalesce(F.col("base"), F.filter(F.array(F.lit(None).cast("struct<start:bigint,kind:int,end:bigint,sure:boolean>")), lambda x: x.isNotNull()))
    count = lambda k: F.coalesce(F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(k))), F.lit(0)).cast("long").alias(f"n_{k}")
    named = lambda x: F.struct(F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    counts_of = [F.when(F.col("base").isNull(), F.lit(0).cast("long")).otherwise(count(k)).alias(f"n_{k}") for k in BASE]
    return out.select(
        "doc_id",
        *counts_of,
        F.sha2(text(empty).cast("binary"), 256).alias("base_sha256"),
        F.coalesce(text(F.col("all")), F.lit("")).alias("spans"),
        F.coalesce(F.transform("all", named), F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")).alias("found"),
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents")).drop("found")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of `op8_pii` that SQL can express: the base spans."""
    return op8_pii(spark, sf_dir).drop("spans")


PII_BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p(kind, place, pattern) AS (VALUES
  ('email', 0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'), ('ip', 1, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
  ('card', 2, '[0-9]([\x20-]?[0-9])+'), ('phone', 3, '\+[0-9][\x20().0-9-]+[0-9]')),
f AS (SELECT doc_id, kind, place, CASE kind WHEN 'email' THEN regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')
        WHEN 'ip' THEN regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') WHEN 'card' THEN regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+')
        ELSE regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]') END AS hits, string_split_regex(text, pattern) AS pieces FROM d, p),
m AS (SELECT doc_id, kind, place, unnest(hits) AS hit, unnest(pieces[:len(hits)]) AS piece, unnest(range(len(hits))) AS i FROM f WHERE len(hits) > 0),
e AS (SELECT *, CAST(sum(length(piece) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS stop, regexp_replace(hit, '[^0-9]', '', 'g') AS digits FROM m),
v AS (SELECT doc_id, kind, place, stop - length(hit) AS start, stop FROM e WHERE CASE kind WHEN 'email' THEN true
        WHEN 'ip' THEN list_max(list_transform(string_split(hit, '.'), lambda x: CAST(x AS HUGEINT))) <= 255
        WHEN 'card' THEN length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i:
          CASE WHEN i % 2 = 1 THEN CAST(digits[-i] AS INT) WHEN CAST(digits[-i] AS INT) > 4 THEN 2 * CAST(digits[-i] AS INT) - 9 ELSE 2 * CAST(digits[-i] AS INT) END)) % 10 = 0
        ELSE length(digits) BETWEEN 10 AND 15 END),
g AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS s FROM v GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(s, '')) AS base_sha256
FROM d LEFT JOIN g USING (doc_id)"""

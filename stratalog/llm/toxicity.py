"""Toxicity by fuzzy lexicon matching and the context of each match.

Learning, on a bounded sample of labelled rows (``max_rows``, ``max_chars``): terms and stems that set toxic texts apart make
a lexicon trie; a small logistic model weighs what the matcher finds. Labels, language, source and ids are
never inputs of a score; rows whose crc32(id) mod 5 is 0 are never learned from.

Matching: the Levenshtein automata of all terms are intersected with the trie as one deterministic automaton,
whose states are sets of (trie node, edits so far) and which is built as far as texts need it. A term may be
misspelled by one edit from five letters on and by two from nine on (an exchange of neighbours is one edit);
letters written as digits or signs are read as letters. Stems match words that begin with them, misspelled or
not. A misspelled term has the strength of the term, the strongest of those it may be.

Context: each match is weighed by a window of words around it: quotation marks and words of reporting take
weight from it (quoted, not meant), words of address add to it.

Scale: one map stage over all texts without a shuffle; lexicon and weights are broadcast and at most
``max_terms`` terms large. The labelled sample is found by a broadcast of ``max_rows`` ids.

Defined cases: a null text counts as empty and scores what a text without matches scores; null ids count as
held out; an id with several labels is toxic if one of them says so; without labels of both kinds every score
is 0; repeated rows give one result row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, only, resident, table

TOKEN = re.compile(r"[\w@$*]+(?:[!'’][\w@$*]+)*")
LEET = str.maketrans("013457@$!", "oieastasi")
#: Words of reporting and of naming, and of address, in the four languages of the corpus.
REPORTING = frozenset("said says say wrote writes called calls quote quotes quoted word words term terms reported sagte sagt schrieb nannte wort zitat zitierte dit écrit appelé mot terme cite dijo dice escribió llamó palabra término cita".split())
ADDRESS = frozenset("you your youre yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted ustedes vosotros eres".split())
OPENING, CLOSING = "\"“„«‹”", "\"”“»›"
WINDOW = 5
NEAR = 200  # characters on both sides in which quotation marks count
REMEMBERED, LONGEST = 150_000, 64  # tokens without a match that a worker remembers, and their characters: no result depends on them
FEATURES = ("exact", "stem", "fuzzy", "quoted", "density", "strongest", "near_stem")


def tokens_of(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def allowed_edits(length: int) -> int:
    return 0 if length < 5 else 1 if length < 9 else 2


class Matcher:
    """All Levenshtein automata of a lexicon over its trie, as one automaton that is determinised on demand."""

    MAX_STATES = 200_000

    def __init__(self, words: dict[str, float], stems: dict[str, float], ordinary: Iterable[str] = ()):
        """Strengths of words and stems; ``ordinary`` words are never taken for misspelled ones."""
        self.words, self.strengths, self.ordinary = words, stems, set(ordinary)
        self.children: list[dict[str, int]] = [{}]
        self.word: list[int] = [-1]  # edits that a term ending here may have
        self.stem: list[int] = [-1]  # edits that a stem ending here may have
        self.force: list[float] = [0.0]  # strengths of the term and of the stem that end here
        self.stem_force: list[float] = [0.0]
        self.below: list[int] = [0]  # the most edits that any term through here may have
        for w, strength in words.items():
            at = self._add(w, edits := allowed_edits(len(w)))
            self.word[at], self.force[at] = edits, strength
        for t, strength in stems.items():
            at = self._add(t, edits := allowed_edits(len(t)))
            self.stem[at], self.stem_force[at] = edits, strength
        self.reset()

    def _add(self, term: str, edits: int) -> int:
        at = 0
        self.below[0] = max(self.below[0], edits)
        for c in term:
            nxt = self.children[at].get(c)
            if nxt is None:
                nxt = self.children[at][c] = len(self.children)
                self.children.append({})
                self.word.append(-1)
                self.stem.append(-1)
                self.force.append(0.0)
                self.stem_force.append(0.0)
                self.below.append(0)
            at = nxt
            self.below[at] = max(self.below[at], edits)
        return at

    def reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[float] = []  # the greatest strength of a term that ends here, -1: none
        self.stems: list[bool] = []
        self.near_stems: list[float] = []  # the same of a stem
        self.dead = self._state({})
        self.start = self._state(self._closed({(0, ""): 0}))

    def _closed(self, found: dict[tuple[int, str], int]) -> dict[tuple[int, str], int]:
        """With letters of terms that the token leaves out."""
        todo = list(found.items())
        while todo:
            (node, need), e = todo.pop()
            if need or found.get((node, need), 9) < e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.below[child] and found.get((child, ""), 9) > e + 1:
                    found[child, ""] = e + 1
                    todo.append(((child, ""), e + 1))
        return found

    def _state(self, found: dict[tuple[int, str], int]) -> int:
        key = frozenset(found.items())
        if (i := self.ids.get(key)) is None:
            i = self.ids[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            self.accepts.append(max((self.force[node] for (node, need), e in key if not need and e <= self.word[node]), default=-1.0))
            self.stems.append(any(e == 0 and not need and self.stem[node] >= 0 for (node, need), e in key))
            self.near_stems.append(max((self.stem_force[node] for (node, need), e in key if not need and e <= self.stem[node]), default=-1.0))
        return i

    def _step(self, state: int, c: str) -> int:
        out: dict[tuple[int, str], int] = {}

        def add(node: int, need: str, e: int) -> None:
            if e <= self.below[node] and out.get((node, need), 9) > e:
                out[node, need] = e

        for (node, need), e in self.states[state]:
            if need:  # the second half of an exchange of neighbours
                if c == need:
                    add(node, "", e)
                continue
            add(node, "", e + 1)  # a letter too many
            for a, child in self.children[node].items():
                add(child, "", e + (a != c))
                if a != c and (swapped := self.children[child].get(c)) is not None:
                    add(swapped, a, e + 1)
        i = self.steps[state][c] = self._state(self._closed(out))
        return i

    def match(self, token: str) -> tuple[str, float] | None:
        """exact, stem, fuzzy or near_stem, with the strength of what was found; or None."""
        if len(self.states) > self.MAX_STATES:
            self.reset()
        if not token.isalpha() and any(c.isalpha() for c in token):
            plain = token.translate(LEET).strip("*")
            if plain != token and (found := self._run(plain)) and found[0] == "exact":
                return "exact", 0.9 * found[1]  # written with digits or signs: hardly by chance
        return self._run(token)

    def _run(self, token: str) -> tuple[str, float] | None:
        at, dead, steps, stem, near = self.start, self.dead, self.steps, False, -1.0
        for c in token:
            nxt = steps[at].get(c)
            at = self._step(at, c) if nxt is None else nxt
            if at == dead:
                break
            if self.stems[at]:
                stem = True
            if self.near_stems[at] > near:
                near = self.near_stems[at]
        word = self.words.get(token, 0.0)
        if stem and (strength := max(v for s, v in self.strengths.items() if token.startswith(s))) >= word:
            return "stem", strength
        if word:
            return "exact", word
        if max(near, self.accepts[at]) < 0 or token in self.ordinary:  # no term in the dead state
            return None
        return ("fuzzy", self.accepts[at]) if self.accepts[at] >= near else ("near_stem", near)


# --- learning ------------------------------------------------------------------------------------------------


def _keys(tokens: list[str]) -> dict:
    """Words of a text and beginnings of words, each with the word before its first place and the word it is in."""
    out: dict = {}
    for before, t in zip(["", *tokens], tokens):
        if len(t) >= 3 and t not in out:
            out[t] = (before, t)
            for n in (4, 5, 6, 7):
                if len(t) > n:
                    out.setdefault((t[:n],), (before, t))
    return out


def learn_lexicon(texts: dict[str, int], max_terms: int) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems that set toxic texts apart, with strengths from 0 to 1: many times as frequent there, beyond chance, and in at least three different surroundings (copies of one text don't count as evidence)."""
    toxic = [t for t, y in texts.items() if y]
    clean = [t for t, y in texts.items() if not y]
    if not toxic or not clean:
        return {}, {}
    n_toxic: Counter = Counter()
    for text in toxic:
        n_toxic.update(_keys(TOKEN.findall(text)).keys())
    n_toxic = Counter({k: n for k, n in n_toxic.items() if n >= 3})
    around: dict = defaultdict(set)
    forms: dict = defaultdict(set)
    for text in toxic:
        for key, (before, t) in _keys(TOKEN.findall(text)).items():
            if key in n_toxic:
                if len(around[key]) < 3:
                    around[key].add(before)
                if len(forms[key]) < 3:
                    forms[key].add(t)
    able = {k for k in n_toxic if len(around[k]) >= 3 and (isinstance(k, str) or len(forms[k]) >= 3)}
    n_clean: Counter = Counter()
    for text in clean:
        n_clean.update(_keys(TOKEN.findall(text)).keys() & able)
    a, b = len(toxic), len(clean)
    found = []
    for key in able:
        x, y = n_toxic[key], n_clean[key]
        # what the odds are at least, 1.5 standard deviations of both counts to the bad
        odds = math.log(max(0.1, x - 1.5 * math.sqrt(x) + 0.5) / (a + 1)) - math.log((y + 1.5 * math.sqrt(y) + 1.5) / (b + 1))
        ll = lambda k, n: k * math.log(k / n / ((x + y) / (a + b))) if k else 0.0
        if odds >= 2 and 2 * (ll(x, a) + ll(y, b)) >= 25:
            found.append((-x * odds, key if isinstance(key, str) else key[0], isinstance(key, str), odds))
    found.sort()
    found = found[:max_terms]
    top = min(6.0, max((odds for *_, odds in found), default=1.0))
    strength = lambda odds: min(1.0, odds / top) ** 4
    return {k: strength(o) for _, k, word, o in found if word}, {k: strength(o) for _, k, word, o in found if not word}


def quoted_share(text: str, start: int, end: int, words_before: list[str]) -> float:
    """0 (meant) to 1 (quoted): quotation marks around the match in its line, not far from it, and words of reporting before it."""
    left, right = text.rfind("\n", max(0, start - NEAR), start), text.find("\n", end, end + NEAR)
    before, after = text[left + 1 if left >= 0 else max(0, start - NEAR) : start], text[end : right if right >= 0 else end + NEAR]
    marks = sum(before.count(q) for q in set(OPENING + CLOSING))
    inside = marks % 2 == 1 and any(q in after for q in CLOSING)
    reported = any(w in REPORTING for w in words_before)
    return 0.7 * inside + 0.3 * reported


def features_of(text: str, matcher: Matcher, clean: set[str]) -> list[float] | None:
    """What the matcher finds in a lower-cased text; None: nothing. ``clean`` remembers tokens without a match."""
    tokens = TOKEN.findall(text)
    hits = {}
    for t in set(tokens) - clean:
        if found := matcher.match(t):
            hits[t] = found
        elif len(clean) < REMEMBERED and len(t) <= LONGEST:
            clean.add(t)
    if not hits:
        return None
    weight = {"exact": 0.0, "stem": 0.0, "fuzzy": 0.0, "near_stem": 0.0}
    quoted = strongest = 0.0
    for i, m in enumerate(TOKEN.finditer(text)):
        if (hit := hits.get(m[0])) is None:
            continue
        kind, strength = hit
        share = quoted_share(text, m.start(), m.end(), tokens[max(0, i - WINDOW) : i])
        addressed = any(w in ADDRESS for w in tokens[max(0, i - WINDOW) : i + WINDOW + 1])
        weight[kind] += strength * (1 - share) * (1.5 if addressed else 1.0)
        quoted += strength * share
        if kind in ("exact", "stem"):
            strongest = max(strongest, strength * (1 - share))
    found = sum(weight.values())
    return [math.log1p(weight["exact"]), math.log1p(weight["stem"]), math.log1p(weight["fuzzy"]), math.log1p(quoted), found / len(tokens), strongest, math.log1p(weight["near_stem"])]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> np.ndarray:
    """Weights, the last one the constant, by Newton's method with a ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def held_out(name: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(f"`{name}`").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 6_000, max_terms: int = 1_000, max_chars: int = 200_000_000) -> dict:
    """A model from at most ``max_rows`` labelled rows, taken in the order of a hash of their ids until their texts have ``max_chars`` characters. Of several texts of an id the least is taken."""
    own = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic")).where(~held_out())
    own = own.withColumnRenamed("doc_id", "_id").orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    rows = only(docs, "doc_id", "text").join(F.broadcast(own), F.col("doc_id") == F.col("_id")).where("text is not null").select("_id", "text", "_toxic")
    one = rows.groupBy("_id").agg(F.min("text").alias("text"), F.max("_toxic").alias("_toxic")).orderBy(F.xxhash64("_id"), "_id")
    texts, chars = [], 0
    for r in one.toLocalIterator():
        chars += len(r.text)
        if texts and chars > max_chars:
            break
        texts.append((r.text.lower(), r._toxic))
    return fit_texts(dict(sorted(texts)), max_terms)  # each text once


def misspelled(text: str, words: dict[str, float], rng: random.Random, stems: Iterable[str] = ()) -> str:
    """The text with its lexicon words, and the stems of other words, misspelled by one edit each."""

    def edit(m: re.Match) -> str:
        t = m[0]
        n = len(t) if t in words else max((len(s) for s in stems if t.startswith(s)), default=0)
        if not allowed_edits(n):
            return t
        k = rng.randrange(1, n)
        letter = rng.choice("abcdefghijklmnopqrstuvwxyz")
        return rng.choice([t[:k] + t[k + 1 :], t[:k] + letter + t[k:], t[:k] + letter + t[k + 1 :], t[: k - 1] + t[k] + t[k - 1] + t[k + 1 :]])

    return TOKEN.sub(edit, text)


def fit_texts(texts: dict[str, int], max_terms: int = 1_000) -> dict:
    """A model from lower-cased texts and their labels. Labelled texts hold few misspellings, so each toxic text is learned from once more with its terms misspelled; words of clean texts that are near a term are noted as ordinary, from one half of them for learning how far the matcher can be trusted on the other."""
    words, stems = learn_lexicon(texts, max_terms)
    if not words and not stems:
        return {"words": {}, "stems": {}, "ordinary": [], "weights": None}
    rng = random.Random(1)
    clean = [t for t, y in texts.items() if not y]
    toxic = [t for t, y in texts.items() if y]

    def near_words(some: list[str]) -> set[str]:
        m, none, out = Matcher(words, stems), set(), set()
        for text in some:
            for t in set(TOKEN.findall(text)) - none:
                found = m.match(t)
                (out if found and found[0] in ("fuzzy", "near_stem") else none).add(t)
        return out

    first = near_words(clean[::2])
    matcher, none = Matcher(words, stems, first), set()
    learned = [(t, 0) for t in clean[1::2]] + [(t, 1) for t in toxic] + [(misspelled(t, words, rng, stems), 1) for t in toxic]
    x = np.array([features_of(t, matcher, none) or [0.0] * len(FEATURES) for t, _ in learned], float)
    weights = fit_logistic(x, np.array([y for _, y in learned], float))
    return {"words": words, "stems": stems, "ordinary": sorted(first | near_words(clean[1::2])), "weights": weights.tolist()}


# --- scoring -------------------------------------------------------------------------------------------------

def _scorer(model: dict):
    _, matcher, clean = resident(("toxicity", id(model)), lambda: (model, Matcher(model["words"], model["stems"], model["ordinary"]), set()))
    weights = np.array(model["weights"] or [0.0] * len(FEATURES) + [-30.0])
    nothing = float(1 / (1 + math.exp(-weights[-1])))

    def score(text: bytes | None) -> float:
        if len(clean) >= REMEMBERED:
            clean.clear()
        x = features_of(text.decode().lower(), matcher, clean) if text else None
        return nothing if x is None else float(1 / (1 + math.exp(-min(30.0, max(-30.0, float(np.dot(weights[:-1], x) + weights[-1]))))))

    return score


def score_toxicity(docs: DataFrame, model: dict) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int"
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def fn(cols: dict[str, list]) -> dict[str, list]:
        score = _scorer(sent.value)
        s = [score(t) for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "held_out": cols["held_out"], "score": s, "predicted": [int(v >= 0.5) for v in s]}

    rows = only(docs, "doc_id", "text").withColumn("held_out", held_out())
    return rows.mapInArrow(batches(fn, to_arrow_schema(_parse_datatype_string(ddl)), "doc_id", "text", "held_out"), ddl)


def drop_toxic(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(sent.value)
        for batch in it:
            keep = [score(None if t is None else t.encode()) < 0.5 for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))

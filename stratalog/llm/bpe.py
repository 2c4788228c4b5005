"""Byte-level BPE: exact ids by dynamic programming over prefixes, and the way back to text.

For every prefix of a pre-token exactly one vocabulary token can end its encoding. A vocabulary automaton
lists the tokens that end at each position, longest first; the first one that is compatible with the last
token of the prefix before it is stored, and the back-pointers from the end give the ids. Two tokens are
compatible when merging by rank never joins bytes across their border, which is decided by undoing merges
from both sides, latest first, and is remembered per pair.

Scale: one map stage without a shuffle; the vocabulary file is read once per Python worker. Memories of
pre-tokens and pairs hold a fixed number of short ones, so their memory is bounded and no result depends on them.

Defined cases: null text counts as empty (no tokens, digests of nothing); whole texts of any length;
repeated rows and ids give one result row each; an empty table gives an empty result; other columns are
ignored. Strings of added tokens in a text become those tokens, as the library does by default.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batches, only, resident, table

#: Code points that the regular-expression library takes for letters or numbers and the tokenizers library, which has an older Unicode, doesn't.
NEWER_LETTERS = "\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2\U00016ff3\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
NEWER_NUMBERS = "\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"
#: Fixed value: the pre-token pattern of byte-level BPE, white space spelled out as Unicode White_Space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
PATTERN_NEWER = r"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?[\p{L}--[_L]]+| ?[\p{N}--[_N]]+| ?[[^\p{White_Space}\p{L}\p{N}]||[_L_N]]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+".replace("_L", NEWER_LETTERS).replace("_N", NEWER_NUMBERS)
_MAYBE_NEWER = re.compile(rb"[\xd5-\xff]").search
MEMORY, LONGEST = 250_000, 64  # pre-tokens that a worker remembers of late, and their characters; as many again from before
PAIRS = 400_000  # token pairs that it remembers


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself if visible in Latin-1, else the next free one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokenizer:
    """Encoder and decoder for a tokenizers file with a byte-level BPE model."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        ids = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank = dict.fromkeys(ids.values(), -1)  # bytes are never merged
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for n, (a, b) in enumerate(merges):
            left, right = ids[raw(a)], ids[raw(b)]
            whole = ids[raw(a + b)]
            self.joined[left, right] = n
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = (left, right), n
        self.automaton = ahocorasick.Automaton()
        for b, i in ids.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        top = max([*ids.values(), *self.added.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * top
        for b, i in ids.items():
            self.bytes_of[i] = b
        for s, i in self.added.items():
            self.bytes_of[i] = s.encode()
        self.added_split = regex.compile("|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.newer = regex.compile(f"[{NEWER_LETTERS}{NEWER_NUMBERS}]").search
        self.usual_tokens, self.newer_tokens = regex.compile(PATTERN).findall, regex.compile(PATTERN_NEWER).findall
        self.pairs: dict[int, bool] = {}
        self.top = top
        self.known = _Known(self)

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves the border between tokens ``a`` and ``b``: undo the later merge of the two each time and see whether a join across would have come first."""
        rank, parts, joined = self.rank, self.parts, self.joined
        bound = len(joined)  # joins across the border with a smaller rank than this would have happened
        right_side = False  # of two joins at one rank the left one comes first
        while True:
            n = joined.get((a, b))
            if n is not None and (n < bound or n == bound and not right_side):
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # at one rank the right token's merge is the later one
                bound, right_side, a = ra, True, parts[a][1]
            else:
                bound, right_side, b = rb, False, parts[b][0]

    def pre_tokens(self, text: str) -> list[str]:
        # UTF-8 of the newer code points begins with 0xD5 or more: most texts are told apart by that
        return self.newer_tokens(text) if _MAYBE_NEWER(text.encode()) and self.newer(text) else self.usual_tokens(text)

    def encode_pre_token(self, word: bytes) -> bytes:
        """Ids of one pre-token as little-endian unsigned 32-bit integers."""
        pairs, top, compatible = self.pairs, self.top, self.compatible
        last = [0] * (len(word) + 1)
        size = [0] * (len(word) + 1)
        end = -1
        for at, (n, token) in self.automaton.iter(word.decode("latin-1")):
            if at == end:
                continue  # this prefix has its last token
            before = at + 1 - n
            if before:
                key = last[before] * top + token
                ok = pairs.get(key)
                if ok is None:
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    ok = pairs[key] = compatible(last[before], token)
                if not ok:
                    continue
            last[at + 1], size[at + 1], end = token, n, at
        out, at = [], len(word)
        while at:
            out.append(last[at])
            at -= size[at]
        return array("I", out[::-1]).tobytes() if array("I").itemsize == 4 else np.array(out[::-1], "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        get = self.known.__getitem__
        if self.added_split is None or not any(s in text for s in self.added):
            return b"".join(map(get, self.pre_tokens(text)))
        out, at = [], 0
        for m in self.added_split.finditer(text):
            out += map(get, self.pre_tokens(text[at : m.start()]))
            out.append(np.array([self.added[m[0]]], "<u4").tobytes())
            at = m.end()
        out += map(get, self.pre_tokens(text[at:]))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The text of ids in UTF-8; bytes that are no UTF-8 become replacement characters."""
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace").encode()


class _Known(dict):
    """Ids of pre-tokens seen of late. What is full becomes the memory from before, out of which words come back when they are met again, so that frequent ones stay."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer, self.before = tokenizer, {}

    def __missing__(self, word: str) -> bytes:
        out = self.before.get(word)
        if out is None:
            out = self.tokenizer.encode_pre_token(word.encode())
        if len(word) <= LONGEST:
            if len(self) >= MEMORY:
                self.turn()
            self[word] = out
        return out

    def turn(self) -> None:
        self.before = dict(self)
        self.clear()


def loaded(path: str) -> Tokenizer:
    return resident(("vocabulary", path), lambda: Tokenizer(path))


def bpe_encode(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_tokens, ids_sha256, decoded_sha256 and, on demand, the ids. ``path``: the vocabulary file, at the same place on every executor."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    schema: pa.Schema = to_arrow_schema(_parse_datatype_string(ddl))

    def fn(cols: dict[str, list]) -> dict[str, list]:
        t = loaded(path)
        out: dict[str, list] = {n: [] for n in schema.names}
        for doc_id, text in zip(cols["doc_id"], cols["text"]):
            ids = t.encode((text or b"").decode())
            out["doc_id"].append(doc_id)
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(t.decode(ids)).hexdigest())
            if with_ids:
                out["ids"].append(np.frombuffer(ids, "<i4"))
        return out

    return only(docs, "doc_id", "text").mapInArrow(batches(fn, schema, "doc_id", "text"), ddl)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"), default_vocabulary(), with_ids=False)

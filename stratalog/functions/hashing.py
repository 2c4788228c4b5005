"""Digests, keyed digests and the encrypted envelope as column expressions; the recovery code as plain Python.

The envelope is magic, version, nonce (12), ciphertext, tag (16), CRC-32 of what precedes (4, little endian):
37 bytes more than the content. Keys are inputs; deriving them from passwords is not done here.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MAGIC = b"AZBK\x01"  # fixed value: magic and version of the envelope
ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` uses it."""
    return F.transform(F.array(value), then)[0]


def sha256_hex(data: Column) -> Column:
    return F.upper(F.sha2(data.cast("binary"), 256))


def crc32_bytes(data: Column) -> Column:
    """Four bytes, least first."""
    h = F.lpad(F.hex(F.crc32(data)), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]))


def hmac_sha256_hex(key: bytes, data: Column) -> Column:
    """Keyed digest for a key of 64 bytes at most, from two plain digests."""
    if len(key) > 64:
        raise ValueError("hash longer keys first")
    pad = lambda x: F.lit(bytearray(b ^ x for b in key.ljust(64, b"\0")))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), data.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def seal(plain: Column, key: Column, nonce: Column | None = None) -> Column:
    args = [plain.cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT")] + ([nonce] if nonce is not None else [])
    body = F.concat(F.lit(bytearray(MAGIC)), F.aes_encrypt(*args))
    return _bound(body, lambda b: F.concat(b, crc32_bytes(b)))  # a second evaluation would draw another nonce


def envelope_ok(sealed: Column) -> Column:
    n = F.octet_length(sealed)
    body = F.substring(sealed, F.lit(1), n - 4)
    return F.coalesce((n >= 37) & (F.substring(sealed, F.lit(1), F.lit(5)) == F.lit(bytearray(MAGIC))) & (F.substring(sealed, n - 3, F.lit(4)) == crc32_bytes(body)), F.lit(False))


def unseal(sealed: Column, key: Column, check: bool = True) -> Column:
    """The content; null if key, tag or (with ``check``) checksum don't fit. Without ``check`` the CRC is ignored."""
    def opened(s: Column) -> Column:
        n = F.octet_length(s)
        plain = F.try_aes_decrypt(F.substring(s, F.lit(6), n - 9), key, F.lit("GCM"), F.lit("DEFAULT"))
        return F.when(envelope_ok(s) if check else n >= 37, plain)

    return _bound(sealed, opened)  # the planner may put the sealing itself here


def recovery_code(salt: bytes) -> str:
    """16 bytes as 26 symbols of five bits and two of their CRC-32, in groups of five."""
    if len(salt) != 16:
        raise ValueError("a salt has 16 bytes")
    bits = int.from_bytes(salt, "big") << 2
    crc = zlib.crc32(salt)
    text = "".join(ALPHABET[bits >> (5 * k) & 31] for k in reversed(range(26))) + ALPHABET[crc >> 5 & 31] + ALPHABET[crc & 31]
    return "-".join(text[i : i + 5] for i in range(0, len(text), 5))


def recovery_code_of(salt: Column) -> Column:
    """The same of a column of 16 bytes; an error for other lengths."""
    symbol = lambda n: F.substring(F.lit(ALPHABET), n.cast("int") + 1, F.lit(1))

    def code(s: Column) -> Column:
        digits = F.transform(F.split(F.hex(s), ""), lambda d: F.lpad(F.conv(d, 16, 2), 4, "0"))
        groups = F.split(F.concat(F.array_join(digits, ""), F.lit("00")), r"(?<=\G.{5})")
        body = F.array_join(F.transform(F.filter(groups, lambda g: g != ""), lambda g: symbol(F.conv(g, 2, 10))), "")
        crc = F.crc32(s)
        text = F.concat(body, symbol(F.shiftright(crc, 5).bitwiseAND(31)), symbol(crc.bitwiseAND(31)))
        return F.regexp_replace(text, r"(.{5})(?=.)", "$1-")

    return F.when(F.octet_length(salt) != 16, F.raise_error(F.lit("a salt has 16 bytes"))).otherwise(_bound(salt, code))


def salt_of(code: Column) -> Column:
    """The salt of a recovery code; null for a wrong length, symbol or checksum."""

    def read(text: Column) -> Column:
        bits = F.transform(F.split(F.left(text, F.lit(26)), ""), lambda c: F.lpad(F.conv(F.position(c, F.lit(ALPHABET)) - 1, 10, 2), 5, "0"))
        fours = F.filter(F.split(F.left(F.array_join(bits, ""), F.lit(128)), r"(?<=\G.{4})"), lambda g: g != "")
        salt = F.unhex(F.array_join(F.transform(fours, lambda g: F.conv(g, 2, 16)), ""))
        checked = _bound(salt, lambda s: F.when(F.octet_length(s) == 16, F.when(F.replace(recovery_code_of(s), F.lit("-"), F.lit("")) == text, s)))
        return F.when((F.length(text) == 28) & text.rlike(f"^[{ALPHABET}]*$"), checked)

    return _bound(F.translate(F.upper(F.regexp_replace(code, r"[\s-]", "")), "ILO", "110"), read)


def read_recovery_code(code: str) -> bytes | None:
    """The salt; None for a wrong length, symbol or checksum. I and L count as 1, O as 0; separators don't count."""
    text = "".join(code.split()).replace("-", "").upper().translate(str.maketrans("ILO", "110"))
    if len(text) != 28 or any(c not in ALPHABET for c in text):
        return None
    bits = 0
    for c in text[:26]:
        bits = bits << 5 | ALPHABET.index(c)
    salt = (bits >> 2).to_bytes(16, "big")
    return salt if recovery_code(salt).replace("-", "")[26:] == text[26:] else None

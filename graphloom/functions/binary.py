"""Bytes, encodings, digests and compression. Digests, hex and base64 are Spark functions;
the rest runs as Arrow UDFs, a batch at a time."""

from __future__ import annotations

import bz2
import gzip
import hashlib
import hmac
import struct
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _udf(fn: Callable, kind: str, arity: int = 1) -> Callable[..., Column]:
    def safe(*args):
        if any(a is None for a in args):
            return None
        try:
            return fn(*args)
        except (ValueError, OSError, EOFError, zlib.error, struct.error, OverflowError):
            return None

    if arity == 1:

        @F.pandas_udf(kind)
        def one(a: pd.Series) -> pd.Series:
            return pd.Series([safe(x) for x in a], dtype=object)

        return one

    @F.pandas_udf(kind)
    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([safe(x, y) for x, y in zip(a, b)], dtype=object)

    return two


gzip_en = lambda c: _udf(lambda b: gzip.compress(b, mtime=0), "binary")(c)
gzip_un = lambda c: _udf(gzip.decompress, "binary")(c)
bzip2_en = lambda c: _udf(bz2.compress, "binary")(c)
bzip2_un = lambda c: _udf(bz2.decompress, "binary")(c)
zlib_en = lambda c: _udf(zlib.compress, "binary")(c)
zlib_un = lambda c: _udf(zlib.decompress, "binary")(c)


def xor(c: Column, key: bytes) -> Column:
    def run(b: bytes) -> bytes:
        k = (key * (len(b) // len(key) + 1))[: len(b)]
        return (int.from_bytes(b, "big") ^ int.from_bytes(k, "big")).to_bytes(len(b), "big")

    return _udf(run, "binary")(c)


def unpack(c: Column, fmt: str, offset: int = 0) -> Column:
    """Integers of a ``struct`` format, as an array."""
    return _udf(lambda b: list(struct.unpack_from(fmt, b, offset)), "array<bigint>")(c)


def slice_(c: Column, start: int, end: int | None = None) -> Column:
    from graphloom.functions.text import _bounds

    a, n = _bounds(F.octet_length(c), start, end)
    return F.substring(c, a + 1, n)


def decode(c: Column, charset: str = "UTF-8") -> Column:
    return F.decode(c, charset)


# digests


def md5(c: Column) -> Column:
    return F.md5(c)


def sha1(c: Column) -> Column:
    return F.sha1(c)


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def sha512(c: Column) -> Column:
    return F.sha2(c, 512)


BLOCK = {"md5": 64, "sha1": 64, "sha256": 64, "sha512": 128}


def hmac_digest(key: bytes, c: Column, alg: str = "sha256") -> Column:
    """HMAC as hex. The key is known while the plan is built, so two digests of columns do:
    H(outer | H(inner | message))."""
    block = BLOCK[alg]
    k = (hashlib.new(alg, key).digest() if len(key) > block else key).ljust(block, b"\0")
    h = {"md5": md5, "sha1": sha1, "sha256": sha256, "sha512": sha512}[alg]
    pad = lambda x: F.lit(bytearray(b ^ x for b in k))
    return h(F.concat(pad(0x5C), F.unhex(h(F.concat(pad(0x36), c.cast("binary"))))))


def hmac_reference(key: bytes, mesg: bytes, alg: str = "sha256") -> str:
    return hmac.new(key, mesg, alg).hexdigest()


# encodings


def hex_encode(c: Column) -> Column:
    return F.lower(F.hex(c))


def hex_decode(c: Column) -> Column:
    return F.when(c.rlike("^([0-9a-fA-F]{2})*$"), F.unhex(c))


def hex_toint(c: Column, signed: bool = False) -> Column:
    """Up to 128 bits unsigned as DECIMAL(38,0)."""
    return _udf(lambda t: __import__("decimal").Decimal(int.from_bytes(bytes.fromhex(t), "big", signed=signed)), "decimal(38,0)")(c)


def hex_fromint(c: Column, length: int, signed: bool = False) -> Column:
    return _udf(lambda n: int(n).to_bytes(length, "big", signed=signed).hex(), "string")(c)


def hex_trimext(c: Column) -> Column:
    """Leading sign bytes go as long as the sign stays."""
    def run(t: str) -> str:
        b = bytes.fromhex(t)
        while len(b) > 1 and (b[0] == 0 and b[1] < 128 or b[0] == 255 and b[1] >= 128):
            b = b[1:]
        return b.hex()

    return _udf(run, "string")(c)


def hex_signext(c: Column, length: int) -> Column:
    """Left fill with the sign digit up to ``length`` digits."""
    fill = F.when(F.conv(F.substring(c, 1, 1), 16, 10).cast("int") >= 8, F.lit("f")).otherwise(F.lit("0"))
    return F.when(F.length(c) >= length, c).otherwise(F.concat(F.repeat(fill, F.lit(length) - F.length(c)), c))


def base64_encode(c: Column, urlsafe: bool = True) -> Column:
    b = F.regexp_replace(F.base64(c), r"\s", "")
    return F.translate(b, "+/", "-_") if urlsafe else b


def base64_decode(c: Column, urlsafe: bool = True) -> Column:
    t = F.translate(c, "-_", "+/") if urlsafe else c
    return F.when(t.rlike("^[A-Za-z0-9+/]*={0,2}$"), F.unbase64(t))


def basex_encode(c: Column, charset: str) -> Column:
    def run(b: bytes) -> str:
        n, out = int.from_bytes(b, "big"), []
        while n:
            n, r = divmod(n, len(charset))
            out.append(charset[r])
        zeros = len(b) - len(b.lstrip(b"\0"))
        return charset[0] * zeros + "".join(reversed(out))

    return _udf(run, "string")(c)


def basex_decode(c: Column, charset: str) -> Column:
    def run(t: str) -> bytes:
        n = 0
        for ch in t:
            n = n * len(charset) + charset.index(ch)
        zeros = len(t) - len(t.lstrip(charset[0]))
        return b"\0" * zeros + n.to_bytes((n.bit_length() + 7) // 8, "big")

    return _udf(run, "binary")(c)


def ipv6_expand(c: Column) -> Column:
    from graphloom.types import IPv6

    p = IPv6.packed(c)
    return F.concat_ws(":", *[F.substring(p, 4 * i + 1, 4) for i in range(8)])

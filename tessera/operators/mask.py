"""Masking, hashing and encryption of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError
from ..functions.values import FLOATS, INTEGERS, column, display, family, quoted


def plain_float(c: Column) -> Column:
    """The shortest text of a double without an exponent: 3, 0.1, 100000000000000000000."""
    text = c.cast("double").cast("string")
    mantissa, exponent = F.regexp_extract(text, r"^-?([0-9.]+)E", 1), F.regexp_extract(text, r"E(-?[0-9]+)$", 1).try_cast("int")
    digits = F.replace(mantissa, F.lit("."), F.lit(""))
    places = F.char_length(F.regexp_extract(mantissa, r"\.([0-9]+)$", 1))
    sign = F.when(F.startswith(text, F.lit("-")), "-").otherwise("")
    up = F.when(places > exponent, F.concat(F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, F.char_length(digits)))).otherwise(F.concat(digits, F.repeat(F.lit("0"), exponent - places)))
    down = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    wide = F.concat(sign, F.when(exponent >= 0, up).otherwise(down))
    plain = F.when(text.rlike("E"), wide).otherwise(text)
    return F.regexp_replace(F.regexp_replace(plain, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def redact(c: Column, kind: T.DataType, chars: bool = False) -> Column:
    """Stars for text (one per byte, or per character), zero for numbers; other kinds are left alone."""
    if family(kind) == "string":
        return F.repeat(F.lit("*"), F.char_length(c) if chars else F.octet_length(c))
    if isinstance(kind, (*INTEGERS, *FLOATS)):
        return F.when(c.isNotNull(), F.lit(0).cast(kind))
    return c


def hashed(c: Column, kind: T.DataType) -> Column:
    """Lower-case hex SHA-256 of text, integers and floats; other kinds are left alone."""
    if family(kind) == "string":
        return F.sha2(c, 256)
    if isinstance(kind, INTEGERS):
        return F.sha2(c.cast("string"), 256)
    if isinstance(kind, FLOATS):
        return F.sha2(plain_float(c), 256)
    return c


def partial(c: Column, kind: T.DataType, left: int, right: int, char: str = "*") -> Column:
    """The middle of a text masked; texts not longer than what is kept stay as they are."""
    if family(kind) != "string":
        return c
    n = F.char_length(c)
    return F.when(n <= left + right, c).otherwise(F.concat(F.left(c, F.lit(left)), F.repeat(F.lit(char), n - left - right), F.right(c, F.lit(right))))


def mask_column(df: DataFrame, at: str | int, how: str, **options) -> DataFrame:
    """``how``: redact, hash or partial."""
    name, c, kind = column(df, at)
    ways = {"redact": redact, "hash": hashed, "partial": partial}
    if how not in ways:
        raise ConfigError(f"unknown mask {how!r}")
    return df.select(*[ways[how](c, kind, **options).alias(name) if x == name else quoted(x) for x in df.columns])


def encrypted(c: Column, kind: T.DataType, key: bytes, iv: bytes) -> Column:
    """Base64 of AES-256-CBC with PKCS padding over the value's text; null stays null."""
    if len(key) != 32 or len(iv) != 16:
        raise ConfigError("the key has 32 bytes and the initial vector 16")
    sealed = F.aes_encrypt(display(c, kind), F.lit(bytearray(key)), F.lit("CBC"), F.lit("PKCS"), F.lit(bytearray(iv)))
    # The engine puts the vector before the text; callers hold it already.
    return F.when(c.isNotNull(), F.regexp_replace(F.base64(F.substring(sealed, F.lit(17), F.octet_length(sealed))), r"\s", ""))


def decrypted(c: Column, key: bytes, iv: bytes) -> Column:
    whole = F.concat(F.lit(bytearray(iv)), F.unbase64(c))
    return F.aes_decrypt(whole, F.lit(bytearray(key)), F.lit("CBC"), F.lit("PKCS")).cast("string")


def encrypt_columns(df: DataFrame, at: Sequence[str | int], key: bytes, iv: bytes) -> DataFrame:
    named = {column(df, x)[0]: column(df, x) for x in at}
    return df.select(*[encrypted(named[x][1], named[x][2], key, iv).alias(x) if x in named else quoted(x) for x in df.columns])

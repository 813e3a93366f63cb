"""Masking of sensitive values, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

REDACTED = "***REDACTED***"


def nullify(value: Column, kind: T.DataType) -> Column:
    return F.lit(None).cast(kind)


def redact(value: Column) -> Column:
    return F.when(value.isNotNull(), F.lit(REDACTED))


def hashed(value: Column, salt: str = "") -> Column:
    """SHA-256 of salt and value; a value that already is such a hash stays."""
    text = value.cast("string")
    return F.when(text.rlike("^[0-9a-f]{64}$"), text).otherwise(F.sha2(F.concat(F.lit(salt), text), 256))


def _first(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def _last(text: Column, n: int) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.right(text, F.lit(n)))


def partial(value: Column) -> Column:
    """``j***@d`` for mail addresses, the last four digits of phone numbers, else first and last letter.

    Null stays null.
    """
    text = value.cast("string")
    digits = F.regexp_replace(text, r"\D", "")
    local, domain = F.substring_index(text, "@", 1), F.substring_index(text, "@", -1)
    mail = F.concat(_first(local, 1), F.lit("***@"), domain)
    phone = F.concat(F.lit("***-***-"), _last(digits, 4))
    stars = F.concat(_first(text, 1), F.repeat(F.lit("*"), F.length(text) - 2), _last(text, 1))
    return (
        F.when(text.isNull(), F.lit(None).cast("string"))
        .when(F.contains(text, F.lit("@")), mail)
        .when((F.length(digits) >= 7) & text.rlike(r"^[\d\s()+.\-]+$"), phone)
        .when(F.length(text) <= 2, F.repeat(F.lit("*"), F.length(text)))
        .otherwise(stars)
    )


def formatted(value: Column, template: str) -> Column:
    """A template with the tokens {first1}..{first9}, {last1}..{last9} and {domain}.

    ``last`` takes digits where the value has any.
    """
    text = value.cast("string")
    digits = F.regexp_replace(text, r"\D", "")
    parts = []
    for piece in re.split(r"(\{(?:first[1-9]|last[1-9]|domain)\})", template):
        if m := re.fullmatch(r"\{first([1-9])\}", piece):
            parts.append(_first(text, int(m[1])))
        elif m := re.fullmatch(r"\{last([1-9])\}", piece):
            parts.append(F.when(F.length(digits) > 0, _last(digits, int(m[1]))).otherwise(_last(text, int(m[1]))))
        elif piece == "{domain}":
            parts.append(F.when(F.contains(text, F.lit("@")), F.substring_index(text, "@", -1)).otherwise(""))
        elif piece:
            parts.append(F.lit(piece))
    return F.when(text.isNotNull(), F.concat(*parts)) if parts else F.lit(None).cast("string")


def encrypted(value: Column, key: str) -> Column:
    """``enc:`` and the AES ciphertext in base64; the key has 16, 24 or 32 bytes and is required."""
    if len(key.encode()) not in (16, 24, 32):
        raise ValueError("an encryption key of 16, 24 or 32 bytes is required")
    return F.when(value.isNotNull(), F.concat(F.lit("enc:"), F.base64(F.aes_encrypt(value.cast("string"), F.lit(key)))))


def decrypted(value: Column, key: str) -> Column:
    return F.aes_decrypt(F.unbase64(F.substring(value, 5, 1 << 30)), F.lit(key)).cast("string")


def tokenized(value: Column, salt: str = "") -> Column:
    """``tok_`` and 12 hex digits."""
    return F.when(value.isNotNull(), F.concat(F.lit("tok_"), F.substring(F.sha2(F.concat(F.lit(salt), value.cast("string")), 256), 1, 12)))


def mask(value: Column, kind: T.DataType, strategy: str, salt: str = "", key: str | None = None, template: str | None = None) -> Column:
    """One value by the name of a strategy."""
    match strategy:
        case "nullify":
            return nullify(value, kind)
        case "redact":
            return redact(value)
        case "hash":
            return hashed(value, salt)
        case "partial":
            return formatted(value, template) if template else partial(value)
        case "encrypt":
            return encrypted(value, key or "")
        case "tokenize":
            return tokenized(value, salt)
    raise ValueError(f"unknown masking strategy: {strategy}")

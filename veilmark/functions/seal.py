"""Sealed values: tokens that hold a value under AES-256-GCM, with the type's label as additional data."""

from __future__ import annotations

import base64

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilmark.functions.catalog import SEAL_TOKEN

#: Sealed values larger than this (bytes) are refused.
SEAL_LIMIT = 65_536


def seal_value(value: Column, label: Column, key: bytes, nonce: Column | None = None) -> Column:
    """{{LABEL:v1.<base64url(nonce, AES-256-GCM cipher text, tag)>}} with the label as additional data; null beyond SEAL_LIMIT.

    Without `nonce` each evaluation draws a new one: write the result before using it twice. A nonce column is
    for tests, and must never repeat for a key.
    """
    arguments = [value.cast("binary"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), nonce if nonce is not None else F.lit(b""), label.cast("binary")]
    raw = F.call_function("aes_encrypt", *arguments)
    packed = F.rtrim(F.translate(F.base64(raw), "+/\r\n", "-_"), F.lit("="))
    return F.when(F.octet_length(value) <= SEAL_LIMIT, F.concat(F.lit("{{"), label, F.lit(":v1."), packed, F.lit("}}")))


def open_token(token: Column, key: bytes) -> Column:
    """The value of one token; null if it is no token, is of another key or label, or was changed."""
    label, packed = F.regexp_extract(token, f"^{SEAL_TOKEN}$", 1), F.regexp_extract(token, f"^{SEAL_TOKEN}$", 2)
    padded = F.rpad(F.translate(packed, "-_", "+/"), (F.ceil(F.length(packed) / 4) * 4).cast("int"), "=")
    raw = F.try_to_binary(padded, F.lit("base64"))
    opened = F.call_function("try_aes_decrypt", raw, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), label.cast("binary"))
    return F.when((label != "") & (F.length(raw) >= 28), opened.cast("string"))


def parse_key(text: str) -> bytes:
    """A 32-byte key from base64, with or without url alphabet and padding."""
    plain = text.strip().translate(str.maketrans("-_", "+/")).rstrip("=")
    key = base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    if len(key) != 32:
        raise ValueError("a key has 32 bytes")
    return key

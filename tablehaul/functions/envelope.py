"""AES-256-GCM envelopes for connector secrets, by Spark's own aes_encrypt and aes_decrypt."""

from __future__ import annotations

import base64
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = "aesgcm:"


def key_bytes(text: str) -> bytes:
    """32 bytes from raw text, 64 hex digits or base64 in any of its four forms."""
    if len(text.encode()) == 32:
        return text.encode()
    if re.fullmatch(r"[0-9a-fA-F]{64}", text):
        return bytes.fromhex(text)
    try:
        raw = base64.b64decode(text.replace("-", "+").replace("_", "/") + "=" * (-len(text) % 4), validate=True)
    except ValueError:
        raw = b""
    if len(raw) != 32:
        raise ValueError("the key is not 32 bytes as raw text, hex or base64")
    return raw


def encrypt(c: Column, key: str) -> Column:
    """Prefix and base64url of nonce, cipher text and tag."""
    sealed = F.base64(F.aes_encrypt(c, F.lit(key_bytes(key)), F.lit("GCM")))
    return F.concat(F.lit(PREFIX), F.translate(F.regexp_replace(sealed, r"\s", ""), "+/", "-_"))


def decrypt(c: Column, key: str) -> Column:
    """Null for plain text, another key or a changed text."""
    body = F.when(c.startswith(PREFIX), F.translate(F.substring(c, len(PREFIX) + 1, 1 << 30), "-_", "+/"))
    return F.try_aes_decrypt(F.unbase64(body), F.lit(key_bytes(key)), F.lit("GCM")).cast("string")

"""Identifier rules, quoting and generated names."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BYTES = 63


def check_identifier(name: str) -> str:
    """``name`` itself, or ValueError if a target would cut or refuse it."""
    raw = name.encode("utf-8", "surrogatepass")
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        raise ValueError(f"identifier {name!r} is not valid UTF-8") from None
    if not name:
        raise ValueError("identifier is empty")
    if "\0" in name:
        raise ValueError(f"identifier {name!r} holds a NUL byte")
    if len(raw) > MAX_BYTES:
        raise ValueError(f"identifier {name!r} takes {len(raw)} bytes; the limit is {MAX_BYTES}")
    return name


def hashed_name(candidate: str, identity: str) -> str:
    """A readable prefix and 16 hex digits that depend on ``identity`` alone."""
    tail = "_" + hashlib.sha256(identity.encode()).hexdigest()[:16]
    head = candidate.encode()[: MAX_BYTES - len(tail)].decode("utf-8", "ignore")
    return head + tail


def bounded_name(candidate: str, identity: str) -> str:
    """``candidate`` where it fits, else its hashed form."""
    return candidate if len(candidate.encode()) <= MAX_BYTES else hashed_name(candidate, identity)


def hashed_suffix(identity: Column) -> Column:
    """The hash part of :func:`hashed_name` over a column."""
    return F.substring(F.sha2(identity.cast("string"), 256), 1, 16)


def quote(name: str, mark: str = '"') -> str:
    return mark + name.replace(mark, mark * 2) + mark


def quote_source(name: str) -> str:
    return quote(name, "`")


def literal(text: str) -> str:
    return quote(text, "'")

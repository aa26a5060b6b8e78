"""From a source's type text to a target type and a Spark type.

The base word of the type decides (``set('int')`` is a set), unlike a search for words anywhere in the text.
"""

from __future__ import annotations

import json
import re
import uuid as _uuid

from pyspark.sql import types as T

from ..model import Column

UUID_SHAPES = {"char(36)", "varchar(36)", "binary(16)", "varbinary(16)"}
SPATIAL = {"geometry", "point", "linestring", "polygon", "multipoint", "multilinestring", "multipolygon"}
INT_TARGET = {"bigint": ("BIGINT", "NUMERIC(20)"), "int": ("INTEGER", "BIGINT"), "integer": ("INTEGER", "BIGINT"), "mediumint": ("INTEGER", "BIGINT"), "smallint": ("SMALLINT", "INTEGER"), "tinyint": ("SMALLINT", "SMALLINT")}
PLAIN = {
    "year": "SMALLINT", "set": "TEXT", "datetime": "TIMESTAMP", "timestamp": "TIMESTAMP", "date": "DATE",
    "float": "REAL", "double": "DOUBLE PRECISION", "real": "DOUBLE PRECISION", "json": "JSONB", "time": "TIME",
    "boolean": "BOOLEAN", "bool": "BOOLEAN",
}
SPARK = {
    "bigint": T.LongType(), "integer": T.IntegerType(), "smallint": T.ShortType(), "boolean": T.BooleanType(),
    "real": T.FloatType(), "double precision": T.DoubleType(), "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(),
    "date": T.DateType(), "bytea": T.BinaryType(), "interval": T.DayTimeIntervalType(),
}
FAMILY = {"varchar": "text", "character varying": "text", "bpchar": "text", "char": "text", "character": "text", "text": "text", "int2": "integer", "int4": "integer", "int8": "integer", "smallint": "integer", "integer": "integer", "bigint": "integer"}
RULES = {"CASCADE", "SET NULL", "SET DEFAULT", "RESTRICT", "NO ACTION"}
NUMBER = re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?")
NOW = re.compile(r"current_timestamp(\(\d*\))?", re.I)


class Unsupported(ValueError):
    """The type or default has no safe counterpart."""


def enum_labels(type_text: str) -> list[str] | None:
    """Labels of ``enum('a','b')``; commas in quotes, doubled quotes and backslashes count. None if malformed."""
    m = re.fullmatch(r"\s*(?:enum|set)\s*\((.*)\)\s*", type_text, re.S | re.I)
    if not m:
        return None
    item = r"'((?:[^'\\]|''|\\.)*)'"
    if not re.fullmatch(rf"\s*{item}(?:\s*,\s*{item})*\s*", m[1], re.S):
        return None
    return [re.sub(r"''|\\(.)", lambda e: e[1] or "'", x, flags=re.S) for x in re.findall(item, m[1], re.S)]


def parts(type_text: str) -> tuple[str, str, bool]:
    """Base word, argument text and whether it's unsigned."""
    low = type_text.strip().lower()
    m = re.match(r"([a-z]+)\s*(\([^)]*\))?", low)
    if not m:
        raise Unsupported(f"unsupported type {type_text!r}")
    return m[1], (m[2] or "").replace(" ", ""), "unsigned" in low[m.end() :] or "unsigned" in low


def is_unsigned_bigint(type_text: str) -> bool:
    base, _, unsigned = parts(type_text)
    return base == "bigint" and unsigned


def is_uuid_storage(type_text: str) -> bool:
    return type_text.strip().lower() in UUID_SHAPES


def target_type(column: Column, enum_name: str | None = None, demoted: bool = False) -> str:
    """The target's type text. ``demoted``: an unsigned bigint whose values were found to fit a signed one."""
    if column.cast:
        return column.cast.upper()
    base, args, unsigned = parts(column.type)
    if column.is_uuid and is_uuid_storage(column.type):
        return "UUID"
    if base == "enum":
        return enum_name or "TEXT"
    if (base, args) in {("tinyint", "(1)"), ("bit", "(1)")}:
        return "BOOLEAN"
    if base in SPATIAL or base == "bit":
        return "BYTEA"
    if base in INT_TARGET:
        if base == "bigint" and unsigned and demoted:
            return "BIGINT"
        return INT_TARGET[base][unsigned]
    if base == "varchar":
        return f"VARCHAR{args or '(255)'}"
    if base == "char":
        return f"CHAR{args}"
    if base in {"decimal", "numeric"}:
        return f"DECIMAL{args}"
    if base.endswith("text"):
        return "TEXT"
    if base.endswith(("blob", "binary")):
        return "BYTEA"
    if base in PLAIN:
        return PLAIN[base]
    raise Unsupported(f"unsupported type {column.type!r} of column {column.name!r}")


def spark_type(target: str) -> T.DataType:
    """The Spark type that holds a target type's values; text where Spark has no such type."""
    low = target.strip().lower()
    if low.endswith("[]"):
        return T.ArrayType(spark_type(low[:-2]))
    if m := re.fullmatch(r"(?:numeric|decimal)\((\d+)(?:,\s*(\d+))?\)", low):
        p, s = int(m[1]), int(m[2] or 0)
        return T.DecimalType(p, s) if p <= 38 and s <= p else T.StringType()
    if low in {"numeric", "decimal"}:
        return T.DecimalType(38, 10)
    return SPARK.get(low, T.StringType())


def family(type_name: str) -> str:
    low = re.sub(r"\(.*", "", type_name.strip().lower()).strip()
    return FAMILY.get(low, low)


def fk_rule(rule: str) -> str:
    if (up := " ".join(rule.upper().split())) not in RULES:
        raise Unsupported(f"foreign key rule {rule!r}")
    return up


def default_sql(column: Column, target: str) -> str | None:
    """The target's DEFAULT expression; None without one. Raises Unsupported rather than guess."""
    value, low = column.default, target.lower()
    if value is None or column.generation or "auto_increment" in column.extra.lower():
        return None
    temporal = low.startswith(("timestamp", "date", "time"))
    if temporal and (NOW.fullmatch(value) or value.upper() in {"CURRENT_DATE", "CURRENT_TIME"}):
        return value.upper().replace("()", "")
    if "default_generated" in column.extra.lower():
        raise Unsupported(f"generated default {value!r} of {column.name!r}")
    if low == "boolean":
        word = {"1": "TRUE", "true": "TRUE", "b'1'": "TRUE", "0": "FALSE", "false": "FALSE", "b'0'": "FALSE"}.get(value.lower())
        if word is None:
            raise Unsupported(f"boolean default {value!r} of {column.name!r}")
        return word
    if low.startswith(("smallint", "integer", "bigint", "numeric", "decimal", "real", "double")):
        if not NUMBER.fullmatch(value):
            raise Unsupported(f"numeric default {value!r} of {column.name!r}")
        return value
    quoted = "'" + value.replace("'", "''") + "'"
    if low == "uuid":
        try:
            return f"'{_uuid.UUID(value)}'::uuid"
        except ValueError:
            raise Unsupported(f"uuid default {value!r} of {column.name!r}") from None
    if low == "jsonb":
        try:
            json.loads(value)
        except ValueError:
            raise Unsupported(f"json default {value!r} of {column.name!r}") from None
        return f"{quoted}::jsonb"
    if low == "bytea":
        raise Unsupported(f"binary default of {column.name!r}")
    return quoted


def sequence_state(largest: int | None, source_next: int | None) -> tuple[int, bool]:
    """(value, called): the next value handed out is past both sides' values."""
    nxt = max(1, (largest or 0) + 1, source_next or 1)
    if nxt > 2**63 - 1 or (source_next is not None and source_next <= 0):
        raise ValueError("identity value out of range")
    return (nxt - 1, True) if nxt > 1 else (1, False)

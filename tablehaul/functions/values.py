"""The value transform as Column expressions: what is valid, and what it becomes.

Every rule is stricter than Spark's own casts (``2`` is no boolean, ``2024-1-5`` no date), so each cast stands
behind a pattern. Patterns end in ``\\z``: Java's ``$`` lets a line end through. All of it stays inside codegen.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UUID_DASHED = r"(?i)\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
TIMESTAMP = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,9})?\z"
CLOCK = r"\A([01]?[0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\.[0-9]{1,9})?)?\z"
DURATION = r"\A-?[0-9]{1,3}:[0-9]{1,2}:[0-9]{1,2}(\.[0-9]+)?\z"
FLOAT = r"\A[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
INTERVAL_HINT = "a duration, not a time of day: cast the column to interval"

KINDS = {
    "boolean": "boolean", "uuid": "uuid", "bytea": "bytea", "date": "date", "time": "time", "timetz": "time",
    "smallint": "integer", "integer": "integer", "bigint": "integer", "real": "numeric", "double precision": "numeric",
    "text": "text", "json": "text", "jsonb": "text", "user-defined": "enum",
}


def kind_of(target: str) -> str:
    """One of the value kinds, from a target type's text."""
    low = target.strip().lower()
    base = low.split("(")[0].strip()
    if base.endswith("[]"):
        return "other"
    if base.startswith(("varchar", "char", "bpchar")):
        return "text"
    if base.startswith(("numeric", "decimal")):
        return "numeric"
    if base.startswith("timestamp"):
        return "timestamp"
    return KINDS.get(base) or ("other_time" if "time" in base else "other")


def bare(c: Column) -> Column:
    """Without white space around it; Spark's own trim takes blanks alone."""
    return F.trim(c, F.lit(" \t\n\r\x0b\x0c\x85\xa0"))


def is_zero_date(c: Column) -> Column:
    return F.coalesce(c.cast("string").startswith("0000-00-00"), F.lit(False))


def has_nul(c: Column) -> Column:
    return F.instr(c, "\0") > 0


def strip_nul(c: Column) -> Column:
    return F.replace(c, F.lit("\0"), F.lit(""))


def uuid_invalid(c: Column, binary: bool = False) -> Column:
    """Null is never invalid."""
    bad = F.octet_length(c) != 16 if binary else ~c.rlike(UUID_DASHED)
    return c.isNotNull() & bad


def time_out_of_day(c: Column) -> Column:
    """Over text ``[-]H..H:MM:SS``: negative, or from 24:00:00 on."""
    return c.startswith("-") | (F.try_to_number(F.split_part(c, F.lit(":"), F.lit(1)), F.lit("9999")) >= 24)


def to_boolean(c: Column) -> Column:
    low = F.lower(bare(c))
    return F.when(low.isin("true", "1", "yes", "t", "y"), True).when(low.isin("false", "0", "no", "f", "n"), False)


def to_uuid(c: Column) -> Column:
    """Dashed, braced, ``urn:uuid:`` or 32 hex digits, to lower-case dashed text; null otherwise."""
    t = F.lower(bare(c))
    t = F.regexp_replace(t, r"\Aurn:uuid:", "")
    t = F.when(t.rlike(r"\A\{[0-9a-f-]{36}\}\z"), F.substring(t, 2, 36)).otherwise(t)
    digits = F.replace(t, F.lit("-"), F.lit(""))
    shaped = t.rlike(UUID_DASHED) | c.rlike(r"(?i)\A\s*[0-9a-f]{32}\s*\z")
    return F.when(shaped, dashed(digits))


def dashed(digits: Column) -> Column:
    return F.concat_ws("-", *(F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def uuid_from_bytes(c: Column) -> Column:
    return F.when(F.octet_length(c) == 16, dashed(F.lower(F.hex(c))))


def to_date(c: Column) -> Column:
    t = bare(c)
    return F.when(t.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), t.try_cast("date"))


def to_timestamp(c: Column) -> Column:
    t = bare(c)
    return F.when(t.rlike(TIMESTAMP), t.try_cast("timestamp_ntz"))


def to_integer(c: Column) -> Column:
    t = bare(c)
    return F.when(t.rlike(r"\A[+-]?[0-9]+\z"), t.try_cast("bigint"))


def numeric_text(c: Column) -> Column:
    """The trimmed text where a 64-bit float can hold its size; the text keeps every digit."""
    t = bare(c)
    size = F.abs(F.when(t.rlike(FLOAT), t).try_cast("double"))
    return F.when(size <= F.lit(1.7976931348623157e308), t)


def to_time(c: Column) -> Column:
    t = bare(c)
    return F.when(t.rlike(CLOCK), t)


def json_valid(c: Column) -> Column:
    """One whole JSON value. Spark's parser ignores what follows a value, so the text is also parsed inside an array and an object."""
    inside = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    held = F.try_parse_json(F.concat(F.lit('{"a":'), c, F.lit("}")))
    return F.try_parse_json(c).isNotNull() & inside.isNotNull() & held.isNotNull() & F.try_variant_get(inside, "$[1]", "string").isNull()


@dataclass(frozen=True)
class ValuePlan:
    """One source column on its way to the target."""

    name: str
    target: str
    nullable: bool = True
    labels: tuple[str, ...] | None = None
    alias: str | None = None

    @property
    def kind(self) -> str:
        return "enum" if self.labels is not None else kind_of(self.target)


def transform(p: ValuePlan, dtype: T.DataType) -> tuple[Column, Column]:
    """(value, reason): reason is null where the value may be loaded.

    In one cell's order: null, zero date, NUL bytes, enum label, then the kind's own rule. A value that the source
    already holds in a typed column passes, except into boolean and uuid.
    """
    c, kind = F.col(f"`{p.name}`"), p.kind
    text = isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))
    zero = is_zero_date(c) if text and kind in {"date", "timestamp"} else F.lit(False)
    held = F.when(~zero, c)
    if text and kind in {"text", "other", "enum"}:
        held = strip_nul(held)
    reason = F.lit(None).cast("string")
    value = held
    if kind == "enum":
        reason = F.when(held.isNotNull() & ~held.isin(*p.labels), F.lit("not a label of the enum"))
    elif kind == "boolean" and not isinstance(dtype, T.BooleanType):
        value = to_boolean(held.cast("string"))
    elif kind == "uuid":
        value = uuid_from_bytes(held) if isinstance(dtype, T.BinaryType) else to_uuid(held)
    elif text and kind in {"date", "timestamp", "integer", "numeric", "time", "other_time"}:
        value = {"date": to_date, "timestamp": to_timestamp, "integer": to_integer, "numeric": numeric_text}.get(kind, to_time)(held)
    elif text and kind == "other":
        value = bare(held)
    if kind not in {"enum", "text", "bytea"}:
        empty = (bare(held) == "") if text else F.lit(False)
        why = F.when(empty, F.lit("empty")).otherwise(F.lit(f"not a valid {kind}"))
        if kind in {"time", "other_time"} and text:
            why = F.when(empty, F.lit("empty")).when(bare(held).rlike(DURATION), F.lit(INTERVAL_HINT)).otherwise(F.lit(f"not a valid {kind}"))
        reason = F.when(held.isNotNull() & (value.isNull() | empty), why)
    if not p.nullable:
        reason = F.when(c.isNull(), F.lit("null in a NOT NULL column")).when(zero, F.lit("zero date in a NOT NULL column")).otherwise(reason)
    return value.alias(p.alias or p.name), reason


def apply(df, plans: list[ValuePlan]):
    """The transformed columns and ``violations``: an array of (column, reason), empty for a row that may load."""
    made = [(p, *transform(p, df.schema[p.name].dataType)) for p in plans]
    found = F.array(*(F.when(r.isNotNull(), F.struct(F.lit(p.name).alias("column"), r.alias("reason"))) for p, _, r in made))
    return df.select(*(v for _, v, _ in made), F.filter(found, lambda x: x.isNotNull()).alias("violations"))


def violation_counts(checked):
    """Rows (column, reason, n) of what :func:`apply` found, by one aggregate."""
    return checked.select(F.explode("violations").alias("v")).groupBy("v.column", "v.reason").agg(F.count("*").alias("n"))

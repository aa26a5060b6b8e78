import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablehaul.functions import cursor, envelope, formats, names, typemap
from tablehaul.functions import values as V
from tablehaul.functions.casts import parse_rules
from tablehaul.model import Column


@pytest.mark.parametrize(
    "source, want",
    [("tinyint(1) unsigned", "BOOLEAN"), ("varchar(36)", "VARCHAR(36)"), ("binary(16)", "BYTEA"), ("bigint unsigned", "NUMERIC(20)"), ("int unsigned", "BIGINT"), ("varbinary(255)", "BYTEA"), ("bit(8)", "BYTEA"), ("bit(1)", "BOOLEAN"), ("year", "SMALLINT"), ("multipoint", "BYTEA"), ("decimal(20,4) unsigned", "DECIMAL(20,4)"), ("set('int')", "TEXT"), ("longtext", "TEXT"), ("mediumblob", "BYTEA"), ("double", "DOUBLE PRECISION"), ("time(3)", "TIME"), ("json", "JSONB")],
)
def test_types(source, want):
    assert typemap.target_type(Column("c", source)) == want


def test_type_edges():
    with pytest.raises(typemap.Unsupported):
        typemap.target_type(Column("c", "vector(3)"))
    assert typemap.target_type(Column("c", "char(36)", is_uuid=True)) == "UUID"
    assert typemap.target_type(Column("c", "bigint unsigned"), demoted=True) == "BIGINT"
    assert typemap.enum_labels("enum('ready','needs, review','it''s done','')") == ["ready", "needs, review", "it's done", ""]
    assert typemap.enum_labels("enum('a") is None
    assert [typemap.sequence_state(*a) for a in ((None, None), (None, 100), (150, 100))] == [(1, False), (99, True), (150, True)]
    with pytest.raises(ValueError):
        typemap.sequence_state(2**63 - 1, None)
    d = lambda t, v, **k: typemap.default_sql(Column("c", "x", default=v, **k), t)
    assert (d("BOOLEAN", "1"), d("INTEGER", "7"), d("VARCHAR(9)", "it's"), d("TIMESTAMP", "CURRENT_TIMESTAMP(6)")) == ("TRUE", "7", "'it''s'", "CURRENT_TIMESTAMP(6)")
    for t, v, k in (("INTEGER", "x", {}), ("BYTEA", "a", {}), ("JSONB", "{", {}), ("UUID", "z", {}), ("TEXT", "uuid()", {"extra": "DEFAULT_GENERATED"})):
        with pytest.raises(typemap.Unsupported):
            d(t, v, **k)


def test_names():
    assert names.bounded_name("short", "x") == "short" and len(names.bounded_name("é" * 60, "x").encode()) <= 63
    assert names.hashed_name("t", "a") != names.hashed_name("t", "b")
    for bad in ("", "a\0", "x" * 64):
        with pytest.raises(ValueError):
            names.check_identifier(bad)
    assert (names.quote('a"b'), names.quote_source("a`b"), names.literal("a'b")) == ('"a""b"', "`a``b`", "'a''b'")


def test_cast_rules():
    r = parse_rules(["jobs.id=text", "datetime=timestamptz", "tinyint(1)=smallint", "decimal=numeric(20, 4)"])
    assert r.lookup("JOBS", "Id", "char(36)") == "text" and r.lookup("t", "c", "DATETIME(6)") == "timestamptz"
    assert r.lookup("t", "c", "tinyint(1)") == "smallint" and r.lookup("t", "c", "tinyint(4)") is None
    for bad in ("", "x", "=text", "a.b=", "a.b=text; drop table t", "db.t.c=text", ".c=text"):
        with pytest.raises(ValueError):
            parse_rules([bad])


@given(st.lists(st.one_of(st.integers(-(2**63), 2**64 - 1), st.text(), st.binary(), st.booleans(), st.floats(allow_nan=False), st.datetimes(timezones=st.just(dt.UTC))), min_size=1))
def test_cursor_round_trip(values):
    assert cursor.decode(cursor.encode(values)) == values


def test_cursor_edges():
    assert cursor.decode("") is None
    for bad in ("x", '[{"type":"nope","value":"1"}]', '[{"type":"int64","value":"a"}]'):
        with pytest.raises(ValueError):
            cursor.decode(bad)
    with pytest.raises(ValueError):
        cursor.encode([None])


def one(spark, text, plan):
    return V.apply(spark.createDataFrame([(text,)], "x string"), [plan]).first()


@pytest.mark.parametrize(
    "target, text, want",
    [("BOOLEAN", " Yes ", True), ("BOOLEAN", "2", None), ("DATE", "2024-02-30", None), ("DATE", "2024-1-5", None), ("TIMESTAMP", "2024-02-29 10:11:12Z", None), ("BIGINT", "9223372036854775808", None), ("BIGINT", "", None), ("TIME", "24:00:01", None), ("TIME", "12:30:45.123456", "12:30:45.123456"), ("NUMERIC(20,4)", "1e400", None), ("UUID", "{6BA7B810-9dad-11d1-80b4-00c04fd430c8}", "6ba7b810-9dad-11d1-80b4-00c04fd430c8"), ("TEXT", " a\0b ", " ab "), ("DATE", "2024-02-29\n", dt.date(2024, 2, 29))],
)
def test_values(spark, target, text, want):
    r = one(spark, text, V.ValuePlan("x", target))
    assert r.x == want and bool(r.violations) == (want is None)


def test_value_reasons(spark):
    assert one(spark, "838:59:59", V.ValuePlan("x", "TIME")).violations[0].reason == V.INTERVAL_HINT
    assert one(spark, "0000-00-00", V.ValuePlan("x", "DATE")) == (None, [])
    assert "zero date" in one(spark, "0000-00-00", V.ValuePlan("x", "DATE", nullable=False)).violations[0].reason
    assert one(spark, None, V.ValuePlan("x", "TEXT", nullable=False)).violations
    assert one(spark, "2024-00-00", V.ValuePlan("x", "DATE")).violations
    assert one(spark, "b", V.ValuePlan("x", "e", labels=("a",))).violations and not one(spark, "a\0", V.ValuePlan("x", "e", labels=("a",))).violations


def test_envelope(spark):
    df = spark.createDataFrame([("geheim é",)], "s string").select(envelope.encrypt(F.col("s"), "k" * 32).alias("c"))
    read = lambda c, k="k" * 32: df.select(envelope.decrypt(c, k)).first()[0]
    assert read(F.col("c")) == "geheim é" and read(F.col("c"), "x" * 32) is None and read(F.lit("plain")) is None
    assert envelope.key_bytes("ab" * 32) == bytes.fromhex("ab" * 32)


def test_formats():
    assert [formats.duration(x) for x in (5, 65, 3725)] == ["5s", "1m05s", "1h02m05s"] and formats.progress(5, 20) == "5/20 rows (25.0%)"

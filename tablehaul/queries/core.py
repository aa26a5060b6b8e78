from __future__ import annotations

import contextlib
import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cursor as cur
from ..functions import values as V
from ..functions.names import hashed_suffix
from ..functions.typemap import sequence_state, target_type
from ..model import Column, Manual, Table
from ..operators import groups, integrity, keyset, load, profile, rollup, selection
from ..plans import planner
from ..plans.runner import Options, Runner
from ..plans.state import Store
from ..sources.tables import FOREIGN, KEYS, ParquetSource, read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


# Scans -------------------------------------------------------------------------------------------------------------


@query("s1_keyset_first_batch", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 1000")
def s1_first(spark, d):
    return keyset.batch(read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderkey"], 1000)


@query("s1_keyset_next_batch", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 1000")
def s1_next(spark, d):
    return keyset.batch(read(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 1000, cursor=[500])


@query("s1_keyset_composite_next", "SELECT conv_id, turn, role FROM conversations WHERE (conv_id, turn) > (50, 1) ORDER BY conv_id, turn LIMIT 500")
def s1_composite(spark, d):
    return keyset.batch(read(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"], 500, cursor=[50, 1])


@query("s1_legacy_offset", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 20")
def s1_offset(spark, d):
    return keyset.batch(read(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"], 50, offset=20)


@query("s2_stream_projection", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def s2(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")


@query("s3_batch_assignment", "SELECT CAST(b AS BIGINT) batch_no, count(*) n, min(o_orderkey) first_key, max(o_orderkey) last_key FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 5000 b FROM orders) GROUP BY b")
def s3(spark, d):
    rows = keyset.assign_batches(read(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 5000)
    return rows.groupBy("batch_no").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query("s4_exact_count", "SELECT count(*) n_rows FROM lineitem")
def s4(spark, d):
    return read(spark, d, "lineitem").agg(F.count("*").alias("n_rows"))


CATALOG_SQL = ", ".join(f"('{t}', {len(k)})" for t, k in sorted(KEYS.items()))


@query("s6_list_tables", f"SELECT t table_name, CAST(k AS INT) key_columns, CAST(k > 0 AS BOOLEAN) resumable FROM (VALUES {CATALOG_SQL}) v(t, k)")
def s6(spark, d):
    src = ParquetSource(spark, d)  # a row for each table that the folder holds
    return spark.createDataFrame([(t, len(src.keys.get(t, ())), bool(src.keys.get(t))) for t in src.list_tables()], "table_name string, key_columns int, resumable boolean")


@query("s7_column_catalog", None)
def s7(spark, d):
    return ParquetSource(spark, d).catalog().orderBy("table_name", "ordinal")


INDEX_ROWS = [("orders", "by_day", 2, "o_custkey"), ("orders", "by_day", 1, "o_orderdate"), ("customer", "by_name", 1, "c_name"), ("lineitem", "by_part", 2, "l_suppkey"), ("lineitem", "by_part", 1, "l_partkey")]
INDEX_SQL = ", ".join(f"('{a}', '{b}', {s}, '{c}')" for a, b, s, c in INDEX_ROWS)


@query("s12_index_catalog", f"SELECT t table_name, i index_name, string_agg(c, ',' ORDER BY s) index_columns FROM (VALUES {INDEX_SQL}) v(t, i, s, c) GROUP BY t, i")
def s12(spark, d):
    rows = spark.createDataFrame(INDEX_ROWS, "table_name string, index_name string, seq int, column_name string")
    cols = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "column_name"))), lambda x: x["column_name"]), ",")  # a catalog's rows
    return rows.groupBy("table_name", "index_name").agg(cols.alias("index_columns"))


FK_SQL = ", ".join(f"('{k.name}', '{k.table}', '{k.columns[0]}', '{k.parent}', '{k.parent_columns[0]}')" for k in FOREIGN)


@query("s13_foreign_keys", f"SELECT * FROM (VALUES {FK_SQL}) v(fk, child, child_column, parent, parent_column)")
def s13(spark, d):
    return _fks(spark)


def _fks(spark) -> DataFrame:
    return spark.createDataFrame([(k.name, k.table, k.columns[0], k.parent, k.parent_columns[0]) for k in FOREIGN], "fk string, child string, child_column string, parent string, parent_column string")


# Keys and predicates -----------------------------------------------------------------------------------------------


@query("p2_pushed_keyset", "SELECT count(*) n, min(conv_id) low, max(conv_id) high FROM conversations WHERE (conv_id, turn) > (20, 0)")
def p2(spark, d):
    return read(spark, d, "conversations").filter(keyset.predicate(["conv_id", "turn"], [20, 0])).agg(F.count("*").alias("n"), F.min("conv_id").alias("low"), F.max("conv_id").alias("high"))


@query("p3_last_cursor", "SELECT conv_id, turn FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 1")
def p3(spark, d):
    return keyset.last_key(read(spark, d, "conversations"), ["CONV_ID", "turn"])


@query("p4_column_match", "SELECT c_custkey AS C_CUSTKEY, c_name AS C_NAME FROM customer")
def p4(spark, d):
    from ..sources.tables import match_columns

    names = match_columns(["c_custkey", "c_name"], ["C_NAME", "C_CUSTKEY"])
    return read(spark, d, "customer").select(*(F.col(a).alias(b) for a, b in names.items()))


@query("p5_include", "SELECT * FROM (VALUES ('orders'), ('customer')) v(table_name)")
def p5i(spark, d):
    return selection.TableFilter(include=[" Orders", "CUSTOMER"]).frame(_names(spark))


@query("p5_exclude", "SELECT t table_name FROM (VALUES " + ", ".join(f"('{t}')" for t in KEYS) + ") v(t) WHERE t NOT IN ('orders', 'customer')")
def p5e(spark, d):
    return selection.TableFilter(exclude=["orders", "customer"]).frame(_names(spark))


def _names(spark) -> DataFrame:
    return spark.createDataFrame([(t,) for t in KEYS], "table_name string")


@query("p7_not_null", "SELECT count(*) FILTER (WHERE x IS NULL) n_null, count(*) n FROM (SELECT CASE WHEN event_id % 31 <> 0 THEN value END x FROM events)")
def p7(spark, d):
    v = F.when(F.col("event_id") % 31 != 0, F.col("value"))
    return read(spark, d, "events").agg(F.count_if(v.isNull()).alias("n_null"), F.count("*").alias("n"))


def _uuid(spark, d) -> DataFrame:
    """Dashed md5 of event_id; every 89th broken."""
    text = V.dashed(F.md5(F.col("event_id").cast("string")))
    return read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 89 == 0, F.concat(text, F.lit("x"))).otherwise(text).alias("u"))


UUID_SQL = "SELECT event_id, substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) || CASE WHEN event_id % 89 = 0 THEN 'x' ELSE '' END u FROM (SELECT event_id, md5(CAST(event_id AS VARCHAR)) m FROM events)"
HEX = "[0-9a-f]"


@query("p9_uuid_invalid", f"SELECT count(*) FILTER (WHERE NOT regexp_full_match(u, '{HEX}{{8}}-{HEX}{{4}}-{HEX}{{4}}-{HEX}{{4}}-{HEX}{{12}}')) n_invalid, count(*) n FROM ({UUID_SQL})")
def p9(spark, d):
    return _uuid(spark, d).agg(F.count_if(V.uuid_invalid(F.col("u"))).alias("n_invalid"), F.count("*").alias("n"))


def _dated(spark, d) -> DataFrame:
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 97 == 0, "0000-00-00 00:00:00").otherwise(text).alias("t"))


DATED_SQL = "SELECT event_id, CASE WHEN event_id % 97 = 0 THEN '0000-00-00 00:00:00' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END t FROM events"


@query("p10_zero_dates", f"SELECT count(*) FILTER (WHERE starts_with(t, '0000-00-00')) n_zero, count(*) n FROM ({DATED_SQL})")
def p10(spark, d):
    return _dated(spark, d).agg(F.count_if(V.is_zero_date(F.col("t"))).alias("n_zero"), F.count("*").alias("n"))


@query("f4_zero_date_to_null", f"SELECT event_id, CASE WHEN NOT starts_with(t, '0000-00-00') THEN CAST(t AS TIMESTAMP) END t FROM ({DATED_SQL})")
def f4(spark, d):
    return V.apply(_dated(spark, d), [V.ValuePlan("event_id", "BIGINT"), V.ValuePlan("t", "TIMESTAMP")]).drop("violations")


def _nul(spark, d) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 53 == 0, F.concat(F.lit("a\0b"), "text")).otherwise(F.col("text")).alias("x"))


NUL_SQL = "SELECT doc_id, CASE WHEN doc_id % 53 = 0 THEN 'a' || chr(0) || 'b' || text ELSE text END x FROM documents"


@query("p11_nul_counts", f"SELECT count(*) FILTER (WHERE contains(x, chr(0))) n_nul, count(*) n FROM ({NUL_SQL})")
def p11(spark, d):
    return _nul(spark, d).agg(F.count_if(V.has_nul(F.col("x"))).alias("n_nul"), F.count("*").alias("n"))


@query("f5_nul_strip", f"SELECT CAST(sum(length(replace(x, chr(0), ''))) AS BIGINT) n_chars FROM ({NUL_SQL})")
def f5(spark, d):
    return V.apply(_nul(spark, d), [V.ValuePlan("x", "TEXT")]).agg(F.sum(F.length("x")).alias("n_chars"))


def _clock(spark, d) -> DataFrame:
    return read(spark, d, "events").select("event_id", F.concat((F.col("event_id") % 900).cast("string"), F.lit(":00:00")).alias("t"))


@query("p12_time_range", "SELECT count(*) FILTER (WHERE event_id % 900 >= 24) n_out, count(*) n FROM events")
def p12(spark, d):
    return _clock(spark, d).agg(F.count_if(V.time_out_of_day(F.col("t"))).alias("n_out"), F.count("*").alias("n"))


@query("f10_time", f"SELECT reason, count(*) n FROM (SELECT CASE WHEN event_id % 900 >= 24 THEN '{V.INTERVAL_HINT}' END reason FROM events) WHERE reason IS NOT NULL GROUP BY reason")
def f10(spark, d):
    return V.violation_counts(V.apply(_clock(spark, d), [V.ValuePlan("t", "TIME")])).select("reason", "n")


def _marked(spark, d) -> DataFrame:
    return read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 101 == 0, "").otherwise(F.col("event_type")).alias("e"))


MARKED_SQL = "SELECT event_id, CASE WHEN event_id % 101 = 0 THEN '' ELSE event_type END e FROM events"


@query("p13_enum_marker", f"SELECT count(*) FILTER (WHERE e = '') n_marker FROM ({MARKED_SQL})")
def p13(spark, d):
    return _marked(spark, d).agg(F.count_if(F.col("e") == "").alias("n_marker"))


@query("p8_enum_membership", f"SELECT count(*) FILTER (WHERE e NOT IN ('signup', 'purchase', 'view', 'click')) n_bad FROM ({MARKED_SQL})")
def p8(spark, d):
    return V.apply(_marked(spark, d), [V.ValuePlan("e", "e", labels=("signup", "purchase", "view", "click"))]).agg(F.count_if(F.size("violations") > 0).alias("n_bad"))


# Joins -------------------------------------------------------------------------------------------------------------

ORPHANS_SQL = " UNION ALL ".join(f"SELECT '{k.name}' fk, '{k.table}' child, '{k.parent}' parent, count(*) n_orphans FROM {k.table} c WHERE c.{k.columns[0]} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {k.parent} p WHERE p.{k.parent_columns[0]} = c.{k.columns[0]})" for k in FOREIGN)


@query("j1_orphans_clean", ORPHANS_SQL)
def j1(spark, d):
    return integrity.orphan_counts(FOREIGN, lambda t: read(spark, d, t))


def _parents(spark, d) -> DataFrame:
    return read(spark, d, "documents").filter("doc_id % 10 <> 0")


DIRTY_SQL = "FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents p WHERE p.doc_id % 10 <> 0 AND p.doc_id = l.doc_id)"


@query("j1_orphans_dirty", f"SELECT count(*) n_orphans {DIRTY_SQL}")
def j1d(spark, d):
    return integrity.orphans(read(spark, d, "labels"), ["doc_id"], _parents(spark, d), ["doc_id"]).agg(F.count("*").alias("n_orphans"))


@query("j2_orphan_rows", f"SELECT l.doc_id, l.quality, l.toxic {DIRTY_SQL}")
def j2(spark, d):
    return integrity.orphans(read(spark, d, "labels"), ["doc_id"], _parents(spark, d), ["doc_id"])


@query("j1_orphans_composite_nulls", "SELECT count(*) n_orphans FROM (SELECT CASE WHEN conv_id % 7 <> 0 THEN conv_id END a, turn + 1 b FROM conversations) c WHERE a IS NOT NULL AND b IS NOT NULL AND NOT EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.a AND p.turn = c.b)")
def j1c(spark, d):
    c = read(spark, d, "conversations")
    child = c.select(F.when(F.col("conv_id") % 7 != 0, F.col("conv_id")).alias("a"), (F.col("turn") + 1).alias("b"))
    return integrity.orphans(child, ["a", "b"], c, ["conv_id", "turn"]).agg(F.count("*").alias("n_orphans"))


@query("j3_typed_edges", f"SELECT fk, child, parent, child_column, parent_column, c.ty child_type, p.ty parent_type FROM (VALUES {FK_SQL}) v(fk, child, child_column, parent, parent_column) JOIN (SELECT table_name t, column_name c, CASE data_type WHEN 'INTEGER' THEN 'int' ELSE lower(data_type) END ty FROM information_schema.columns) c ON c.t = child AND c.c = child_column JOIN (SELECT table_name t, column_name c, CASE data_type WHEN 'INTEGER' THEN 'int' ELSE lower(data_type) END ty FROM information_schema.columns) p ON p.t = parent AND p.c = parent_column")
def j3(spark, d):
    cat = ParquetSource(spark, d).catalog()
    side = lambda n: cat.select(F.col("table_name").alias(n), F.col("column_name").alias(f"{n}_column"), F.col("type").alias(f"{n}_type"))
    return _fks(spark).join(side("child"), ["child", "child_column"]).join(side("parent"), ["parent", "parent_column"])


@query("j4_semi_exists", "SELECT n_nationkey, n_name FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9000)")
def j4(spark, d):
    rich = read(spark, d, "customer").filter("c_acctbal > 9000")
    n = read(spark, d, "nation")
    return n.join(rich, n.n_nationkey == rich.c_nationkey, "left_semi").select("n_nationkey", "n_name")


CHOSEN = ["orders", "lineitem", "customer", "labels"]


@query("j7_fk_closure", f"SELECT DISTINCT child, fk, parent FROM (VALUES {FK_SQL}) v(fk, child, child_column, parent, parent_column) WHERE child IN ('orders', 'lineitem', 'customer', 'labels') AND parent NOT IN ('orders', 'lineitem', 'customer', 'labels')")
def j7(spark, d):
    chosen = selection.TableFilter(include=CHOSEN).frame(_names(spark))
    return selection.closure_violations(_fks(spark), chosen, _names(spark))


# Aggregates --------------------------------------------------------------------------------------------------------


def _profile(t: str, cols: list[tuple[str, bool]]):
    one = [f"SELECT '{c}' column_name, count(*) n_rows, count(*) FILTER (WHERE {c} IS NULL) n_null, " + (f"count(*) FILTER (WHERE trim({c}) = '')" if text else "CAST(0 AS BIGINT)") + f" n_blank, CAST(min({c}) AS VARCHAR) min_value, CAST(max({c}) AS VARCHAR) max_value FROM {t}" for c, text in cols]

    @query(f"a1_profile_{t}", " UNION ALL ".join(one))
    def a1(spark, d):
        return profile.column_profile(read(spark, d, t).select(*(c for c, _ in cols)))


for _t, _c in {
    "region": [("r_regionkey", False), ("r_name", True)],
    "nation": [("n_nationkey", False), ("n_name", True), ("n_regionkey", False)],
    "customer": [("c_custkey", False), ("c_name", True), ("c_nationkey", False), ("c_mktsegment", True)],
    "supplier": [("s_suppkey", False), ("s_name", True), ("s_nationkey", False)],
    "part": [("p_partkey", False), ("p_name", True), ("p_brand", True), ("p_type", True), ("p_size", False)],
    "orders": [("o_orderkey", False), ("o_custkey", False), ("o_orderstatus", True), ("o_orderpriority", True)],
    "lineitem": [("l_orderkey", False), ("l_linenumber", False), ("l_returnflag", True), ("l_linestatus", True)],
    "events": [("event_id", False), ("user_id", False), ("event_type", True), ("props", True)],
    "documents": [("doc_id", False), ("lang", True), ("source", True), ("n_chars", False)],
    "labels": [("doc_id", False), ("quality", False), ("toxic", False)],
    "pages": [("page_id", False), ("url", True)],
    "benchmark": [("item_id", False), ("text", True)],
    "conversations": [("conv_id", False), ("turn", False), ("role", True)],
    "embeddings": [("vec_id", False), ("label", False)],
}.items():
    _profile(_t, _c)


@query(
    "a2_fused_conditions",
    f"SELECT 'zero_date' \"check\", 't' \"column\", count(*) FILTER (WHERE starts_with(t, '0000-00-00')) n FROM ({DATED_SQL}) UNION ALL SELECT 'enum_marker', 'e', count(*) FILTER (WHERE e = '') FROM ({MARKED_SQL}) UNION ALL SELECT 'uuid', 'u', count(*) FILTER (WHERE event_id % 89 = 0) FROM events UNION ALL SELECT 'nul', 'e', 0 UNION ALL SELECT 'nul', 'u', 0 UNION ALL SELECT 'rows', '', count(*) FROM events",
)
def a2(spark, d):
    e = F.col("event_id")
    text = V.dashed(F.md5(e.cast("string")))
    df = read(spark, d, "events").select(
        F.when(e % 97 == 0, "0000-00-00 00:00:00").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("t"), F.when(e % 101 == 0, "").otherwise(F.col("event_type")).alias("e"), F.when(e % 89 == 0, F.concat(text, F.lit("x"))).otherwise(text).alias("u")
    )
    return profile.standard(df, dates=["t"], enums=["e"], uuids=["u"]).long()


@query("a7_unsigned_max", "SELECT CAST(max(CAST(9223372036854775800 AS HUGEINT) + event_id) AS VARCHAR) max_value, max(CAST(9223372036854775800 AS HUGEINT) + event_id) <= 9223372036854775807 fits FROM events")
def a7(spark, d):
    v = F.lit("9223372036854775800").cast("decimal(20,0)") + F.col("event_id").cast("decimal(19,0)")
    m = F.max(v.cast("decimal(20,0)"))
    return read(spark, d, "events").agg(m.cast("string").alias("max_value"), (m <= F.lit(groups.SIGNED_MAX)).alias("fits"))


@query("a8_identity_max", "SELECT max(o_orderkey) max_key, max(o_orderkey) + 1 next_value FROM orders")
def a8(spark, d):
    return read(spark, d, "orders").agg(F.max("o_orderkey").alias("max_key"), F.greatest(F.lit(1), F.max("o_orderkey") + 1).alias("next_value"))


def _checkpoints(spark, d) -> DataFrame:
    k = F.col("o_custkey") % 7
    return read(spark, d, "orders").groupBy(k.alias("session_id"), F.concat(F.lit("t"), (F.col("o_orderkey") % 5).cast("string")).alias("table_name")).agg(F.count("*").alias("row_count"), F.count_if(F.col("o_orderstatus") != "P").alias("last_offset"), F.max("o_orderkey").alias("updated_at")).withColumn("status", F.when(F.col("session_id") < 2, "done").when((F.col("session_id") == 4) & (F.col("table_name") == "t3"), "error").when((F.col("session_id") == 5), "pending").otherwise("in_progress")).withColumn("error_message", F.when(F.col("status") == "error", F.concat(F.lit("broken "), "table_name")))


CHECKPOINT_SQL = "SELECT *, CASE WHEN session_id < 2 THEN 'done' WHEN session_id = 4 AND table_name = 't3' THEN 'error' WHEN session_id = 5 THEN 'pending' ELSE 'in_progress' END status, CASE WHEN session_id = 4 AND table_name = 't3' THEN 'broken t3' END error_message FROM (SELECT o_custkey % 7 session_id, 't' || (o_orderkey % 5) table_name, count(*) row_count, count(*) FILTER (WHERE o_orderstatus <> 'P') last_offset, max(o_orderkey) updated_at FROM orders GROUP BY 1, 2)"
STATUS_SQL = f"SELECT session_id, count(*) tables_total, count(*) FILTER (WHERE status = 'done') tables_done, CAST(sum(last_offset) AS BIGINT) rows_done, CAST(sum(row_count) AS BIGINT) rows_total, max(updated_at) updated_at, min(error_message) first_error, CASE WHEN count(*) FILTER (WHERE status = 'error') > 0 THEN 'error' WHEN count(*) FILTER (WHERE status <> 'done') = 0 THEN 'done' WHEN count(*) FILTER (WHERE status <> 'pending') > 0 THEN 'in_progress' ELSE 'created' END status FROM ({CHECKPOINT_SQL}) GROUP BY session_id"


@query("a11_status_rollup", STATUS_SQL)
def a11(spark, d):
    return rollup.status_rollup(_checkpoints(spark, d))


def _events(spark, d) -> DataFrame:
    return read(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 7).alias("session_id"), F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "done").otherwise("info").alias("level"), F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message"))


EVENTS_SQL = "SELECT event_id id, user_id % 7 session_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'done' ELSE 'info' END level, 'm' || event_id message FROM events"


@query("a10_session_rollup", f"WITH s AS ({STATUS_SQL}), e AS ({EVENTS_SQL}), l AS (SELECT session_id, arg_max(level, id) lv, arg_max(message, id) msg FROM e GROUP BY session_id) SELECT s.session_id, tables_total, tables_done, rows_done, rows_total, updated_at, coalesce(first_error, CASE WHEN lv = 'error' THEN msg END) first_error, CASE WHEN lv = 'error' THEN 'error' WHEN lv = 'done' AND status <> 'error' THEN 'done' ELSE status END status FROM s LEFT JOIN l ON l.session_id = s.session_id")
def a10(spark, d):
    return rollup.session_rollup(_checkpoints(spark, d), _events(spark, d))


REPORT_ROWS = [("issue", "t1", "a", "zero_date", 3), ("warning", "t1", "b", "nul", 2), ("manual", "t1", "tr", "trigger", 1), ("manual", "", "v", "view", 1), ("manual", "t2", "fk", "foreign_key", 1), ("issue", "t2", "c", "time_range", 9)]


@query("a13_plan_totals", "SELECT CAST(2 AS BIGINT) issues, CAST(1 AS BIGINT) warnings, CAST(2 AS BIGINT) manual_items, CAST(3 AS BIGINT) manual_all")
def a13(spark, d):
    return rollup.plan_totals(spark.createDataFrame(REPORT_ROWS, "severity string, table_name string, column_name string, kind string, n int"))


def _edges(spark, d) -> DataFrame:
    return read(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_partkey") % 50 + F.col("l_suppkey") * 0).alias("dst"))


@query("g1_components", "WITH e AS (SELECT DISTINCT l_partkey a, l_partkey % 50 b FROM lineitem) SELECT node, min(root) root FROM (SELECT a node, b root FROM e UNION ALL SELECT b, b FROM e) GROUP BY node")
def g1(spark, d):
    return groups.components(_edges(spark, d))


CHAIN = [(i, i + 1) for i in range(0, 40) if i % 9 != 8] + [(3, 30)]


@query("g2_components", f"WITH RECURSIVE e(a, b) AS (VALUES {', '.join(map(str, CHAIN))}), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, root) AS (SELECT a, a FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node) SELECT CAST(node AS BIGINT) node, CAST(min(root) AS BIGINT) root FROM r GROUP BY node")
def g2(spark, d):
    return groups.components(spark.createDataFrame(CHAIN, "src bigint, dst bigint"))


@query("a15_group_verdicts", "SELECT o_custkey % 20 root, bool_or(o_orderkey % 4001 = 0) any_dirty, bool_or(o_orderkey % 3001 = 0) any_anchored, bool_and(9223372036854775700 + CAST(o_orderkey % 200 AS HUGEINT) <= 9223372036854775807) all_fit, CAST(max(9223372036854775700 + CAST(o_orderkey % 200 AS HUGEINT)) AS VARCHAR) max_value, NOT bool_or(o_orderkey % 4001 = 0) AND NOT bool_or(o_orderkey % 3001 = 0) converts FROM orders GROUP BY 1")
def a15(spark, d):
    big = (F.lit("9223372036854775700").cast("decimal(20,0)") + (F.col("o_orderkey") % 200).cast("decimal(19,0)")).cast("decimal(20,0)")
    m = read(spark, d, "orders").select((F.col("o_custkey") % 20).alias("root"), (F.col("o_orderkey") % 4001 == 0).alias("dirty"), (F.col("o_orderkey") % 3001 == 0).alias("anchored"), big.alias("largest"))
    return groups.verdicts(m).withColumn("max_value", F.col("max_value").cast("string"))


# The value transform -----------------------------------------------------------------------------------------------


def _dirty(spark, d, values: list[str]) -> DataFrame:
    """Every event takes the value its id points to."""
    pick = F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % len(values)).cast("int") + 1)
    return read(spark, d, "events").select("event_id", pick.alias("x"))


def _dirty_sql(values: list[str], expr: str) -> str:
    rows = ", ".join("(%d, '%s')" % (i, v.replace("'", "''")) for i, v in enumerate(values))
    return f"SELECT event_id, {expr} v FROM (SELECT event_id, x FROM events JOIN (VALUES {rows}) t(i, x) ON event_id % {len(values)} = i)"


def _value(name: str, values: list[str], target: str, expr: str, cast: str | None = None):
    @query(name, _dirty_sql(values, expr))
    def f(spark, d):
        out = V.apply(_dirty(spark, d, values), [V.ValuePlan("event_id", "BIGINT"), V.ValuePlan("x", target, alias="v")])
        return out.select("event_id", out.v.cast(cast).alias("v") if cast else "v")


_value("f6_boolean", ["true", " T ", "yes", "1", "0", "No", "f", "2", "", "maybe", "Y"], "BOOLEAN", "CASE WHEN lower(trim(x)) IN ('true', '1', 'yes', 't', 'y') THEN true WHEN lower(trim(x)) IN ('false', '0', 'no', 'f', 'n') THEN false END")
_value(
    "f7_uuid_canonical",
    ["6BA7B810-9DAD-11D1-80B4-00C04FD430C8", "{6ba7b810-9dad-11d1-80b4-00c04fd430c8}", "urn:uuid:6ba7b810-9dad-11d1-80b4-00c04fd430c8", "6ba7b8109dad11d180b400c04fd430c8", "6ba7b810-9dad-11d1-80b4", "nope"],
    "UUID", "CASE WHEN event_id % 6 < 4 THEN '6ba7b810-9dad-11d1-80b4-00c04fd430c8' END",
)
_value("f8_verbatim_text", [" a ", "", "B\n", "ä"], "TEXT", "x")
_value("f9_trim_other", [" 10.0.0.1 ", "x", "y  "], "INET", "trim(x)")
_value("f11_date", ["2024-02-29", "2023-02-29", "2024-1-5", "01/02/2026", " 2020-12-31 ", "2024-02-30"], "DATE", "CASE WHEN regexp_full_match(trim(x), '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN try_cast(trim(x) AS DATE) END")
_value("f12_timestamp", ["2024-02-29 10:11:12", "2024-02-29T10:11:12.5", "2024-02-29", "2024-02-29 10:11:12Z", "2024-02-30 00:00:00", "2024-01-01 24:00:00"], "TIMESTAMP", "CASE WHEN event_id % 6 < 2 THEN try_cast(trim(x) AS TIMESTAMP) END")
_value("f13_integer", ["1", "-9223372036854775808", "9223372036854775808", "+7", "1.0", "abc", ""], "BIGINT", "CASE WHEN regexp_full_match(trim(x), '[+-]?[0-9]+') THEN try_cast(trim(x) AS BIGINT) END")
_value("f14_numeric", ["1.50", "1e400", "1d", "-.5", "12345678901234567890.123456789", "1e5", " 7 "], "NUMERIC(38,9)", "CASE WHEN event_id % 7 NOT IN (1, 2) THEN trim(x) END")


@query("f19_index_prefix", "SELECT substr(c_name, 1, 14) prefix, count(*) n FROM customer GROUP BY 1 HAVING count(*) > 1")
def f19(spark, d):
    return read(spark, d, "customer").groupBy(F.substring("c_name", 1, 14).alias("prefix")).agg(F.count("*").alias("n")).filter("n > 1")


@query("f21_hashed_names", "SELECT c_custkey, substr(sha256('customer.' || c_name), 1, 16) suffix FROM customer")
def f21(spark, d):
    return read(spark, d, "customer").select("c_custkey", hashed_suffix(F.concat(F.lit("customer."), "c_name")).alias("suffix"))


@query("f23_type_map", "SELECT * FROM (VALUES ('bigint unsigned', 'NUMERIC(20)'), ('tinyint(1)', 'BOOLEAN'), ('set(''int'',''b'')', 'TEXT'), ('decimal(20,4) unsigned', 'DECIMAL(20,4)'), ('datetime(6)', 'TIMESTAMP'), ('varchar(36)', 'VARCHAR(36)'), ('year', 'SMALLINT'), ('mediumint unsigned', 'BIGINT')) v(source_type, target_type)")
def f23(spark, d):
    kinds = ["bigint unsigned", "tinyint(1)", "set('int','b')", "decimal(20,4) unsigned", "datetime(6)", "varchar(36)", "year", "mediumint unsigned"]
    return spark.createDataFrame([(k, target_type(Column("c", k))) for k in kinds], "source_type string, target_type string")


@query("f25_sequence_state", "SELECT t, CAST(v AS BIGINT) v, c FROM (VALUES ('empty', 1, false), ('next only', 99, true), ('data ahead', 150, true)) x(t, v, c)")
def f25(spark, d):
    rows = [(n, *sequence_state(*a)) for n, a in (("empty", (None, None)), ("next only", (None, 100)), ("data ahead", (150, 100)))]
    return spark.createDataFrame(rows, "t string, v bigint, c boolean")


@query("f29_cursor_roundtrip", "SELECT conv_id, turn, true same FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 1")
def f29(spark, d):
    row = keyset.last_key(read(spark, d, "conversations"), ["conv_id", "turn"]).first()
    same = cur.decode(cur.encode(list(row))) == list(row)
    return spark.createDataFrame([(*row, same)], "conv_id bigint, turn bigint, same boolean")


@query("f30_json_valid", "SELECT count(*) FILTER (WHERE json_valid(p)) n_valid, count(*) n FROM (SELECT CASE WHEN event_id % 13 = 0 THEN props || '}' ELSE props END p FROM events)")
def f30(spark, d):
    p = F.when(F.col("event_id") % 13 == 0, F.concat("props", F.lit("}"))).otherwise(F.col("props"))
    return read(spark, d, "events").agg(F.count_if(V.json_valid(p)).alias("n_valid"), F.count("*").alias("n"))


@query("f31_envelope", "SELECT s_suppkey, s_name same FROM supplier")
def f31(spark, d):
    from ..functions.envelope import decrypt, encrypt

    key = "k" * 32
    return read(spark, d, "supplier").select("s_suppkey", decrypt(encrypt(F.col("s_name"), key), key).alias("same"))


# Loads -------------------------------------------------------------------------------------------------------------

UPSERT_SQL = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < 4900 UNION ALL SELECT o_orderkey, o_totalprice + 1 FROM orders WHERE o_orderkey >= 4900"


@query("k3_upsert", f"SELECT count(*) n_rows, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DECIMAL(28, 2)) total FROM ({UPSERT_SQL})")
def k3(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    out = load.upsert(o.filter("o_orderkey < 5000"), o.filter("o_orderkey >= 4900").withColumn("o_totalprice", F.col("o_totalprice") + 1), ["o_orderkey"])
    return out.agg(F.count("*").alias("n_rows"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))


@query("k4_chunk_size", "SELECT CAST(n AS BIGINT) n_columns, CAST(least(1000, greatest(1, 65535 // n)) AS BIGINT) chunk FROM (VALUES (1), (65), (66), (100), (65535), (70000)) v(n)")
def k4(spark, d):
    return spark.createDataFrame([(n, load.chunk_rows(n)) for n in (1, 65, 66, 100, 65535, 70000)], "n_columns bigint, chunk bigint")


@query("k6_keyless_copy", "SELECT count(*) n_rows, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DECIMAL(28, 2)) total FROM lineitem")
def k6(spark, d):
    """A keyless load into a new folder of the shared one, read back."""
    path = f"{load.shared_dir(spark)}/keyless-{uuid.uuid4().hex}"
    load.keyless_load(read(spark, d, "lineitem"), path)
    return spark.read.parquet(path).agg(F.count("*").alias("n_rows"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("total"))


class _Breaks(Exception):
    pass


@query("x4_resumed_copy", "SELECT count(*) n_rows, count(DISTINCT o_orderkey) n_keys, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DECIMAL(28, 2)) total, TRUE broke, TRUE resumed FROM orders")
def x4(spark, d):
    """A run that breaks off after two ranges of the key, then goes on in the same session: what the target holds at the end."""
    target, store, seen = f"{load.shared_dir(spark)}/resumed-{uuid.uuid4().hex}", Store(), []

    def sink(event):
        seen.append(event["message"])
        if len(seen) == 2:
            raise _Breaks

    source = ParquetSource(spark, d, ["orders"], {"orders": ("o_orderkey",)}, [])
    with contextlib.suppress(_Breaks):
        Runner(spark, source, target, store, "s", Options(batch=100, ranges=5, sink=sink)).start()
    held = store.checkpoint("s", "orders")
    moved = Runner(spark, source, target, store, "s", Options(batch=100, ranges=5)).start()["rows"]
    resumed = moved + held.last_offset == held.row_count and 0 < moved < held.row_count
    out = spark.read.parquet(f"{target}/orders")
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(28,2)").alias("total")
    return out.agg(F.count("*").alias("n_rows"), F.countDistinct("o_orderkey").alias("n_keys"), total).withColumns({"broke": F.lit(held.status == "error"), "resumed": F.lit(resumed)})


@query("x3_replay_equivalence", "SELECT CAST(0 AS BIGINT) n_diff, count(*) n_rows FROM orders")
def x3(spark, d):
    """A batch applied twice gives the source again: rows by which the two differ, either way."""
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    first, second = o.filter("o_orderkey <= 10000"), o.filter("o_orderkey > 8000")
    got = load.upsert(load.upsert(first, second, ["o_orderkey"]), second, ["o_orderkey"])
    diff = got.withColumn("s", F.lit(1)).unionByName(o.withColumn("s", F.lit(-1))).groupBy("o_orderkey", "o_custkey", "o_totalprice").agg(F.sum("s").alias("s"))
    n = got.agg(F.count("*").alias("n_rows"))
    return diff.agg(F.count_if(F.col("s") != 0).alias("n_diff")).join(F.broadcast(n))  # one row by one row


@query("x7_event_tail", "SELECT event_id, user_id, event_type FROM events WHERE event_id > 400 ORDER BY event_id LIMIT 500")
def x7(spark, d):
    return rollup.after(read(spark, d, "events").select("event_id", "user_id", "event_type"), 400, order="event_id")


@query("x8_dedup_by_id", "SELECT count(*) n FROM (SELECT DISTINCT event_id % 500 FROM events)")
def x8(spark, d):
    return read(spark, d, "events").select((F.col("event_id") % 500).alias("id")).dropDuplicates(["id"]).agg(F.count("*").alias("n"))


@query("o2_tail_k", f"SELECT id, session_id, level, message FROM ({EVENTS_SQL}) WHERE session_id = 3 ORDER BY id DESC LIMIT 15")
def o2(spark, d):
    return rollup.tail(_events(spark, d).filter("session_id = 3"), 15)


@query("o3_latest", f"SELECT session_id, max(id) id, arg_max(level, id) level, arg_max(message, id) message FROM ({EVENTS_SQL}) GROUP BY session_id")
def o3(spark, d):
    return rollup.latest_event(_events(spark, d))


@query("u1_unknown_tables", "SELECT * FROM (VALUES ('nowhere'), ('zzz')) v(table_name)")
def u1(spark, d):
    asked = spark.createDataFrame([("orders",), ("zzz",), ("nowhere",)], "table_name string")
    return asked.join(_names(spark), "table_name", "left_anti").orderBy("table_name")


# Keys, indexes, progress, plan -------------------------------------------------------------------------------------


@query("d3_pk_unique", " UNION ALL ".join(f"SELECT '{t}' table_name, count(*) n_repeated, CAST(coalesce(sum(n - 1), 0) AS BIGINT) n_surplus FROM (SELECT count(*) n FROM {t} GROUP BY {', '.join(k or ('l_orderkey', 'l_linenumber'))} HAVING count(*) > 1)" for t, k in KEYS.items()))
def d3(spark, d):
    from functools import reduce

    one = lambda t, k: integrity.duplicate_keys(read(spark, d, t), list(k or ("l_orderkey", "l_linenumber"))).agg(F.count("*").alias("n_repeated"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_surplus")).select(F.lit(t).alias("table_name"), "n_repeated", "n_surplus")
    return reduce(DataFrame.unionByName, (one(t, k) for t, k in KEYS.items()))


@query("d6_unique_index", "SELECT p_brand, p_type, p_size, count(*) n FROM part GROUP BY 1, 2, 3 HAVING count(*) > 1")
def d6(spark, d):
    return integrity.duplicate_keys(read(spark, d, "part"), ["p_brand", "p_type", "p_size"])


@query("d7_fk_ladder", " UNION ALL ".join(f"SELECT '{k.name}' fk, 'create' verdict" for k in FOREIGN))
def d7(spark, d):
    src = ParquetSource(spark, d)
    known = set(src.list_tables())
    n = {r.fk: r.n_orphans for r in integrity.orphan_counts(FOREIGN, src.read).collect()}  # a row for each foreign key
    types = lambda t, cols: [target_type(c) for x in cols for c in src.table(t).columns if c.name == x]
    rows = [(k.name, integrity.fk_verdict(k, known, known, set(), (types(k.table, k.columns), types(k.parent, k.parent_columns)), n[k.name])) for k in FOREIGN]
    return spark.createDataFrame(rows, "fk string, verdict string")


@query("w_progress", "SELECT table_name, batch_no, n, CAST(sum(n) OVER (PARTITION BY table_name ORDER BY batch_no) AS BIGINT) rows_done FROM (SELECT o_orderstatus table_name, o_orderkey // 1000 batch_no, count(*) n FROM orders GROUP BY 1, 2)")
def w_progress(spark, d):
    b = read(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("table_name"), F.floor(F.col("o_orderkey") / 1000).alias("batch_no")).agg(F.count("*").alias("n"))
    return rollup.running_progress(b)


@query("c1_plan_report", "SELECT 'warning' severity, 'lineitem' table_name, '' column_name, 'no_key' kind, CAST(1 AS BIGINT) n")
def c1(spark, d):
    """The plan over the tables of orders: clean but for the table without a key."""
    src = ParquetSource(spark, d, ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"])
    return planner.frame(spark, planner.dry_run(src.tables(), src.read)).drop("message")


@query("c1_plan_dirty", "SELECT severity, table_name, column_name, kind, CAST(n AS BIGINT) n FROM (SELECT 'issue' severity, 'dirty' table_name, 't' column_name, 'zero_date' kind, count(*) FILTER (WHERE event_id % 97 = 0) n FROM events UNION ALL SELECT 'issue', 'dirty', 'c', 'time_range', count(*) FILTER (WHERE event_id % 900 >= 24) FROM events UNION ALL SELECT 'warning', 'dirty', 'e', 'enum_marker', count(*) FILTER (WHERE event_id % 101 = 0) FROM events UNION ALL SELECT 'manual', 'dirty', 'trg', 'trigger', 1) WHERE n > 0")
def c1d(spark, d):
    e = F.col("event_id")
    df = read(spark, d, "events").select("event_id", F.when(e % 97 == 0, "0000-00-00 00:00:00").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("t"), F.concat((e % 900).cast("string"), F.lit(":00:00")).alias("c"), F.when(e % 101 == 0, "").otherwise(F.col("event_type")).alias("e"))
    t = Table("dirty", (Column("event_id", "bigint", False), Column("t", "datetime", False), Column("c", "time"), Column("e", "enum('signup','purchase','error','view','click')")), ("event_id",), triggers=("trg",))
    return planner.frame(spark, planner.dry_run([t], lambda _: df)).drop("message")


@query("d13_manual_union", "SELECT * FROM (VALUES ('view', '', 'v1'), ('function', '', 'f1')) x(kind, table_name, name)")
def d13(spark, d):
    from ..plans.ddl import report_only

    items: list[Manual] = report_only("view", ["v1"]) + report_only("function", ["f1"])
    return spark.createDataFrame([(m.kind, m.table, m.name) for m in items], "kind string, table_name string, name string")


@query("v_checksum", "SELECT count(*) n_rows, CAST(sum(CAST(('0x' || substr(sha256(concat_ws(chr(31), CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR), c_mktsegment)), 1, 12)) AS HUGEINT)) AS VARCHAR) digest FROM customer")
def v_checksum(spark, d):
    return load.checksum(read(spark, d, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])


def flagship(spark, d) -> DataFrame:
    """Orders on their way: typed, checked, tied to customers, as one profile row for each status."""
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    bad = integrity.orphans(o, ["o_custkey"], c, ["c_custkey"]).select("o_orderkey", F.lit(True).alias("orphan"))
    typed = V.apply(o, [V.ValuePlan("o_orderkey", "BIGINT", False), V.ValuePlan("o_custkey", "BIGINT"), V.ValuePlan("o_orderstatus", "e", labels=("F", "O", "P")), V.ValuePlan("o_totalprice", "DOUBLE PRECISION")])
    return typed.join(bad, "o_orderkey", "left").groupBy("o_orderstatus").agg(F.count("*").alias("n_rows"), F.count_if(F.size("violations") > 0).alias("n_violations"), F.count_if(F.col("orphan")).alias("n_orphans"), F.max("o_orderkey").alias("last_key"))


@query("entry_flagship", "SELECT o_orderstatus, count(*) n_rows, CAST(0 AS BIGINT) n_violations, CAST(0 AS BIGINT) n_orphans, max(o_orderkey) last_key FROM orders GROUP BY 1")
def _flagship(spark, d):
    return flagship(spark, d)


__all__ = ["ORACLE", "QUERIES", "flagship"]

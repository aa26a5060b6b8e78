import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablehaul.model import Column, ForeignKey, Index, Table
from tablehaul.operators import groups, integrity, keyset, load
from tablehaul.operators.selection import TableFilter
from tablehaul.plans import ddl, planner
from tablehaul.plans.runner import Options, Runner
from tablehaul.plans.state import Checkpoint, Store
from tablehaul.sources import jdbc, snapshot
from tablehaul.sources.tables import FOREIGN, KEYS, ParquetSource, read
from tablehaul.streaming import eventlog, microbatch

SF = "/root/testdata/sf0.001"
SMALL = ["region", "nation", "customer", "orders"]


def source(spark):
    return ParquetSource(spark, SF, SMALL, {t: KEYS[t] for t in SMALL}, [k for k in FOREIGN if k.table in SMALL])


def test_run_resume_and_refusals(spark, tmp_path):
    store = Store(str(tmp_path / "s.db"))
    store.create_session("a")
    out = Runner(spark, source(spark), str(tmp_path / "t"), store, "a", Options(fresh=True, manual_path=str(tmp_path / "m.sql"))).start()
    n = sum(read(spark, SF, t).count() for t in SMALL)
    assert out["rows"] == n and all(o["verdict"] == "create" for o in out["objects"])
    assert os.stat(tmp_path / "m.sql").st_mode & 0o777 == 0o600
    assert {c.status for c in store.checkpoints("a")} == {"done"}
    for t in SMALL:
        assert load.checksum(spark.read.parquet(str(tmp_path / "t" / t)).drop("batch")).collect() == load.checksum(read(spark, SF, t)).collect()
    assert Runner(spark, source(spark), str(tmp_path / "t"), store, "a").start()["rows"] == 0
    with pytest.raises(RuntimeError, match="fresh"):
        Runner(spark, source(spark), str(tmp_path / "t"), store, "b", Options(fresh=True)).start()
    c = store.checkpoint("a", "orders")
    c.row_count += 1
    store.save(c)
    with pytest.raises(RuntimeError, match="finished"):
        Runner(spark, source(spark), str(tmp_path / "t"), store, "a").start()
    with pytest.raises(ValueError, match="refer"):
        Runner(spark, source(spark), str(tmp_path / "u"), store, "c", Options(chosen=TableFilter(include=["orders"]))).start()


def test_violations_stop_a_table(spark, tmp_path):
    class Dirty(ParquetSource):
        def table(self, name):
            t = super().table(name)
            return Table(**{**t.__dict__, "columns": tuple(Column(c.name, "enum('BUILDING')" if c.name == "c_mktsegment" else c.type) for c in t.columns)})

    store = Store()
    with pytest.raises(ValueError, match="label"):
        Runner(spark, Dirty(spark, SF, ["customer"], {"customer": ("c_custkey",)}, []), str(tmp_path), store, "x").start()
    assert store.checkpoint("x", "customer").status == "error"


def test_options():
    for bad in ({"batch": 0}, {"workers": 0}, {"workers": 17}, {"method": "x"}, {"phase": "x"}):
        with pytest.raises(ValueError):
            Options(**bad)


def test_filter():
    f = TableFilter(include=[" Orders "])
    assert f.apply(["users", "orders"]) == ["orders"]
    for bad in ({"include": ["a"], "exclude": ["b"]},):
        with pytest.raises(ValueError):
            TableFilter(**bad)
    with pytest.raises(ValueError, match="a, z"):
        TableFilter(exclude=["z", "a"]).apply(["users"])
    with pytest.raises(ValueError):
        TableFilter(exclude=["users"]).apply(["users"])


def test_keyset_sql():
    sql, args = keyset.batch_sql("events", ["tenant_id", "id"], ["tenant_id", "id"], [b"x", 5], size=10)
    assert sql.endswith("WHERE (`tenant_id` > ?) OR (`tenant_id` = ? AND `id` > ?) ORDER BY `tenant_id`, `id` LIMIT 10") and args == [b"x", b"x", 5]
    assert keyset.batch_sql("t", ["a"], ["a"], offset=7)[0].endswith("OFFSET 7")
    for bad in ({"keys": []}, {"keys": ["a"], "cursor": [1, 2]}, {"keys": ["a"], "size": 0}):
        with pytest.raises(ValueError):
            keyset.batch_sql("t", ["a"], **bad)


def test_batches_are_the_table(spark):
    df, keys, got, cur = read(spark, SF, "conversations").select("conv_id", "turn"), ["conv_id", "turn"], [], None
    while rows := keyset.batch(df, keys, 17, cur).collect():
        got += rows
        cur = list(rows[-1])
    assert got == df.orderBy(*keys).collect()
    ranges = keyset.key_ranges(df, "conv_id", 5)
    assert sum(df.filter(keyset.range_predicate("conv_id", *r)).count() for r in ranges) == df.count()


@settings(max_examples=10, deadline=None)
@given(st.integers(0, 60), st.integers(1, 20))
def test_replay_at_any_point(spark, crash, size):
    df = spark.range(60).withColumn("v", F.col("id") * 2)
    done = df.filter(F.col("id") < crash)
    again = df.filter(F.col("id") >= max(0, crash - size))
    assert sorted(load.upsert(done, again, ["id"]).collect()) == df.collect()


def test_insert_text():
    assert load.insert_sql("s", "user", ["id", "name"], ["id"], 2) == 'INSERT INTO "s"."user" ("id", "name") VALUES ($1, $2), ($3, $4) ON CONFLICT ("id") DO UPDATE SET "name" = EXCLUDED."name"'
    assert load.insert_sql("s", "t", ["id"], ["id"], 1).endswith('SET "id" = EXCLUDED."id"')
    with pytest.raises(ValueError):
        load.insert_sql("s", "t", ["a"], ["id"], 1)
    assert (load.chunk_rows(10), load.chunk_rows(100), load.chunk_rows(0)) == (1000, 655, 0)
    assert load.replay_risk(0, 0) and load.replay_risk(4, 5) and not load.replay_risk(5, 5) and load.use_append("copy", False)


def test_keyless(spark, tmp_path):
    df = read(spark, SF, "lineitem")
    assert load.keyless_load(df, str(tmp_path / "l")) == df.count()
    with pytest.raises(RuntimeError):
        load.keyless_load(df, str(tmp_path / "l"))


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), min_size=1, max_size=25))
def test_components(spark, edges):
    got = {r.node: r.root for r in groups.components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == groups.union_find({x for e in edges for x in e}, edges)


def t(name, cols, key=(), fks=(), **k):
    return Table(name, tuple(Column(*c) if isinstance(c, tuple) else c for c in cols), key, foreign_keys=fks, **k)


def test_key_groups():
    fk = ForeignKey("f", "c", ("pid",), "p", ("id",))
    tables = [t("p", [("id", "char(36)")], ("id",)), t("c", [("id", "int"), ("pid", "char(36)")], ("id",), (fk,))]
    assert all(d.converts for d in groups.resolve_uuid(tables, {}).values())
    got = groups.resolve_uuid(tables, {("c", "pid"): 3})
    assert not got["p", "id"].converts and "linked" in got["p", "id"].reason and "3 values" in got["c", "pid"].reason
    loose = [tables[0], t("c", [("pid", "varchar(99)")], (), (fk,))]
    assert not groups.resolve_uuid(loose, {})["p", "id"].converts
    big = [t("p", [("id", "bigint unsigned")], ("id",)), t("c", [("pid", "bigint unsigned")], (), (fk,))]
    assert groups.resolve_unsigned(big, {("p", "id"): 5})["c", "pid"].converts
    assert not groups.resolve_unsigned(big, {("p", "id"): 2**63})["c", "pid"].converts
    with pytest.raises(ValueError):
        groups.resolve_unsigned([big[0], t("c", [("pid", "int")], (), (fk,))], {("p", "id"): 2**63})


def test_ddl():
    o = t("order", [Column("id", "bigint", False, extra="auto_increment"), Column("status", "varchar(20)", True, "it's ready"), Column("on", "tinyint(1)", False, "1"), Column("g", "int", generation="a+1"), Column("at", "datetime", extra="on update CURRENT_TIMESTAMP")], ("id",))
    sql = ddl.create_table_sql(o)
    assert '"id" BIGINT NOT NULL GENERATED BY DEFAULT AS IDENTITY' in sql and "DEFAULT 'it''s ready'" in sql and '"on" BOOLEAN NOT NULL DEFAULT TRUE' in sql and '"g" INTEGER,' in sql
    assert len(ddl.on_update_manual(o)) == 1 and "GENERATED ALWAYS AS (a+1)" in ddl.generated_manual(o)[0].sql
    assert 'substring("status" FROM 1 FOR 5)) DESC' in ddl.index_sql(o, Index("i", (("status", 5, True),), True))
    with pytest.raises(ValueError):
        ddl.index_sql(o, Index("i", (("status", None, False),), method="HASH"))
    assert ddl.enum_sql("s", "t", Column("c", "enum('a')"), 1).endswith("('', 'a');")
    k = ForeignKey("f", "orders", ("customer_id", "region"), "customers", ("id", "region"), "CASCADE")
    assert "ON DELETE CASCADE" in integrity.fk_sql(k) and "region" in integrity.orphan_sql(k)
    assert integrity.types_fit(["varchar(9)", "int4"], ["text", "bigint"]) and not integrity.types_fit(["uuid"], ["text"])


def test_dry_run_text(spark):
    src = source(spark)
    text = planner.render(planner.dry_run(src.tables(), src.read, views=["v"]))
    assert "0 issues, 1 manual items" in text


def test_store_upgrade(tmp_path):
    import sqlite3

    p = str(tmp_path / "old.db")
    sqlite3.connect(p).execute("CREATE TABLE migrations(id INTEGER PRIMARY KEY, session_id TEXT, table_name TEXT, status TEXT, last_offset INTEGER, row_count INTEGER, error_message TEXT, created_at TEXT, updated_at TEXT, deleted_at TEXT, UNIQUE(session_id, table_name))")
    s = Store(p)
    s.save(Checkpoint("a", "t", "done", 15_000_000_000, '["x"]', 5, 20_000_000_000))
    s.save(Checkpoint("a", "t", "done", 15_000_000_001, '["y"]', 5, 20_000_000_000))
    assert [(c.last_offset, c.last_cursor) for c in s.checkpoints()] == [(15_000_000_001, '["y"]')]
    ids = [s.append_event("a", "info", str(i)) for i in range(5)]
    assert [e["id"] for e in s.events_after("a", ids[1], 2)] == ids[2:4] and s.last_event("a")["id"] == ids[-1]


def test_hub():
    h = eventlog.Hub(ring=3, slots=2)
    for i in range(5):
        h.publish({"id": i})
    old, q = h.subscribe(3)
    assert [e["id"] for e in old] == [3, 4]
    for i in range(5, 9):
        h.publish({"id": i})
    assert q.closed and q not in h.listeners
    h.finish()
    assert h.subscribe()[1].get() is None
    r = eventlog.Runs()
    first = r.begin("a")
    with pytest.raises(RuntimeError):
        r.begin("a")
    first.finish()
    r.begin("a")


def test_snapshot(spark):
    seq = iter("aabcdd")
    assert snapshot.aligned(lambda: next(seq), lambda: 7) == 7
    n = iter(range(99))
    with pytest.raises(RuntimeError):
        snapshot.aligned(lambda: str(next(n)), lambda: 7)
    assert snapshot.file_token(spark, SF) == snapshot.file_token(spark, SF)


def test_jdbc_on_derby(spark, tmp_path):
    src = jdbc.JdbcSource(spark, f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.jdbc.EmbeddedDriver")
    df = read(spark, SF, "nation")
    df.limit(0).write.jdbc(src.url, "nation", properties=src.properties)
    assert src.checked_append(df, "nation") == 25
    got = src.read_ranges("nation", "n_nationkey", keyset.key_ranges(df, "n_nationkey", 4))
    assert got.rdd.getNumPartitions() == 4 and sorted(got.collect()) == sorted(df.collect())
    assert "useCompression=true" in jdbc.mysql_url("h", 1, "d")
    calls = iter([ValueError("x"), ValueError("x")])

    def connect():
        if (e := next(calls, None)) is not None:
            raise e
        return 1

    assert jdbc.with_retry(connect, sleep=lambda _: None) == 1


def test_stream_restart_counts_once(spark, tmp_path):
    df = read(spark, SF, "orders")
    df.repartition(6).write.parquet(str(tmp_path / "in"))
    go = lambda **k: microbatch.copy_stream(microbatch.parquet_stream(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "out"), str(tmp_path / "ck"), **k)
    with pytest.raises(Exception):  # noqa: B017
        go(fail_after=2)
    go()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert load.checksum(got).collect() == load.checksum(df).collect()


def test_keyset_stream(spark, tmp_path):
    from tablehaul.sources.keyset_stream import KeysetSource

    spark.dataSource.register(KeysetSource)
    df = read(spark, SF, "orders").select("o_orderkey", "o_custkey")
    stream = spark.readStream.format("keyset").schema(df.schema).option("key", "o_orderkey").load(f"{SF}/orders.parquet")
    seen = microbatch.copy_stream(stream, str(tmp_path / "o"), str(tmp_path / "c"))
    assert sum(seen) == df.count() and spark.read.parquet(str(tmp_path / "o")).select("o_orderkey").distinct().count() == df.count()


def test_batches_keep_a_column_of_that_name(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None)], "batch string, n int")
    path = str(tmp_path / "t")
    assert load.load_batch(spark, df, path, 0) == 2 and load.load_batch(spark, df.limit(1), path, 1) == 1 and load.load_batch(spark, df, path, 0) == 2
    got = spark.read.parquet(path)
    assert got.columns == df.columns and sorted(r.batch for r in got.collect()) in (["a", "a", "b"], ["a", "b", "b"])
    assert load.load_batch(spark, df.limit(0), path, 1) == 0 and load.checksum(spark.read.parquet(path)).collect() == load.checksum(df).collect()


def test_null_keys_belong_to_the_first_range(spark):
    df = spark.createDataFrame([(None,), *((i,) for i in range(50))], "k int")
    ranges = keyset.key_ranges(df, "k", 4)
    assert len(ranges) > 1 and sum(df.filter(keyset.range_predicate("k", *r)).count() for r in ranges) == 51
    assert jdbc.range_predicates("k", [(None, 5), (5, None)], "`") == ["(`k` <= 5 OR `k` IS NULL)", "`k` > 5"]


class Break(Exception):
    pass


def test_a_run_goes_on_after_its_last_range(spark, tmp_path):
    store, names = Store(), ["conversations", "customer"]
    src = ParquetSource(spark, SF, names, {t: KEYS[t] for t in names}, [])
    seen = []

    def sink(e):
        seen.append(e["message"])
        if len(seen) == 3:
            raise Break

    options = {"batch": 20, "ranges": 4, "workers": 1}
    with pytest.raises(Break):
        Runner(spark, src, str(tmp_path), store, "a", Options(**options, sink=sink)).start()
    held = store.checkpoint("a", "conversations")
    assert held.status == "error" and 0 < held.last_offset < held.row_count and held.last_cursor
    assert spark.read.parquet(str(tmp_path / "conversations")).count() == held.last_offset
    # a batch whose end was not saved: its files go by the same number, and are replaced
    load.load_batch(spark, read(spark, SF, "conversations").limit(7), str(tmp_path / "conversations"), held.last_offset)
    out = Runner(spark, src, str(tmp_path), store, "a", Options(**options)).start()
    assert out["rows"] == held.row_count - held.last_offset + read(spark, SF, "customer").count()
    for t in names:
        assert load.checksum(spark.read.parquet(str(tmp_path / t))).collect() == load.checksum(read(spark, SF, t)).collect()
    spark.read.parquet(str(tmp_path / "customer")).limit(3).write.mode("append").parquet(str(tmp_path / "customer"))
    with pytest.raises(RuntimeError, match="finished"):
        Runner(spark, src, str(tmp_path), store, "a", Options(**options)).start()


def test_tables_whose_keys_make_no_ranges(spark, tmp_path):
    base = f"{tmp_path}/in"
    spark.createDataFrame([(f"k{i}", i) for i in range(40)], "k string, n int").write.parquet(f"{base}/words.parquet")
    spark.createDataFrame([(None, 1), (2, 2), (2, 3)], "k int, n int").write.parquet(f"{base}/nulls.parquet")
    spark.createDataFrame([], "k int, n int").write.parquet(f"{base}/void.parquet")
    src = ParquetSource(spark, base, keys={"words": ("k",), "nulls": ("k", "n"), "void": ("k",)})
    assert src.list_tables() == ["nulls", "void", "words"]
    out = Runner(spark, src, str(tmp_path / "t"), Store(), "a", Options(batch=1, ranges=3)).start()
    assert out["rows"] == 43
    for t in src.list_tables():
        assert load.checksum(spark.read.parquet(str(tmp_path / "t" / t))).collect() == load.checksum(src.read(t)).collect()


def test_a_database_as_source(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/src;create=true"
    c = spark._jvm.java.sql.DriverManager.getConnection(url)
    s = c.createStatement()
    for sql in (
        "CREATE TABLE SHELF (AISLE INT NOT NULL, SPOT INT NOT NULL, LABEL VARCHAR(20), PRIMARY KEY (AISLE, SPOT))",
        """CREATE TABLE "Box" (ID BIGINT NOT NULL GENERATED BY DEFAULT AS IDENTITY PRIMARY KEY, AISLE INT, SPOT INT, KG DECIMAL(9,3), TAG VARCHAR(9) DEFAULT 'x', CONSTRAINT HOME FOREIGN KEY (AISLE, SPOT) REFERENCES SHELF (AISLE, SPOT) ON DELETE CASCADE)""",
        'CREATE UNIQUE INDEX BY_TAG ON "Box" (TAG, KG DESC)', 'CREATE TABLE "Box_Log" (NOTE VARCHAR(50))',
        "INSERT INTO SHELF VALUES (1, 1, 'low'), (1, 2, NULL), (2, 1, 'high')", """INSERT INTO "Box" (AISLE, SPOT, KG, TAG) VALUES (1, 1, 0.5, 'a'), (1, 2, 12.125, 'b'), (NULL, NULL, NULL, 'c')""",
    ):
        s.execute(sql)
    c.close()
    src = jdbc.JdbcSource(spark, url, "org.apache.derby.jdbc.EmbeddedDriver", schema="APP")
    box, log, shelf = src.tables()
    assert (box.name, box.key, log.key, shelf.key) == ("Box", ("ID",), (), ("AISLE", "SPOT"))
    assert [(c.name, c.type, c.nullable, c.extra) for c in box.columns] == [("ID", "bigint", False, "auto_increment"), ("AISLE", "int", True, ""), ("SPOT", "int", True, ""), ("KG", "decimal(9,3)", True, ""), ("TAG", "varchar(9)", True, "")]
    assert box.foreign_keys == (ForeignKey("HOME", "Box", ("AISLE", "SPOT"), "SHELF", ("AISLE", "SPOT"), "CASCADE"),)
    assert box.indexes == (Index("BY_TAG", (("TAG", None, False), ("KG", None, True)), True),) and not shelf.indexes
    out = Runner(spark, src, str(tmp_path / "t"), Store(), "a", Options(batch=1, ranges=2)).start()
    assert out["rows"] == 6 and {o["object"]: o["verdict"] for o in out["objects"]} == {"HOME": "create"}
    assert load.checksum(spark.read.parquet(str(tmp_path / "t" / "Box"))).collect() == load.checksum(src.read("Box")).collect()
    assert planner.dry_run(src.tables(), src.read).issues == 0

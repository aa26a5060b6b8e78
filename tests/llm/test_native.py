import random

import pytest
from pyspark.sql import functions as F

from tablehaul.llm import chat, queries, sharding, url_filter
from tablehaul.llm.url_filter import Rule

from ..oracle import same

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op1_url_filter", "op2_chat_perspectives"])
def test_matches_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLE[name], SF)


URLS = ["http://a.COM/x", "https://www.example.com/en/1?x#y", "http://m.example.com/en/", "http://example.com/en", "ftp://x.net/es/a", "http://net/fr/", "http://com", "http://COM?/", "mailto:x", None, "", "http://ÄB.com/ß/", "http://example.com:80/en/", "http://xcom/"]


def test_url_edges(spark):
    df = spark.createDataFrame([(i, u, "keep") for i, u in enumerate(URLS)] + [(1, URLS[1], "keep")], "page_id long, url string, note string")
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    assert (got[0].host, got[0].rule) == ("a.com", "com/")
    assert (got[1].rule, got[1].verdict) == ("www.example.com/en/", "allow")
    assert (got[2].rule, got[2].verdict) == ("example.com/en/", "block")
    assert got[3].rule == "com/" and got[4].rule == "net/es/" and got[5].rule == "net/fr/"
    assert got[6].rule is None and (got[7].host, got[7].path, got[7].rule) == ("com", "", None)
    for i in (8, 9, 10):
        assert (got[i].host, got[i].path, got[i].verdict) == ("", "", "allow")
    assert got[11].host == "Äb.com" and got[11].rule == "com/" and got[12].rule is None and got[13].rule is None
    assert url_filter.judge(df.limit(0)).count() == 0 and url_filter.judge(df).count() == len(URLS) + 1


def test_url_table_path_agrees(spark):
    rules = [*url_filter.RULES, Rule("block", "m.example.com", "/en/4"), Rule("allow", "example.org", "/")]
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    a, b = url_filter.judge(pages, rules), url_filter.judge(pages, rules, inline=0)
    assert a.exceptAll(b.select(a.columns)).count() == 0 and b.select(a.columns).exceptAll(a).count() == 0


def test_rotation_edges(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, None, "?"), (2, 0, "system", "alone"), (None, 0, "ann", "lost"), (3, 700, "ann", "x"), (3, 1, "ann", "y" * 5000)]
    out = chat.rotate(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, rendered int"))
    got = out.orderBy("conv_id", "participant", "char_start").collect()
    assert {(r.conv_id, r.participant) for r in got} == {(1, "ann"), (1, "bob"), (1, "unknown"), (3, "ann")}
    whole = {(r.conv_id, r.participant): r for r in chat.dialogues(out).collect()}
    for r in got:
        text = whole[r.conv_id, r.participant].text
        assert text[r.char_start : r.char_end] == r.rendered
        if r.mask_start is not None:
            assert r.role == "assistant" and r.masked_chars == r.mask_end - r.mask_start
    ann = whole[1, "ann"]
    assert ann.text == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n<|user|> bob\n<|end|>\n<|user|> unknown\n?<|end|>\n"
    assert [ann.text[a:b] for a, b in ann.masks] == ["hi"]
    assert chat.dialogues(out, max_chars=1000).filter("conv_id = 3").count() == 0
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_shards(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.QUERIES["op6_slot_sharding"](spark, SF).toPandas()
    assert len(got) == docs.count()
    loads = got.groupby("shard")["size"].sum()
    assert len(loads) == 16 and loads.max() - loads.min() < 0.02 * loads.mean()
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


def test_shard_edges(spark):
    rows = [(1, None), (None, "a"), (None, None), (2, ""), (2, ""), (3, "ä" * 10_000)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=3, slots=64).toPandas()
    assert sorted(out["size"]) == [1, 1, 1, 1, 2, 20_001]
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string"), shards=3, slots=64).count() == 0


def test_map_edits(spark, tmp_path):
    w = [(i * 7919) % 101 + 1 for i in range(512)]
    a = sharding.balanced(w, 8)
    b = sharding.rebalance(a, w, 9)
    load = lambda m: [sum(x for x, s in zip(w, m.owner, strict=True) if s == k) for k in range(m.shards)]
    assert max(load(b)) < 1.02 * sum(w) / 9 and b.version == 2
    moved = [i for i in range(512) if a.owner[i] != b.owner[i]]
    assert len(moved) < 512 / 9 * 1.5
    c = sharding.rebalance(b, w, 5)
    assert c.shards == 5 and max(load(c)) < 1.02 * sum(w) / 5
    for m in (a, b, c):
        m.save(spark, str(tmp_path / "map"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "map")).owner == c.owner
    assert sharding.SlotMap.load(spark, str(tmp_path / "map"), 1).owner == a.owner
    assert a.frame(spark).filter(F.col("shard") > 7).isEmpty()


def test_rules_with_dots_run_and_hosts_may_hold_anything(spark):
    rules = [Rule("allow", "com", "/"), Rule("block", "example.com", "/v1.2/"), Rule("block", "example.com", "/a.b")]
    urls = ["http://example.com/v1.2/x", "http://example.com/a.bc", "http://a\nb.example.com/v1.2/", "http://example.com/v1-2/"]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    for inline in (2000, 0):
        got = {r.page_id: r.rule for r in url_filter.judge(df, rules, inline=inline).collect()}
        assert got == {0: "example.com/v1.2/", 1: "example.com/a.b", 2: "example.com/v1.2/", 3: "com/"}
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame([(1, "http://a\nb.example.com/en/x")], "page_id long, url string")).collect()}
    assert got == {1: ("example.com/en/", "block")}


def test_shards_against_python(spark):
    import zlib

    r = random.Random(3)
    rows = [(i, "é" * r.randrange(50)) for i in range(600)] + [(7, "same text")] * 3000 + [(None, None)] * 40 + [(9, "z" * 40_000)]
    df = spark.createDataFrame([(*x, 5, "b") for x in rows], "doc_id long, text string, shard int, slot string").repartition(3)
    got = sharding.shard(df, shards=16, slots=512).toPandas()
    want = sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows if d is not None)
    known = got[got.doc_id.notna()]
    assert sorted(zip(known.doc_id.astype(int), known["size"], known.text_crc32)) == want and len(got) == len(rows)
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    loads = got[got["size"] < 40_000].groupby("shard")["size"].sum()
    whole = got.groupby("shard")["size"].sum()
    assert len(whole) == 16 and sorted(whole)[-2] < 1.1 * sorted(whole)[0] and (got[got.doc_id == 7].groupby("shard").size() < 600).all() and len(loads) >= 15

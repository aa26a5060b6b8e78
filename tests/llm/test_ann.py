import numpy as np
import pytest

from tablehaul.llm import ann, queries


def exact(rows, every=20, top=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for a in np.flatnonzero(ids % every == 0):
        s = x @ x[a]
        order = [j for j in np.lexsort((ids, -s)) if j != a][:top]
        out[int(ids[a])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_against_brute_force(spark, sf):
    d = f"/root/testdata/sf{sf}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    want = exact(rows)
    got = queries.QUERIES["op4_additive_ann"](spark, d).toPandas().sort_values(["query_id", "rank"])
    assert set(got.query_id) == set(want)
    hits = n = 0
    by = dict(rows)
    for q, g in got.groupby("query_id"):
        assert list(g["rank"]) == list(range(1, len(g) + 1)) and len(g) == len(want[q])
        assert list(zip(-g.score, g.vec_id)) == sorted(zip(-g.score, g.vec_id))
        assert np.allclose(g.score, [np.dot(np.array(by[q], float), np.array(by[v], float)) for v in g.vec_id], atol=1e-12)
        hits += len(set(g.vec_id) & {v for v, _ in want[q]})
        n += len(want[q])
    assert hits / n >= 0.95


def test_blocks_agree(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(v) for v in r.normal(size=8)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = exact(rows := [(i, np.float32(v).tolist()) for i, v in rows])
    got = ann.search(df, m=6, k=16, rerank=300, query_block=4, code_block=50).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(q, v) for q in sorted(want) for v, _ in want[q]]


def test_beam_beats_greedy():
    x = np.random.default_rng(1).normal(size=(400, 16)).astype(np.float32)
    books = ann.fit(x, 6, 16, rounds=1)
    err = lambda b: float(((x - ann.decode(ann.encode(x, books, b), books)) ** 2).sum())
    assert err(8) < err(1)
    codes = ann.encode(x, books)
    tables = np.einsum("qd,mkd->qmk", x[:5], books)
    assert np.allclose(ann.look_up(tables, codes.astype(int)), x[:5] @ ann.decode(codes, books).T, atol=1e-3)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 9), (20, [1.0, 2.0], 9), (20, [1.0, 2.0], 9), (1, None, 9), (2, [0.0, 0.0], 9), (3, [nan, 1.0], 9), (40, [inf, 1.0], 9), (5, [None, 1.0], 9), (6, [1.0], 9), (None, [1.0, 1.0], 9), (7, [1.0, 2.0], 9), (8, [], 9), (9, [-1.0, 0.0], 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 7, 5.0), (0, 2, 20, 5.0), (0, 3, 9, -1.0), (20, 1, 0, 5.0), (20, 2, 7, 5.0), (20, 3, 9, -1.0)]
    assert ann.search(df.limit(0)).count() == 0
    assert ann.search(df.filter("vec_id = 0")).count() == 0


def test_many_equal_vectors_go_by_id(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0, 3.0, 4.0]) for i in range(1000)], "vec_id long, embedding array<float>").repartition(5)
    got = ann.search(df).filter("query_id = 500").orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(20)) and {r.score for r in got} == {30.0}


def test_recall_on_rows_outside_the_sample(spark):
    r = np.random.default_rng(11)
    x = r.normal(size=(5 * ann.SAMPLE, 32)).astype(np.float32)
    df = spark.createDataFrame(__import__("pandas").DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<float>")
    got = ann.search(df, every=400).toPandas()
    q = np.arange(0, len(x), 400)
    s = x[q].astype(float) @ x.T.astype(float)
    s[np.arange(len(q)), q] = -np.inf
    want = np.argpartition(-s, 19, axis=1)[:, :20]
    hits = sum(len(set(g.vec_id) & set(want[k // 400].tolist())) for k, g in got.groupby("query_id"))
    assert hits / want.size >= 0.95


def test_other_rows_lose_none_of_the_nearest(spark):
    """More dimensions than the codes can tell apart, lengths far apart, components that single precision can't square."""
    r = np.random.default_rng(2)
    for x in (r.normal(size=(6000, 192)), r.normal(size=(3000, 8)) * np.exp(3 * r.normal(size=(3000, 1))), r.normal(size=(1500, 8)) * 1e25):
        x = x.astype(np.float32)
        df = spark.createDataFrame(__import__("pandas").DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<float>")
        got = ann.search(df, every=100, m=8, code_block=2500).orderBy("query_id", "rank").collect()
        want = exact(list(enumerate(x.astype(float))), every=100)
        assert [(g.query_id, g.vec_id) for g in got] == [(q, v) for q in sorted(want) for v, _ in want[q]]
        assert np.allclose([g.score for g in got], [s for q in sorted(want) for _, s in want[q]], rtol=1e-9)

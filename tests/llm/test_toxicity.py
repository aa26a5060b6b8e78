from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tablehaul.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


def random_index(n=700, nf=60, seed=5):
    r = np.random.default_rng(seed)
    some = lambda: {int(f): int(r.integers(1, 5)) for f in r.choice(nf, size=r.integers(0, 6), replace=False)}
    rows = [(i, int(r.random() < 0.3), some()) for i in range(n)]
    return toxicity.build(1 + r.random(nf) * 4, rows, {0: 7000, 1: 300}), rows, r


def test_nearest_is_exact_and_skips_blocks():
    index, _, r = random_index()
    m = np.concatenate(index.dense, 1)
    index.opened, n = 0, 0
    for _ in range(300):
        f, w = index.vector(Counter({int(x): int(c) for x, c in zip(r.choice(60, 3, replace=False), r.integers(1, 4, 3))}))
        got, sims = index.nearest(f, w, 10)
        exact = w @ m[f]
        at = np.flatnonzero(exact > 0)
        want = at[np.lexsort((at, -exact[at]))][:10]
        assert np.allclose(exact[want], sims) and np.allclose(exact[got], sims)
        n += len(index.dense)
    assert index.opened < n


def test_isotonic_rises():
    r = np.random.default_rng(2)
    x = r.random(500)
    y = (r.random(500) < x).astype(float)
    xs, ys = toxicity.isotonic(x, y, np.ones(500))
    assert (np.diff(ys) >= 0).all() and abs(np.interp(0.5, xs, ys) - 0.5) < 0.2


def test_held_out_rows(spark):
    got = queries.QUERIES["op3_toxicity"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    held = got[got.held_out]
    tp = ((held.predicted == 1) & (held.toxic == 1)).sum()
    assert tp / (held.predicted == 1).sum() > 0.95 and tp / (held.toxic == 1).sum() > 0.85
    pos, neg = held.score[held.toxic == 1].to_numpy(), held.score[held.toxic == 0].to_numpy()
    assert ((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()) > 0.93


def test_labels_of_held_out_rows_have_no_say(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.crc32_mod(F.col("doc_id"), 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, turned)
    assert a[1] == b[1] and a[0].bare == b[0].bare and (a[0].ids == b[0].ids).all()


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (2, "", 0.5), (None, "idiot " * 30_000, 0.5), (5, "x", 0.5)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels, want in ((none, 0.0), (spark.createDataFrame([(1, None)], "doc_id long, toxic int"), 0.0)):
        index, known = toxicity.train(docs, labels)
        got = toxicity.score(docs, index, known).collect()
        assert len(got) == 5 and {r.score for r in got} == {want}
    index, _, _ = random_index()
    index.bare = 0.1
    known = {"idio": 3}
    got = {r.doc_id: r for r in toxicity.score(docs, index, known).collect()}
    assert got[None].evidence and got[1].score == 0.1
    assert toxicity.keep_clean(docs, index, known).columns == docs.columns
    assert toxicity.score(docs.limit(0), index, known).count() == 0


def test_every_word_of_the_examples_has_a_say(spark):
    docs = spark.createDataFrame([(i, f"common words w{i % 5} " + ("sour lemon" if i % 3 == 0 else "sweet melon")) for i in range(1, 61)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) toxic")
    index, known = toxicity.train(docs, labels)  # 16 toxic examples at most: no gate may drop their words
    assert set(known) == {"comm", "commo", "word", "words", "w0", "w1", "w2", "w3", "w4", "sour", "lemo", "lemon", "swee", "sweet", "melo", "melon"}
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, index, known).collect()}
    assert all(got[i] == (i % 3 == 0) for i in got)


def test_head_and_postings_give_the_exact_nearest():
    import pickle

    r = np.random.default_rng(9)
    p = np.r_[np.full(10, 0.4), np.full(90, 0.01)]
    rows = [(i, i % 2, {int(f): int(r.integers(1, 5)) for f in np.flatnonzero(r.random(100) < p)}) for i in range(500)]
    index = pickle.loads(pickle.dumps(toxicity.build(1 + r.random(100), rows, {0: 250, 1: 250})))
    assert 0 < len(index.head) < 100 and len(index.example)
    m = np.concatenate(index.dense, 1)[:, : len(index.ids)]
    assert np.allclose((m**2).sum(0), 1)
    vectors = [index.vector(Counter(row[2])) for row in rows if row[2]]
    for (f, w), base in zip(vectors, index.from_head(vectors), strict=True):
        exact = w @ m[f]
        got, sims = index.nearest(f, w, 10, base=base)
        assert np.allclose(np.sort(exact[exact > 0])[::-1][:10], sims) and np.allclose(exact[got], sims)


def test_the_driver_gives_memory_back_while_it_trains(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(toxicity, "settle", lambda s: calls.append(s), raising=False)
    docs = spark.createDataFrame([(i, f"word{i % 7} other text") for i in range(40)], "doc_id long, text string")
    toxicity.train(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int"))
    assert len(calls) == 2


def test_latin_words_are_cut_without_the_pattern(monkeypatch):
    odd = ["x²y ª_ß é\xa0b\x85c\x1cd µ ÿ÷×½¾ İ", "Straße, NAÏVE l'été! 12_ab " * 3, "Σ ΑΣ ﬁn 漢字かな 中 word", "".join(map(chr, range(1, 400))), ""]
    want = [toxicity.WORD.findall(t.lower()) for t in odd]
    assert [toxicity.heads(t) for t in odd] == want
    asked = []

    class Counting:
        def findall(self, text):
            asked.append(text)
            return []

    monkeypatch.setattr(toxicity, "WORD", Counting())
    known = {s: i for i, s in enumerate(("nave", "naïv", "naïve", "word", "words"))}
    got = toxicity.counts(["Words, WORD naïve wordy", None, "", "naïvely \xa0 nothing"] * 30, known, {})
    assert not asked
    assert [(f.tolist(), n.tolist()) for f, n in got] == [([1, 2, 3, 4], [1, 1, 3, 1]), ([], []), ([], []), ([1, 2], [1, 1])] * 30


def test_texts_counted_in_parts_give_the_same(monkeypatch):
    texts = ["a b c d e f " * 9, None, "b", "", "c " * 40, "d e", "x"] * 5
    known = {c: i for i, c in enumerate("abcdef")}
    want = [Counter(known[w] for w in (t or "").split() if w in known) for t in texts]
    for limit in (1, 7, 1 << 16):
        monkeypatch.setattr(toxicity, "AT_ONCE", limit, raising=False)
        assert [dict(zip(f.tolist(), n.tolist(), strict=True)) for f, n in toxicity.counts(texts, known, {})] == want


def test_wide_blocks_give_the_exact_nearest():
    index, _, r = random_index(n=5000, nf=400, seed=8)
    assert index.blocks <= toxicity.BLOCKS and index.size > toxicity.BLOCK
    m = np.concatenate(index.dense, 1)[:, : len(index.ids)]
    for _ in range(200):
        f, w = index.vector(Counter({int(x): int(c) for x, c in zip(r.choice(400, 4, replace=False), r.integers(1, 4, 4))}))
        got, sims = index.nearest(f, w)
        exact = w @ m[f]
        assert np.allclose(np.sort(exact[exact > 0])[::-1][:30], sims) and np.allclose(exact[got], sims)

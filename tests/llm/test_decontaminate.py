import random

import numpy as np

from tablehaul.llm import decontaminate as D
from tablehaul.llm import queries

SF = "/root/testdata/sf0.01"


def slow(item, doc):
    h = np.zeros((len(item) + 1, len(doc) + 1), int)
    for i, a in enumerate(item, 1):
        for j, b in enumerate(doc, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (D.MATCH if a == b else D.MISMATCH), h[i - 1, j] + D.GAP, h[i, j - 1] + D.GAP)
    return h.max()


def test_alignment_equals_the_table():
    r = np.random.default_rng(4)
    for _ in range(150):
        item, doc = r.integers(0, 6, r.integers(1, 25)), r.integers(0, 6, r.integers(1, 60))
        s, a, b = D.align(item, doc)
        assert s == slow(item, doc)
        assert s == 0 or slow(item, doc[a:b]) == s


def corpus():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    say = lambda n: [word() for _ in range(n)]
    items = [(i, say(r.randrange(15, 50))) for i in range(25)]
    docs, truth = [], set()
    for d in range(150):
        text = say(r.randrange(0, 300))
        if d % 5 == 0:
            k, w = items[d % 25 if d % 2 else 0]
            w = list(w)
            if d % 10 == 0:
                for _ in range(max(1, len(w) // 8)):
                    at = r.randrange(len(w))
                    w[at : at + 1] = r.choice([[word()], [], [w[at], word()]])
            cut = r.randrange(len(text) + 1)
            text[cut:cut] = [x.upper() + "," for x in w]
            truth.add((d, k))
        docs.append((d, " ".join(text)))
    return items, docs, truth


def test_planted_leaks_against_every_pair(spark):
    items, docs, truth = corpus()
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in D.leaks(df, b).collect()}
    every = {}
    for i, w in items:
        for d, t in docs:
            names = {}
            n = lambda xs: np.array([names.setdefault(x, len(names)) for x in xs], int)
            a, x = n(w), n(D.words(t))
            if len(x) and (s := D.align(a, x)[0] / (2 * len(a))) >= D.THRESHOLD:
                every[d, i] = s
    assert set(got) == set(every) == truth
    assert all(abs(got[k] - every[k]) < 1e-9 for k in got)
    in_groups = {(r.doc_id, r.item_id): r.score for r in D.leaks(df, b, group=7).collect()}
    assert set(in_groups) == truth
    kept = {r.doc_id for r in D.keep_clean(df, b, group=10).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in truth}


def test_query_finds_whole_passages(spark):
    norm = lambda t: " ".join(D.words(t))
    items = [(r.item_id, norm(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(r.doc_id, f" {norm(r.text)} ") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {(d, i) for d, t in docs for i, w in items if f" {w} " in t}
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op5_decontamination"](spark, SF).collect()}
    assert want and want <= got and len(got - want) <= 1


def test_edges(spark):
    b = spark.createDataFrame([(1, "alpha beta gamma delta epsilon", 0), (2, None, 0), (3, "", 0), (4, "zeta", 0), (None, "alpha beta gamma delta epsilon", 0)], "item_id long, text string, score int")
    df = spark.createDataFrame([(1, None, "b"), (2, "", "b"), (None, "x Alpha beta, gamma delta epsilon y", "b"), (4, "zeta", "b"), (4, "zeta", "b"), (5, "one two " * 20_000, "b")], "doc_id long, text string, item_id string")
    got = sorted((str(r.doc_id), str(r.item_id)) for r in D.leaks(df, b).collect())
    assert got == sorted([("None", "1"), ("None", "None"), ("4", "4"), ("4", "4")])
    assert D.leaks(df.limit(0), b).count() == 0 and D.leaks(df, b.limit(0)).count() == 0
    assert D.keep_clean(df, b).columns == df.columns


def test_partial_copies_that_many_documents_share(spark):
    r = random.Random(3)
    say = lambda n: ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    item = say(60)
    b = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    for n, copies in ((1000, 30), (100, 30)):
        parts = [item] + [item[:40]] * copies
        docs = [(d, " ".join(say(20) + (parts[d] if d < len(parts) else []) + say(20))) for d in range(n)]
        df = spark.createDataFrame(docs, "doc_id long, text string")
        got = {x.doc_id: x.score for x in D.leaks(df, b).collect()}
        assert set(got) == set(range(copies + 1)) and got[0] == 1 and all(abs(got[d] - 40 / 60) < 1e-9 for d in range(1, copies + 1))
        assert {x.doc_id for x in D.keep_clean(df, b).collect()} == set(range(copies + 1, n))


def test_windows_reach_as_far_as_a_leak_can():
    r = random.Random(5)
    say = lambda n: ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    item, noise = say(20), say(60)
    text = noise[:20] + item[:3] + noise[20:37] + item[:10] + noise[37:53] + item[10:] + noise[53:]  # a stray seed 20 words before a copy with 16 words put in
    (k, score, a, e, _), = D.matches(D.Items([(1, " ".join(item))]), " ".join(text), 0.5)
    assert k == 0 and score == (2 * 20 - 16) / 40 and text[a:e] == item[:10] + noise[37:53] + item[10:]

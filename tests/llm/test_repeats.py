import hashlib
import random
from collections import Counter

import pytest

from tablehaul.llm import queries, repeats


def brute(docs, window):
    raws = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(hash(r[q : q + window]) for _, r in raws for q in range(len(r) - window + 1))
    out = []
    for d, r in raws:
        gone = bytearray(len(r))
        for q in range(len(r) - window + 1):
            if seen[hash(r[q : q + window])] > 1:
                gone[q : q + window] = b"\1" * window
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(r), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(r, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=repr)


@pytest.mark.parametrize("window", [4, 20, 50])
def test_against_every_window(spark, window):
    r = random.Random(window)
    text = lambda n: "".join(r.choice("abéd \n") for _ in range(n))
    parts = [text(r.randrange(1, 3 * window)) for _ in range(12)]
    docs = [(i, "".join(x for _ in range(r.randrange(0, 5)) for x in (text(r.randrange(0, 2 * window)), r.choice(parts)))) for i in range(60)]
    docs += [(100, "z" * 9 * window), (101, docs[3][1]), (102, docs[3][1]), (103, "xy" * 4 * window), (104, None), (None, "q" * (window - 1)), (None, docs[5][1]), (104, "")]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, key int, n_bytes int").repartition(3)
    assert rows(repeats.deduplicate(df, window)) == brute(docs, window)
    assert repeats.deduplicate(df.limit(0), window).count() == 0


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = rows(queries.QUERIES["op8_repeats"](spark, d))
    assert got == brute(docs, 400) and any(r[2] for r in got)


@pytest.mark.parametrize("passage", [3, 51])
def test_passages_against_every_string_of_words(spark, passage):
    r = random.Random(passage)
    text = lambda n: [r.choice("ab") * r.randrange(1, 6) for _ in range(n)]
    shared = [text(r.randrange(passage, 2 * passage)) for _ in range(5)]
    docs = [(i, (" \n" if i % 2 else " ").join(w.upper() if i % 3 else w for k in range(r.randrange(4)) for w in (*text(r.randrange(2 * passage)), *(r.choice(shared) if k else [])))) for i in range(50)]
    docs += [(90, docs[1][1]), (91, None), (None, "a " * 9 * passage), (92, "")]
    split = [(d, (t or "").lower().split()) for d, t in docs]
    seen = Counter(tuple(w[q : q + passage]) for _, w in split for q in range(len(w) - passage + 1))
    want = []
    for d, w in split:
        gone = [False] * len(w)
        for q in range(len(w) - passage + 1):
            if seen[tuple(w[q : q + passage])] > 1:
                gone[q : q + passage] = [True] * passage
        want.append((d, sum(gone)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(((x.doc_id, x.n_passage_words) for x in repeats.deduplicate(df, 40, passage).collect()), key=repr) == sorted(want, key=repr)

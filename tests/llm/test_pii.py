import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tablehaul.llm import boosting, pii, queries

SF = "/root/testdata/sf0.01"


def naive(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(pii.only_digits(m[0])) <= 19 and pii.luhn(pii.only_digits(m[0]))]
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(pii.only_digits(m[0])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.-+0123456789 (é", max_size=60))
def test_base_spans_equal_the_patterns(t):
    assert sorted(pii.base_spans(t)) == sorted(naive(t))


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.QUERIES["op10_pii"](spark, SF).collect():
        base = naive(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == b[0] for b in base) for k in pii.BASE]
        assert r.base_sha256 == hashlib.sha256(pii.digest_text(base).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(spans)


def test_model_holds_on_new_sentences():
    trees, limits = pii.model()
    e = pii.examples(1500, 77, True)
    y = np.array([v for *_, v in e])
    s = trees.score(np.array([pii.features(*x[:4]) for x in e]))
    p = s >= np.array([limits[x[1]] for x in e])
    assert y[p].mean() > 0.97 and p[y == 1].mean() > 0.9


def test_selection():
    trees, limits = pii.model()
    found = lambda t: pii.added_spans(t, pii.base_spans(t), trees, limits)
    t = "mail: ann12 (at) corp (dot) com now"
    assert [t[a:b] for _, a, b in found(t)] == ["ann12 (at) corp (dot) com"]
    assert found("order 4123 4567 8901 2345 shipped") == [] and found("the clock says 10:11:12:13:14") == []
    assert found("plain words only") == [] and found("") == []
    assert pii.redact_text("write to a@b.co or +1 (514) 555-8389.", trees, limits) == "write to <EMAIL> or <PHONE>."


def test_edges(spark):
    rows = [(1, None, 5), (None, "a@b.co", 5), (2, "", 5), (2, "", 5), (3, "9" * 50_000 + " x@" + "y" * 20_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = pii.detect(df).collect()
    assert len(got) == 5 and sum(r.n_email for r in got) == 1 and all(r.spans == "" for r in got if r.doc_id is not None)
    assert pii.detect(df.limit(0)).count() == 0
    red = pii.redact(df).collect()
    assert [r.text for r in red][:2] == [None, "<EMAIL>"] and red[0].spans == 5


def test_trees_learn_an_exclusive_or():
    r = np.random.default_rng(1)
    x = r.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    m = boosting.fit(x[:1500], y[:1500])
    assert ((m.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    assert boosting.threshold(np.array([0.9, 0.8, 0.1]), np.array([1, 0, 0]), 0.9) == 0.9

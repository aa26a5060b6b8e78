import zlib

import numpy as np
import pytest

from tablehaul.llm import packing, queries

P = pytest.importorskip("public_tokenizers")
TOK = P.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
ODD = ["a\x1cb c", "<|endoftext|>x <|startoftext|>", "İstanbul ΑΣ Σ", "é ́x", "a b c", "it's WE'LL", "", " ", "​ ᠎", "..." * 50]


def test_chunked_ids_equal_the_tokenizers(spark):
    e = packing.Encoder(TOK)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ODD
    assert all(e.ids_of(t) == e.direct(t) for t in texts)


def test_full_store_is_emptied_safely(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 5)
    e = packing.Encoder(TOK)
    for t in ("a b c", "c d e f", "a b c d e f g h", "a x"):
        assert e.ids_of(t) == e.direct(t)


def brute(pos, pen, size):
    p, w = [0, *pos], [0, *pen]
    best = [0] + [10**12] * len(pos)
    for j in range(1, len(p)):
        best[j] = min(best[i] + size - (p[j] - p[i]) + w[j] for i in range(j) if p[j] - p[i] <= size)
    return best[-1]


def test_cuts_are_the_cheapest():
    r = np.random.default_rng(3)
    for _ in range(200):
        size = int(r.integers(4, 40))
        pos = np.cumsum(r.integers(1, size + 1, int(r.integers(1, 30))))
        pen = r.choice([0, 2, 9], len(pos))
        got = packing.cuts(pos, pen, size)
        at = [0, *got]
        assert got[-1] == pos[-1] and all(0 < b - a <= size for a, b in zip(at, got))
        assert sum(size - (b - a) for a, b in zip(at, got)) + sum(int(pen[list(pos).index(b)]) for b in got) == brute(list(pos), list(pen), size)


def check(pieces, ids_by_doc, size=4096):
    for doc, g in pieces.sort_values("start").groupby("doc_id"):
        ids, at = ids_by_doc[doc], 0
        for r in g.itertuples():
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].astype("<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= size


def test_round_trip(spark):
    got = queries.QUERIES["op9_packing"](spark, SF).toPandas()
    e = packing.Encoder(TOK)
    docs = {r.doc_id: np.frombuffer(e.direct(r.text) + b"\x02\0\0\0", "<u4") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(got.doc_id) == set(docs)
    check(got, docs)
    total = sum(map(len, docs.values()))
    assert total / (4096 * got.sequence_id.nunique()) > 0.95


def test_small_blocks_and_edges(spark):
    e = packing.Encoder(TOK)
    rows = [(i, t, 0) for i, t in enumerate(ODD + ["word " * 9000, None, "One. Two! Three? " * 400])]
    docs = {i: np.frombuffer((e.direct(t) if t else b"") + b"\x02\0\0\0", "<u4") for i, t, _ in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    check(packing.pack(df.coalesce(1), TOK, size=64, block=300).toPandas(), docs, 64)
    check(packing.pack(df, TOK, size=4096).toPandas(), docs)
    assert packing.pack(df.limit(0), TOK).count() == 0
    twice = packing.pack(df.union(df.filter("doc_id = 0")).coalesce(1), TOK).filter("doc_id = 0").count()
    assert twice == 2
    assert packing.pack(spark.createDataFrame([(None, "x")], "doc_id long, text string"), TOK).first().doc_id is None


def test_words_of_the_same_letters_are_encoded_once():
    e = packing.Encoder(P.path("word_bpe_49k.json"))
    text = "Word word, WORD. word?! wordy Wordy; it's IT'S. it é. É, n1 N1, ... a.b A.B"
    assert e.ids_of(text) == e.direct(text)
    sent = []

    class Counting:
        def encode_batch_fast(self, part, add_special_tokens):
            sent.extend(part)
            return tok.encode_batch_fast(part, add_special_tokens=add_special_tokens)

    tok, e.tok = e.tok, Counting()
    more = "Other, other. OTHER! other; Word: wordy!"
    got = e.ids_of(more)
    e.tok = tok
    assert got == e.direct(more) and sorted(x for x in sent if x.isalpha()) == ["other"]


class Counting:
    def __init__(self, tok):
        self.tok, self.sent = tok, []

    def encode_batch_fast(self, part, add_special_tokens):
        self.sent.extend(part)
        return self.tok.encode_batch_fast(part, add_special_tokens=add_special_tokens)


def test_accents_and_all_marks_share_a_words_ids():
    e = packing.Encoder(TOK)
    text = "Échpa échpa, ÉCHPA$$$ échpa%%% straße STRASSE Straße### ÿ Ÿ ÀÖØöøÿ' don't don' don'' x<|endoftext|> x<| x|> a^_^ a\\ a[0] é É́ µ ª"
    want = e.direct(text)
    e.tok = counting = Counting(e.tok)
    assert e.ids_of(text) == want
    assert [x for x in counting.sent if "chpa" in x] == ["échpa"] and "straße###" not in counting.sent


def test_words_still_in_use_survive_a_full_store(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 40)
    e = packing.Encoder(TOK)
    e.tok, tok = Counting(e.tok), e.tok
    for i in range(60):
        e.tok.sent.clear()
        assert e.ids_of(f"common Word{'abcdefghij'[i % 10]}{'klmnop'[i // 10]}") == np.array(tok.encode(f"common Word{'abcdefghij'[i % 10]}{'klmnop'[i // 10]}", add_special_tokens=False).ids, "<u4").tobytes()
        assert len(e.seen) + len(e.old) <= 40 and ("common" in e.tok.sent) == (i == 0)


def slow_candidates(ids, doc_ends, ends, size, sentence, forced, grid):
    grid, pen, low = min(grid, size), {}, 0
    for p in sorted({i + 1 for i, t in enumerate(ids) if ends[min(t, len(ends) - 1)]} | set(doc_ends)):
        pen |= {q: forced for q in range(low + grid, p, grid)} | {p: 0 if p in doc_ends else sentence}
        low = p
    return sorted(pen), [pen[p] for p in sorted(pen)]


def test_candidates_equal_the_slow_way_without_sets(monkeypatch):
    r = np.random.default_rng(4)
    for name in ("unique", "union1d", "isin"):  # they hash in this numpy, which took half of the packing's time
        monkeypatch.setattr(np, name, None)
    for _ in range(200):
        n, size, grid = int(r.integers(1, 400)), int(r.integers(4, 60)), int(r.integers(2, 80))
        ids, ends = r.integers(0, 30, n), r.random(20) < 0.1
        doc_ends = sorted({*r.integers(1, n + 1, 3).tolist(), n})
        pos, pen = packing.candidates(ids, np.array(doc_ends), ends, size, 3, 9, grid)
        assert (pos.tolist(), pen.tolist()) == slow_candidates(ids.tolist(), doc_ends, ends, size, 3, 9, grid)

"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

1. A bounded sample of labelled rows (``PER_CLASS`` of either class, in hash order) is the pool of examples.
2. Features are all word stems of the examples: a word's first 4 and first 5 letters, a shorter word as it is, and
   pairs of letters in scripts without spaces. None is left out; common ones weigh little.
3. Document frequencies of these features are counted over all documents. A feature weighs its count times the square
   of its IDF, which says more than plain IDF in texts full of function words.
4. The examples' unit vectors form an inverted index: postings (example, weight) by feature and block of examples
   (``BLOCK`` of them, or as many times ``BLOCK`` as leave ``BLOCKS`` blocks), with the largest weight of each. Features that more than one in ``HEAD`` examples hold have no postings but a
   column of a matrix, which is multiplied by ``TEXTS`` documents at once, in single precision; whatever may be
   among the nearest by that is computed again in double. What a block's examples have from there, and
   a document's vector times the maxima, bound what a block can offer; the k-th best of what the matrix alone gives
   bounds the k-th best cosine from below. Blocks from the first to the last that reach it are opened, so a feature's
   postings are one stretch: the exact k nearest. Like examples share blocks or lie in neighbours, which keeps the bounds of other blocks low.
5. Neighbours vote with weight 1 / (distance + ``NEAR``), class sizes set right; votes pass an isotonic curve fitted on
   leave-one-out votes of the examples, interpolated between the middles of its steps. A document that shares no feature with any example gets the rate that
   holds for such examples. Evidence: the nearest examples and their cosines.

The index has a fixed bound and travels to every task; no document is shuffled. Labels, lang, source and doc_id never
enter a score; labels only say which examples vote how.

Defined results: null and empty texts have no features; a doc_id labelled both ways counts as toxic; labels of null
are ignored; of rows with one doc_id the least text is the example; without labels of both classes every score is the
toxic share (0 without labels); repeated rows are scored each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod, lean, settle, slices, trim

PER_CLASS = 4000
K, NEAR, BLOCK, EVIDENCE = 30, 0.05, 128, 3
HEAD, TEXTS, BLOCKS = 25, 256, 16
AT_ONCE = 1 << 16  # words whose features are counted at once, one text's at least
WORD = re.compile("([\u2e80-\U0010ffff]\\w*|\\w{1,5})\\w*")  # what stems() reads of a word
LATIN = bytes(i if WORD.match(chr(i)) else 32 for i in range(256))  # Latin-1, with blanks for what no word holds


def stems(word: str) -> tuple[str, ...]:
    if word > "\u2e80":
        return tuple(word[i : i + 2] for i in range(max(1, len(word) - 1)))
    return tuple(word[:n] for n in range(4, min(5, len(word)) + 1)) or (word,)


class Words(dict):
    """word -> its number; known features of word w are ``features[first[w] : first[w + 1]]``."""

    def __init__(self, known: dict[str, int]):
        super().__init__()
        self.known, self.features, self.first = known, array("q"), array("q", [0])

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.features.extend(self.known[s] for s in stems(word) if s in self.known)
        self.first.append(len(self.features))
        return n


def heads(text: str) -> list[str]:
    """``WORD.findall`` of the lower-cased text; in Latin-1 by a table and a split, which are faster."""
    text = text.lower()
    try:
        plain = text.encode("latin-1")
    except UnicodeEncodeError:
        return WORD.findall(text)
    return [w[:5] for w in plain.translate(LATIN).decode("latin-1").split()]


def counts(texts: list[str | None], known: dict[str, int], seen: dict) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text its known features, rising, and how often each occurs. ``seen`` keeps what words gave, and begins
    anew when it is large."""
    words = seen.get("words")
    if words is None or len(words) > 100_000:
        words = seen["words"] = Words(known)
    ids = [np.fromiter(map(words.__getitem__, heads(t)), np.int64) if t else np.zeros(0, np.int64) for t in texts]
    first, features = np.array(words.first), np.array(words.features, np.int64)
    group = np.cumsum([len(i) for i in ids]) // AT_ONCE
    out = []
    for part in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(group)) + 1):  # a text that reaches the next multiple begins a part
        mine = [ids[i] for i in part]
        word = np.concatenate(mine) if mine else np.zeros(0, np.int64)
        start, end = first[word], first[word + 1]
        text = np.repeat(np.arange(len(mine)) << 32, np.array([len(i) for i in mine], np.int64))
        both = np.sort(np.repeat(text, end - start) | features[ranges(start, end)])
        at = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
        n, both = np.diff(np.append(at, len(both))), both[at]
        cut = np.searchsorted(both, np.arange(len(mine) + 1) << 32).tolist()
        f = both & 0xFFFFFFFF
        out += [(f[a:b], n[a:b]) for a, b in zip(cut, cut[1:])]
    return out


def ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges, one after the other."""
    n = end - start
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


@dataclass
class Index:
    """Unit vectors of the examples as postings, by feature, in each by block, in each by rising example."""

    idf: np.ndarray  # what a feature weighs
    ids: np.ndarray
    labels: np.ndarray
    weights: np.ndarray  # of each example, by class
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # of each feature: its first posting, one more at the end
    postings: np.ndarray = field(default_factory=lambda: np.zeros(0, complex))  # example + weight * i, so that one copy moves both
    head: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # features of the matrix
    place: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of each feature: its column, or -1
    common: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))  # examples x head
    curve: tuple[np.ndarray, np.ndarray] = field(default=(np.array([0.0]), np.array([0.0])))
    bare: float = 0.0  # score without any shared feature
    opened: int = 0

    def __post_init__(self) -> None:
        self.bound()

    def __getstate__(self) -> dict:
        """The matrix travels without its zeros, and what follows from the postings not at all."""
        at = np.nonzero(self.common)
        state = self.__dict__ | {"common": (self.common.shape, *(x.astype(np.int32) for x in at), self.common[at])}
        return {k: v for k, v in state.items() if k not in ("top", "at")}

    def __setstate__(self, state: dict) -> None:
        shape, i, j, w = state["common"]
        self.__dict__ = state | {"common": np.zeros(shape, np.float32)}
        self.common[i, j] = w
        self.bound()

    @property
    def size(self) -> int:
        """Examples in a block."""
        return BLOCK * max(1, -(-len(self.ids) // (BLOCK * BLOCKS)))

    @property
    def blocks(self) -> int:
        return max(1, -(-len(self.ids) // self.size))

    @property
    def example(self) -> np.ndarray:
        return self.postings.real.astype(np.int64)

    @property
    def weight(self) -> np.ndarray:
        return self.postings.imag

    def features(self) -> np.ndarray:
        """Of each posting its feature."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    @property
    def dense(self) -> list[np.ndarray]:
        """The same vectors by block as features x examples; for small indexes."""
        m = np.zeros((len(self.idf), self.blocks * self.size))
        m[self.features(), self.example] = self.weight
        m[self.head, : len(self.ids)] = self.common.T
        return [m[:, i : i + self.size] for i in range(0, m.shape[1], self.size)]

    def bound(self) -> None:
        """``top``: the largest weight of each feature and block, rounded up; ``at``: the first posting of both, one more at the end."""
        n = (len(self.first) - 1) * self.blocks
        key = self.features() * self.blocks + self.example // self.size
        self.at = np.append(0, np.cumsum(np.bincount(key, minlength=n))).astype(np.int32)
        self.top = np.zeros((len(self.first) - 1, self.blocks), np.float32)
        if len(key):
            new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            self.top.ravel()[key[new]] = np.nextafter(np.maximum.reduceat(self.weight, new).astype(np.float32), np.float32(np.inf))

    def post(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        f = np.concatenate([f for f, _ in vectors]) if vectors else np.zeros(0, np.int64)
        ex = np.repeat(np.arange(len(vectors), dtype=np.int32), [len(f) for f, _ in vectors])
        order = np.argsort(f, kind="stable")
        f, ex = f[order], ex[order]
        w = np.concatenate([w for _, w in vectors])[order] if vectors else np.zeros(0)
        del order
        self.head = np.flatnonzero(np.bincount(f, minlength=len(self.idf)) * HEAD > len(vectors))
        self.place = np.full(len(self.idf), -1)
        self.place[self.head] = np.arange(len(self.head))
        self.common = np.zeros((len(vectors), len(self.head)), np.float32)
        col = self.place[f]
        held = col >= 0
        self.common[ex[held], col[held]] = w[held]
        del col
        self.postings = np.empty(len(f) - int(held.sum()), complex)
        self.postings.real, self.postings.imag = ex[~held], w[~held]
        self.first = np.searchsorted(f[~held], np.arange(len(self.idf) + 1))
        del f, ex, w, held
        self.bound()

    def vector(self, tf: Counter) -> tuple[np.ndarray, np.ndarray]:
        f = np.array(sorted(tf), int)
        return self.unit(f, np.array([tf[i] for i in f.tolist()], float))

    def unit(self, f: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = n * self.idf[f]
        return f, w / np.linalg.norm(w) if len(f) else w

    def from_head(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the examples share with each vector in the matrix's features, in single precision."""
        q = np.zeros((len(vectors), len(self.head)), np.float32)
        for row, (f, w) in zip(q, vectors, strict=True):
            col = self.place[f]
            row[col[col >= 0]] = w[col >= 0]
        return q @ self.common.T

    def nearest(self, f: np.ndarray, w: np.ndarray, k: int = K, skip: int = -1, base: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) above 0, best first, ties to the earlier example. Exact. ``base``: the vector's row of from_head."""
        if not len(self.ids):
            return np.zeros(0, int), np.zeros(0)
        base = (self.from_head([(f, w)])[0] if base is None else base).astype(float)
        if skip >= 0:
            base[skip] = 0
        col = self.place[f]
        rare, held = col < 0, col >= 0
        g, v = f[rare], w[rare]
        reach = v @ self.top[g]
        off = (2 + len(self.head)) * 2.0**-23  # more than single precision can be off by, for unit vectors
        low = np.partition(base, -k)[-k] if len(base) >= k else 0.0  # the k-th best cosine is this at least
        chosen = np.flatnonzero((reach > 0) & (reach + np.maximum.reduceat(base, np.arange(0, len(base), self.size)) >= low - 2 * off))
        tail = np.zeros(len(base))
        if len(chosen):
            a, b = self.at[g * self.blocks + chosen[0]], self.at[g * self.blocks + chosen[-1] + 1]
            self.opened += int(chosen[-1] - chosen[0] + 1)
            found = np.concatenate([self.postings[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)])
            tail = np.bincount(found.real.astype(np.int64), np.repeat(v, b - a) * found.imag, len(base))
        s = tail + base
        got = np.flatnonzero(s >= low - 2 * off)
        low = np.partition(s[got], -k)[-k] if len(got) >= k else 0.0
        got = got[(s[got] > 0) & (s[got] >= low - 2 * off)]
        if skip >= 0:
            got = got[got != skip]
        sims = tail[got] + (self.common[got].take(col[held], 1) * w[held]).sum(1)
        best = np.lexsort((got, -sims))[:k]
        best = best[sims[best] > 0]
        return got[best], sims[best]

    def vote(self, got: np.ndarray, sims: np.ndarray) -> float:
        w = self.weights[got] / (1 - np.minimum(sims, 1) + NEAR)
        return float((w * self.labels[got]).sum() / w.sum())

    def scores(self, texts: list[str | None], known: dict[str, int], seen: dict) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        for i in range(0, len(texts), TEXTS):
            vectors = [self.unit(f, n.astype(float)) for f, n in counts(texts[i : i + TEXTS], known, seen)]
            for (f, w), base in zip(vectors, self.from_head(vectors), strict=True):
                got, sims = self.nearest(f, w, base=base) if len(f) else (np.zeros(0, int), np.zeros(0))
                if len(got):
                    yield float(np.interp(self.vote(got, sims), *self.curve)), got, sims
                else:
                    yield self.bare, got, sims

    def score(self, text: str | None, known: dict[str, int], seen: dict) -> tuple[float, np.ndarray, np.ndarray]:
        return next(self.scores([text], known, seen))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising step curve nearest to y in weighted squares, as the middles of its steps for linear interpolation."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # value, weight, first x, last x, middle
    for i in order:
        pools.append([y[i], w[i], x[i], x[i], x[i]])
        while len(pools) > 1 and (pools[-2][0] >= pools[-1][0] or pools[-2][3] == pools[-1][2]):
            v, n, _, last, middle = pools.pop()
            p = pools[-1]
            p[4] = (p[4] * p[1] + middle * n) / (p[1] + n)
            p[0], p[1], p[3] = (p[0] * p[1] + v * n) / (p[1] + n), p[1] + n, last
    return np.array([p[4] for p in pools]), np.array([p[0] for p in pools])


def alike(m: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows ``at`` of ``m`` in an order that puts like ones into one block: halved along the main direction, again and again."""
    if len(at) <= BLOCK or not m.shape[1]:
        return at
    x = m[at] - m[at].mean(0)
    v = 1 + np.arange(m.shape[1], dtype=m.dtype) / m.shape[1]
    for _ in range(8):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) or 1
    at = at[np.argsort(x @ v, kind="stable")]
    half = -(-len(at) // (2 * BLOCK)) * BLOCK
    return np.concatenate([alike(m, at[:half]), alike(m, at[half:])])


def build(idf: np.ndarray, rows: list[tuple[int, int, dict[int, int] | tuple[np.ndarray, np.ndarray]]], totals: dict[int, int]) -> Index:
    """The index over (doc_id, toxic, feature counts: a dict, or rising features and their counts), and its calibration.
    Runs on the driver over the bounded sample."""
    rows = [(d, y, (np.array(sorted(c), int), np.array([c[f] for f in sorted(c)], float)) if isinstance(c, dict) else c) for d, y, c in rows]
    n_by = Counter(y for _, y, _ in rows)
    cw = {c: totals.get(c, 0) / max(1, n_by[c]) for c in (0, 1)}
    full = sorted((r for r in rows if len(r[2][0])), key=lambda r: (r[2][0][np.argmax(r[2][1] * idf[r[2][0]])], r[0]))
    for arranged in (False, True):  # the matrix of the first pass says which examples are alike
        index = Index(idf, np.array([r[0] for r in full], np.int64), np.array([r[1] for r in full], float), np.array([cw[r[1]] for r in full]))
        vectors = [index.unit(*r[2]) for r in full]
        index.post(vectors)
        if not arranged:
            full = [full[i] for i in alike(index.common, np.arange(len(full)))]
    bare = [r for r in rows if not len(r[2][0])]
    weight = sum(cw[y] for _, y, _ in bare)
    index.bare = sum(cw[y] for _, y, _ in bare if y == 1) / weight if weight else 0.0
    votes = []
    for at in range(0, len(vectors), TEXTS):
        for i, base in enumerate(index.from_head(vectors[at : at + TEXTS]), at):
            got, sims = index.nearest(*vectors[i], skip=i, base=base)
            if len(got):
                votes.append((index.vote(got, sims), full[i][1], cw[full[i][1]]))
    if votes:
        v = np.array(votes)
        index.curve = isotonic(v[:, 0], v[:, 1], v[:, 2])
    return index


def vocabulary(sample: DataFrame) -> list[str]:
    """All features of the sample (text), in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[str] = set()
        for b in slices(batches):
            for text in b.column(0).to_pylist():
                found.update(s for w in set(WORD.findall((text or "").lower())) for s in stems(w))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], ["stem"])

    return sorted(sample.select("text").mapInArrow(lean(run), "stem string").distinct().toArrow().column(0).to_pylist())  # bounded by the sample


def document_frequencies(docs: DataFrame, known: dict[str, int]) -> tuple[int, dict[int, int]]:
    """(documents, documents with each feature), over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total, seen = np.zeros(len(known), np.int64), 0, {}
        for b in slices(batches):
            total += b.num_rows
            texts = b.column(0).to_pylist()
            for i in range(0, len(texts), TEXTS):
                df += np.bincount(np.concatenate([f for f, _ in counts(texts[i : i + TEXTS], known, seen)]), minlength=len(known))
        f = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(f, -1)), pa.array(np.append(df[f], total))], ["f", "n"])

    got = docs.select("text").mapInArrow(lean(run), "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()  # a row for each feature
    got = dict(zip(got.column("f").to_pylist(), got.column("n").to_pylist(), strict=True))
    return got.pop(-1, 0), got


def train(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, per_class: int = PER_CLASS, held_out: int | None = 0) -> tuple[Index, dict[str, int]]:
    """Labelled rows whose crc32 remainder by 5 is ``held_out`` are left out. ``corpus``: what frequencies are counted over."""
    known_labels = labels.select("doc_id", "toxic").dropna()
    if held_out is not None:
        known_labels = known_labels.filter(crc32_mod(F.col("doc_id"), 5) != held_out)
    per_doc = known_labels.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # labels without a text can't be examples
    have = docs.select("doc_id").distinct()
    per_doc = per_doc.join(have, "doc_id", "left_semi")
    totals = {r.toxic: r.n for r in per_doc.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    empty = Index(np.zeros(0), np.zeros(0, int), np.zeros(0), np.zeros(0))
    if not totals.get(0) or not totals.get(1):
        empty.bare = float(bool(totals.get(1)))
        return empty, {}
    part = lambda c: per_doc.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    picked = part(0).unionByName(part(1)).collect()  # 2 * per_class rows
    spark = docs.sparkSession
    ids = spark.createDataFrame([tuple(r) for r in picked], "doc_id long, toxic int")
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    known = {s: i for i, s in enumerate(vocabulary(sample))}
    if not known:
        empty.bare = totals[1] / (totals[0] + totals[1])
        return empty, {}
    settle(spark)
    total, df = document_frequencies(corpus if corpus is not None else docs, known)
    settle(spark)
    idf = np.array([math.log((1 + total) / (0.5 + df.get(i, 0))) ** 2 for i in range(len(known))])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for b in slices(batches):
            tf = counts(b.column(2).to_pylist(), known, seen)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([c[i] for c in tf], pa.list_(pa.int32())) for i in (0, 1))], ["doc_id", "toxic", "f", "n"])

    got = sample.mapInArrow(lean(vectors), "doc_id long, toxic int, f array<int>, n array<int>").toArrow()  # the sample, as counts of features
    lists = ([x.values.to_numpy(zero_copy_only=False) for x in got.column(c)] if len(got) else [] for c in ("f", "n"))
    rows = sorted(zip(got.column("doc_id").to_pylist(), got.column("toxic").to_pylist(), zip(*lists, strict=True), strict=True), key=lambda r: r[0])
    index = build(idf, rows, totals)
    del got, lists, rows, df
    trim()
    return index, known


def score(docs: DataFrame, index: Index, known: dict[str, int]) -> DataFrame:
    """doc_id, score, predicted, evidence (the nearest examples with cosine and label)."""
    schema = "doc_id long, score double, predicted int, evidence string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for b in slices(batches):
            rows = []
            for s, got, sims in index.scores(b.column(1).to_pylist(), known, seen):
                rows.append((s, int(s >= 0.5), " ".join(f"{index.ids[i]}:{c:.4f}:{int(index.labels[i])}" for i, c in zip(got[:EVIDENCE], sims[:EVIDENCE], strict=True))))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], ["doc_id", "score", "predicted", "evidence"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), schema)


def keep_clean(docs: DataFrame, index: Index, known: dict[str, int]) -> DataFrame:
    """``docs`` without the rows scored as toxic: judged where they lie, so no key is needed and nothing moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for b in slices(batches):
            ok = [s < 0.5 for s, _, _ in index.scores(b.column(b.schema.get_field_index("text")).to_pylist(), known, seen)]
            yield b.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)

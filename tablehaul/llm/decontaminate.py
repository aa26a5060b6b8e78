"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are runs of ``\\w`` in lower case. An item's seeds are all its word n-grams (``N`` words; the whole item if
shorter), however many documents hold them: those of a widely leaked part are frequent, and may be all that a copy
has. Seeds that a document holds name the items to compare, and where; the words around them are aligned with the item
(match 2, mismatch -1, gap -1), which finds paraphrased, cut and edited copies. The score is the alignment's share of
what the whole item would reach; a pair from ``THRESHOLD`` up is a leak. A window reaches as far as any such alignment
through its seeds can, and is passed over only if it shares too few words with the item for any to exist, so every
leak that keeps ``N`` words of the item in a row is found. One that keeps fewer everywhere has no seed.

Items go in groups of ``GROUP``, each with its own pass over the documents, so what a task holds has a fixed bound
for any benchmark. No document is shuffled.

Defined results: null and empty texts and items match nothing; repeated rows and repeated items are judged each (an
item's number is carried, not its key alone); other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, slices

N, THRESHOLD, GROUP, GROUP_CHARS = 3, 0.5, 20_000, 8 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
WORD = re.compile(r"\w+")
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def keys(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key for each run of ``n`` word numbers. Two runs with one key only cost an alignment."""
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for i in range(n):
        out = (out ^ (ids[i : len(ids) - n + 1 + i].astype(np.uint64) + np.uint64(1))) * M1
        out ^= out >> np.uint64(29)
        out *= M2
    return out


class Items:
    """A group of items as word numbers, and its n-grams by key."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.vocab: dict[str, int] = {}
        self.ids: list[int] = []
        self.words: list[np.ndarray] = []
        grams: dict[int, list[tuple[int, int]]] = {}
        for item_id, text in rows:
            w = np.array([self.vocab.setdefault(x, len(self.vocab)) for x in words(text)], np.int64)
            self.ids.append(item_id)
            self.words.append(w)
        self.bags = [np.unique(w, return_counts=True) for w in self.words]
        self.sizes = sorted({min(N, len(w)) for w in self.words} - {0})
        for k, w in enumerate(self.words):
            if len(w):
                for at, key in enumerate(keys(w, min(N, len(w))).tolist()):
                    grams.setdefault(key, []).append((k, at))
        self.grams = grams
        self.seeds = np.array(sorted(grams), np.uint64)

    def numbered(self, text: str | None) -> np.ndarray:
        get = self.vocab.get
        return np.array([get(w, -1) for w in words(text)], np.int64)

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, keys) of the seeds in a document."""
        at, found = [], []
        for n in self.sizes:
            if len(ids) >= n and len(self.seeds):
                k = keys(ids, n)
                i = np.minimum(np.searchsorted(self.seeds, k), len(self.seeds) - 1)
                hit = np.flatnonzero(self.seeds[i] == k)
                at.append(hit)
                found.append(k[hit])
        return (np.concatenate(at), np.concatenate(found)) if at else (np.zeros(0, int), np.zeros(0, np.uint64))

    def shared(self, k: int, window: np.ndarray) -> int:
        """Words that item ``k`` and a sorted window have in common, each as often as both hold it: no alignment matches more."""
        w, n = self.bags[k]
        return int(np.minimum(n, np.searchsorted(window, w, "right") - np.searchsorted(window, w)).sum())


def _matrix(item: np.ndarray, doc: np.ndarray) -> tuple[int, int, int]:
    """(best score, end in item, end in doc), ends exclusive. A row for each word of the item, all of its cells at once."""
    steps = np.arange(1, len(doc) + 1) * GAP
    row = np.zeros(len(doc) + 1, np.int64)
    best = (0, 0, 0)
    for i, w in enumerate(item, 1):
        new = np.maximum(0, np.maximum(row[:-1] + np.where(doc == w, MATCH, MISMATCH), row[1:] + GAP))
        new = np.maximum(new, np.maximum.accumulate(new - steps) + steps)
        j = int(new.argmax())
        if new[j] > best[0]:
            best = (int(new[j]), i, j + 1)
        row = np.concatenate([[0], new])
    return best


def align(item: np.ndarray, doc: np.ndarray) -> tuple[int, int, int]:
    """(score, start, end) of the best local alignment in ``doc``. The start comes from aligning backwards from the end."""
    score, i, j = _matrix(item, doc)
    if not score:
        return 0, 0, 0
    _, _, back = _matrix(item[:i][::-1], doc[:j][::-1])
    return score, j - back, j


def matches(items: Items, text: str | None, threshold: float) -> list[tuple[int, float, int, int, int]]:
    """(item number, score, first word, end word, seeds) of the items that a text leaks: the best place of each."""
    ids = items.numbered(text)
    at, found = items.hits(ids)
    if not len(at):
        return []
    diagonals: dict[int, list[tuple[int, int]]] = {}
    for p, key in zip(at.tolist(), found.tolist(), strict=True):
        for k, q in items.grams[key]:
            diagonals.setdefault(k, []).append((p - q, p))
    out = []
    for k, spots in diagonals.items():
        w = items.words[k]
        n, best = len(w), (0, 0, 0)
        least, reach = threshold * n, int(MATCH * n * (1 - threshold) / -GAP)  # matches needed; gaps that a leak can afford
        spots = sorted(set(spots))
        i = 0
        while i < len(spots):
            j = i
            while j + 1 < len(spots) and spots[j + 1][0] - spots[i][0] <= n:  # places of one copy lie on near diagonals
                j += 1
            low, high = max(0, spots[i][0] - reach), min(len(ids), spots[j][0] + n + reach)
            if items.shared(k, np.sort(ids[low:high])) >= least:
                s, a, b = align(w, ids[low:high])
                if s > best[0]:
                    best = (s, low + a, low + b)
            i = j + 1
        if (score := best[0] / (MATCH * n)) >= threshold:
            out.append((k, score, best[1], best[2], len({p for _, p in spots})))
    return out


def _groups(benchmark: DataFrame, group: int) -> Iterator[list[tuple[int, str | None]]]:
    """The items in groups of at most ``group`` items and, but for the last item, ``GROUP_CHARS`` characters, through the
    driver one group at a time."""
    rows, size = [], 0
    for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        rows.append((r.item_id, r.text))
        size += len(r.text or "")
        if len(rows) == group or size >= GROUP_CHARS:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, group: int = GROUP) -> DataFrame:
    """doc_id, item_id, score, word_start, word_end, n_seeds: each leaked item of each document, at its best place."""
    schema = "doc_id long, item_id long, score double, word_start long, word_end long, n_seeds long"
    out = None
    for rows in _groups(benchmark, group):
        items = Items(rows)

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                found = [(d, items.ids[k], s, a, e, n) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, s, a, e, n in matches(items, t, threshold)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if i == 2 else pa.int64()) for i, c in enumerate(zip(*found, strict=True))], [f.split()[0] for f in schema.split(", ")])

        part = docs.select("doc_id", "text").mapInArrow(lean(run), schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, group: int = GROUP) -> DataFrame:
    """``docs`` without rows that leak an item: judged where they lie."""
    for rows in _groups(benchmark, group):
        items = Items(rows)

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                ok = [not matches(items, t, threshold) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
                yield b.filter(pa.array(ok, pa.bool_()))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs

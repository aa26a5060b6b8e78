"""Exact repeated windows across a corpus by a depth-limited radix sort of suffixes.

Every token (a byte, or a word) starts a suffix, of which only the first ``window`` tokens count. Passes group suffixes
by digits, a group of one leaves the sort, and groups that are equal through the last digit are exactly the repeated
windows. Digits are fingerprints, so equal suffixes get equal digits wherever they lie, and passes are group-bys.

Where it departs from the plain sort: suffixes don't move one by one. Sixteen bytes (digit, place) for each byte of text
are far more than the disk that a run may use, so suffixes of neighbouring places are passed on in runs, and the most
significant digit is not the first bytes but an anchor inside the window that neighbours share.

A window belongs to its anchor, the ``GRAM``-byte string in it with the least fingerprint (of 32 bits, the last of equals), and has
an offset d to it. Neighbours share anchors, about one for a hundred bytes, so windows are sorted in runs: those of one
anchor whose offsets fall into one block. All windows of a block hold its core; a run's hull is what its windows cover.
A pass groups runs by core and then by hull:

- a core that occurs once rules its run out: none of its windows is anywhere else;
- a hull that occurs twice settles its runs: all their windows are repeated;
- where a core has several hulls and one of them occurs once, one run of each hull goes on to the next pass, which
  reads smaller blocks; of hulls that occur twice it only stands for the others.

The first pass has one block (the core is about the anchor), the second blocks of the square root of all offsets, the last
single windows, where core and hull are the window. So around an edit of a near copy only the runs at its two edges
are read to the end.

Core and hull have 64 bits each, from different numbers for each token; windows are not compared token by token. Every pass is pre-aggregated group-bys and joins on their
staged results, so groups of any size are split among tasks; a text moves only if it holds a repeated anchor.

Defined results: matches never cross rows; overlaps with itself count; a null text is empty; texts are known by a
64-bit hash and length, equal texts get one result; texts shorter than the window lose nothing; doc_ids may repeat or
be null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_hot, lean, slices, staged
from .hashing import K1, K2, K3, column_bytes, mix, powers, prefix, values, words

WINDOW, SLICE, ROWS = 400, 1 << 18, 1 << 16
PASSAGE, GRAM = 51, 10  # words
SETTLED, OPEN, STANDS = 1, 2, 4


def slide_min(h: np.ndarray, w: int) -> np.ndarray:
    """Least of each ``w`` neighbours, by blocks: a minimum from the left meets one from the right."""
    n = len(h)
    x = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    x[:n] = h
    b = x.reshape(-1, w)
    left = np.minimum.accumulate(b, 1).ravel()
    right = np.minimum.accumulate(b[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def half(window: int) -> int:
    return max(1, window // 2)


class Suffixes:
    """The windows of a batch of texts, by anchor: ``pos``, and least and greatest offset of the windows that belong to it.

    The texts lie one after the other in ``raw`` (bytes, or hashes of words), text i from ``at[i]``; ``doc`` is an anchor's
    text, ``first`` a text's first anchor. A run is numbered ``anchor * offsets + block``.
    """

    def __init__(self, raw: np.ndarray, at: np.ndarray, window: int = WINDOW, gram: int | None = None):
        self.window, gram = window, gram or half(window)
        self.n, self.offsets = max(0, len(raw) - window + 1), window - gram + 1
        self.inverse = powers(len(raw) + 1)[1]
        self.sums, self.second = map(prefix, values(raw))
        size = np.diff(at)
        whole = np.ones(self.n, bool)  # windows that end in the text they begin in
        for end, length in zip(at[1:].tolist(), size.tolist(), strict=True):
            whole[max(0, end - min(length, window - 1)) : end] = False
        start = np.flatnonzero(whole)
        own = self._anchors(gram)[start]
        edge = np.flatnonzero(np.diff(own, prepend=-1))  # anchors rise with the window
        many = np.diff(np.append(edge, len(own)))
        self.pos = own[edge]
        self.greatest, self.least = self.pos - start[edge], self.pos - (start[edge] + many - 1)
        self.doc = np.searchsorted(at, self.pos, side="right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(size)))

    def _span(self, sums: np.ndarray, a: np.ndarray, n) -> np.ndarray:
        """Fingerprints of raw[a : a + n]."""
        return mix((sums[a + n] - sums[a]) * self.inverse[a])

    def _anchors(self, gram: int) -> np.ndarray:
        """For each window the last position in it whose string has the least fingerprint, of 32 bits."""
        if not self.n:
            return np.zeros(0, np.int64)
        m = len(self.sums) - gram
        h = mix((self.sums[gram:] - self.sums[:m]) * self.inverse[:m])
        low = np.uint64(0xFFFFFFFF)
        h &= ~low
        h |= low - np.arange(m, dtype=np.uint64)
        return (low - (slide_min(h, self.offsets) & low)).astype(np.int64)

    def bounds(self, run: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor position, least offset, greatest offset) of runs."""
        i, r = run // self.offsets, run % self.offsets
        return self.pos[i], np.maximum(self.least[i], r * block), np.minimum(self.greatest[i], (r + 1) * block - 1)

    def split(self, run: np.ndarray, block: int, into: int) -> tuple[np.ndarray, np.ndarray]:
        """(runs of smaller blocks, index of the run that each is a part of)."""
        _, low, high = self.bounds(run, block)
        many = high // into - low // into + 1
        parent = np.repeat(np.arange(len(run)), many)
        step = np.arange(len(parent)) - np.repeat(np.cumsum(many) - many, many)
        return (run // self.offsets * self.offsets + low // into)[parent] + step, parent

    def digits(self, run: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """(core, hull) of runs, each with where it lies about the anchor."""
        pos, low, high = self.bounds(run, block)
        r = run % self.offsets
        end = np.minimum((r + 1) * block, self.offsets) - 1
        core = self._span(self.sums, pos - r * block, self.window - (end - r * block))
        hull = self._span(self.second, pos - high, self.window + high - low)
        return mix(core ^ (r.astype(np.uint64) * K1)), mix(hull ^ (low.astype(np.uint64) * K2) ^ (high.astype(np.uint64) * K3))

    def starts(self, run: np.ndarray, block: int) -> np.ndarray:
        """Which windows are in the runs."""
        pos, low, high = self.bounds(run, block)
        edge = np.zeros(self.n + 1, np.int64)
        np.add.at(edge, pos - high, 1)
        np.add.at(edge, pos - low + 1, -1)
        return np.cumsum(edge)[:-1] > 0


def _suffixes(b: pa.RecordBatch, window: int, gram: int, by_word: bool) -> tuple[np.ndarray, Suffixes]:
    """(keys, windows) of a batch of key, raw, ..."""
    raw, at = column_bytes(b.column(1))
    return b.column(0).to_numpy(), Suffixes(*(words(raw, at) if by_word else (raw, at)), window, gram)


def _runs(lists: pa.Array, s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """(text, run as numbered in the batch) of lists of the texts' own runs; a null list is empty."""
    doc = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
    return doc, lists.flatten().to_numpy().astype(np.int64) + s.first[doc] * s.offsets


def _packed(parts: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of some ``ROWS`` rows from arrays of (key, run, core, hull, open)."""
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        key, run, v, u, is_open = (np.concatenate([h[j] for h in held]) for j in range(5))
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(run), pa.array(v.view(np.int64)), pa.array(u.view(np.int64)), pa.array(is_open)], ["key", "run", "v", "u", "open"])

    for part in parts:
        held.append(part)
        size += len(part[1])
        if size >= ROWS:
            yield batch()
            held, size = [], 0
    if size:
        yield batch()


DIGITS = "key long, run long, v long, u long, open boolean"


def first_digits(texts: DataFrame, window: int, gram: int, by_word: bool) -> DataFrame:
    """A run of all windows for each anchor of key, raw."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in slices(batches, SLICE):
            key, s = _suffixes(b, window, gram, by_word)
            run = np.arange(len(s.pos)) * s.offsets
            yield key[s.doc], run - s.first[s.doc] * s.offsets, *s.digits(run, s.offsets), np.ones(len(run), bool)

    return texts.mapInArrow(lean(lambda batches: _packed(parts(batches))), DIGITS)


def next_digits(marked: DataFrame, window: int, gram: int, by_word: bool, block: int, into: int) -> DataFrame:
    """Runs of smaller blocks from the runs that go on. Input: key, raw, open, stands."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in slices(batches, SLICE):
            key, s = _suffixes(b, window, gram, by_word)
            (doc, is_open), (other, stands) = (_runs(b.column(i), s) for i in (2, 3))
            run, parent = s.split(np.concatenate([is_open, stands]), block, into)
            doc = np.concatenate([doc, other])[parent]
            yield key[doc], run - s.first[doc] * s.offsets, *s.digits(run, into), parent < len(is_open)

    return marked.mapInArrow(lean(lambda batches: _packed(parts(batches))), DIGITS)


def resolve(runs: DataFrame, name: str) -> DataFrame:
    """(key, run, what): what becomes of runs, as bits of SETTLED, OPEN and STANDS. Runs ruled out are left out.

    A run that stands for others counts as two.
    """
    weight = F.when(F.col("open"), 1).otherwise(2)
    cores = runs.groupBy("v").agg(F.sum(weight).alias("n"), F.min("u").alias("lo"), F.max("u").alias("hi"), F.max("open").alias("any"))
    cores = staged(cores.filter("n > 1 and any").select("v", (F.col("lo") != F.col("hi")).alias("mixed")), f"{name}-cores")
    part = lambda c: F.when(F.col("mixed"), F.col(c)).alias(c)
    hits = staged(runs.join(cores, "v").filter("open or mixed").select("key", "run", part("v"), part("u"), "open", "mixed"), f"{name}-hits")
    mixed = hits.filter("mixed")
    hulls = staged(mixed.groupBy("v", "u").agg(F.sum(weight).alias("n"), F.min(F.struct("key", "run")).alias("first")), f"{name}-hulls")
    undone = staged(hulls.filter("n = 1").select("v", F.lit(True).alias("undone")).distinct(), f"{name}-open")  # staged, so that a core of many hulls can be split in the join
    told = staged(hulls.join(undone, "v", "left"), f"{name}-undone")
    first = (F.col("first.key") == F.col("key")) & (F.col("first.run") == F.col("run"))
    bit = lambda c, value: F.when(c, value).otherwise(0)
    what = F.when(F.col("n") == 1, OPEN).otherwise(bit(F.col("open"), SETTLED) + bit(F.coalesce("undone", F.lit(False)) & first, STANDS))
    split = mixed.select("key", "run", "v", "u", "open").join(told, ["v", "u"]).select("key", "run", what.alias("what")).filter("what > 0")
    out = staged(hits.filter("not mixed").select("key", "run", F.lit(SETTLED).alias("what")).unionByName(split), f"{name}-runs")
    discard(runs, cores, hits, hulls, undone, told)
    return out


def by_text(runs: DataFrame, **bits: int) -> DataFrame:
    """key and, for each name, the text's own runs with that bit."""
    return runs.groupBy("key").agg(*(F.collect_set(F.when(F.col("what").bitwiseAND(bit) > 0, F.col("run"))).alias(name) for name, bit in bits.items()))


def covered(n: int, window: int, starts: np.ndarray) -> np.ndarray:
    """Which of ``n`` tokens the windows that begin at ``starts`` cover."""
    edge = np.zeros(n + 1, np.int64)
    edge[starts] += 1
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge)[:-1] > 0


def removal(raw: np.ndarray, gone: np.ndarray) -> tuple[int, int, str]:
    """(bytes removed, runs, sha256 of the rest)."""
    runs = int(gone[0]) + int((np.diff(gone.astype(np.int8)) == 1).sum()) if len(gone) else 0
    return int(gone.sum()), runs, hashlib.sha256(raw[~gone].tobytes()).hexdigest()


def repeated(texts: DataFrame, base: DataFrame, window: int, gram: int, by_word: bool, result: Callable, schema: str, copies: DataFrame | None = None) -> DataFrame:
    """key and what ``result`` makes of (raw, covered tokens), for texts with repeated windows. Staged.

    ``texts``: key, raw; ``base``: the keys of all rows. ``copies`` (key, copied): a text that is there twice is repeated as
    a whole; its runs matter only where they stand for others, and it gets no row.
    """
    blocks = [window - gram + 1, max(1, math.isqrt(window - gram)), 1]
    top = resolve(staged(first_digits(texts, window, gram, by_word), "repeats-digits"), "repeats-first")
    marks = by_text(top, settled=SETTLED, open=OPEN, stands=STANDS)
    marks = marks.join(copies, "key").filter((F.size("open") + F.size("stands") > 0) | ~F.col("copied")) if copies is not None else marks.withColumn("copied", F.lit(False))
    marks = staged(marks, "repeats-marks")
    found = join_hot(texts, marks.select("key", F.lit(True).alias("found")), "key", counted=base).filter("found")
    marked = staged(found.groupBy("key").agg(F.first("raw").alias("raw")), "repeats-texts")
    passes = [top]
    for block, into in zip(blocks, blocks[1:], strict=False):
        on = by_text(passes[-1].filter(F.col("what").bitwiseAND(OPEN + STANDS) > 0), open=OPEN, stands=STANDS)
        runs = next_digits(marked.join(on, "key").select("key", "raw", "open", "stands"), window, gram, by_word, block, into)
        passes.append(resolve(staged(runs, "repeats-digits"), "repeats-next"))
    names = [f.split()[0] for f in schema.split(", ")]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE):
            raw, at = column_bytes(b.column(1))
            t, word_at = words(raw, at) if by_word else (raw, at)
            s = Suffixes(t, word_at, window, gram)
            starts = np.zeros(s.n, bool)
            for i, block in enumerate(blocks, 2):
                starts |= s.starts(_runs(b.column(i), s)[1], block)
            gone = covered(len(t), window, np.flatnonzero(starts))
            bounds = zip(b.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), word_at[:-1].tolist(), word_at[1:].tolist(), strict=True)
            rows = [(key, *result(raw[i:j], gone[k:m])) for key, i, j, k, m in bounds]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    read = marked.join(marks.filter(~F.col("copied")).select("key", F.col("settled").alias("s0")), "key")
    for i, p in enumerate(passes[1:], 1):
        read = read.join(by_text(p.filter(F.col("what").bitwiseAND(SETTLED) > 0), **{f"s{i}": SETTLED}), "key", "left")
    done = staged(read.select("key", "raw", "s0", "s1", "s2").mapInArrow(lean(finish), schema), "repeats-done")
    discard(marks, marked, *passes)
    return done


def keyed_texts(docs: DataFrame) -> DataFrame:
    raw = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select("doc_id", raw.alias("raw")).withColumn("n_bytes", F.octet_length("raw").cast("bigint")).withColumn("key", F.xxhash64("raw", "n_bytes"))


def deduplicate(docs: DataFrame, window: int = WINDOW, passage: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: a row for each row of ``docs``.

    With ``passage`` also n_passage_words: the words covered by strings of so many words that start elsewhere too. They
    are counted, not removed: short words make such passages of fewer than ``window`` bytes.
    """
    keyed = keyed_texts(docs)
    base = staged(keyed.select("doc_id", "key", "n_bytes", F.sha2("raw", 256).alias("sha")), "repeats-base")
    copies = base.filter(F.col("n_bytes") >= window).groupBy("key").agg((F.count("*") > 1).alias("copied"))
    long_ = keyed.filter(F.col("n_bytes") >= window).select("key", "raw")
    done = repeated(long_, base, window, half(window), False, removal, "key long, n_removed long, n_spans long, kept string", copies)
    told = done.join(copies.filter("copied").select("key", F.lit(True).alias("whole")), "key", "full")
    if passage:
        wide = keyed.filter(F.col("n_bytes") >= 2 * passage - 1).select("key", "raw")
        count = lambda _, gone: (int(gone.sum()),)
        told = told.join(repeated(wide, base, passage, min(GRAM, half(passage)), True, count, "key long, n_passage_words long"), "key", "full")
    result = lambda all_, some, none: F.when(F.col("whole"), all_).otherwise(F.coalesce(some, none))
    return join_hot(base, staged(told, "repeats-told"), "key").select(
        "doc_id", "n_bytes", result(F.col("n_bytes"), "n_removed", F.lit(0)).cast("bigint").alias("n_removed"), result(F.lit(1), "n_spans", F.lit(0)).cast("bigint").alias("n_spans"),
        result(F.sha2(F.lit(b""), 256), "kept", "sha").alias("kept_sha256"), *([F.coalesce("n_passage_words", F.lit(0)).cast("bigint").alias("n_passage_words")] if passage else []),
    )

"""Packing documents into fixed windows by order-preserving dynamic programming.

Token streams stay in the order in which a task reads its documents. A window may end at a document's end (free), at
a sentence's end (a small truncation penalty), or, in text without sentences, at one of a grid of points (a larger
one). The cheapest set of cuts minimises padding plus penalties: with p the token position of a candidate,

    cost(j) = min over i, p(j) - p(i) <= size, of cost(i) + size - (p(j) - p(i)) + penalty(j)

so the best i is the least cost(i) + p(i) in a sliding window, which a monotone queue gives in constant time. Blocks
of about ``block`` tokens are solved at a time; a block's last window stays open and begins the next block, so memory
is bounded and no padding comes from the blocks. No row is shuffled: a task packs what it reads, and a lost task
packs the same again.

A sequence at a power of two needs no padding by the contract; the cuts never aim at that.

Tokens: a chunk between white spaces always gives the same ids, so ids of chunks seen are kept (``CACHE`` of them at
most, those not met for long go first) and only new chunks go through the tokenizer, plain words once whatever their
case and marks. ``ids_of`` equals encoding the whole text, which a test holds it to.

Defined results: a null or empty text is the end token alone; repeated rows are packed each; a null doc_id stays null;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, slices

SIZE, END_ID = 4096, 2
SENTENCE, FORCED, GRID = 32, 128, 256
BLOCK = 1 << 20
CACHE = 1_200_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: White space to Python's split, but not to the tokenizer.
ODD = re.compile("[\x1c-\x1f]")
#: Words whose ids are those of the small letters and those of the marks: the tokenizer folds case and parts letters from
#: a run of marks. Latin-1's letters are each one code point in every form it knows; ASCII's marks all count.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\\[-`{-~]*)")
_made: dict[str, Encoder] = {}


class Encoder:
    """Text to packed little-endian uint32 ids, by chunks seen before where possible: ``seen`` is half of them at most,
    ``old`` what it held when it was last full."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.seen: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        size = self.tok.get_vocab_size()
        self.ends = np.zeros(size + 1, bool)
        for token, i in self.tok.get_vocab().items():
            if re.search(r"[.!?]+(</w>)?\Z", token):
                self.ends[i] = True

    def direct(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, chunks: list[str]) -> None:
        """Ids of new chunks, many in one call. Words with the same letters are encoded once."""
        seen, old, split, new = self.seen, self.old, [], {}
        for c in chunks:
            if c in old:
                seen[c] = old[c]
            elif parts := (c, "") if c.isascii() and c.isalpha() else (m := PLAIN.fullmatch(c)) and m.groups():
                word, tail = parts[0].lower(), parts[1]
                if word not in seen:
                    if word in old:
                        seen[word] = old[word]
                    else:
                        new[word] = None
                if tail and tail not in seen:
                    new[tail] = None
                if c != word:
                    split.append((c, word, tail))
            else:
                new[c] = None
        todo = list(new)
        for i in range(0, len(todo), 4096):
            part = todo[i : i + 4096]
            for c, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False), strict=True):
                seen[c] = array("I", e.ids).tobytes()
        for c, word, tail in split:
            seen[c] = seen[word] + seen[tail] if tail else seen[word]

    def ids_of(self, text: str) -> bytes:
        if ODD.search(text):
            return self.direct(text)
        chunks = text.split()
        if new := set(chunks).difference(self.seen):
            if len(self.seen) + 3 * len(new) > CACHE // 2:
                self.old, self.seen = self.seen, {}
                new = set(chunks)
            self.learn(list(new))
        return b"".join(map(self.seen.__getitem__, chunks))


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _made:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _made[path] = Encoder(path)
    return _made[path]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, size: int = SIZE, sentence: int = SENTENCE, forced: int = FORCED, grid: int = GRID) -> tuple[np.ndarray, np.ndarray]:
    """Rising cut positions and their penalties; no two neighbours are more than ``grid`` apart, nor is the first from 0."""
    grid = min(grid, size)
    free = np.zeros(len(ids) + 1, bool)
    free[doc_ends] = True
    stop = free.copy()
    stop[1:] |= ends[np.minimum(ids, len(ends) - 1)]
    pos = out = np.flatnonzero(stop)
    gaps = np.diff(pos, prepend=0)
    wide = np.flatnonzero(gaps > grid)
    if len(wide):
        more = np.concatenate([np.arange(b - g + grid, b, grid) for b, g in zip(pos[wide].tolist(), gaps[wide].tolist(), strict=True)])
        either = stop.copy()
        either[more] = True
        out = np.flatnonzero(either)
    return out, np.where(free[out], 0, np.where(stop[out], sentence, forced))


def cuts(pos: np.ndarray, penalty: np.ndarray, size: int = SIZE) -> list[int]:
    """The cheapest cut positions, the last candidate among them. Ties go to the longest window."""
    p = [0, *pos.tolist()]
    pen = [0, *penalty.tolist()]
    n = len(p)
    best, back = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (cost + position, candidate), rising
    for j in range(1, n):
        low = p[j] - size
        while p[queue[0][1]] < low:
            queue.popleft()
        g, i = queue[0]
        back[j] = i
        c = best[j] = g + size - p[j] + pen[j]
        g = c + p[j]
        while queue and queue[-1][0] > g:
            queue.pop()
        queue.append((g, j))
    out, j = [], n - 1
    while j:
        out.append(p[j])
        j = back[j]
    return out[::-1]


class Packer:
    """The documents of one task, in order. ``add`` gives finished pieces as they come, ``close`` the rest."""

    def __init__(self, ends: np.ndarray, first: int, size: int = SIZE, block: int = BLOCK):
        self.ends, self.next, self.size, self.block = ends, first, size, max(block, 4 * size)
        self.docs: list[tuple[object, int, int, bytes]] = []  # doc_id, tokens gone before, tokens in all, packed ids left
        self.held = 0

    def add(self, doc_id, packed: bytes) -> list[tuple]:
        self.docs.append((doc_id, 0, len(packed) // 4, packed))
        self.held += len(packed) // 4
        return self._solve(False) if self.held >= self.block else []

    def close(self) -> list[tuple]:
        return self._solve(True) if self.held else []

    def _solve(self, last: bool) -> list[tuple]:
        data = b"".join([d[3] for d in self.docs])
        ids = np.frombuffer(data, "<u4")
        ends = np.cumsum([len(d[3]) // 4 for d in self.docs])
        at = cuts(*candidates(ids, ends, self.ends, self.size), self.size)
        if not last:
            at.pop()  # the last window goes on
        out, view, seq_from, k = [], memoryview(data), 0, 0
        doc_from = 0
        for to in at:
            here = seq_from
            while here < to:
                stop = min(to, int(ends[k]))
                doc_id, gone, total, _ = self.docs[k]
                out.append((doc_id, gone + here - doc_from, stop - here, zlib.crc32(view[4 * here : 4 * stop]), total, self.next, here - seq_from))
                here = stop
                if stop == ends[k]:
                    doc_from = stop
                    k += 1
            seq_from = to
            self.next += 1
        rest = []
        for d, (doc_id, gone, total, packed) in enumerate(self.docs[k:], k):
            skip = seq_from - doc_from if d == k else 0
            rest.append((doc_id, gone + skip, total, packed[4 * skip :]))
        self.docs, self.held = rest, (len(ids) - seq_from)
        return out


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """A row for each piece. ``sequence_id``: the task's number in the high 31 bits, a count in the low 32."""
    tail = np.array([end_id], "<u4").tobytes()
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        e = encoder(tokenizer)
        packer = Packer(e.ends, TaskContext.get().partitionId() << 32, size, block)
        for b in slices(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if rows := packer.add(doc_id, (e.ids_of(text) if text else b"") + tail):
                    yield batch(rows)
        if rows := packer.close():
            yield batch(rows)

    return docs.select("doc_id", "text").mapInArrow(lean(run), SCHEMA)

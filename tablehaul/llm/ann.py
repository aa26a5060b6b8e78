"""Approximate nearest neighbours by additive quantisation.

A vector of length 1 is the sum of one codeword from each of ``M`` codebooks; every codeword has the full dimension. Codebooks
start as k-means of the residuals, then alternate: beam-search encoding of the sample, and a least-squares update of
all codebooks at once. Codebooks are fitted on a bounded sample (``SAMPLE`` rows in hash order); every row is encoded.
A row keeps its length, ``M`` bytes, the factor that makes its code's length 1 and the distance from that to its own
direction. A query scores all rows by ``M`` table look-ups each (its inner products with all codewords), scaled by these;
the best ``RERANK`` are compared again on the original vectors in double precision.

An exact check follows, for no fixed depth suffices for all tables (many dimensions, lengths far apart, directions that
the sample has not): a row's score is at most its code's plus that distance, times both lengths. Every row whose bound
reaches the query's ``top``-th score found so far is compared too, so the answer is that of a search of all vectors,
whatever the quantiser is worth; a worse one only leaves more to compare.

Scoring goes block by block: blocks of queries meet blocks of codes by their block numbers, and each meeting returns
``RERANK`` rows a query. Blocks have fixed sizes, so no task grows with the data, and codes (not vectors) are what
moves. Queries against all rows is the search asked for; its work is queries times rows. In the check ``ASKED`` bytes of
queries at most go to all tasks at once; each reads its own rows and returns ``top`` a query at most.

Defined results: vectors that are null, empty, zero, hold a null or non-finite component, or differ in length from
most take no part, nor do rows without an id; of rows with one id the least vector counts; equal scores go to the
smaller id, before reranking too (equal vectors have equal codes); with fewer candidates than asked, all are returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, staged, staged_parts

M, CODES, BEAM, SAMPLE, ROUNDS = 40, 32, 4, 8192, 2
TOP, RERANK, EVERY = 20, 200, 20
QUERY_BLOCK, CODE_BLOCK = 256, 65_536
ASKED, AT_ONCE, SLACK = 8 << 20, 4096, 1e-4  # SLACK: more than single precision can be off, for vectors of length 1


def sound(embeddings: DataFrame, dim: int | None = None) -> DataFrame:
    """(vec_id, embedding as doubles): the rows that take part, each id once."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ok = v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)
    df = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & ok)
    df = df.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return df if dim is None else df.filter(F.size("embedding") == dim)


def kmeans(x: np.ndarray, k: int, rounds: int, r: np.random.Generator) -> np.ndarray:
    c = x[r.choice(len(x), size=k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ c.T - 0.5 * (c * c).sum(1), 1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        c[n == 0] = x[r.choice(len(x), size=int((n == 0).sum()))]
    return c


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM, chunk: int = 1024) -> np.ndarray:
    """Codes (rows x M) by beam search: the ``beam`` best partial sums are carried from codebook to codebook."""
    m, k, d = books.shape
    norms = (books * books).sum(2)
    out = np.zeros((len(x), m), np.uint8 if k <= 256 else np.uint16)
    for at in range(0, len(x), chunk):
        part = x[at : at + chunk]
        n = len(part)
        left = part[:, None, :]  # residuals: n x beams x d
        cost, codes = np.zeros((n, 1), x.dtype), np.zeros((n, 1, 0), out.dtype)
        for b in range(m):
            worth = cost[:, :, None] + norms[b] - 2 * (left @ books[b].T)
            flat = worth.reshape(n, -1)
            take = min(beam, flat.shape[1])
            best = np.argpartition(flat, take - 1, axis=1)[:, :take] if take < flat.shape[1] else np.tile(np.arange(take), (n, 1))
            rows, word = best // k, best % k
            cost = np.take_along_axis(flat, best, 1)
            left = np.take_along_axis(left, rows[:, :, None], 1) - books[b][word]
            codes = np.concatenate([np.take_along_axis(codes, rows[:, :, None], 1), word[:, :, None].astype(out.dtype)], 2)
        out[at : at + n] = codes[np.arange(n), cost.argmin(1)]
    return out


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[b][codes[:, b]] for b in range(books.shape[0]))


def fit(x: np.ndarray, m: int = M, k: int = CODES, rounds: int = ROUNDS, beam: int = BEAM, seed: int = 7) -> np.ndarray:
    """Codebooks (m x k x d) in single precision."""
    r = np.random.default_rng(seed)
    x = np.asarray(x, np.float32)
    left, books = x.copy(), []
    for _ in range(m):
        c = kmeans(left, k, 6, r)
        near = np.argmax(left @ c.T - 0.5 * (c * c).sum(1), 1)
        left -= c[near]
        books.append(c)
    out = np.stack(books)
    for _ in range(rounds):
        codes = encode(x, out, beam)
        used = np.zeros((len(x), m * k), np.float32)
        np.put_along_axis(used, codes.astype(int) + np.arange(m) * k, 1, axis=1)
        gram, right = used.T @ used, used.T @ x
        gram[np.diag_indices(m * k)] += 0.5
        right += 0.5 * out.reshape(m * k, -1)  # codewords that are never used stay
        out = np.linalg.solve(gram, right).reshape(m, k, -1).astype(np.float32)
    return out


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of length 1, lengths), in double precision, however large or small the components are."""
    most = np.abs(x).max(1)
    x = x / most[:, None]
    norm = np.linalg.norm(x, axis=1)
    return x / norm[:, None], norm * most


def encoded(vectors: DataFrame, books: np.ndarray, beam: int = BEAM) -> DataFrame:
    """vec_id, embedding, codes, norm, scale (the code's own length is 1 / scale) and rest (the scaled code's distance from the vector's direction)."""
    kind = dict(vectors.dtypes)["embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, norm = directions(np.asarray(b.column(1).flatten().to_numpy(), float).reshape(b.num_rows, -1))
            codes = encode(x.astype(np.float32), books, beam)
            back = decode(codes, books).astype(float)
            size = np.linalg.norm(back, axis=1)
            scale = np.divide(1.0, size, out=np.zeros_like(size), where=size > 0)
            rest = np.linalg.norm(x - back * scale[:, None], axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), *map(pa.array, (norm, scale, rest))], ["vec_id", "embedding", "codes", "norm", "scale", "rest"])

    return vectors.mapInArrow(run, f"vec_id long, embedding {kind}, codes binary, norm double, scale double, rest double")


def look_up(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Sums of table entries: tables are queries x M x codewords, codes rows x M."""
    out = tables[:, 0, :][:, codes[:, 0]]
    for b in range(1, tables.shape[1]):
        out += tables[:, b, :][:, codes[:, b]]
    return out


def first_best(s: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` largest; of equal ones at the edge the first."""
    edge = np.partition(s, len(s) - n)[len(s) - n]
    above = np.flatnonzero(s > edge)
    return np.concatenate([above, np.flatnonzero(s == edge)[: n - len(above)]])


def exact_scores(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (a * c).sum(1)


def first_copies(ids: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Places of the rows that fewer than ``n`` equal ones with smaller ids precede."""
    kind = np.unique(np.ascontiguousarray(x).view(f"V{x.shape[1] * x.itemsize}"), return_inverse=True)[1].ravel()
    order = np.lexsort((ids, kind))
    kind = kind[order]
    return np.sort(order[np.arange(len(kind)) - np.searchsorted(kind, kind) < n])


class Nearest:
    """Each query's ``top`` nearest of the rows that a task has met and that reach the least score asked for."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, least: np.ndarray, books: np.ndarray, top: int):
        self.ids, self.vectors, self.least, self.books, self.top = ids, vectors, least.copy(), books, top
        self.units, self.norms = directions(vectors)
        self.held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)  # query's place, vec_id, score

    def add(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, norm: np.ndarray, scale: np.ndarray, rest: np.ndarray) -> None:
        back = (decode(codes, self.books) * scale[:, None]).astype(np.float32)
        slack = 1e-12 * x.shape[1]
        for at in range(0, len(self.ids), QUERY_BLOCK):
            part = slice(at, at + QUERY_BLOCK)
            most = (self.units[part].astype(np.float32) @ back.T).astype(float)
            most += rest + SLACK
            most *= norm
            may = most * self.norms[part, None] >= self.least[part, None]
            may &= self.ids[part, None] != ids
            rows = np.flatnonzero(may.any(0))
            if not len(rows):
                continue
            s = self.vectors[part] @ x[rows].T
            s += slack * self.norms[part, None] * norm[rows]
            q, r = np.nonzero(may[:, rows] & ~(s < self.least[part, None]))
            if len(q) > self.top:  # far more than can be among the nearest where the least score is low, or where rows are equal
                s[~may[:, rows]] = -np.inf
                q, r = self.reaching(s, q, r, 2 * slack * self.norms[part, None] * norm[rows])
            self.take(q + at, ids[rows[r]], x, rows[r])

    def reaching(self, s: np.ndarray, q: np.ndarray, r: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs that can be among the ``top`` of these rows."""
        if s.shape[1] <= self.top:
            return q, r
        edge = np.partition(s - off, s.shape[1] - self.top, axis=1)[:, s.shape[1] - self.top]
        keep = s[q, r] >= edge[q]
        return q[keep], r[keep]

    def take(self, q: np.ndarray, ids: np.ndarray, x: np.ndarray, rows: np.ndarray) -> None:
        step = max(1, (1 << 20) // x.shape[1])
        for i in range(0, len(q), step):
            k = slice(i, i + step)
            score = exact_scores(self.vectors[q[k]], x[rows[k]])
            fine = score >= self.least[q[k]]
            new = q[k][fine], ids[k][fine], score[fine]
            mine = np.isin(self.held[0], new[0])
            q_, v, s = (np.concatenate([h[mine], n]) for h, n in zip(self.held, new, strict=True))
            order = np.lexsort((v, -s, q_))
            q_, v, s = q_[order], v[order], s[order]
            place = np.arange(len(q_)) - np.searchsorted(q_, q_)
            last = place == self.top - 1
            self.least[q_[last]] = np.maximum(self.least[q_[last]], s[last])
            best = place < self.top
            self.held = tuple(np.concatenate([h[~mine], n[best]]) for h, n in zip(self.held, (q_, v, s), strict=True))


def checked(codes: DataFrame, asked: DataFrame, books: np.ndarray, top: int) -> DataFrame:
    """query_id, vec_id, score: all rows that are among a query's ``top`` nearest, and some others. ``asked``: query_id, qv,
    least (a score that ``top`` rows reach, or none)."""
    sc, dim = codes.sparkSession.sparkContext, books.shape[2]
    parts = max(1, -(-asked.count() * dim * 8 // ASKED))

    def part(i: int) -> Iterator[DataFrame]:
        got = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i).select("query_id", "qv", "least").toArrow().combine_chunks()
        qid = got.column(0).to_numpy()
        qv = np.asarray(got.column(1).combine_chunks().flatten().to_numpy(), float).reshape(len(qid), dim)
        sent = sc.broadcast((qid, qv, got.column(2).to_numpy(), books))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near = Nearest(*sent.value, top)
            for whole in batches:
                for at in range(0, whole.num_rows, AT_ONCE):
                    b = whole.slice(at, AT_ONCE)
                    x = np.asarray(b.column(1).flatten().to_numpy(), float).reshape(b.num_rows, dim)
                    code = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8 if near.books.shape[1] <= 256 else np.uint16).reshape(b.num_rows, -1)
                    ids = b.column(0).to_numpy()
                    some = first_copies(ids, x, top + 1)  # the query itself may be one
                    near.add(ids[some], x[some], code[some], *(b.column(k).to_numpy()[some] for k in (3, 4, 5)))
            q, v, s = near.held
            for at in range(0, len(q), 1 << 16):
                k = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(near.ids[q[k]]), pa.array(v[k]), pa.array(s[k])], ["query_id", "vec_id", "score"])

        yield codes.select("vec_id", "embedding", "codes", "norm", "scale", "rest").mapInArrow(run, "query_id long, vec_id long, score double")
        sent.unpersist()

    return staged_parts((df for i in range(parts) for df in part(i)), "ann-checked")


def search(embeddings: DataFrame, every: int = EVERY, top: int = TOP, rerank: int = RERANK, m: int = M, k: int = CODES, sample: int = SAMPLE, query_block: int = QUERY_BLOCK, code_block: int = CODE_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id ``every`` divides, its ``top`` nearest other rows by inner product."""
    spark = embeddings.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    all_ok = sound(embeddings)
    sizes = all_ok.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(64).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    dim, total = sizes[0].d, sizes[0].n
    vectors = all_ok.filter(F.col("embedding").isNotNull() & (F.size("embedding") == dim))
    if dict(embeddings.dtypes)["embedding"] == "array<float>":  # as they came, which is exact
        vectors = vectors.withColumn("embedding", F.col("embedding").cast("array<float>"))
    some = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()  # the bounded sample
    x = directions(np.asarray(some.column(0).combine_chunks().flatten().to_numpy(), float).reshape(-1, dim))[0]
    books = fit(x, m, min(k, max(1, len(x))))
    width = np.uint8 if books.shape[1] <= 256 else np.uint16
    codes = staged(encoded(vectors, books), "ann-codes")
    vectors = codes.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    longest = codes.agg(F.max("norm")).first()[0]
    is_query = F.col("vec_id") % every == 0
    # Blocks are hash groups of a fixed mean size, since each id is there once.
    n_code, n_query = -(-total // code_block), max(1, -(-total // (every * query_block)))
    cands = codes.withColumn("scale", F.col("scale") * (F.col("norm") / longest)).groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n_code)).alias("cb")).agg(F.collect_list(F.struct("vec_id", "codes", "scale")).alias("c"))
    queries = vectors.filter(is_query).groupBy(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_query)).alias("qb")).agg(F.collect_list(F.struct("vec_id", "embedding")).alias("q"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    # Both sides name the meetings they take part in, so each meeting is a key of its own and no task gets a block's whole row of them.
    met = queries.withColumn("cb", upto(n_code)).join(cands.withColumn("qb", upto(n_query)), ["qb", "cb"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                q, c = b.column("q")[i].values, b.column("c")[i].values
                qid = q.field("vec_id").to_numpy()
                qv = directions(np.asarray(q.field("embedding").flatten().to_numpy(), float).reshape(len(qid), dim))[0].astype(np.float32)
                cid = c.field("vec_id").to_numpy()
                order = np.argsort(cid)
                code = np.frombuffer(b"".join(c.field("codes").to_pylist()), width).reshape(len(cid), -1).astype(np.intp)[order]
                scale, cid = c.field("scale").to_numpy().astype(np.float32)[order], cid[order]
                tables = np.einsum("qd,mkd->qmk", qv, books, optimize=True)
                for at in range(0, len(qid), 32):
                    s = look_up(tables[at : at + 32], code) * scale
                    s[qid[at : at + 32, None] == cid[None, :]] = -np.inf
                    n = min(rerank, len(cid))
                    best = np.stack([first_best(row, n) for row in s])
                    approx = np.take_along_axis(s, best, 1)
                    keep = np.isfinite(approx)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid[at : at + 32], keep.sum(1))), pa.array(cid[best][keep]), pa.array(approx[keep].astype(float))], ["query_id", "vec_id", "approx"])

    found = met.select("q", "c").mapInArrow(score, "query_id long, vec_id long, approx double")
    if n_code > 1:
        found = found.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("approx"), "vec_id"))).filter(F.col("r") <= rerank)
    pairs = found.select("query_id", "vec_id").join(vectors.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv")), "query_id").join(vectors.select("vec_id", F.col("embedding").alias("cv")), "vec_id")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a, c = (b.column(i).flatten().to_numpy().reshape(b.num_rows, dim) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(exact_scores(a, c))], ["query_id", "vec_id", "score"])

    scored = pairs.select("query_id", "vec_id", "qv", "cv").mapInArrow(exact, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    least = scored.withColumn("rank", rank).filter(F.col("rank") == top).select("query_id", F.col("score").alias("least"))
    asked = vectors.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv")).join(least, "query_id", "left")
    asked = staged(asked.withColumn("least", F.coalesce("least", F.lit(float("-inf")))), "ann-asked")
    out = checked(codes, asked, books, top)
    discard(codes, asked)
    return out.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")

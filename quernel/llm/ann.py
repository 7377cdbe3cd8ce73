"""Nearest neighbours by score-aware quantisation.

Vectors are scaled to length 1, so the largest cosine is the largest inner product. Each is quantised in pairs
of components to 16 codewords, 4 bits a pair. What counts for a large inner product is the error along the
vector, so the loss weighs the parallel residual more than the rest; codewords and codes are both chosen by
that loss. A scan of the codes adds up table entries for two pairs a byte, blocks of rows against blocks of queries.

How far an estimate may be off is known: a row keeps the length of its residual along itself and across. A row of
cosine t with the query has an estimate of at least t (1 - along) - sqrt(1 - t^2) across, so rows whose estimate is under
that for the query's k-th best cosine so far can't be among its nearest; all others are scored exactly. So nothing is
missed, whatever the vectors are like; how many are scored depends on how well the codes tell them apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from quernel.store import mapped, saved

WORDS = 16
QUERY_BLOCK = 256  #: queries in a row of the query side, on average
TABLES = 16 << 20  #: bytes of lookup tables that a task holds at once
SCAN_ROWS = 4096  #: rows at most whose codes are one row of the scanned side
SCAN_BYTES = 4 << 20  #: bytes at most of their vectors
PAIRS_BYTES = 2 << 20  #: bytes of the vectors of pairs that are scored at once


@dataclass
class Quantiser:
    """books: pairs x 16 x 2; weight: of the parallel residual against the rest."""

    books: np.ndarray
    weight: float

    def pairs(self, unit: np.ndarray) -> np.ndarray:
        n, d = unit.shape
        wide = 4 * -(-d // 4)
        if wide > d:
            unit = np.hstack([unit, np.zeros((n, wide - d))])
        return unit.reshape(n, wide // 2, 2)

    def codes(self, unit: np.ndarray, passes: int = 3) -> np.ndarray:
        """Codes by coordinate descent: each pair in turn takes the codeword that is best given the others."""
        x = self.pairs(unit)
        n, m, _ = x.shape
        code = np.empty((n, m), np.int64)
        along = np.empty((n, m))
        for j in range(m):
            rest = x[:, j, None, :] - self.books[j][None]
            code[:, j] = (rest**2).sum(2).argmin(1)
            along[:, j] = ((x[:, j] - self.books[j][code[:, j]]) * x[:, j]).sum(1)
        total = along.sum(1)
        for _ in range(passes):
            for j in range(m):
                rest = x[:, j, None, :] - self.books[j][None]
                share = (rest * x[:, j, None, :]).sum(2)
                others = total - along[:, j]
                loss = (rest**2).sum(2) + (self.weight - 1) * (others[:, None] + share) ** 2
                code[:, j] = loss.argmin(1)
                along[:, j] = share[np.arange(n), code[:, j]]
                total = others + along[:, j]
        return code

    def off(self, unit: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row, its residual along itself (signed) and the length of the rest of it."""
        x = self.pairs(unit)
        rest = x - self.books[np.arange(codes.shape[1])[None], codes]
        along = (rest * x).sum((1, 2))
        return along, np.sqrt(np.maximum((rest**2).sum((1, 2)) - along**2, 0))

    def tables(self, unit: np.ndarray) -> np.ndarray:
        """Of each query, inner products by byte: queries x pairs / 2 x 256."""
        part = np.einsum("qmd,mcd->qmc", self.pairs(unit), self.books)
        low, high = part[:, 0::2], part[:, 1::2]
        return (high[:, :, :, None] + low[:, :, None, :]).reshape(len(unit), -1, 256).astype(np.float32)


def packed(codes: np.ndarray) -> np.ndarray:
    """Two codes a byte."""
    return (codes[:, 0::2] | codes[:, 1::2] << 4).astype(np.uint8)


def train(sample: np.ndarray, threshold: float = 0.2, rounds: int = 8) -> Quantiser:
    """Codebooks for unit vectors; ``threshold`` is the cosine from which scores matter."""
    d = sample.shape[1]
    weight = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
    made = Quantiser(np.zeros((0, WORDS, 2)), weight)
    x = made.pairs(sample)
    n, m, _ = x.shape
    first = np.linspace(0, n - 1, WORDS).astype(int)
    order = np.argsort(np.arctan2(x[:, :, 1], x[:, :, 0]), axis=0)
    made.books = np.stack([x[order[first, j], j] for j in range(m)])
    for turn in range(rounds):
        code = made.codes(sample, passes=1 if turn else 0)
        along = np.stack([((x[:, j] - made.books[j][code[:, j]]) * x[:, j]).sum(1) for j in range(m)], 1)
        total = along.sum(1)
        for j in range(m):
            others = total - along[:, j]
            for c in range(WORDS):
                own = np.flatnonzero(code[:, j] == c)
                if len(own):
                    v = x[own, j]
                    left = len(own) * np.eye(2) + (weight - 1) * v.T @ v
                    right = v.sum(0) + (weight - 1) * (v * (others[own] + (v**2).sum(1))[:, None]).sum(0)
                    made.books[j, c] = np.linalg.solve(left + 1e-9 * np.eye(2), right)
            along[:, j] = ((x[:, j] - made.books[j][code[:, j]]) * x[:, j]).sum(1)
            total = others + along[:, j]
    return made


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two, which rounds nothing, so that its largest component is between a half and 1 and
    no square over- or underflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _cosines(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Of each row with the query, or with its row of as many queries. A row's sums are along its own components, so
    equal rows score equally wherever they stand; a matrix product would not promise that."""
    x, query = np.ascontiguousarray(_scaled(x)), np.ascontiguousarray(_scaled(np.atleast_2d(query)))
    return (x * query).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((query * query).sum(1)))


def usable(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    """(id, vector) of the rows that take part: not null, not zero, all components finite numbers."""
    v = F.col(embedding).cast("array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    held = F.col(embedding) if dict(vectors.dtypes)[embedding] == "array<float>" else v
    return vectors.where(F.col(key).isNotNull() & v.isNotNull()).where(finite & some).select(F.col(key).cast("long").alias("id"), held.alias("vector"))


def nearest(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", every: int = 50, k: int = 5, max_sample: int = 8192) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` rows of largest cosine for each query.

    Queries are the rows whose key is divisible by ``every``; candidates are all rows but those with the
    query's key. All codes are scanned, in groups of 4,096 rows or fewer, and every row that its estimate doesn't rule
    out is scored on the original vectors in double precision. Ties go to the smaller key; a query with fewer
    than k candidates gets all. Vectors that are null, zero, or have null or non-finite components take no part,
    nor do rows with a null key or with another number of components than most rows have. A repeated row is a
    candidate as often as it is there; queries of one key are answered once, by the least of their vectors.
    Codebooks are fitted on at most ``max_sample`` rows, those of smallest hash; all rows are indexed.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, key, embedding)
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = sizes[0]["d"]
    rows = rows.where(F.size("vector") == d)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(max_sample).select("vector").toArrow()["vector"]
    quantiser = train(_unit(_matrix(sample, d)))
    kind = np.float32 if dict(rows.dtypes)["vector"] == "array<float>" else np.float64
    size = max(1, min(SCAN_ROWS, SCAN_BYTES // (d * np.dtype(kind).itemsize)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def out() -> pa.RecordBatch:
            own = [np.concatenate(x) for x in zip(*parts, strict=True)]
            values = [pa.array([x.tobytes()], pa.binary()) for x in own]
            return pa.RecordBatch.from_arrays(values, names=["ids", "codes", "along", "across", "rows"])

        for b in batches:
            while len(b):
                part, b = b.slice(0, size - held), b.slice(min(len(b), size - held))
                x = _matrix(part["vector"], d)
                unit = _unit(x)
                codes = quantiser.codes(unit)
                along, across = quantiser.off(unit, codes)
                parts.append((part["id"].to_numpy(), packed(codes), along.astype(np.float32), across.astype(np.float32), x.astype(kind)))
                held += len(part)
                if held == size:
                    yield out()
                    parts, held = [], 0
        if held:
            yield out()

    coded = saved(mapped(rows, index, "ids binary, codes binary, along binary, across binary, rows binary"), "codes")
    queries = saved(rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("vector").alias("vector")), "queries")
    block = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-queries.count() // QUERY_BLOCK))))
    own = queries.groupBy(block.alias("block")).agg(F.collect_list(F.struct("id", "vector")).alias("own"))
    blocks = saved(own.select("block", F.col("own.id").alias("queries"), F.flatten("own.vector").alias("vectors")), "blocks")
    met = coded.crossJoin(blocks)
    found = mapped(met, _scan(quantiser, d, k, kind), "query_id long, vec_id long, score double")
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", turn).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class _Best:
    """The k best so far of each query of one block, over the groups of codes that a task has scanned."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.score, self.vec = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)

    def add(self, query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        """Pairs of a query's place and a row, of which those go that are no better than the k-th."""
        some = score >= self.score[query, -1]
        touched = np.unique(query[some])
        if not len(touched):
            return
        held = np.isfinite(self.score[touched])
        query = np.concatenate([np.repeat(touched, held.sum(1)), query[some]])
        vec = np.concatenate([self.vec[touched][held], vec[some]])
        score = np.concatenate([self.score[touched][held], score[some]])
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        turn = np.arange(len(query)) - np.searchsorted(query, query, "left")
        ok = turn < self.k
        self.score[query[ok], turn[ok]], self.vec[query[ok], turn[ok]] = score[ok], vec[ok]

    def kept(self) -> pa.RecordBatch:
        held = np.isfinite(self.score)
        values = [np.repeat(self.ids, held.sum(1)), self.vec[held], self.score[held]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in values], names=["query_id", "vec_id", "score"])


def _least(kth: np.ndarray, along: np.ndarray, across: np.ndarray, slack: float) -> np.ndarray:
    """Queries x rows: the least estimate of a row whose cosine is the query's k-th best so far, or more."""
    side = np.sqrt(np.maximum(1 - kth * kth, 0)).astype(np.float32)  # before kth is rounded
    kth = kth.astype(np.float32)
    near = kth[:, None] * (1 - along) - side[:, None] * across
    # for cosines below zero the first doesn't rise with the cosine; the whole residual is then what counts
    ok = (kth[:, None] > 0) & (along < 1)
    return np.where(ok, near, kth[:, None] - np.sqrt(along**2 + across**2)) - slack


def _scan(quantiser: Quantiser, d: int, k: int, kind: type):
    """The k best of each query of a block among the groups of codes that a task meets it with: of each group the first by
    estimate are scored, and then all that may still be among the best."""

    def scored(x: np.ndarray, y: np.ndarray, query: np.ndarray, row: np.ndarray) -> np.ndarray:
        step = max(1, PAIRS_BYTES // (8 * d))
        parts = [_cosines(x[row[lo : lo + step]], y[query[lo : lo + step]]) for lo in range(0, len(row), step)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, _Best] = {}
        at, x = None, np.zeros((0, d))
        for b in batches:
            for i in range(len(b)):
                raw = b["rows"][i].as_buffer()
                own = np.frombuffer(b["ids"][i].as_buffer(), np.int64)
                code = np.frombuffer(b["codes"][i].as_buffer(), np.uint8).reshape(len(own), -1)
                along, across = (np.frombuffer(b[c][i].as_buffer(), np.float32) for c in ("along", "across"))
                if at is None or not raw.equals(at):
                    at, x = raw, np.frombuffer(raw, kind).reshape(-1, d).astype(np.float64)
                ids = b["queries"].slice(i, 1).flatten().to_numpy()
                state = best.setdefault(b["block"][i].as_py(), _Best(ids.copy(), k))
                y = _matrix(b["vectors"].slice(i, 1), d)
                unit = _unit(y)
                slack = 1e-5 + 2e-7 * code.shape[1]  # sums of floats are off by less
                most = max(1, TABLES // (code.shape[1] * 1024))
                for lo in range(0, len(ids), most):
                    tables = quantiser.tables(unit[lo : lo + most])
                    guess = np.zeros((len(tables), len(own)), np.float32)
                    for j in range(code.shape[1]):
                        guess += np.take(tables[:, j], code[:, j], axis=1)
                    guess[own[None, :] == ids[lo : lo + most, None]] = -np.inf
                    take = min(2 * k, len(own))
                    row = np.argpartition(guess, len(own) - take, axis=1)[:, len(own) - take :].ravel()
                    query = np.repeat(np.arange(len(tables)), take)
                    some = guess[query, row] > -np.inf
                    for turn in range(2):
                        query, row = query[some], row[some]
                        state.add(lo + query, own[row], scored(x, y, lo + query, row))
                        if not turn:
                            guess[query, row] = -np.inf
                            kth = state.score[lo : lo + len(tables), -1]
                            query, row = np.nonzero((guess > -np.inf) & (guess >= _least(kth, along, across, np.float32(slack))))
                            some = slice(None)
        for state in best.values():
            yield state.kept()

    return run

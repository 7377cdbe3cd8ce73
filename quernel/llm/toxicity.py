"""Severity of toxic language by cumulative-link ordinal regression on sparse word features.

With grades 0 to K, P(grade > k) = s(w.x - t_k): the weights w are shared by all thresholds t_0 < t_1 < ...,
and the expected severity is the sum of these probabilities. x has a 1 for each chosen word, or beginning of words, that occurs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.bytetok import Chunk, chunks
from quernel.llm.langid import Lookup
from quernel.store import free_name, mapped, saved


@dataclass
class Ordinal:
    """words: sorted hashes; weights: one of each word; thresholds: rising."""

    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and threshold."""
        with np.errstate(over="ignore"):  # an infinite threshold gives exactly 0 or 1
            return 1 / (1 + np.exp(self.thresholds[None, :] - score[:, None]))


def fit_ordinal(index: np.ndarray, owner: np.ndarray, grade: np.ndarray, features: int, grades: int, penalty: float = 0.3, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of least penalised loss, by L-BFGS.

    Row r has the features index[owner == r]. Thresholds are the first one and the logarithms of their steps.
    """
    n, cuts = len(grade), grades - 1

    def thresholds(z: np.ndarray) -> np.ndarray:
        return z[0] + np.append(0, np.cumsum(np.exp(z[1:])))

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, z = p[:features], p[features:]
        t = thresholds(z)
        score = np.bincount(owner, weights=w[index], minlength=n)
        # P(grade) = above[grade - 1] - above[grade], with 1 before the first and 0 after the last
        above = 1 / (1 + np.exp(np.clip(t[None, :] - score[:, None], -500, 500)))
        edge = np.hstack([np.ones((n, 1)), above, np.zeros((n, 1))])
        slope = edge * (1 - edge)
        r = np.arange(n)
        share = np.maximum(edge[r, grade] - edge[r, grade + 1], 1e-12)
        by_score = -(slope[r, grade] - slope[r, grade + 1]) / share
        by_cut = np.zeros((n, cuts + 2))
        by_cut[r, grade] += slope[r, grade] / share
        by_cut[r, grade + 1] -= slope[r, grade + 1] / share
        g = by_cut[:, 1:-1].sum(0)
        by_z = np.append(g.sum(), [np.exp(z[i]) * g[i:].sum() for i in range(1, cuts)])
        by_w = np.bincount(index, weights=by_score[owner], minlength=features) + penalty * w
        return -np.log(share).sum() + 0.5 * penalty * (w @ w), np.concatenate([by_w, by_z])

    p = np.zeros(features + cuts)
    past = [(grade > k).mean() for k in range(cuts)]
    start = [np.log((1 - q) / q) for q in np.clip(past, 1e-6, 1 - 1e-6)]
    p[features] = start[0]
    for i in range(1, cuts):
        p[features + i] = np.log(max(start[i] - start[i - 1], 1e-3))
    value, slope = loss(p)
    memory: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way, steps = slope.copy(), []
        for s, y in reversed(memory):
            a = (s @ way) / (y @ s)
            steps.append(a)
            way -= a * y
        if memory:
            s, y = memory[-1]
            way *= (s @ y) / (y @ y)
        for (s, y), a in zip(memory, reversed(steps), strict=True):
            way += s * (a - (y @ way) / (y @ s))
        size, down = 1.0 if memory else min(1.0, 1 / np.abs(slope).sum()), slope @ way
        while size > 1e-10:
            new = p - size * way
            then, there = loss(new)
            if then <= value - 1e-4 * size * down:
                break
            size /= 2
        else:
            break
        s, y = new - p, there - slope
        if s @ y > 1e-12:
            memory = [*memory[-7:], (s, y)]
        done = value - then < 1e-7 * abs(value)
        p, value, slope = new, then, there
        if done:
            break
    return p[:features], thresholds(p[features:])


#: Lengths in bytes of the word beginnings that are features beside whole words.
PREFIXES = (5, 7)


def _features(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and of beginnings of longer words, with the row of each."""
    rows = c.word_rows()
    hashes, owners = [c.hashes()], [rows]
    for n in PREFIXES:
        at = np.flatnonzero(c.ends - c.starts >= n)
        hashes.append(c.hashes(c.starts[at], c.starts[at] + n) ^ np.uint64(n))
        owners.append(rows[at])
    return np.concatenate(hashes), np.concatenate(owners)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, rows with it, those of them above grade 0), added up by chunk."""
    for b in batches:
        up = b["grade"].to_numpy() > 0
        for c in chunks(b["text"]):
            hashes, rows = _features(c)
            words, of = np.unique(hashes, return_inverse=True)
            of, row = np.divmod(np.unique(of * c.rows + rows), c.rows)
            n = np.bincount(of, minlength=len(words))
            a = np.bincount(of, weights=up[c.first + row], minlength=len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(a)], names=["word", "n", "a"])


def _known(known: Lookup, width: int, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature), once each, of the known features of a chunk."""
    hashes, rows = _features(c)
    found = known.rows(hashes)
    at = np.flatnonzero(found >= 0)
    return np.divmod(np.unique(rows[at].astype(np.int64) * width + found[at]), width)


def fit(docs: DataFrame, labels: DataFrame, grade: str = "toxic", key: str = "doc_id", text: str = "text", max_docs: int = 20_000, max_words: int | None = 4096, least: int = 5) -> Ordinal:
    """Learn from at most ``max_docs`` labelled rows, those of smallest hash of the key (and of the text, where several
    rows share a key).

    Features are words, and beginnings of words: the ``max_words`` (None: all) of those in ``least`` rows or more whose share
    among rows above grade 0 differs most surely from that among the others. Grades are whole numbers from 0;
    rows without one, or with several, or without a text are left out. Where all grades are 0, so is every
    severity, and where none is, every row is above it.
    """
    graded = labels.where(F.col(key).isNotNull() & (F.col(grade) >= 0)).groupBy(key).agg(F.min(grade).cast("int").alias("grade"), F.max(grade).alias("_most"))
    graded = graded.where(F.col("grade") == F.col("_most")).select(F.col(key).alias("_key"), "grade")
    chosen = saved(graded.orderBy(F.xxhash64("_key"), "_key").limit(max_docs), "graded")
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_id"), F.col(text).cast("string").alias("text"))
    rows = rows.join(F.broadcast(chosen), F.col("_id") == F.col("_key"))
    slim = saved(rows.select("_key", F.xxhash64("text").alias("_text")), "graded-rows")
    if slim.count() > max_docs:  # some keys have several texts
        kept = slim.distinct().orderBy(F.xxhash64("_key"), "_key", "_text").limit(max_docs).select(F.col("_key").alias("_k"), F.col("_text").alias("_t"))
        first = rows.join(F.broadcast(saved(kept, "graded-rows")), (F.col("_key") == F.col("_k")) & (F.xxhash64("text") == F.col("_t")))
        rows = first.groupBy("_key", "_t").agg(F.first("grade").alias("grade"), F.first("text").alias("text"))
    seen = saved(rows.select("grade", "text"), "graded-texts")
    totals = {bool(r[0]): r[1] for r in seen.groupBy(F.col("grade") > 0).count().collect()}
    if not totals.get(True) or not totals.get(False):
        return Ordinal(np.zeros(0, np.uint64), np.zeros(0), np.full(1, -np.inf if totals.get(True) else np.inf))
    high, low = totals[True], totals[False]
    by_word = mapped(seen, _count, "word long, n long, a long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("a").alias("a")).where(F.col("n") >= least)
    share = F.col("n") / (high + low)
    apart = F.abs(F.col("a") / high - (F.col("n") - F.col("a")) / low)
    sure = apart / F.sqrt(share * (1 - share) * (1 / high + 1 / low) + 1e-9)
    best = by_word.select("word", sure.alias("sure")).orderBy(F.desc("sure"), "word")
    best = best if max_words is None else best.limit(max_words)
    words = np.sort(best.select("word").toArrow()["word"].to_numpy().view(np.uint64))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lookup(words)
        for b in batches:
            for c in chunks(b["text"]):
                row, feature = _known(known, len(words), c)
                offsets = np.append(0, np.cumsum(np.bincount(row, minlength=c.rows))).astype(np.int32)
                features = pa.ListArray.from_arrays(pa.array(offsets), pa.array(feature.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b["grade"].slice(c.first, c.rows), features], names=["grade", "features"])

    got = mapped(seen, pick, "grade int, features array<int>").toArrow().combine_chunks()
    grades, features = got["grade"].to_numpy(), got["features"].combine_chunks()
    owner = np.repeat(np.arange(len(grades)), features.value_lengths().to_numpy())
    weights, thresholds = fit_ordinal(features.flatten().to_numpy(), owner, grades, len(words), int(grades.max()) + 1)
    return Ordinal(words, weights, thresholds)


def severity(docs: DataFrame, model: Ordinal, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of all rows, severity (double, the expected grade), grade (the largest that is more
    likely reached than not) and toxic (grade over 0). Columns of these names are replaced.

    Whole texts are looked at. A text without a known word, an empty one too, has the severity of no features;
    a null text has null in all three.
    """
    keep = [c for c in keep if c not in ("severity", "grade", "toxic")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, width = Lookup(model.words), max(len(model.words), 1)
        for b in batches:
            score = [np.zeros(0)]
            for c in chunks(b.column(len(keep))):
                row, word = _known(known, width, c)
                score.append(np.bincount(row, weights=np.append(model.weights, 0.0)[word], minlength=c.rows))
            above = model.above(np.concatenate(score))
            null = b.column(len(keep)).is_null().to_numpy(zero_copy_only=False)
            expected, grade = above.sum(1), (above > 0.5).sum(1)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(keep)], pa.array(expected, mask=null), pa.array(grade.astype(np.int32), mask=null), pa.array(grade > 0, mask=null)],
                names=[*keep, "severity", "grade", "toxic"],
            )

    schema = docs.select(*keep).schema.add("severity", "double").add("grade", "integer").add("toxic", "boolean")
    return mapped(docs.select(*keep, F.col(text).cast("string").alias(free_name(docs, "own_text"))), run, schema)

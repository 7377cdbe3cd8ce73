"""Benchmark decontamination by winnowing.

Both sides are cut into words and hashed into k-grams. Of every run of w = window - k + 1 consecutive k-grams
the smallest hash is kept (all of them, if it occurs more than once), so two texts that share ``window``
words share a kept k-gram at the same place. Kept k-grams of documents that pass a bitmap of fixed size are
joined with those of the benchmark, with the words around them, and each meeting is extended word by word:
only equal words count, whatever the hashes say. Items of fewer words than a window are one window of their
own length, looked for at every position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.bytetok import LOWER, Chunk, chunks, mix
from quernel.store import MAX_BROADCAST_ROWS, free_name, hinted, mapped, saved

_STEP = np.uint64(0x9FB21C651E98DF25)
_FIELDS = "row long, id {id}, n_words long, hash long, pos long, context string, left int, size int"


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(k), dtype=np.uint64)
    for j in range(k):
        out = out * _STEP + words[j : j + n]
    return mix(out)


def _slide(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Least or most of each w neighbours."""
    out = x[: len(x) - w + 1].copy()
    for j in range(1, w):
        (np.minimum if least else np.maximum)(out, x[j : j + len(out)], out=out)
    return out


def winnowed(words: np.ndarray, rows: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of kept k-grams; windows don't cross from one row of the chunk to the next."""
    w = window - k + 1
    grams = gram_hashes(words, k)
    if len(words) < window:
        return np.zeros(0, np.int64), grams[:0]
    least = _slide(grams, w, True)
    least[rows[: len(least)] != rows[window - 1 :]] = 0
    padded = np.zeros(len(grams) + w - 1, np.uint64)
    padded[w - 1 : w - 1 + len(least)] = least
    at = np.flatnonzero((_slide(padded, w, False) == grams) & (grams != 0))
    return at, grams[at]


def _context(c: Chunk, row: int, pos: int, size: int, around: int) -> tuple[str, int]:
    a = max(int(c.word_bounds[row]), pos - around)
    b = min(int(c.word_bounds[row + 1]), pos + size + around)
    words = [LOWER[c.data[s:e]].tobytes().decode() for s, e in zip(c.starts[a:b], c.ends[a:b], strict=True)]
    return " ".join(words), pos - a


def _windows(window: int):
    """Hashes of all runs of ``window`` words of the rows of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                rows, g = c.word_rows(), gram_hashes(c.hashes(), window)
                if len(g):
                    yield pa.RecordBatch.from_pydict({"hash": np.unique(g[rows[: len(g)] == rows[window - 1 :]]).view(np.int64)})

    return run


def _inside(words: np.ndarray, rows: np.ndarray, pos: np.ndarray, k: int, window: int, full: np.ndarray) -> np.ndarray:
    """Which k-grams lie in a run of ``window`` words whose hash is in the bitmap of the benchmark's runs."""
    g = gram_hashes(words, window)
    held = in_bitmap(full, g) & (rows[: len(g)] == rows[window - 1 :]) if len(g) else np.zeros(0, bool)
    before = np.append(0, np.cumsum(held))
    first, last = np.clip(pos - (window - k), 0, len(held)), np.clip(pos + 1, 0, len(held))
    return before[last] > before[first]


def _scan(window: int, k: int, short: list[int], bits: np.ndarray | None, all_rows: bool, full: np.ndarray | None = None):
    """Kept k-grams of the rows of (id, text); with all_rows, a row with a null hash for each row that has none.

    Of a document's, those go on that the benchmark may have, in a run that it may have: a k-gram that is frequent on
    both sides, in runs of words of which none is shared, would else meet itself as often as the two counts multiply to.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column(0)
            for c in chunks(batch.column(1)):
                words, rows, n = c.hashes(), c.word_rows(), np.diff(c.word_bounds)
                found = []
                sets = [(k, window, *winnowed(words, rows, k, window))]
                for m in short:
                    g = gram_hashes(words, m)
                    own = np.flatnonzero(rows[: len(g)] == rows[m - 1 :]) if len(g) else np.zeros(0, np.int64)
                    if bits is None:  # the benchmark's own side: whole items only
                        own = own[n[rows[own]] == m]
                    sets.append((m, m, own, g[own]))
                for gram, size, pos, hashes in sets:
                    if bits is not None and len(pos):
                        hit = in_bitmap(bits, hashes)
                        if size == window and gram < size:
                            hit &= _inside(words, rows, pos, k, window, full)
                        pos, hashes = pos[hit], hashes[hit]
                    for p, h in zip(pos.tolist(), hashes.view(np.int64).tolist(), strict=True):
                        row = int(rows[p])
                        text, left = _context(c, row, p, gram, size - gram)
                        found.append((row, h, p - int(c.word_bounds[row]), text, left, size))
                if all_rows:
                    bare = np.ones(c.rows, bool)
                    bare[[f[0] for f in found]] = False
                    found += [(int(r), None, None, None, None, None) for r in np.flatnonzero(bare)]
                if found:
                    row, h, pos, text, left, size = zip(*found, strict=True)
                    own = np.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(at + c.first + own),
                            ids.take(pa.array(own + c.first)),
                            pa.array(n[own].astype(np.int64)),
                            pa.array(h, pa.int64()),
                            pa.array(pos, pa.int64()),
                            pa.array(text, pa.string()),
                            pa.array(left, pa.int32()),
                            pa.array(size, pa.int32()),
                        ],
                        names=["row", "id", "n_words", "hash", "pos", "context", "left", "size"],
                    )
            at += len(ids)

    return scan


def bitmap(prints: DataFrame, count: int) -> np.ndarray:
    """A bit for each hash, in 8 KB to 8 MB: its size is bounded, whatever the benchmark's."""
    bits = min(max(16, (1024 * max(count, 1)).bit_length()), 26)
    bit = F.shiftrightunsigned("hash", 64 - bits)
    found = prints.groupBy(F.shiftright(bit, 5).cast("int").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(31).cast("long")).cast("int"))).alias("bits")
    )
    got = found.toArrow()
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().astype(np.uint32)
    return out.astype("<u4").view(np.uint8)


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes >> np.uint64(64 - (len(bits) * 8 - 1).bit_length())
    return ((bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1) > 0


def _extend():
    """Of each meeting, the equal words around it if they make up a window: start and end in the document."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, end, item = [], [], []
            for pos, text, left, size, other, shift, key in zip(*(b[c].to_pylist() for c in ("pos", "context", "left", "size", "item_context", "item_left", "item_id")), strict=True):
                hit = None
                if other is not None and text is not None:
                    mine, theirs = text.split(" "), other.split(" ")
                    lo = hi = 0
                    while left - lo > 0 and shift - lo > 0 and mine[left - lo - 1] == theirs[shift - lo - 1]:
                        lo += 1
                    while left + hi < len(mine) and shift + hi < len(theirs) and mine[left + hi] == theirs[shift + hi]:
                        hi += 1
                    if hi and lo + hi >= size:
                        hit = (pos - lo, pos + hi)
                start.append(hit and hit[0])
                end.append(hit and hit[1])
                item.append(key if hit else None)
            yield pa.RecordBatch.from_arrays(
                [b["row"], b["id"], b["n_words"], pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(item, b.schema.field("item_id").type)],
                names=["row", "id", "n_words", "start", "end", "item_id"],
            )

    return extend


def _met(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str, window: int, k: int) -> DataFrame:
    """Kept k-grams of documents beside the benchmark's that have the same hash, each with the words around it; a row of
    ``docs`` without any comes once."""
    kind = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    bench = items.select(F.col(item_id), F.col(text))
    every = list(range(1, window))
    prints = saved(
        mapped(bench, _scan(window, k, every, None, False), _FIELDS.format(id=kind[1])).select(
            "hash", F.col("id").alias("item_id"), F.col("context").alias("item_context"), F.col("left").alias("item_left"), F.col("size").alias("item_size")
        ).distinct(),
        "prints",
    )
    full = saved(mapped(bench, _windows(window), "hash long").distinct(), "windows")
    count = prints.count()
    short = [r[0] for r in prints.where(F.col("item_size") < window).select("item_size").distinct().collect()]
    scan = _scan(window, k, sorted(short), bitmap(prints, count), True, bitmap(full, full.count()))
    rows = mapped(docs.select(F.col(doc_id), F.col(text)), scan, _FIELDS.format(id=kind[0]))
    same = (F.col("hash") == F.col("_hash")) & (F.col("size") == F.col("item_size"))
    if count <= MAX_BROADCAST_ROWS:
        met = rows.join(F.broadcast(prints.withColumnRenamed("hash", "_hash")), same, "left")
    else:  # deal a frequent k-gram's documents over salts, with the benchmark's side once in each
        salts = 16
        rows = rows.withColumn("_salt", F.pmod(F.col("row"), F.lit(salts))).withColumn("hash", F.coalesce("hash", F.xxhash64("row")))
        wide = prints.withColumnRenamed("hash", "_hash").withColumn("_its", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = rows.join(wide, same & (F.col("_salt") == F.col("_its")), "left")
    return met.select("row", "id", "n_words", "pos", "context", "left", "size", "item_id", "item_context", "item_left")


def overlaps(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", window: int = 10, k: int = 5) -> DataFrame:
    """Shared word runs: row, id, n_words, start, end (word positions in the document), item_id.

    ``row`` numbers the rows of ``docs`` (with gaps). A row of docs without a shared run comes once, with null
    start, end and item_id; otherwise it comes once for each kept k-gram inside a shared run, so runs repeat
    and overlap. A null text has no words. A null item_id leaves its item unnamed, but its runs still count.
    """
    kind = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    met = _met(docs, items, doc_id, item_id, text, window, k)
    return mapped(met, _extend(), f"row long, id {kind[0]}, n_words long, start long, end long, item_id {kind[1]}")


def report(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", window: int = 10, k: int = 5) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it is inside any occurrence of a benchmark window. Repeated rows are each reported.
    """
    runs = overlaps(docs, items, doc_id, item_id, text, window, k)
    by_row = runs.groupBy("row").agg(
        F.first("id").alias(doc_id),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "end")))).alias("_runs"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("_items"),
    )
    total = F.aggregate(
        "_runs",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("e")),
        lambda a, x: F.struct(
            (a.n + F.greatest(F.lit(0).cast("long"), x.end - F.greatest(x.start, a.e))).alias("n"), F.greatest(a.e, x.end).alias("e")
        ),
        lambda a: a.n,
    )
    return by_row.select(
        doc_id,
        "n_words",
        total.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (total > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", window: int = 10, k: int = 5) -> DataFrame:
    """The rows of ``docs`` whose own text holds no benchmark window."""
    row, i, h1, h2 = (free_name(docs, x) for x in ("own_row", "its_id", "its_h1", "its_h2"))
    first, second = F.xxhash64("text"), F.xxhash64(F.lit(7), F.col("text"))
    own = F.struct(F.col(doc_id).alias("id"), first.alias("h1"), second.alias("h2"))
    runs = overlaps(docs.select(own.alias(row), "text"), items, row, window=window, k=k)
    found = runs.where("start is not null").select(F.col("id.id").alias(i), F.col("id.h1").alias(h1), F.col("id.h2").alias(h2)).distinct()
    same = F.col(doc_id).eqNullSafe(F.col(i)) & (first == F.col(h1)) & (second == F.col(h2))
    return docs.join(hinted(saved(found, "contaminated")), same, "left_anti")

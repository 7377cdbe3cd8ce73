"""Balanced shards by histogram sort.

Rows are ordered by (hash of the text, doc_id). The driver proposes boundary keys, every partition counts the
exact rows and bytes below each of them, and the proposals are refined until each boundary is near enough to
its target. Then rows move once, straight to their range, and are sorted there. Counts below each boundary
are exact, so a row's slot in its shard needs no further pass. Where a boundary falls among rows of one key, those
rows get a place as third part of their keys, and the boundary is sought again.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.store import free_name, mapped, saved

_LOCAL = (1 << 33) - 1  #: the part of monotonically_increasing_id() that counts within a partition
_HALF = 1 << 63
_END = 1 << 192
_KEY = ("_h", "_d", "_place")


def _split(keys: list[int]) -> list[np.ndarray]:
    """Whole numbers of three parts of 64 bits, as three columns."""
    low = 2 * _HALF - 1
    return [np.array([((k >> shift) & low) - _HALF for k in keys], dtype=np.int64) for shift in (128, 64, 0)]


def below(rows: list[np.ndarray], probes: list[np.ndarray]) -> np.ndarray:
    """How many of the sorted probes are at most each row's key; both in columns, the first being the upper part."""
    if len(rows) == 1:
        return np.searchsorted(probes[0], rows[0], "right")
    low, high = np.searchsorted(probes[0], rows[0], "left"), np.searchsorted(probes[0], rows[0], "right")
    out = low.copy()
    for start in np.unique(low[low != high]):
        own = np.flatnonzero((low == start) & (high > start))
        out[own] += below([c[own] for c in rows[1:]], [c[start : high[own[0]]] for c in probes[1:]])
    return out


def _counts(slim: DataFrame, probes: list[int]) -> dict[int, tuple[int, int]]:
    """Exact (bytes, rows) below each probe. One small row for each probe and partition is shuffled."""
    columns = _split(probes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for b in batches:
            at = below([b[c].to_numpy() for c in _KEY], columns)
            np.add.at(size, at, b["_size"].to_numpy())
            rows += np.bincount(at, minlength=len(rows))
        at = np.flatnonzero(rows)
        yield pa.RecordBatch.from_pydict({"at": at.astype(np.int32), "size": size[at], "n": rows[at]})

    found = mapped(slim, count, "at int, size long, n long").groupBy("at").agg(F.sum("size"), F.sum("n")).collect()
    size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for at, s, n in found:
        size[at], rows[at] = s, n
    size, rows = np.cumsum(size), np.cumsum(rows)
    return {k: (int(size[i]), int(rows[i])) for i, k in enumerate(probes)}


def splitters(
    slim: DataFrame, targets: list[tuple[int, float, float]], total: tuple[int, int], probes: int = 4096
) -> tuple[list[int], dict[int, tuple[int, int]], set[tuple[int, int]]]:
    """Boundary keys for ``targets`` of (0 for bytes or 1 for rows, value below, tolerance), counts below each, and
    the (hash, doc_id) whose rows are without places and would have to be cut to come nearer to a target.

    A target is met when a probe is within its tolerance, or when at most one row, or only rows of one equal
    key, lie between its closest probes; then the closer one is taken. Each round shares out ``probes`` among
    the intervals that are still open, so the driver holds a bounded number of counts for each round.
    """
    known: dict[int, tuple[int, int]] = {0: (0, 0), _END: total}
    while True:
        keys, wide, chosen, equal = sorted(known), set(), [], set()
        for which, value, tolerance in targets:
            column = [known[k][which] for k in keys]
            i = min(max(bisect.bisect_left(column, value), 1), len(keys) - 1)
            low, high = keys[i - 1], keys[i]
            best = min((low, high), key=lambda k: abs(known[k][which] - value))
            if abs(known[best][which] - value) <= tolerance or known[high][1] - known[low][1] <= 1:
                chosen.append(best)
            elif high - low <= 1:
                chosen.append(best)
                equal.add((((low >> 128) & (2 * _HALF - 1)) - _HALF, ((low >> 64) & (2 * _HALF - 1)) - _HALF))
            else:
                wide.add((low, high))
        if not wide:
            return sorted({k for k in chosen if 0 < k < _END}), known, equal
        new = set()
        for low, high in wide:
            step = max(1, (high - low) // (max(8, probes // len(wide)) + 1))
            new.update(range(low + step, high, step))
        known |= _counts(slim, sorted(new))


def histogram_shards(df: DataFrame, shards: int = 16, text: str = "text", key: str = "doc_id", tolerance: float = 0.0005, parts: int | None = None) -> DataFrame:
    """All rows and columns of ``df``, plus ``shard`` (int, from 0), ``slot`` (long, gapless from 0 in a shard).

    Law ``bytes``: the UTF-8 bytes of the text plus 1 (a null has none) sum to nearly the same in each shard:
    each boundary is within ``tolerance`` of a shard's size, or as near as a single row allows. Equal texts are
    neighbours, so a group of copies lies in one shard or in consecutive ones; a hot group, of rows equal in text and
    key too, is cut where the law asks for it. Columns named shard or slot are replaced. A null key sorts before
    others. Rows equal in text and key are interchangeable, so their slots among each other are too. An empty
    table stays empty.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    h, d = F.xxhash64(text), F.coalesce(F.col(key).cast("long"), F.lit(-_HALF))
    own_h, own_d, own_place, own_range = (free_name(df, x) for x in ("own_h", "own_d", "own_place", "own_range"))
    keyed = df.withColumns({own_h: h, own_d: d, own_place: F.lit(0).cast("long")})

    def slim(rows: DataFrame) -> DataFrame:
        return saved(rows.select(F.col(own_h).alias("_h"), F.col(own_d).alias("_d"), F.col(own_place).alias("_place"), size.alias("_size")), "keys")

    keys = slim(keyed)
    total = tuple(x or 0 for x in keys.agg(F.sum("_size"), F.count("*")).first())
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = shards * max(1, -(-parts // shards))
    targets = []
    for i in range(1, parts):
        near = tolerance * total[0] / shards if i % (parts // shards) == 0 else 0.05 * total[0] / parts
        targets += [(0, total[0] * i / parts, near), (1, total[1] * i / parts, 0.05 * total[1] / parts)]
    cuts, known, equal = splitters(keys, targets, total) if total[1] else ([], {}, set())
    if equal:
        keyed = _placed(keyed, own_h, own_d, own_place, equal)
        cuts, known, _ = splitters(slim(keyed), targets, total)
    ends = splitters_of(known, cuts, total, shards)
    columns = _split(cuts)
    shard_of, start, begun = [], [], 0
    for i in range(len(cuts) + 1):
        rows_below = known[cuts[i - 1]][1] if i else 0
        at = bisect.bisect_right(ends, cuts[i - 1]) if i else 0
        if not i or at != shard_of[-1]:
            begun = rows_below
        shard_of.append(at)
        start.append(rows_below - begun)

    @F.pandas_udf(T.IntegerType())
    def range_of(h: pd.Series, d: pd.Series, place: pd.Series) -> pd.Series:
        return pd.Series(below([h.to_numpy(), d.to_numpy(), place.to_numpy()], columns).astype(np.int32))

    at = F.array(*map(F.lit, shard_of))[F.col(own_range)]
    first = F.array(*[F.lit(x).cast("long") for x in start])[F.col(own_range)]
    return (
        keyed.withColumn(own_range, range_of(own_h, own_d, own_place))
        .repartitionById(len(cuts) + 1, F.col(own_range))
        .sortWithinPartitions(own_h, own_d, own_place)
        .withColumn("slot", first + F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL)))
        .withColumn("shard", at)
        .drop(own_h, own_d, own_place, own_range)
    )


def _placed(keyed: DataFrame, h: str, d: str, place: str, equal: set[tuple[int, int]]) -> DataFrame:
    """The rows of these keys, which are at most as many as there are boundaries, with places of their own. They are
    written, so that each has the same place whenever it is read; equal rows side by side take little room."""
    i, j = free_name(keyed, "its_h"), free_name(keyed, "its_d")
    known = F.broadcast(keyed.sparkSession.createDataFrame(sorted(equal), f"`{i}` long, `{j}` long"))
    same = (F.col(h) == F.col(i)) & (F.col(d) == F.col(j))
    hot = saved(keyed.join(known, same, "left_semi").withColumn(place, F.monotonically_increasing_id()), "equal")
    return keyed.join(known, same, "left_anti").unionByName(hot)


def splitters_of(known: dict[int, tuple[int, int]], cuts: list[int], total: tuple[int, int], shards: int) -> list[int]:
    """Of all cuts, the shards - 1 (fewer where one row fills a shard) nearest to the shards' targets in bytes."""
    best = [min(cuts, key=lambda k, v=total[0] * i / shards: abs(known[k][0] - v)) for i in range(1, shards)] if cuts else []
    return sorted(set(best))

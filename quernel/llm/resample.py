"""Importance resampling towards a target: hashed word features of a raw table are weighed by how much more often a
target table has them, and documents are drawn without replacement by weight and a seeded random draw.

Two passes over the raw texts, both by Arrow batches. The first counts buckets: each partition gives one vector, and a
tree of sums merges the vectors, so neither the driver nor any task holds more than a few of them. The second gathers
the gains of a document's buckets, which all tasks have by broadcast (a fixed number of them), and sums them by document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.operators.order import numbered
from quernel.store import free_name, mapped, saved

#: Bytes of words are digits, lower-case letters and those of all other alphabets; the rest become spaces.
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8: A to Z in lower case, cut at ASCII characters that are no letter or digit."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_WORD).split()


def features(own: list[bytes], longest: int) -> np.ndarray:
    """CRC-32 of all runs of 1 to ``longest`` words joined by spaces; a run's checksum goes on from its start's."""
    spaced = [b" " + w for w in own]
    run = list(map(zlib.crc32, own))
    out = [np.array(run, np.uint32)]
    for k in range(1, min(longest, len(own))):
        run = list(map(zlib.crc32, spaced[k:], run[:-1]))
        out.append(np.array(run, np.uint32))
    return np.concatenate(out)


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = 10_000, longest: int = 2) -> np.ndarray:
    """How many features of all texts fall into each bucket, repeats counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for t in b["text"]:
                total += np.bincount(features(words(t.as_py()), longest) % buckets, minlength=buckets)
        yield pa.RecordBatch.from_pydict({"counts": [total.tobytes()]})

    vectors = mapped(texts.select(F.col(text).alias("text")), count, "counts binary").rdd.map(lambda x: np.frombuffer(x[0], np.int64))
    none = texts.sparkSession.sparkContext.parallelize([np.zeros(buckets, np.int64)], 1)
    return vectors.union(none).treeReduce(np.add)


def gains(source: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """Floored ``scale`` times the log of how much likelier a bucket is in the target; one is added to each count."""
    many, few = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(scale * math.log((t + 1.0) * many / ((s + 1.0) * few))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", longest: int = 2) -> DataFrame:
    """(key, n_words, n_features, weight) of each row: weight is the floored mean gain of its features, 0 if none."""
    shared = docs.sparkSession.sparkContext.broadcast(gain.astype(np.float64))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            lists = [words(t.as_py()) for t in b["text"]]
            found = [features(x, longest) for x in lists]
            n = np.array([len(x) for x in found], np.int64)
            held = own[np.concatenate([*found, np.zeros(0, np.uint32)]) % len(own)]
            total = np.bincount(np.repeat(np.arange(len(n)), n), weights=held, minlength=len(n)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b["id"], pa.array([len(x) for x in lists], pa.int64()), pa.array(n), pa.array(total // np.maximum(n, 1))], names=["id", "n_words", "n_features", "weight"]
            )

    slim = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return mapped(slim, weigh, "id long, n_words long, n_features long, weight long").withColumnRenamed("id", key)


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = 25, least: int = 20, seed: int = 7, key: str = "doc_id", text: str = "text", buckets: int = 10_000, longest: int = 2
) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank), all long, a row for each row of ``docs``.

    Words are runs of ASCII letters and digits and of all signs beyond ASCII, A to Z lower-cased; features are runs of
    1 to ``longest`` of them. The score is the weight plus a draw from the Gumbel distribution that seed and key give,
    in thousandths, so the largest scores are a draw without replacement by weight. Of the N documents of ``least``
    words or more, floor(percent * N / 100) are drawn: they have ranks from 1 on by falling score, ties to the
    smaller key; others have null. A null text has no words and weight 0. A null key is hashed as an empty text
    and comes after others in ties. Repeated rows each count, and are ranked one after the other. An empty table
    stays empty; an empty target makes all weights follow from rarity alone.
    """
    gain = gains(bucket_counts(docs, text, buckets, longest), bucket_counts(target, text, buckets, longest))
    own = weighed(docs, gain, key, text, longest)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    draw = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double")
    luck = F.floor(-1000 * F.log(-F.log((draw + 0.5) / 4294967296.0)))
    scored = saved(own.withColumn("score", (F.col("weight") + luck).cast("long")), "scored")
    full = scored.where(F.col("n_words") >= least)
    drawn = full.count() * percent // 100
    placed = numbered(full, [], [F.col("score").desc(), F.col(key).asc_nulls_last(), F.col("n_features")], "rank")
    rank = F.when(F.col("rank") < drawn, F.col("rank") + 1).cast("long")
    rest = scored.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long"))
    return placed.withColumn("rank", rank).unionByName(rest)


def drawn(docs: DataFrame, target: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The drawn documents, with all their columns. Rows of a key that was drawn come all; keys are best unique."""
    own = free_name(docs, "own_key")
    chosen = resampled(docs, target, key=key, **options).where("rank is not null").select(F.col(key).alias(own)).distinct()
    return docs.join(saved(chosen, "drawn"), F.col(key).cast("long").eqNullSafe(F.col(own)), "left_semi")

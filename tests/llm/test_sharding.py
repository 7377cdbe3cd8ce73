import zlib

import numpy as np
import pytest
from cases import SCHEMA, odd, prose
from pyspark.sql import functions as F

from quernel.llm import sharding


def sizes(rows, shards):
    out = [0] * shards
    for x in rows:
        out[x.shard] += len((x.text or "").encode()) + 1
        assert 0 <= x.shard < shards
    for s in range(shards):
        slots = sorted(x.slot for x in rows if x.shard == s)
        assert slots == list(range(len(slots)))
    return out


def test_bytes_are_near_equal_with_hot_texts(spark):
    rows = [(i, prose(i, 1 + i % 90)) for i in range(1500)] + [(5000 + i, "the same hot text") for i in range(900)] + [(9000 + i, None) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.histogram_shards(df, 8).collect()
    assert sorted((x.doc_id, x.text or "") for x in got) == sorted((i, t or "") for i, t in rows)
    own = sizes(got, 8)
    assert max(own) - min(own) < 0.02 * sum(own) / 8 + 2 * 91 * 6
    again = {x.doc_id: (x.shard, x.slot) for x in sharding.histogram_shards(df.repartition(9), 8).collect()}
    assert again == {x.doc_id: (x.shard, x.slot) for x in got}


@pytest.mark.parametrize("parts", [1, 40])
def test_few_rows_and_other_partitions(spark, parts):
    df = spark.createDataFrame([(i, "x" * i) for i in range(5)], "doc_id long, text string")
    got = sharding.histogram_shards(df, 16, parts=parts).collect()
    assert len(got) == 5
    sizes(got, 16)


def test_odd_rows(spark):
    got = sharding.histogram_shards(odd(spark), 4)
    rows = got.collect()
    assert len(rows) == 19 and got.columns[-2:] == ["slot", "shard"]
    sizes(rows, 4)
    assert sharding.histogram_shards(spark.createDataFrame([], SCHEMA), 4).count() == 0


@pytest.mark.parametrize("share", [3, 1])
def test_a_row_that_is_repeated(spark, share):
    """One row makes up a third, or half, of all rows: it is cut like any other group."""
    rows = [(i, prose(i, 20 + i % 9), "a") for i in range(800)] + [(77, prose(7, 25), "b")] * (400 * 2 // share)
    df = spark.createDataFrame(rows, "doc_id long, text string, its_h string").repartition(5)
    got = sharding.histogram_shards(df, 16).collect()
    assert sorted((x.doc_id, x.text, x.its_h) for x in got) == sorted(rows)
    own = sizes(got, 16)
    assert min(own) > 0 and max(own) - min(own) <= 2 * 250


def test_only_one_row_repeated(spark):
    df = spark.createDataFrame([(1, "same text")] * 1000, "doc_id long, text string").repartition(7)
    assert sizes(sharding.histogram_shards(df, 8).collect(), 8) == [1250] * 8


def test_keys_of_three_parts(spark):
    r = np.random.default_rng(1)
    rows = r.integers(-3, 3, (3, 400))
    probes = sorted({tuple(map(int, x)) for x in r.integers(-3, 3, (60, 3))})
    want = [sum(p <= tuple(map(int, x)) for p in probes) for x in rows.T]
    assert sharding.below(list(rows), list(np.array(probes).T)).tolist() == want


def test_crc(spark):
    row = spark.createDataFrame([("é",)], "t string").select(F.crc32(F.col("t").cast("binary")).alias("c")).first()
    assert row.c == zlib.crc32("é".encode())

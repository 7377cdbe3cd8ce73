import time

import pandas as pd
from pyspark.sql import functions as F

from quernel.streaming.caps import capped


def rows(n=200):
    return [(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{i % 11}", f"é{i}", i) for i in range(n)]


SCHEMA = "id long, k string, t string, turn long"


def brute(some, most):
    """The first rows of each group, batch after batch."""
    seen, out = {}, []
    for batch in some:
        for i, k, t, _ in sorted(batch):
            n = seen.get(k, 0)
            if n < most:
                out.append((i, k, t, n))
                seen[k] = n + 1
    return sorted(out)


def drain(spark, source, sink, checkpoint, most):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{source}/*")
    q = capped(stream, "k", "id", most).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
    q.awaitTermination()


def put(spark, batch, path):
    spark.createDataFrame(batch, SCHEMA).coalesce(1).write.json(path)
    time.sleep(0.02)  # the source goes by the time of files


def test_batches_and_a_restart_give_what_one_pass_gives(spark, tmp_path):
    own = rows()
    batches = [own[:60], own[60:61], own[61:150], own[150:]]
    for k, b in enumerate(batches[:2]):
        put(spark, b, f"{tmp_path}/in/{k}")
    run = lambda: drain(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", 9)
    run()
    for k, b in enumerate(batches[2:]):
        put(spark, b, f"{tmp_path}/in/{k + 2}")
    run()  # a query of its own, from the checkpoint
    run()  # nothing new
    got = sorted(((x.id, x.k, x.t, x.turn) for x in spark.read.parquet(f"{tmp_path}/out").collect()), key=str)
    assert got == sorted(brute(batches, 9), key=str) == sorted(brute([own], 9), key=str)


def test_a_table_and_a_group_of_a_third_of_all_rows(spark):
    own = rows(3000)
    df = spark.createDataFrame(own, SCHEMA).repartition(5)
    got = sorted(((x.id, x.k, x.t, x.turn) for x in capped(df, "k", "id", 4).collect()), key=str)
    assert got == sorted(brute([own], 4), key=str)
    clash = df.withColumn("its_group", F.lit("g")).withColumn("n", F.lit(1))
    assert {(x.its_group, x.n) for x in capped(clash, "k", "id", 4).collect()} == {("g", 1)}
    assert capped(df.where("id < 0"), "k", "id", 4).count() == 0


def test_heads_are_bounded():
    from quernel.streaming.caps import _heads
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pandas(pd.DataFrame({"id": range(i * 100, i * 100 + 100), "k": ["a", "b"] * 50})) for i in (2, 0, 1)]
    (out,) = list(_heads(["k"], ["id"], 3)(iter(batches)))
    assert sorted(out["id"].to_pylist()) == [0, 1, 2, 3, 4, 5]

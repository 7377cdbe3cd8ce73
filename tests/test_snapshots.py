import os
import time

from pyspark.sql import functions as F

from quernel import store
from quernel.sources import snapshots as S


def made(path):
    """Times at which the rows of a stage's snapshots were written."""
    return {d: os.stat(f"{path}/{d}/rows/_SUCCESS").st_mtime_ns for d in os.listdir(path) if os.path.isdir(f"{path}/{d}")}


def test_unchanged_inputs_are_not_read_again(spark, tmp_path):
    source, folder = f"{tmp_path}/in", f"{tmp_path}/snaps"
    spark.range(20).withColumn("v", F.col("id") * 2).write.parquet(source)
    stage = lambda: spark.read.parquet(source).where("v > 10").withColumnRenamed("v", "w")
    first = sorted(map(tuple, S.snapshot(stage(), folder, "one").collect()))
    before = made(f"{folder}/one")
    assert sorted(map(tuple, S.snapshot(stage(), folder, "one").collect())) == first and made(f"{folder}/one") == before
    # another plan over the same files
    other = S.snapshot(stage().where("w < 30"), folder, "one")
    assert other.count() == len([x for x in first if x[1] < 30]) and len(made(f"{folder}/one")) == 2
    # other files under the same plan
    time.sleep(0.01)
    spark.range(100, 103).withColumn("v", F.col("id") * 2).write.mode("append").parquet(source)
    grown = S.snapshot(stage(), folder, "one")
    assert grown.count() == len(first) + 3 and len(made(f"{folder}/one")) == 3
    # a file of the same name and length, written later
    files = [f for f in os.listdir(source) if f.endswith(".parquet")]
    for f in files:
        os.utime(f"{source}/{f}", (1, 1))
    S.snapshot(stage(), folder, "one").count()
    assert len(made(f"{folder}/one")) == 4
    S.snapshot(stage(), folder, "one", version="2").count()
    assert len(made(f"{folder}/one")) == 5


def test_what_was_cut_off_is_made_anew(spark, tmp_path):
    source, folder = f"{tmp_path}/in", f"{tmp_path}/snaps"
    spark.range(5).write.parquet(source)
    S.snapshot(spark.read.parquet(source), folder, "s").count()
    (name,) = made(f"{folder}/s")
    os.unlink(f"{folder}/s/{name}/manifest.json")
    before = made(f"{folder}/s")
    assert S.snapshot(spark.read.parquet(source), folder, "s").count() == 5 and made(f"{folder}/s") != before


def test_rows_from_the_driver_need_a_version(spark, tmp_path):
    df = lambda n: spark.createDataFrame([(n,)], "n int")
    assert [S.snapshot(df(n), f"{tmp_path}", "a").first().n for n in (1, 2, 2)] == [1, 2, 2] and len(made(f"{tmp_path}/a")) == 3
    assert [S.snapshot(df(n), f"{tmp_path}", "b", version=f"v{n}").first().n for n in (1, 2, 2)] == [1, 2, 2] and len(made(f"{tmp_path}/b")) == 2


def test_a_sweep_leaves_what_is_named(spark, tmp_path):
    source, folder = f"{tmp_path}/in", f"{tmp_path}/snaps"
    spark.range(5).write.parquet(source)
    read = spark.read.parquet(source)
    for n in range(3):
        last = S.snapshot(read.where(F.col("id") > n), folder, "s")
        S.snapshot(read, folder, f"t{n}")
    gone = S.sweep(spark, folder)
    assert len(gone) == 2 and last.count() == 2 and len(made(f"{folder}/s")) == 1 and S.sweep(spark, folder) == []
    back = S.snapshot(read.where("id > 0"), folder, "s")
    assert back.count() == 4 and len(S.sweep(spark, folder)) == 1


def test_intermediate_tables_can_be_forgotten(spark):
    own = f"{store.shared_dir(spark)}/quernel/{spark.sparkContext.applicationId}".removeprefix("file:").replace("///", "/")
    store.saved(spark.range(3), "x").count()
    assert os.listdir(own)
    store.forget(spark)
    assert not os.path.exists(own)
    assert store.saved(spark.range(3), "x").count() == 3

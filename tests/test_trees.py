import json
import os

import pytest
from pyspark.sql import functions as F

from quernel.sources import trees as S


def tree(root):
    for exp in ("a", "b"):
        for step in (1, 2, 10, None):
            folder = f"{root}/{exp}/checkpoint-{f'step={step}' if step else 'last'}"
            os.makedirs(folder)
            for bench in ("human", "machine"):
                with open(f"{folder}/{bench}_0_1.jsonl_results.jsonl", "w") as f:
                    f.write(json.dumps({"task_id": f"{exp}{step}{bench}", "completion": "x\ny", "passed": step == 2}) + "\n\n  \n[1]\nnot json\n" + json.dumps({"task_id": 5}) + "\n" + json.dumps({"completion": None, "more": 1}))
    open(f"{root}/a/other.jsonl", "w").close()


def rows(df):
    return sorted((x.exp, x.step or 0, x.benchmark, x.task_id, x.passed) for x in df.collect())


def test_a_filter_opens_only_its_files(spark, tmp_path):
    tree(tmp_path)
    root = f"file://{tmp_path}"
    every = rows(S.read_results(spark, root))
    assert len(every) == 16 and ("a", 2, "human", "a2human", True) in every
    for test, keep in (
        ("step = 2", lambda x: x[1] == 2), ("step > 1 and exp = 'a'", lambda x: x[1] > 1 and x[0] == "a"), ("step in (1, 10) and benchmark = 'human'", lambda x: x[1] in (1, 10) and x[2] == "human"),
        ("step is null", lambda x: not x[1]), ("step <=> 10", lambda x: x[1] == 10), ("step <= 1", lambda x: x[1] == 1), ("exp = 'none'", lambda x: False), ("passed and step < 5", lambda x: x[4] and 0 < x[1] < 5),
        ("task_id like 'a%' and step >= 2", lambda x: x[0] == "a" and x[1] >= 2), ("step = 1 or exp = 'b'", lambda x: x[1] == 1 or x[0] == "b"), ("benchmark = exp", lambda x: False),
    ):
        assert rows(S.read_results(spark, root).where(test)) == [x for x in every if keep(x)], test
    # what is not asked for is not opened: it may be gone, or unreadable
    two = S.read_results(spark, root).where("step = 2")
    for exp in ("a", "b"):
        for f in os.listdir(f"{tmp_path}/{exp}/checkpoint-step=1"):
            os.chmod(f"{tmp_path}/{exp}/checkpoint-step=1/{f}", 0)
    reader = S.ResultReader(root)
    assert list(reader.pushFilters([S.D.EqualTo(("step",), 2), S.D.IsNotNull(("step",)), S.D.IsNotNull(("exp",)), S.D.EqualTo(("passed",), True)])) == [S.D.IsNotNull(("step",)), S.D.EqualTo(("passed",), True)]
    assert len(reader.partitions()) == 4 and all("step=2" in p.path for p in reader.partitions())
    assert two.rdd.getNumPartitions() == 4


def test_named_files_appear_together(spark, tmp_path):
    df = spark.range(100).select(F.col("id"), F.concat(F.lit("é\n"), F.col("id")).alias("t"), F.lit(None).cast("string").alias("none")).repartition(7)
    S.write_named_shards(df, f"file://{tmp_path}/out", 6, ["id"])
    assert sorted(os.listdir(tmp_path)) == ["out"]
    assert sorted(os.listdir(f"{tmp_path}/out")) == [f"shard-{i:05d}.jsonl" for i in range(6)]
    got = [[json.loads(x)["id"] for x in open(f"{tmp_path}/out/shard-{i:05d}.jsonl")] for i in range(6)]
    assert got == [list(range(i * 17, min(100, i * 17 + 17))) for i in range(6)]
    assert json.loads(open(f"{tmp_path}/out/shard-00000.jsonl").readline()) == {"id": 0, "t": "é\n0", "none": None}
    with pytest.raises(Exception, match="FileExistsError"):
        S.write_named_shards(df, f"file://{tmp_path}/out", 6, ["id"])
    assert sorted(os.listdir(tmp_path)) == ["out"]
    S.write_named_shards(df.limit(2), f"file://{tmp_path}/few", 4, ["id"])
    assert [os.path.getsize(f"{tmp_path}/few/shard-0000{i}.jsonl") > 0 for i in range(4)] == [True, True, False, False]
    S.write_named_shards(df.limit(0), f"file://{tmp_path}/none", 2, ["id"])
    assert sorted(os.listdir(f"{tmp_path}/none")) == ["shard-00000.jsonl", "shard-00001.jsonl"]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    bad = spark.range(50).select(F.concat(F.lit("f"), F.col("id") % 5).alias("file"), F.when(F.col("id") == 49, F.raise_error(F.lit("bad row"))).otherwise(F.col("id")).alias("v"))
    with pytest.raises(Exception, match="bad row"):
        S.write_named(bad, f"file://{tmp_path}/out")
    assert os.listdir(tmp_path) == []


def test_names_may_be_folders_and_replace_what_was_there(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    df = spark.range(30).select(F.col("id"), F.concat((F.col("id") % 2).cast("string"), F.lit("/checkpoint-step=3/h_0_1.jsonl_results.jsonl")).alias("file"), F.lit("t").alias("task_id"))
    S.write_named(df, path, order=["id"])
    assert S.read_results(spark, path).where("step = 3 and exp = '1'").count() == 15
    S.write_named(df.where("id < 4"), path, overwrite=True)
    assert sorted(x.exp for x in S.read_results(spark, path).collect()) == ["0", "0", "1", "1"] and os.listdir(tmp_path) == ["out"]
    writer = S.NamedWriter(path, [], False)
    with pytest.raises(ValueError, match="more than one task"):
        _twice(writer)


def _twice(writer):
    files, root = writer._open(writer.draft)
    for a in "ab":
        files.create_dir(f"{root}/{a}", recursive=True)
        files.open_output_stream(f"{root}/{a}/x").close()
    try:
        writer.commit([S.Written({"a/x": 1}), S.Written({"b/x": 1})])
    finally:
        writer.abort([])

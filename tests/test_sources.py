import gzip
import json

import pytest

from quernel.plans import tasks
from quernel.sources import records
from quernel.streaming.append import append_new


def test_jsonl(spark, tmp_path):
    lines = ['{"index": 1, "text": "a"}', "", "  ", "{bad", "7", "null", '{"index": 2, "text": null}', '{"index": 3}']
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write("\n".join(lines))
    for name in ("a.jsonl", "b.jsonl.gz"):
        df = records.read_jsonl(spark, str(tmp_path / name), "index int, text string")
        assert sorted((x["index"], x.text) for x in df.collect() if x.text) == [(1, "a")]
        assert sorted(x["index"] for x in df.select("index").collect()) == [1, 2, 3]
    with pytest.raises(Exception, match="(?i)malformed"):
        records.read_jsonl(spark, str(tmp_path / "a.jsonl"), "index int, text string", strict=True).collect()


def test_tables_by_name(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n1,"two\nlines ""q"""\n')
    assert records.read_table(spark, str(tmp_path / "x.csv")).first().b == 'two\nlines "q"'
    (tmp_path / "x.txt").write_text("one\ntwo")
    assert [x.text for x in records.read_table(spark, str(tmp_path / "x.txt")).collect()] == ["one", "two"]
    spark.range(3).write.parquet(str(tmp_path / "p"))
    assert records.read_table(spark, str(tmp_path / "p")).count() == 3


def test_last_problem_wins(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text("\n".join(json.dumps({"task_id": t, "prompt": p}) for t, p in (("a", "1"), ("b", "2"), ("a", "3"))))
    assert {x.task_id: x.prompt for x in records.read_problems(spark, str(tmp_path / "p.jsonl")).collect()} == {"a": "3", "b": "2"}


def test_benchmark_and_checkpoints(spark, tmp_path):
    one = spark.createDataFrame([("a", "p")], "task_id string, prompt string")
    two = spark.createDataFrame([("b", "s")], "task_id string, canonical_solution string")
    told = spark.createDataFrame([("a", "d")], "task_id string, detail_description string")
    got = {x.benchmark: x for x in records.read_benchmark({"one": one, "two": two}, {"one": told}).collect()}
    assert got["one"].detail_description == "d" and got["two"].prompt is None and got["two"].detail_description is None
    folder = tmp_path / "exp1" / "checkpoint-step=20-x"
    folder.mkdir(parents=True)
    (folder / "Human_0_1.jsonl_results.jsonl").write_text(json.dumps({"task_id": "a", "completion": "c", "passed": True}))
    row = records.read_checkpoints(spark, str(tmp_path), {"human": "Human", "none": "None"}).first()
    assert (row.exp, row.step, row.benchmark, row.passed) == ("exp1", 20, "human", True)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 2 else "x") for i in range(10)], "i int, t string")
    records.write_jsonl(df, str(tmp_path / "out"))
    records.write_jsonl(df, str(tmp_path / "out"), append=True)
    back = spark.read.json(str(tmp_path / "out"))
    assert back.count() == 20 and any('"t":null' in p.read_text() for p in (tmp_path / "out").glob("*.json"))
    records.write_shards(df, str(tmp_path / "shards"), 3, ["i"])
    assert sorted(p.name for p in (tmp_path / "shards").glob("shard=*")) == ["shard=0", "shard=1", "shard=2"]
    assert spark.read.json(str(tmp_path / "shards")).count() == 10
    assert records.snapshot(df, str(tmp_path / "snap"), 1, "kept").count() == 10
    other = df.where("i < 3")
    assert records.snapshot(other, str(tmp_path / "snap"), 1, "kept", reuse=True).count() == 10
    assert records.snapshot(other, str(tmp_path / "snap"), 2, "kept", reuse=True).count() == 3
    assert records.output_name("e", "a.b.jsonl", 5, "s") == "out/e_a.b_5_s"


def test_append_goes_on_where_it_ended(spark, tmp_path):
    source, sink, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    source.mkdir()
    for turn in range(2):
        (source / f"{turn}.jsonl").write_text(f'{{"index": {turn}}}\n')
        append_new(spark, str(source), "index int", sink, check, lambda df: df.where("index >= 0")).awaitTermination()
    assert sorted(x["index"] for x in spark.read.json(sink).collect()) == [0, 1]


def test_a_benchmark_folder_and_templates(spark, tmp_path):
    def put(name, rows):
        text = "\n".join(json.dumps(x) for x in rows)
        with gzip.open(tmp_path / name, "wt") if name.endswith(".gz") else open(tmp_path / name, "w") as f:
            f.write(text)

    put("verilogeval-machine.jsonl.gz", [{"task_id": "a", "prompt": "p", "canonical_solution": "m"}])
    put("verilogeval-manual.jsonl.gz", [{"task_id": "a", "prompt": "q", "canonical_solution": "h"}, {"task_id": "a", "canonical_solution": "h2"}])
    put("rtllm.jsonl", [{"task_id": "z", "canonical_solution": "r", "detail_description": "dr"}])
    put("VerilogDescription_Machine.jsonl", [{"task_id": "a", "detail_description": "dm"}])
    put("VerilogDescription_Human.jsonl", [{"task_id": "a", "detail_description": "dh"}, {"task_id": "b", "detail_description": "none"}])
    got = {(x.benchmark, x.task_id): (x.canonical_solution, x.detail_description) for x in records.read_benchmark_folder(spark, str(tmp_path)).collect()}
    assert got == {("machine", "a"): ("m", "dm"), ("human", "a"): ("h2", "dh"), ("rtllm", "z"): ("r", "dr")}
    (tmp_path / "t.txt").write_text("two\nlines {code}\n")
    assert tasks.read_template(spark, str(tmp_path / "t.txt")) == "two\nlines {code}\n"

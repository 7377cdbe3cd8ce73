import os
import sys
import time
from dataclasses import dataclass, replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quernel.operators import answers
from quernel.operators.models import Answer, Command, Limits, Stub, ask, chat, executed
from quernel.plans import tasks


@dataclass(frozen=True)
class Counting:
    """Notes each prompt in a file before it answers; ends its process at a prompt, as long as ``ends`` is there."""

    notes: str
    ends: str
    at: str = "say 60"

    def __call__(self, messages, max_tokens, temperature):
        prompt = messages[-1]["content"]
        if prompt == self.at and os.path.exists(self.ends):
            os._exit(1)
        if prompt.endswith("7"):
            raise ValueError("no sevens")
        with open(self.notes, "a") as f:
            f.write(prompt + "\n")
        return Answer(prompt.upper())


def rows(spark, n=90):
    df = spark.range(n).select(F.col("id").alias("index"), F.concat(F.lit("say "), F.col("id")).alias("text"), F.lit("x").alias("its_request"))
    return df.withColumn("talk", chat(None, F.col("text"))).repartition(3)


def test_each_prompt_is_asked_once_though_a_task_is_lost(spark, tmp_path):
    notes, ends, log = str(tmp_path / "notes"), str(tmp_path / "ends"), f"file://{tmp_path}/log"
    Path(notes).touch()
    Path(ends).touch()
    client = Counting(notes, ends)
    with pytest.raises(Exception, match="(?s).*"):
        ask(rows(spark), "talk", client, log=log, threads=1)
    before = Path(notes).read_text().splitlines()
    assert before and len(before) < 80
    os.unlink(ends)
    got = {x["index"]: x for x in ask(rows(spark), "talk", client, log=log, threads=1).collect()}
    own = Path(notes).read_text().splitlines()
    assert len(own) == len(set(own)) == 81
    plain = {x["index"]: x for x in ask(rows(spark), "talk", replace(client, notes=notes + "2")).collect()}
    assert {i: (x.response, x.error, x.its_request) for i, x in got.items()} == {i: (x.response, x.error, x.its_request) for i, x in plain.items()}
    assert got[17].response is None and "no sevens" in got[17].error and got[60].response == "SAY 60"
    # a third run asks for nothing, save for what has failed
    ask(rows(spark), "talk", client, log=log).collect()
    assert Path(notes).read_text().splitlines() == own


def test_a_task_that_is_run_again_reads_its_earlier_attempts(tmp_path):
    first = answers._Writer(f"file://{tmp_path}/3")
    first.put("a", "one")
    first.put("b", 'two\n"')
    first.stream.write(b'{"request": "c", "resp')  # cut off
    first.stream.flush()
    assert answers._Writer(f"file://{tmp_path}/3").earlier() == {"a": "one", "b": 'two\n"'}
    first.close()


def test_equal_requests_and_other_requests(spark, tmp_path):
    notes, log = str(tmp_path / "notes"), f"file://{tmp_path}/log"
    client = Counting(notes, "/nowhere")
    df = rows(spark).withColumn("text", F.when(F.col("index") % 3 == 0, "hot").otherwise(F.col("text"))).withColumn("talk", chat(None, F.col("text")))
    got = ask(df, "talk", client, log=log)
    assert got.count() == 90 and got.where("response = 'HOT'").count() == 30
    assert Path(notes).read_text().splitlines().count("hot") == 1
    ask(df, "talk", client, log=log, temperature=0.5)
    assert Path(notes).read_text().splitlines().count("hot") == 2
    assert ask(df.where("index < 0"), "talk", client, log=log).count() == 0


def test_tasks_take_a_log(spark, tmp_path):
    notes = str(tmp_path / "notes")
    o = tasks.Options(Counting(notes, "/nowhere"), "INPUT:{text}", log=f"file://{tmp_path}/log")
    seeds = spark.createDataFrame([(0, "one"), (1, "two")], "index long, text string")
    first = sorted(x.response for x in tasks.base(seeds, o).collect())
    assert first == sorted(x.response for x in tasks.base(seeds, o).collect()) == ["INPUT:ONE", "INPUT:TWO"]
    assert len(Path(notes).read_text().splitlines()) == 2


def alive(mark):
    return any(mark in Path(p, "cmdline").read_text().replace("\0", " ") for p in Path("/proc").glob("[0-9]*") if Path(p, "cmdline").exists())


def test_a_group_that_is_late_is_ended_whole(tmp_path):
    mark = f"mark{os.getpid()}x"
    code = f"import subprocess, sys, time; subprocess.Popen([sys.executable, '-c', 'import time; time.sleep(300)', '{mark}']); print('begun', flush=True); time.sleep(300)"
    began = time.time()
    run = Command(((sys.executable, "-c", code),), timeout=3.0)({})
    assert run.timed_out and run.out == "begun\n" and time.time() - began < 20
    time.sleep(0.3)
    assert not alive(mark)
    left = code.replace("; time.sleep(300)\"", "").rpartition("; time")[0]
    assert not Command(((sys.executable, "-c", left),), timeout=20.0)({}).timed_out
    time.sleep(0.3)
    assert not alive(mark)  # what a child leaves behind is ended too


def test_limits_harm_no_other_row(spark):
    code = "import sys\nx = open('design.v').read()\nif x == 'big': y = bytearray(3 << 30)\nif x == 'long':\n    while True: pass\nif x == 'file': open('out', 'wb').write(b'x' * (8 << 20))\nprint('done', x)"
    runner = Command(((sys.executable, "-c", code),), timeout=30.0, limits=Limits(cpu=2, memory=1 << 30, file=1 << 20))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "big", "b", "long", "file", "c", None])], "id int, code string")
    got = {x.code: x for x in executed(df, {"design.v": "code"}, runner).collect()}
    assert [got[k].stdout for k in "abc"] == ["done a\n", "done b\n", "done c\n"] and got[None].stdout is None
    assert "MemoryError" in got["big"].stderr and not got["long"].timed_out and "done" not in got["long"].stdout and "done" not in got["file"].stdout

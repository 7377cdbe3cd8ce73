import sys
from dataclasses import replace

import pytest

from quernel.operators.models import Answer, Command, Retry, Run, Stub, ask, executed, judged
from quernel.operators import report
from quernel.plans import tasks
from pyspark.sql import functions as F


def told(prompt):
    body = prompt.rpartition("INPUT:")[2]
    return f"<PROBLEM>{body}</PROBLEM><SOLUTION>{body}</SOLUTION><REASON>why</REASON>"


LONG = ["the quick brown fox jumps over the lazy dog number one", "a wholly different sentence about registers and clocks", "third text on counters that wrap around at ten", "benchmark text that must not come back at all"]


@pytest.fixture
def bench(spark):
    return spark.createDataFrame([(LONG[3], "solution text of the benchmark item"), (None, "x")], "detail_description string, canonical_solution string")


@pytest.fixture
def seeds(spark):
    rows = [(0, LONG[0]), (1, LONG[1]), (2, LONG[0]), (3, LONG[3]), (4, LONG[2])]
    return spark.createDataFrame([(i, t, t, t, "title", t) for i, t in rows], "index long, input string, problem string, oss_input string, title string, text string")


def test_problem_tasks(spark, seeds, bench):
    o = tasks.Options(Stub(told), "Use this.\nINPUT:{code}")
    got = tasks.oss_generate_large(seeds, bench, o).collect()
    assert {x["index"]: x.problem for x in got} == {0: LONG[0], 1: LONG[1], 4: LONG[2]}
    wiki = tasks.instruct_generate_wiki(seeds, bench, replace(o, template="INPUT:{entity}")).collect()
    assert {x.title for x in wiki} == {"title"}
    pool = spark.createDataFrame([(t,) for t in LONG[:3]], "text string")
    large = tasks.instruct_generate_large(seeds, pool, bench, replace(o, template="INPUT:{icl_problem}")).collect()
    assert sorted(x["index"] for x in large) == [0, 1, 2] and {x.problem for x in large} == set(LONG[:3])


def test_solution_task_asks_the_judge_only_of_what_compiles(spark, seeds, bench):
    def runner(files):
        return Run("", "error" if "registers" in files["design.v"] else "")

    def judge(prompt):
        assert "registers" not in prompt
        return "<VALID>True</VALID><REASON>ok</REASON>" if "quick" in prompt else "<VALID>False</VALID>"

    o = tasks.Options(Stub(told), "INPUT:{problem}", runner=runner, judge=Stub(judge), reward=Stub(lambda p: "helpful:2.5"))
    got = {x["index"]: x for x in tasks.code_reason_generate(seeds, bench, o).collect()}
    assert set(got) == {0, 1, 4}
    assert got[0].llm_verification is True and got[0].rewards == {"helpful": 2.5} and got[0].reasoning == "why"
    assert got[1].iverilog_compiler_passed is False and got[1].llm_verification is None and got[1].rewards is None
    assert got[4].llm_verification is False and got[4].rewards is None
    oss = tasks.code_reason_oss(seeds, bench, replace(o, template="{reference_code} INPUT:{problem}", judge=None, reward=None)).collect()
    assert len(oss) == 3 and "index" not in oss[0].asDict()


def test_repair(spark, seeds, bench):
    reports = spark.createDataFrame([("bad", "good", "reason", "t1"), ("bad2", "good2", "reason2", "t2")], "error string, correct string, reason string, task_id string")
    o = tasks.Options(Stub(told), "{icl_error} {icl_reason} {icl_correct} INPUT:{code}")
    got = tasks.oss_repair(seeds, reports, bench, o).collect()
    assert {x.output for x in got} == set(LONG[:3]) and {x.error for x in got} <= {"bad", "bad2"}


def test_unknown_task_and_resume(spark, seeds):
    got = tasks.task("other")(seeds.select("index", "text"), tasks.Options(Stub(lambda p: p.upper()), "x {text}"))
    assert {x.response for x in got.collect()} == {"X " + t.upper() for t in LONG}
    done = spark.createDataFrame([(1,)], "index long")
    assert sorted(x["index"] for x in tasks.resumed(seeds, done, 1, 2).collect()) == [2, 3]


def test_failures_harm_no_other_row(spark):
    def client(messages, max_tokens, temperature):
        text = messages[-1]["content"]
        if text == "boom":
            raise ValueError("no")
        return Answer(text, "length" if text == "long" else "stop")

    df = spark.createDataFrame([("ok",), ("boom",), ("long",)], "t string").withColumn("talk", F.array(F.struct(F.lit("user").alias("role"), F.col("t").alias("content"))))
    got = {x.t: (x.response, x.error) for x in ask(df, "talk", client).collect()}
    assert got == {"ok": ("ok", None), "boom": (None, "ValueError: no"), "long": (None, "finished by length")}
    assert {x.t: x.llm_verification for x in judged(df.select("t"), F.col("t"), Stub(lambda p: "<VALID>True</VALID>" if p == "ok" else "<VALID> true</VALID>")).collect()} == {"ok": True, "boom": False, "long": False}


def test_retry():
    calls, waits = [], []

    def client(*a):
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return Answer("x")

    assert Retry(client, sleep=waits.append)([], 1, 0.0).text == "x"
    assert len(waits) == 2 and 60 <= waits[0] <= 120 and waits[1] >= 2 * waits[0]


def test_command(spark):
    df = spark.createDataFrame([("print(5)",), ("import time; time.sleep(9)",), (None,)], "code string")
    run = Command(((sys.executable, "a.py"),), timeout=3)
    got = {x.code: (x.stdout, x.timed_out) for x in executed(df, {"a.py": "code"}, run).collect()}
    assert got["print(5)"] == ("5\n", False) and got["import time; time.sleep(9)"][1] is True and got[None] == (None, None)


def test_mining(spark):
    rows = [(i, "e", "human", i % 2, f"t{i % 3}", "p", f"completion number {i} " + LONG[i % 3], False) for i in range(18)]
    df = spark.createDataFrame(rows, "row_id long, exp string, benchmark string, step int, task_id string, prompt string, completion string, passed boolean")
    ref = spark.createDataFrame([(f"t{i}", "human", "right") for i in range(3)], "task_id string, benchmark string, correct string")
    got = tasks.mine_errors(df, ref, Stub(lambda p: "<REASON>r</REASON>"), target=2, rounds=2).collect()
    assert sorted(x.task_id for x in got) == ["t0", "t0", "t1", "t1", "t2", "t2"] and {x.difficulty for x in got} == {"hard"}


def test_answers_get_what_the_context_leaves(spark, seeds):
    """Each row's budget goes with its call; a prompt that leaves none is kept with its reason, and isn't asked."""
    asked = []

    def client(messages, max_tokens, temperature):
        return Answer(f"{max_tokens}")

    o = tasks.Options(client, "{text}", system=None, context=25, max_new=9)
    got = {x["index"]: (x.response, x.error) for x in tasks.prompted(seeds.select("index", "text"), o, text="text").collect()}
    size = {i: len(LONG[k].split()) for i, k in ((0, 0), (1, 1), (2, 0), (3, 3), (4, 2))}
    assert {i: r for i, (r, _) in got.items()} == {i: str(min(9, 25 - 10 - n)) for i, n in size.items()}
    none = tasks.prompted(seeds.select("index", "text"), replace(o, context=12), text="text").collect()
    assert len(none) == 5 and all(x.response is None and x.error == "prompt leaves no room for an answer" for x in none)
    assert tasks.base(seeds.select("index", "text"), replace(o, context=12)).count() == 0 and not asked


def test_self_repair(spark):
    rows = [(1, "t1", "bad", "because"), (2, "t1", "worse", "mute"), (3, "t2", "bad", "because")]
    reports = spark.createDataFrame(rows, "row_id long, task_id string, completion string, reason string")
    tests = spark.createDataFrame([("t1", "good"), ("t2", "other")], "task_id string, test string")

    def client(messages, max_tokens, temperature):
        if "mute" in messages[-1]["content"]:
            raise ValueError("no answer")
        return Answer("<SOLUTION>```verilog\ngood```</SOLUTION>")

    def runner(files):
        same = files["design.v"] == files["test.v"]
        return Run("Mismatches: 0 in 5 samples" if same else "Mismatches: 2 in 5 samples", "")

    got = {x.row_id: x for x in tasks.self_repaired(reports, client, runner, tests).collect()}
    assert got[1].passed and got[1].repaired == "good" and got[1].feedback.verdict == "passed"
    assert not got[2].passed and got[2].feedback is None
    assert not got[3].passed and got[3].feedback.verdict == "failed: 2 out of 5 samples."


def test_totals(spark):
    before = spark.createDataFrame([("a", True), ("a", None), ("b", False)], "t string, passed boolean")
    after = before.where("t = 'a' AND passed")
    assert {tuple(x) for x in report.totals(before, after, ["t"]).collect()} == {("a", 2, 1), ("b", 1, 0)}
    assert {tuple(x) for x in report.passed_of(before, ["t"]).collect()} == {("a", 1, 2), ("b", 0, 1)}


def test_first_completions_and_final_reports(spark):
    rows = [(2, "t", "c", True), (1, "t", "c", False), (3, "t", "d", True)]
    df = spark.createDataFrame(rows, "id long, task_id string, completion string, passed boolean")
    assert sorted(x.id for x in report.first_completions(df, ["id"]).collect()) == [1, 3]
    assert {x.id: x.completion_id for x in report.completion_ids(df, ["id"]).collect()} == {1: 0, 2: 1, 3: 2}
    reports = df.selectExpr("*", "'b' AS benchmark", "'right' AS correct", "'e' AS exp", "'hard' AS difficulty", "'why' AS reason")
    told = spark.createDataFrame([("t", "b", "described", "module m();")], "task_id string, benchmark string, detail_description string, header string")
    got = report.final_reports(reports, told, told, checked=True).collect()
    assert {(x.problem, x.error, x.correct) for x in got} == {("described", "module m();c", "module m();right"), ("described", "module m();d", "module m();right")}


def test_evaluated_rows_are_not_moved(spark, seeds, bench):
    """Each stage's rows go on to the next, asked or not: texts are neither joined nor parsed again."""

    def runner(files):
        return Run("", "error" if "registers" in files["design.v"] else "")

    o = tasks.Options(Stub(told), "INPUT:{problem}", runner=runner, judge=Stub(lambda p: f"<VALID>{'quick' in p}</VALID>"), reward=Stub(lambda p: "helpful:2.5"))
    got = tasks.code_reason_generate(seeds, bench, o)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "instr" not in plan and "MapInArrow" not in plan
    assert got.count() == 3
    # columns that stages use for their answers are kept, and equal indices aren't multiplied
    rows = spark.createDataFrame([(1, "in", "quick", "r", "e"), (1, "in", "registers", "s", None)], "index long, input string, response string, kept string, error string")
    out = {x.response: x for x in tasks.evaluated(rows, o, "response").collect()}
    assert {k: (x.kept, x.error, x.iverilog_compiler_passed, x.llm_verification, x.rewards) for k, x in out.items()} == {"quick": ("r", "e", True, True, {"helpful": 2.5}), "registers": ("s", None, False, None, None)}


def test_rows_without_messages_are_not_asked(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",)], "t string").withColumn("talk", F.when(F.col("t") == "a", F.array(F.struct(F.lit("user").alias("role"), F.col("t").alias("content")))))
    for log in (None, f"file://{tmp_path}/log"):
        got = ask(df, "talk", Stub(lambda p: p + "!"), log=log, drop=("talk",), then=lambda x: x.withColumn("n", F.length("response")))
        assert got.columns == ["t", "response", "error", "n"]
        assert {tuple(x) for x in got.collect()} == {("a", "a!", None, 2), ("b", None, None, None)}


def test_seeds_are_dealt_out(spark, tmp_path):
    """One file of one row group is work for all cores."""
    from quernel import queries

    spark.range(100).selectExpr("id AS doc_id", "'text' AS text", "'web' AS source").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    seeds = queries._seeds(spark, str(tmp_path)).select("index", "problem")
    assert seeds.count() == 100 and seeds.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_one_table_of_texts_is_left(spark, seeds, bench):
    """Each stage writes all rows, so the tables before it go; the task's own input and others' tables stay."""
    from pathlib import Path

    from quernel.store import discard, saved, shared_dir

    def tables():
        return {x for x in Path(shared_dir(spark).removeprefix("file://"), "quernel", spark.sparkContext.applicationId).glob("*") if x.name.endswith(("-answers", "-runs", "-own"))}

    own, before = saved(seeds, "own"), tables()
    o = tasks.Options(Stub(told), "INPUT:{problem}", runner=lambda files: Run("", ""), judge=Stub(lambda p: "<VALID>True</VALID>"), reward=Stub(lambda p: "helpful:1"))
    for some, name in ((o, "answers"), (replace(o, reward=None), "answers"), (replace(o, reward=None, judge=None), "runs"), (replace(o, reward=None, judge=None, runner=None), "answers")):
        got = tasks.code_reason_generate(own, bench, some)
        new = tables() - before
        assert len(new) == 1 and new.pop().name.endswith(name)
        assert {x["index"] for x in got.collect()} == {0, 1, 4} == {x["index"] for x in got.collect()}
        before = tables()
    assert own.count() == 5
    discard(own)
    assert len(before - tables()) == 1

"""What a stage that asks a model or runs code holds at once is bounded in bytes, also where nothing ran before it."""

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from quernel.operators import answers, models
from quernel.operators.models import Run, Stub, ask, chat, executed
from quernel.plans import tasks

MOST = 8 << 20


class Watched(ThreadPoolExecutor):
    """Refuses a batch of more than MOST characters of messages."""

    def map(self, call, *columns):
        own = [list(c) for c in columns]
        talks = next(c for c in own if not isinstance(c[0], (int, str)))
        held = sum(len(m["content"]) for t in talks for m in t)
        if held > MOST:
            raise ValueError(f"{held} characters at once")
        return super().map(call, *own)


def rows(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    long = F.concat(F.repeat(F.lit("x"), 300_000), F.col("id").cast("string"))
    return spark.range(60).coalesce(1).select(F.col("id").alias("index"), long.alias("input")).withColumn("talk", chat(None, F.col("input")))


def test_asked_in_bounded_batches(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(models, "ThreadPoolExecutor", Watched)
    monkeypatch.setattr(answers, "ThreadPoolExecutor", Watched)
    for log in (None, f"file://{tmp_path}/log"):
        got = ask(rows(spark), "talk", Stub(lambda p: p[299_990:]), log=log).select("index", "input", "response", "error").collect()
        assert {x["index"]: x.response for x in got} == {i: "x" * 10 + str(i) for i in range(60)}
        assert all(x.error is None and x.input == "x" * 300_000 + str(x["index"]) for x in got)


def test_run_in_bounded_batches(spark):
    got = executed(rows(spark).drop("talk"), {"a.v": "input"}, lambda files: Run(files["a.v"][-3:], "")).collect()
    assert {x["index"]: (x.stdout, x.stderr, x.timed_out) for x in got} == {i: (f"xxx{i}"[-3:], "", False) for i in range(60)}


def _solved(prompt):
    return f"<SOLUTION>{prompt.rpartition('INPUT:')[2]}</SOLUTION><REASON>why</REASON>"


def _sure(prompt):
    return f"<VALID>{int(prompt[-1]) % 2 == 0}</VALID><REASON>{prompt[-1]}</REASON>"


def test_solution_task_in_bounded_batches(spark, monkeypatch):
    """Model, judge and reward each see all of their rows, 8 MB of distinct texts in one task, in batches of their own."""
    monkeypatch.setattr(models, "ThreadPoolExecutor", Watched)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    own = F.col("id") % 28  # rows 28 and 29 are copies of 0 and 1
    words = F.transform(F.sequence(F.lit(1), F.lit(4600)), lambda k: F.sha2(F.concat_ws("|", own, k).cast("binary"), 256))
    text = F.concat(F.array_join(words, " "), F.lit(" "), (own % 10).cast("string"))
    seeds = spark.range(30).coalesce(1).select(F.col("id").alias("index"), text.alias("problem"))
    bench = spark.createDataFrame([("a text of the benchmark", "and its solution")], "detail_description string, canonical_solution string")
    o = tasks.Options(Stub(_solved), "INPUT:{problem}", context=1 << 20, judge=Stub(_sure), reward=Stub(lambda p: f"helpful:{p[-1]}"))
    got = tasks.code_reason_generate(seeds, bench, o)
    assert got.where("input <> output or raw <> concat('<SOLUTION>', input, '</SOLUTION><REASON>why</REASON>')").count() == 0
    rows = {x["index"]: x for x in got.select("index", F.length("output").alias("n"), "reasoning", "llm_verification", "llm_reason", "rewards").collect()}
    assert set(rows) == set(range(28)) and {x.n for x in rows.values()} == {4600 * 65 + 1}
    for i, x in rows.items():
        assert (x.reasoning, x.llm_verification, x.llm_reason) == ("why", i % 2 == 0, str(i % 10))
        assert x.rewards == ({"helpful": float(i % 10)} if i % 2 == 0 else None)

"""The generation tasks, each a chain of DataFrame stages: prompt, ask, parse, remove overlap, evaluate.

Every task takes a seed table with a whole-number column ``index`` and gives its records. Model, judge and
compiler are arguments; stubs serve offline.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions import text as X
from quernel.operators.dedup import near_dedup
from quernel.operators.models import Client, Runner, ask, chat, executed, judged, scored, tested
from quernel.operators.order import cyclic, first_rows, numbered, quota, remaining, seeded_key, short_enough
from quernel.operators.report import accepted, distinct_trajectories, trajectories, trajectory_bands
from quernel.store import discard, free_name, saved


@dataclass(frozen=True)
class Options:
    """What tasks are run with; names say what each is."""

    client: Client
    template: str
    system: str | None = "Follow the form that is asked for."
    engine: str = "stub"
    context: int = 16_384
    max_new: int = 1024
    temperature: float = 0.0
    attempts: int = 1
    seed: int = 976
    threshold: float = 0.7
    judge: Client | None = None
    reward: Client | None = None
    runner: Runner | None = None
    compat: bool = False
    tokenizer: X.Tokenizer | None = None
    log: str | None = None


def reference_texts(benchmark: DataFrame, solutions: bool = True) -> DataFrame:
    """Descriptions, and solutions if asked, as texts to keep away from; rows with a null in either are left out."""
    both = benchmark.select("detail_description", "canonical_solution").na.drop("any")
    columns = ["detail_description", "canonical_solution"] if solutions else ["detail_description"]
    return both.select(F.explode(F.array(*columns)).alias("text"))


def prompted(df: DataFrame, o: Options, then: Callable[[DataFrame], DataFrame] | None = None, /, **values: Column | str) -> DataFrame:
    """All rows with ``response`` and ``error``: the template filled in, and asked of the model for as many tokens as
    its context leaves. A prompt that leaves none isn't asked, and ``error`` says so. ``then`` parses the answers: what it
    adds is written with them, so that answers are gone through once."""
    prompt, most, talk = (free_name(df, x) for x in ("its_prompt", "its_most", "its_talk"))
    rows = df.withColumn(prompt, X.formatted(o.template, **values))
    budget = X.token_budget(X.token_count(prompt, o.tokenizer), o.max_new, o.context)
    if o.tokenizer is None:  # a text has no more words and signs than characters, so a short one isn't counted
        short = X.token_budget(F.length(prompt), o.max_new, o.context) == o.max_new
        budget = F.when(short & F.col(prompt).isNotNull(), F.lit(o.max_new)).otherwise(budget)
    rows = rows.withColumn(most, F.coalesce(budget, F.lit(0))).withColumn(talk, chat(o.system, F.col(prompt))).drop(prompt)
    return ask(rows, talk, o.client, o.engine, most, o.temperature, o.attempts, log=o.log, drop=(talk, most), then=then)


def tagged_or_fenced(df: DataFrame) -> DataFrame:
    """Answered rows with ``problem``: the tagged one, else the first fenced block, else the answer."""
    return df.withColumn("problem", F.coalesce(X.tagged("response", "PROBLEM"), X.fenced("response")))


def emitted(df: DataFrame, result: str, allow_empty: bool = True) -> DataFrame:
    """Rows with a result; an empty one counts where ``allow_empty``."""
    return df.where(F.col(result).isNotNull() if allow_empty else F.length(result) > 0)


def decontaminated(df: DataFrame, o: Options, fields: list[str], reference: DataFrame) -> DataFrame:
    """Over all rows at once: none near a reference text or near a row of smaller index that stays."""
    return near_dedup(df, fields, "index", reference, o.threshold)


def evaluated(df: DataFrame, o: Options, code: str = "output", source: DataFrame | None = None) -> DataFrame:
    """Compile, then ask the judge, then score, each only for what passed before; all rows stay.

    Adds iverilog_compiler_passed, iverilog_compiler_log, llm_verification, llm_reason and rewards, null where a
    stage wasn't run. Each stage writes all rows, so the table before it is deleted; that goes for ``source`` too, the
    saved table that the rows are read from, if the caller has no more use for it.
    """
    # all rows go on, each asked or not, so none is moved; columns that the stages would replace wait under other names
    held = {c: free_name(df, f"its_{c}") for c in df.columns if c in ("response", "error")}
    out, code = df.withColumnsRenamed(held), held.get(code, code)
    if o.runner is not None:
        ran = executed(out, {"design.v": code}, o.runner)
        discard(source)
        source = ran
        log = F.concat_ws("\n", "stdout", "stderr")
        out = ran.withColumn("iverilog_compiler_log", log).withColumn("iverilog_compiler_passed", X.compiles("iverilog_compiler_log")).drop("stdout", "stderr", "timed_out")
    else:
        out = out.withColumn("iverilog_compiler_log", F.lit(None).cast("string")).withColumn("iverilog_compiler_passed", F.lit(None).cast("boolean"))
    sure = F.coalesce("iverilog_compiler_passed", F.lit(True))
    if o.judge is not None:
        asked = F.concat(F.lit("Is this answer right? Say True or False in VALID tags, and why in REASON tags.\n"), F.col("input"), F.lit("\n"), F.col(code))
        out = judged(out, asked, o.judge, where=sure, engine=o.engine)
        discard(source)
        source = out
        sure = sure & F.coalesce("llm_verification", F.lit(True))
    else:
        out = out.withColumn("llm_verification", F.lit(None).cast("boolean")).withColumn("llm_reason", F.lit(None).cast("string"))
    if o.reward is not None:
        talk = free_name(out, "its_talk")
        asked = F.when(sure, chat(None, F.concat("input", F.lit("\n"), F.col(code))))
        out = ask(out.withColumn(talk, asked), talk, o.reward, drop=(talk,), then=lambda x: scored(x, "response").drop("response", "error"))
        discard(source)
    else:
        out = out.withColumn("rewards", F.lit(None).cast("map<string,double>"))
    own = [F.col(held.get(c, c)).alias(c) for c in df.columns]
    return out.select(*own, "iverilog_compiler_passed", "iverilog_compiler_log", "llm_verification", "llm_reason", "rewards")


def instruct_generate_large(seeds: DataFrame, pool: DataFrame, benchmark: DataFrame, o: Options) -> DataFrame:
    """index, seed, problem, raw: new problems after examples of the pool (column ``text``), taken in turn."""
    ready = few_shot(pool, "text", o)
    drawn = cyclic(seeds.select("index"), ready)
    got = prompted(drawn, o, lambda x: x.withColumn("problem", X.problem("response", compat=o.compat)), icl_problem="text")
    rows = emitted(got, "problem")
    return decontaminated(rows, o, ["problem"], reference_texts(benchmark, False)).select("index", F.col("text").alias("seed"), "problem", F.col("response").alias("raw"))


def oss_generate_large(seeds: DataFrame, benchmark: DataFrame, o: Options) -> DataFrame:
    """index, oss_input, problem, raw: problems after a piece of code (column ``input``)."""
    got = prompted(seeds.select("index", "input"), o, tagged_or_fenced, code="input")
    rows = emitted(got, "problem")
    return decontaminated(rows, o, ["problem"], reference_texts(benchmark)).select("index", F.col("input").alias("oss_input"), "problem", F.col("response").alias("raw"))


def instruct_generate_wiki(seeds: DataFrame, benchmark: DataFrame, o: Options) -> DataFrame:
    """index, title, problem, raw: problems about an entity: its title, or by a coin its title and text."""
    coin = F.substring(seeded_key(o.seed, "index"), 1, 1) < "8"
    entity = F.when(coin, F.col("title")).otherwise(F.concat(F.lit("***"), F.col("title"), F.lit("***\n"), F.col("text")))
    got = prompted(seeds.select("index", "title", "text"), o, tagged_or_fenced, entity=entity)
    rows = emitted(got, "problem")
    return decontaminated(rows, o, ["problem"], reference_texts(benchmark, False)).select("index", "title", "problem", F.col("response").alias("raw"))


def code_reason_generate(seeds: DataFrame, benchmark: DataFrame, o: Options) -> DataFrame:
    """index, input, output, reasoning, raw and the columns of ``evaluated``: solutions to problems."""
    solution, reason = X.solution_and_reason("response", o.compat)
    parsed = lambda x: x.withColumn("output", solution).withColumn("reasoning", reason).withColumn("output", X.fenced("output"))
    got = prompted(seeds.select("index", "problem"), o, parsed, problem="problem")
    clean = decontaminated(emitted(got, "output"), o, ["output"], reference_texts(benchmark))
    return evaluated(clean.select("index", F.col("problem").alias("input"), "output", "reasoning", F.col("response").alias("raw")), o, source=got)


def code_reason_oss(seeds: DataFrame, benchmark: DataFrame, o: Options) -> DataFrame:
    """input, output and the columns of ``evaluated``: solutions beside reference code (column ``oss_input``);
    overlap is looked for before the code is taken out of its fence."""
    solution, _ = X.lenient_solution_and_reason("response")
    got = prompted(seeds.select("index", "problem", "oss_input"), o, lambda x: x.withColumn("output", solution), reference_code="oss_input", problem="problem")
    rows = emitted(got, "output")
    clean = decontaminated(rows, o, ["output"], reference_texts(benchmark)).withColumn("output", X.fenced("output"))
    return evaluated(clean.select("index", F.col("problem").alias("input"), "output"), o, source=got).drop("index")


def oss_repair(seeds: DataFrame, reports: DataFrame, benchmark: DataFrame, o: Options) -> DataFrame:
    """index, input (the repair task), output (the code as it was), error, correct, reason, task_id."""
    pool = numbered(reports.select("error", "correct", "reason", "task_id"), [], [seeded_key(87, "task_id", "error"), F.col("task_id"), F.col("error")], "i")
    drawn = cyclic(seeds.select("index", F.col("input").alias("code")), pool)
    parsed = lambda x: x.withColumn("problem", X.problem("response", compat=o.compat))
    rows = emitted(prompted(drawn.withColumnRenamed("error", "shown"), o, parsed, icl_error="shown", icl_reason="reason", icl_correct="correct", code="code"), "problem")
    clean = decontaminated(rows, o, ["problem"], reference_texts(benchmark))
    return clean.select("index", F.col("problem").alias("input"), F.col("code").alias("output"), F.col("shown").alias("error"), "correct", "reason", "task_id")


def few_shot(pool: DataFrame, text: str, o: Options, limits: dict[str, int] | None = None) -> DataFrame:
    """A pool in its seeded order: i, and its columns; rows over their length limits are left out first."""
    rows = pool.where(short_enough(limits)) if limits else pool
    return numbered(rows, [], [seeded_key(87, text), F.col(text)], "i")


def base(seeds: DataFrame, o: Options) -> DataFrame:
    """index, prompt column and response: a task of no known name."""
    return emitted(prompted(seeds, o, **{n: n for n in X.placeholders(o.template)}), "response", allow_empty=False)


TASKS: dict[str, Callable[..., DataFrame]] = {
    "instruct_generate_large": instruct_generate_large,
    "oss_generate_large": oss_generate_large,
    "instruct_generate_wiki": instruct_generate_wiki,
    "code_reason_generate": code_reason_generate,
    "code_reason_oss": code_reason_oss,
    "oss_repair": oss_repair,
}


def task(name: str) -> Callable[..., DataFrame]:
    return TASKS.get(name, base)


def resumed(seeds: DataFrame, done: DataFrame | None, start: int = 0, most: int | None = None) -> DataFrame:
    """Rows from ``start`` on whose index isn't done yet, ``most`` of them at most, lowest first."""
    rows = seeds.where(F.col("index") >= start)
    rows = rows if done is None else remaining(rows, done, "index")
    return rows if most is None else first_rows(rows, ["index"], most)


def self_repaired(reports: DataFrame, client: Client, runner: Runner, tests: DataFrame, engine: str = "stub", temperature: float = 0.0) -> DataFrame:
    """Reports with ``repaired`` (the code that the model makes of the failed one and the report's reason), and with
    ``passed`` and ``feedback`` of its test. Without an answer there is no code, and nothing passed.

    ``tests``: task_id, test.
    """
    asked = F.concat(F.lit("Mend this code; give the whole module in SOLUTION tags.\n"), F.col("completion"), F.lit("\n\nWhat is wrong:\n"), F.col("reason"))
    talk = free_name(reports, "its_talk")
    told = ask(reports.drop("response", "error").withColumn(talk, chat(None, asked)), talk, client, engine, temperature=temperature).drop(talk, "error")
    solution, _ = X.lenient_solution_and_reason("response")
    code = told.withColumn("repaired", X.fenced(F.coalesce(solution, F.col("response")))).drop("response")
    ran = tested(code.join(tests.select("task_id", "test"), "task_id", "left"), {"design.v": "repaired", "test.v": "test"}, runner)
    return ran.withColumn("passed", F.coalesce("passed", F.lit(False))).drop("test")


def mine_errors(results: DataFrame, reference: DataFrame, client: Client, target: int, rounds: int = 3, runner: Callable[[DataFrame], DataFrame] | None = None, seed: int = 0) -> DataFrame:
    """Reports on failed completions, up to ``target`` for each task.

    Each round takes one failed completion of each low-passing group, drops near copies, takes up to ten more of
    each task, asks for the reason, and, if ``runner`` is given, keeps those whose repaired code passes: it gets
    the reports and adds ``passed``, as self_repaired() does.
    """
    out = signed = seen = None
    for turn in range(rounds):
        found = saved(trajectories(results, reference, seed + turn), "trajectories")
        # only what no earlier round has drawn is signed
        new = found if seen is None else remaining(found, seen, "row_id")
        bands = saved(trajectory_bands(new, "row_id"), "bands")
        signed = bands if signed is None else signed.unionByName(bands)
        seen = found.select("row_id") if seen is None else seen.unionByName(new.select("row_id"))
        found = distinct_trajectories(found, "row_id", signed)
        if out is not None:
            found = remaining(found, out, "row_id")
        have = (out if out is not None else found.limit(0)).groupBy("task_id").agg(F.count("*").alias("n"))
        batch = quota(found, have, "task_id", target, [seeded_key(seed + turn, "row_id"), F.col("row_id")])
        asked = F.concat(F.lit("Say in REASON tags why the first is wrong, and give the second's idea.\n"), F.col("completion"), F.lit("\n\n"), F.col("correct"))
        talk = free_name(batch, "its_talk")
        told = ask(batch.withColumn(talk, chat(None, asked)), talk, client, temperature=0.8).drop(talk)
        told = told.withColumn("reason", X.tagged("response", "REASON")).where("reason is not null")
        told = runner(told) if runner is not None else told.withColumn("passed", F.lit(True))
        out = told if out is None else out.unionByName(told)
    return accepted(out, target, "row_id")


def read_template(spark: SparkSession, path: str) -> str:
    """A template, or a test bench: the whole file, from any file system that Spark reads."""
    return spark.read.text(path, wholetext=True).first()[0]

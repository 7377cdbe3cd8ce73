"""Pass rates, difficulty tiers, and the mining of errors to report on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.operators.dedup import banded, field_texts, greedy
from quernel.operators.order import first_of_each, keep_first, numbered, quota, seeded_key
from quernel.store import free_name, hinted, looked, saved


def pass_rate(df: DataFrame, by: list[str], passed: str = "passed") -> DataFrame:
    """Mean of ``passed`` by group; nulls count neither way."""
    return df.groupBy(*by).agg(F.avg(F.col(passed).cast("int")).alias("pass_rate"), F.count("*").alias("n"))


def tier(rate: Column) -> Column:
    """easy over 0.9, hard under 0.2, else soso (both limits too, and an unknown rate)."""
    return F.when(rate > 0.9, F.lit("easy")).when(rate < 0.2, F.lit("hard")).otherwise(F.lit("soso"))


def tiers(df: DataFrame, by: list[str], passed: str = "passed") -> DataFrame:
    return pass_rate(df, by, passed).withColumn("difficulty", tier(F.col("pass_rate")))


def low_groups(df: DataFrame, by: list[str], below: float = 0.2, passed: str = "passed") -> DataFrame:
    return pass_rate(df, by, passed).where(F.col("pass_rate") < below)


def looked_up(df: DataFrame, reference: DataFrame, on: list[str], values: list[str], strict: bool = True) -> DataFrame:
    """Values of the reference (a row for each key) by key; with ``strict`` a key that it lacks fails the job, else gives
    nulls. Columns of the values' names are replaced."""
    return all_looked_up(df, [(reference, values)], on, strict)


def all_looked_up(df: DataFrame, references: list[tuple[DataFrame, list[str]]], on: list[str], strict: bool = True) -> DataFrame:
    """looked_up() in several references of one key, each with its own values. The references are joined with one another
    first, so ``df`` is moved once however many there are."""
    flags, told = [], None
    for i, (reference, values) in enumerate(references):
        flags.append(free_name(df, free_name(reference, f"its_found{i}")))
        own = reference.select(*on, *values, F.lit(True).alias(flags[-1]))
        told = own if told is None else told.join(own, on, "full")
    found = looked(df, told if len(references) == 1 else saved(told, "references"), on)
    for flag, (_, values) in zip(flags, references, strict=True):
        if strict:
            missing = F.raise_error(F.concat(F.lit("no reference for "), F.concat_ws(", ", *on)))
            found = found.withColumn(values[0], F.when(F.col(flag).isNull(), missing.cast(found.schema[values[0]].dataType)).otherwise(F.col(values[0])))
    return found.drop(*flags)


def first_completions(df: DataFrame, order: list[str], keys: tuple[str, ...] = ("task_id", "completion")) -> DataFrame:
    """Of equal completions of a task the first in a stated order, over all experiments, steps and benchmarks."""
    return keep_first(df, list(keys), order)


def completion_ids(df: DataFrame, order: list[str]) -> DataFrame:
    """Completions of a task numbered from 0."""
    return numbered(df, ["task_id"], order, "completion_id")


def trajectories(results: DataFrame, reference: DataFrame, seed: int = 0) -> DataFrame:
    """One failed completion of each (exp, benchmark, task, step) that passes less than a fifth of the time, beside
    the reference solution and the task's tier in its experiment and benchmark.

    ``results``: row_id, exp, benchmark, step, task_id, prompt, completion, passed. ``reference``: task_id,
    benchmark, correct.

    The results are read and moved once: a task of Spark sends on the sums and the one row that it would choose of each
    group, so a hot group is as many rows as there are tasks. Tiers are sums of the groups' sums. A null in ``passed``
    counts neither way; a group with a null in its key gives no row, but its results count for the tier.
    """
    task, row = ["exp", "benchmark", "task_id"], "row_id"
    rest = [c for c in results.columns if c not in (*task, "step", "difficulty")]
    k, n, got, draw = (free_name(results, x) for x in ("its_k", "its_n", "its_row", "its_draw"))
    failed = ~F.col("passed")
    slim = results.select(
        *task, "step", "passed", F.when(failed, F.struct(*[F.col(f"`{c}`") for c in rest])).alias(got),
        F.when(failed, F.struct(seeded_key(seed, row).alias("draw"), F.col(row).alias("at"))).alias(draw),
    )
    groups = slim.groupBy(*task, "step").agg(F.count_if("passed").alias(k), F.count("passed").alias(n), F.min_by(got, draw).alias(got))
    low = groups.withColumn(got, F.when(F.try_divide(k, n) < 0.2, F.col(got)))
    whole = Window.partitionBy(*task)
    graded = low.withColumn("difficulty", tier(F.try_divide(F.sum(k).over(whole), F.sum(n).over(whole))))
    some = graded.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*task, "step", got)]))
    chosen = some.select(*task, "step", *[F.col(f"{got}.`{c}`").alias(c) for c in rest], "difficulty")
    return looked_up(chosen, reference, ["task_id", "benchmark"], ["correct"])


def trajectory_bands(found: DataFrame, order: str) -> DataFrame:
    """What distinct_trajectories() compares (error, correct) by: bands within each task, at threshold 0.9."""
    both = free_name(found, "both")
    text = F.concat(F.col("completion"), F.lit("\n\n"), F.col("correct"))
    return banded(field_texts(found.withColumn(both, text), [both], order, "task_id"), 0.9)


def distinct_trajectories(found: DataFrame, order: str, signed: DataFrame | None = None) -> DataFrame:
    """Near copies of a task's (error, correct) go, at threshold 0.9, the first staying. ``signed``: the bands of these
    rows, and of others, if they are known already."""
    node = free_name(found, "its_node")
    bands = trajectory_bands(found, order) if signed is None else looked(signed, found.select(F.col(order).cast("long").alias("node")).distinct(), ["node"], "left_semi")
    bare = found.where(F.col("completion").isNull() | F.col("correct").isNull()).select(F.col(order).cast("long").alias("node"))
    stay = saved(greedy(bands).unionByName(bare).select(F.col("node").alias(node)), "stay")
    return found.join(hinted(stay), F.col(order).cast("long") == F.col(node), "left_semi")


def steps(results: DataFrame) -> DataFrame:
    """(exp, steps): the distinct steps of each experiment, ascending; rows without a step count for none."""
    return results.groupBy("exp").agg(F.array_sort(F.collect_set("step")).alias("steps"))


def totals(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """Rows before and after a stage, by group; a group that lost all has 0."""
    kept = free_name(before.select(*by), "kept")
    both = before.select(*by, F.lit(0).alias(kept)).unionByName(after.select(*by, F.lit(1).alias(kept)))
    return both.groupBy(*by).agg(F.count_if(F.col(kept) == 0).alias("n_before"), F.count_if(F.col(kept) == 1).alias("n_after"))


def marked_totals(marked: DataFrame, by: list[str], mark: str) -> DataFrame:
    """The same of one table of all rows, which says of each whether it stayed."""
    return marked.groupBy(*by).agg(F.count("*").alias("n_before"), F.count_if(F.col(mark)).alias("n_after"))


def passed_of(df: DataFrame, by: list[str], passed: str = "passed") -> DataFrame:
    """How many passed, of how many; a null hasn't passed."""
    return df.groupBy(*by).agg(F.count_if(F.coalesce(F.col(passed), F.lit(False))).alias("k"), F.count("*").alias("n"))


def next_batch(found: DataFrame, have: DataFrame, target: int, seed: int, order: str) -> DataFrame:
    """Of each task up to ten more trajectories, no more than it lacks of its target."""
    return quota(found, have, "task_id", target, [seeded_key(seed, order), F.col(order)])


def accepted(reports: DataFrame, target: int, order: str) -> DataFrame:
    """Reports whose repair passed, up to the target of each task."""
    turn = free_name(reports, "its_turn")
    return first_of_each(reports.where("passed"), ["task_id"], [F.col(order)], target, turn).drop(turn)


def final_reports(reports: DataFrame, descriptions: DataFrame, headers: DataFrame, checked: bool = False) -> DataFrame:
    """The records to train on: description as problem, and error and solution under their module header.

    ``headers``: task_id, benchmark, header. ``checked`` keeps passed rows only.
    """
    rows = reports.where("passed") if checked else reports
    led = all_looked_up(rows, [(descriptions, ["detail_description"]), (headers, ["header"])], ["task_id", "benchmark"])
    return led.select(
        F.col("detail_description").alias("problem"), F.concat("header", "completion").alias("error"), F.concat("header", "correct").alias("correct"),
        "exp", "benchmark", "difficulty", "task_id", "reason", "passed",
    )


def by_report(reports: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Reports with their verdicts, by report_id: never by place."""
    return reports.drop("passed", "result").join(verdicts.select("report_id", "passed", "result"), "report_id", "left")


def ever(df: DataFrame, by: list[str], test: Column, name: str) -> DataFrame:
    """Whether any row of a group passes the test."""
    return df.groupBy(*by).agg(F.coalesce(F.bool_or(test), F.lit(False)).alias(name))

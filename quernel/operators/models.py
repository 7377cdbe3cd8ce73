"""Stages that ask a model, compile, or run code: any client or runner that can be pickled, called inside tasks.

Answers cost money or differ between calls, so each stage is written to the shared folder as soon as it has run.
"""

from __future__ import annotations

import contextlib
import os
import random
import resource
import signal
import subprocess
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions.text import compiles, rewards, tagged, unescaped, verdict
from quernel.operators.answers import logged
from quernel.store import beside, free_name, mapped, saved


@dataclass(frozen=True)
class Answer:
    text: str
    finish: str = "stop"


class Client(Protocol):
    def __call__(self, messages: list[dict[str, str]], max_tokens: int, temperature: float) -> Answer: ...


@dataclass(frozen=True)
class Stub:
    """Answers offline, the same for the same prompt: a function of the last message."""

    answer: Callable[[str], str]

    def __call__(self, messages: list[dict[str, str]], max_tokens: int, temperature: float) -> Answer:
        return Answer(self.answer(messages[-1]["content"]))


@dataclass(frozen=True)
class Retry:
    """Up to ``times`` more calls; the wait doubles, with jitter, before each."""

    client: Client
    times: int = 3
    first: float = 30.0
    growth: float = 2.0
    sleep: Callable[[float], None] = time.sleep

    def __call__(self, messages: list[dict[str, str]], max_tokens: int, temperature: float) -> Answer:
        wait = self.first
        for turn in range(self.times + 1):
            try:
                return self.client(messages, max_tokens, temperature)
            except Exception:
                if turn == self.times:
                    raise
                wait *= self.growth * (1 + random.random())
                self.sleep(wait)
        raise AssertionError


def chat(system: str | None, prompt: Column) -> Column:
    """[{role, content}] of an optional system message and the prompt."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(*([message("system", F.lit(system))] if system else []), message("user", prompt))


def ask(
    df: DataFrame, messages: str, client: Client, engine: str = "stub", max_tokens: int | str = 1024, temperature: float = 0.0, attempts: int = 1, threads: int = 8, log: str | None = None,
    drop: tuple[str, ...] = (), then: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """All rows with ``response`` and ``error``, saved: the answer, or null if it broke off or was refused.

    A row is asked up to ``attempts`` times until it has an answer; a call that raises leaves its message in
    ``error`` and harms no other row. ``max_tokens`` is a number, or the column that has each row's; a row that has
    none left isn't asked. A row without messages (null) isn't asked either, and has null in both. Columns of ``drop`` serve
    the request only: they aren't written. What ``then`` makes of the answered rows is what is written, once. Calls of a batch, which is bounded in bytes, run in a few threads inside the task. With ``log``, a folder that driver
    and executors share, answers are written there as they come, and what is there already isn't asked for again, be it
    by a task that is run once more or by another run; equal requests then have one answer.
    """

    def one(talk, most: int) -> tuple[str | None, str | None]:
        failure = None
        if talk is None:
            return None, None
        if most <= 0:
            return None, "prompt leaves no room for an answer"
        for _ in range(attempts):
            try:
                got = client([dict(m) for m in talk], most, temperature)
                if got.finish == "stop":
                    return got.text, None
                failure = f"finished by {got.finish}"
            except Exception as e:  # noqa: BLE001
                failure = f"{type(e).__name__}: {e}"
        return None, failure

    if log is not None:
        most = F.col(max_tokens) if isinstance(max_tokens, str) else F.lit(max_tokens)
        answered = logged(df, messages, most, one, log, engine, temperature, threads).drop(*drop)
        answered = answered.withColumn("response", unescaped("response", engine))
        return saved(then(answered), "answers", texts=True) if then else answered

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(threads) as pool:
            for b in batches:
                most = [int(x) for x in b[max_tokens].to_pylist()] if isinstance(max_tokens, str) else [max_tokens] * len(b)
                talks, got = b[messages].to_pylist(), [(None, None)] * len(b)
                some = [i for i, talk in enumerate(talks) if talk is not None]
                if some:
                    for i, answer in zip(some, pool.map(one, [talks[i] for i in some], [most[i] for i in some]), strict=True):
                        got[i] = answer
                yield beside(b.select(left), response=[g[0] for g in got], error=[g[1] for g in got])

    names = [c for c in df.columns if c not in ("response", "error")]
    left = [c for c in names if c not in drop]
    schema = df.select(*left).schema.add("response", "string").add("error", "string")
    answered = mapped(df.select(*names), run, schema).withColumn("response", unescaped("response", engine))
    return saved(then(answered) if then else answered, "answers", texts=True)


def judged(df: DataFrame, prompt: Column, client: Client, target: str = "True", tag: str = "VALID", where: Column | None = None, **options) -> DataFrame:
    """All rows with ``llm_verification`` (the tagged verdict equals ``target`` exactly; null without an answer) and
    ``llm_reason``. Rows for which ``where`` isn't true aren't asked, and have null in both."""
    talk = free_name(df, "its_talk")
    asked = chat(None, prompt) if where is None else F.when(where, chat(None, prompt))

    def told(rows: DataFrame) -> DataFrame:
        said = rows.withColumn("llm_verification", tagged("response", tag) == target)
        return said.withColumn("llm_reason", tagged("response", "REASON")).drop("response", "error")

    return ask(df.withColumn(talk, asked), talk, client, drop=(talk,), then=told, **options)


def scored(df: DataFrame, reply: str) -> DataFrame:
    """All rows with ``rewards``, the map of a reply of the form ``k:v,k:v``."""
    return df.withColumn("rewards", rewards(reply))


@dataclass(frozen=True)
class Run:
    out: str
    err: str
    timed_out: bool = False


class Runner(Protocol):
    def __call__(self, files: dict[str, str]) -> Run: ...


@dataclass(frozen=True)
class Limits:
    """What a child process may use, and all that it starts: seconds of CPU, bytes of memory and of a file, open files.
    None leaves a bound as it is."""

    cpu: int | None = 60
    memory: int | None = 4 << 30
    file: int | None = 256 << 20
    open_files: int | None = 256

    def held(self) -> dict[int, int | None]:
        return {resource.RLIMIT_CPU: self.cpu, resource.RLIMIT_AS: self.memory, resource.RLIMIT_FSIZE: self.file, resource.RLIMIT_NOFILE: self.open_files}


@dataclass(frozen=True)
class Command:
    """Runs commands over files in a folder of their own, in child processes, each up to ``timeout`` seconds.

    Each command leads a session of its own, under limits that its children inherit. When its time is over, or when it
    ends, the whole group is ended, so nothing that it started goes on. Of what it writes the last ``tail`` characters
    are kept.
    """

    commands: tuple[tuple[str, ...], ...]
    timeout: float = 20.0
    limits: Limits = Limits()
    tail: int = 1 << 20

    def _run(self, command: tuple[str, ...], folder: str) -> tuple[str, str, int, bool]:
        out, err = Path(folder, f".out-{uuid.uuid4().hex}"), Path(folder, f".err-{uuid.uuid4().hex}")
        with out.open("wb") as o, err.open("wb") as e:
            child = subprocess.Popen(command, cwd=folder, stdin=subprocess.DEVNULL, stdout=o, stderr=e, start_new_session=True)
            try:
                for kind, most in self.limits.held().items():
                    if most is not None:
                        with contextlib.suppress(ProcessLookupError):  # it is over already
                            resource.prlimit(child.pid, kind, (most, most))
                late = False
                try:
                    child.wait(self.timeout)
                except subprocess.TimeoutExpired:
                    late = True
            finally:
                with contextlib.suppress(ProcessLookupError, PermissionError):  # none of the group is left
                    os.killpg(child.pid, signal.SIGKILL)
                child.wait()
        said = [x.read_bytes()[-self.tail :].decode("utf-8", "replace") for x in (out, err)]
        out.unlink()
        err.unlink()
        return said[0], said[1], child.returncode, late

    def __call__(self, files: dict[str, str]) -> Run:
        out, err = [], []
        with tempfile.TemporaryDirectory() as folder:
            for name, text in files.items():
                Path(folder, name).write_text(text)
            for command in self.commands:
                try:
                    said, failed, code, late = self._run(command, folder)
                except OSError as e:
                    return Run("".join(out), str(e))
                out.append(said)
                err.append(failed)
                if late:
                    return Run("".join(out), "".join(err), True)
                if code:
                    break
        return Run("".join(out), "".join(err))


#: Compilers by name, over the files design.v and test.v. None is run unless a caller asks for it.
BACKENDS = {
    "iverilog": Command((("iverilog", "-g2012", "-o", "test.vvp", "test.v", "design.v"), ("vvp", "-n", "test.vvp"))),
    "quartus": Command((("quartus_map", "--analyze_file=design.v", "design"),), 30.0),
    "vcs": Command((("vcs", "-sverilog", "design.v", "test.v"), ("./simv",)), 20.0),
    "modelsim": Command((("vlib", "work"), ("vlog", "design.v", "test.v")), 10.0),
}


def executed(df: DataFrame, files: dict[str, str], runner: Runner) -> DataFrame:
    """All rows with stdout, stderr and timed_out of the runner over their files ({name: column}), saved.

    A row with a null file isn't run and has nulls. What the runner raises goes to stderr.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for row in zip(*[b[c].to_pylist() for c in files.values()], strict=True):
                if any(x is None for x in row):
                    got.append((None, None, None))
                    continue
                try:
                    r = runner(dict(zip(files, row, strict=True)))
                    got.append((r.out, r.err, r.timed_out))
                except Exception as e:  # noqa: BLE001
                    got.append(("", f"{type(e).__name__}: {e}", False))
            told = beside(b, stdout=[g[0] for g in got], stderr=[g[1] for g in got])
            yield told.append_column("timed_out", pa.array([g[2] for g in got], pa.bool_()))

    schema = df.select("*").schema.add("stdout", "string").add("stderr", "string").add("timed_out", "boolean")
    return saved(mapped(df, run, schema), "runs", texts=True)


def tested(df: DataFrame, files: dict[str, str], runner: Runner, rtllm: Column | bool = False, compile_only: bool = False) -> DataFrame:
    """All rows with ``passed`` and ``feedback``, a struct of the verdict, the log and whether time ran out.

    With ``compile_only`` what passes is what compiles. A row with a null file has null in both.
    """
    ran = executed(df, files, runner)
    said = F.when(compiles(F.concat_ws("\n", "stdout", "stderr")), F.lit("passed")).otherwise("failed: compile error.") if compile_only else verdict("stdout", "stderr", rtllm, F.col("timed_out"))
    feedback = F.struct(said.alias("verdict"), F.concat_ws("\n", "stdout", "stderr").alias("log"), F.col("timed_out"))
    out = ran.withColumn("feedback", F.when(F.col("timed_out").isNotNull(), feedback))
    return out.withColumn("passed", F.col("feedback.verdict") == "passed").drop("stdout", "stderr", "timed_out")

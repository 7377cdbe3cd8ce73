"""Finite-state machines, their texts and their circuits.

A small sampler gives each seed a machine whose states all are reached from the first; tables, next-state logic,
equations, waveforms and keys for exact comparison are column expressions over its edges.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.generators.logic import draw, ids
from quernel.store import looked, saved

SCHEMA = "id long, states int, edges array<struct<src:int,bit:int,dst:int,out:int>>, outs array<int>"


def sample(seed: str, states: int, out_values: int = 2) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """Edges (state, input, next, Mealy output) and Moore outputs.

    Each later state hangs on an earlier one with a free input; other inputs go anywhere but where the state's
    first input goes. Each output value occurs, in both lists.
    """
    r = random.Random(seed)
    goes: list[dict[int, int]] = [{} for _ in range(states)]
    for s in range(1, states):
        parent = r.choice([p for p in range(s) if len(goes[p]) < 2])
        goes[parent][r.choice([b for b in (0, 1) if b not in goes[parent]])] = s
    for own in goes:
        for b in (0, 1):
            if b not in own:
                own[b] = r.choice([s for s in range(states) if s not in own.values()])
    outs = [s % out_values for s in range(states)]
    r.shuffle(outs)
    signs = [i % 2 for i in range(2 * states)]
    r.shuffle(signs)
    return [(s, b, goes[s][b], signs[2 * s + b]) for s in range(states) for b in (0, 1)], outs


def machines(source: SparkSession | DataFrame, n: int | None = None, states: int = 4, seed: int | str = "1234", out_values: int = 2) -> DataFrame:
    """id, states, edges (sorted by state and input), outs: one machine a row, by seed and id alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i in b["id"]:
                edges, outs = sample(f"{seed}|{i}", states, out_values)
                rows.append((i, states, [dict(zip(("src", "bit", "dst", "out"), e, strict=True)) for e in edges], outs))
            yield pd.DataFrame(rows, columns=["id", "states", "edges", "outs"])

    return ids(source, n).mapInPandas(run, SCHEMA)


def name(state: Column) -> Column:
    return F.char(state + 65)


def graph_text(moore: bool = True) -> Column:
    """A line for each edge: ``A (1) --0--> B``, or ``A --0/1--> B``."""
    if moore:
        line = lambda e: F.concat(name(e.src), F.lit(" ("), F.col("outs")[e.src].cast("string"), F.lit(") --"), e.bit.cast("string"), F.lit("--> "), name(e.dst))
    else:
        line = lambda e: F.concat(name(e.src), F.lit(" --"), e.bit.cast("string"), F.lit("/"), e.out.cast("string"), F.lit("--> "), name(e.dst))
    return F.array_join(F.transform("edges", line), "\n")


def graph_key(moore: bool = True) -> Column:
    """The machine's lines in order: equal for equal graphs, whatever the case of letters of a table's head."""
    return F.array_join(F.array_sort(F.split(graph_text(moore), "\n")), "\n")


def _next(s: Column, bit: int) -> Column:
    return F.element_at("edges", s * 2 + bit + 1).getField("dst")


def state_table(code: bool = False, outputs: int = 1, lower: Column | None = None) -> Column:
    """State, next states for input 0 and 1, output (its bits, if it has several); states by letter or by binary code.
    The head is in small letters where ``lower`` says so."""
    width = F.length(F.bin(F.col("states") - 1))
    tell = (lambda s: F.lpad(F.bin(s), width, F.lit("0"))) if code else name
    said = (lambda s: F.col("outs")[s].cast("string")) if outputs == 1 else (lambda s: F.lpad(F.bin(F.col("outs")[s]), outputs, "0"))
    line = lambda s: F.concat_ws(" | ", tell(s), tell(_next(s, 0)), tell(_next(s, 1)), said(s))
    head = F.lit("State | After 0, After 1 | Output\n")
    head = head if lower is None else F.when(lower, F.lower(head)).otherwise(head)
    return F.concat(head, F.array_join(F.transform(F.sequence(F.lit(0), F.col("states") - 1), line), "\n"))


def transition_case(signal: str = "in") -> Column:
    """The body of a next-state ``case``."""
    line = lambda s: F.concat(F.lit("      "), name(s), F.lit(f": next_state = {signal} ? "), name(_next(s, 1)), F.lit(" : "), name(_next(s, 0)), F.lit(";"))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.col("states") - 1), line), "\n")


def asserted(bit: int = 0) -> Column:
    """States in whose output the bit is 1."""
    return F.filter(F.sequence(F.lit(0), F.col("states") - 1), lambda s: F.shiftright(F.col("outs")[s], bit).bitwiseAND(F.lit(1)) == 1)


def output_logic(signal: str = "out", bit: int = 0) -> Column:
    each = F.array_join(F.transform(asserted(bit), lambda s: F.concat(F.lit("(state == "), name(s), F.lit(")"))), " || ")
    return F.concat(F.lit(f"  assign {signal} = "), F.when(F.size(asserted(bit)) > 0, each).otherwise(F.lit("1'b0")), F.lit(";"))


def parameter_line(one_hot: bool = False, decimal: Column | None = None) -> Column:
    """``parameter A = 0, B = 1;``: in decimal, in binary, or one-hot."""
    width = F.length(F.bin(F.col("states") - 1))

    def value(s: Column) -> Column:
        if one_hot:
            return F.concat(F.col("states").cast("string"), F.lit("'b"), F.lpad(F.bin(F.call_function("shiftleft", F.lit(1), s)), F.col("states"), F.lit("0")))
        binary = F.concat(width.cast("string"), F.lit("'b"), F.lpad(F.bin(s), width, F.lit("0")))
        return binary if decimal is None else F.when(decimal, s.cast("string")).otherwise(binary)

    each = F.transform(F.sequence(F.lit(0), F.col("states") - 1), lambda s: F.concat(name(s), F.lit(" = "), value(s)))
    return F.concat(F.lit("  parameter "), F.array_join(each, ", "), F.lit(";"))


def predecessors(state: Column) -> Column:
    """(bit, src) of the edges into a state, in order."""
    into = F.filter("edges", lambda e: e.dst == state)
    return F.array_sort(F.transform(into, lambda e: F.struct(e.bit.alias("bit"), e.src.alias("src"))))


def one_hot_next(state: Column, register: str = "y", signal: str = "w", first: int = 0) -> Column:
    """Next value of a one-hot bit, from the states and inputs that lead to it; bits are numbered from ``first``."""
    each = F.transform(predecessors(state), lambda p: F.concat(F.lit(f"({register}["), (p.src + first).cast("string"), F.lit("] & "), F.when(p.bit == 1, F.lit(signal)).otherwise(F.lit(f"~{signal}")), F.lit(")")))
    return F.when(F.size(each) > 0, F.array_join(each, " | ")).otherwise(F.lit("1'b0"))


def encoded_next(bit: Column, register: str = "y", signal: str = "w") -> Column:
    """Next value of a bit (0: lowest) of the binary code, over all states: none is left out."""
    into = F.filter("edges", lambda e: F.call_function("shiftright", e.dst, bit).bitwiseAND(F.lit(1)) == 1)
    each = F.transform(into, lambda e: F.concat(F.lit(f"(({register} == "), e.src.cast("string"), F.lit(") & "), F.when(e.bit == 1, F.lit(signal)).otherwise(F.lit(f"~{signal}")), F.lit(")")))
    return F.when(F.size(each) > 0, F.array_join(each, " | ")).otherwise(F.lit("1'b0"))


def mealy_output(signal: str = "in", out: str = "out") -> Column:
    up = F.filter("edges", lambda e: e.out == 1)
    each = F.transform(up, lambda e: F.concat(F.lit("((state == "), name(e.src), F.lit(") && "), F.when(e.bit == 1, F.lit(signal)).otherwise(F.lit(f"~{signal}")), F.lit(")")))
    return F.concat(F.lit(f"  assign {out} = "), F.when(F.size(up) > 0, F.array_join(each, " || ")).otherwise(F.lit("1'b0")), F.lit(";"))


def _clocked(ports: str, body: list[Column | str]) -> Column:
    parts = [F.lit(f"module top_module ({ports});")] + [F.lit(x) if isinstance(x, str) else x for x in body] + [F.lit("endmodule")]
    return F.concat(F.array_join(F.array(*parts), "\n"), F.lit("\n"))


def _whole(width: Column, decimal: Column | None, one_hot: bool, out: Column, reset: str = "reset", edge: str = "") -> list[Column | str]:
    return [
        parameter_line(one_hot, decimal),
        F.concat(F.lit("  reg ["), (width - 1).cast("string"), F.lit(":0] state, next_state;")),
        f"  always @(posedge clk{edge})",
        f"    if ({reset}) state <= A; else state <= next_state;",
        "  always @(*)", "    case (state)", transition_case(), "      default: next_state = A;", "    endcase", out,
    ]


def problems(rows: DataFrame, kind: str, seed: int | str = "1234") -> DataFrame:
    """id, input, output, key: a task of one of the kinds below, its right answer, and a key for exact comparison.

    logic: a Moore machine, state codes binary or decimal. onehot: the same, one-hot; wide_onehot: with two outputs.
    mealy: outputs on edges, asynchronous reset. next_onehot: next values of two one-hot bits, drawn from the states;
    next_onehot_1: of bits y[n:1], one of the lower and one of the upper half. next_code: next value
    of a bit of the binary code. table: a table by codes, asking for a bit of the next state and the output.
    wave: outputs over a drawn run of inputs; machines whose output stays 0 are left out.
    """
    states, code = F.col("states"), F.length(F.bin(F.col("states") - 1))
    coin = draw(seed, F.col("id"), "coin", 2) == 1
    moore = kind != "mealy"
    key = graph_key(moore)
    lower = draw(seed, F.col("id"), "head", 5) == 0
    if kind == "wide_onehot":
        told = F.concat(F.lit("Implement this Moore machine with one-hot states, reset to A; the output is out2, out1.\n"), state_table(outputs=2, lower=lower), F.lit("\n"), parameter_line(True))
        answer = _clocked("input clk, input in, input reset, output out1, output out2", [*_whole(states, None, True, output_logic("out1", 0)), output_logic("out2", 1)])
    elif kind in ("logic", "onehot"):
        hot = kind == "onehot"
        told = F.concat(F.lit("Implement this Moore machine" + (" with one-hot states" if hot else "") + ", reset to A.\n"), state_table(lower=lower), F.lit("\n"), parameter_line(hot, None if hot else coin))
        answer = _clocked("input clk, input in, input reset, output out", _whole(states if hot else code, None if hot else coin, hot, output_logic()))
    elif kind == "mealy":
        told = F.concat(F.lit("Implement this Mealy machine with asynchronous reset to A.\n"), graph_text(False))
        answer = _clocked("input clk, input in, input areset, output out", _whole(code, coin, False, mealy_output(), "areset", " or posedge areset"))
    elif kind == "next_onehot":
        a = draw(seed, F.col("id"), "a", 1 << 20) % states
        b = (a + 1 + draw(seed, F.col("id"), "b", 1 << 20) % (states - 1)) % states
        told = F.concat(F.lit("With one-hot states y, lowest bit first, write the next values of bits "), a.cast("string"), F.lit(" and "), b.cast("string"), F.lit(".\n"), graph_text())
        answer = F.concat(F.lit("  assign Y"), a.cast("string"), F.lit(" = "), one_hot_next(a), F.lit(";\n  assign Y"), b.cast("string"), F.lit(" = "), one_hot_next(b), F.lit(";\n"))
    elif kind == "next_onehot_1":
        half = F.floor(states / 2).cast("int")
        a = draw(seed, F.col("id"), "a", 1 << 20) % half
        b = half + draw(seed, F.col("id"), "b", 1 << 20) % (states - half)
        bits = F.concat(F.lit("y["), states.cast("string"), F.lit(":1]"))
        told = F.concat(F.lit("With one-hot states "), bits, F.lit(", state A in y[1], write the next values of bits "), (a + 1).cast("string"), F.lit(" and "), (b + 1).cast("string"), F.lit(".\n"), graph_text())
        answer = F.concat(F.lit("  assign Y"), (a + 1).cast("string"), F.lit(" = "), one_hot_next(a, first=1), F.lit(";\n  assign Y"), (b + 1).cast("string"), F.lit(" = "), one_hot_next(b, first=1), F.lit(";\n"))
    elif kind == "next_code":
        a = draw(seed, F.col("id"), "a", 1 << 20) % code
        told = F.concat(F.lit("With states coded in binary in order, A 0, write the next value of bit "), a.cast("string"), F.lit(".\n"), graph_text())
        answer = F.concat(F.lit("  assign Y"), a.cast("string"), F.lit(" = "), encoded_next(a), F.lit(";\n"))
    elif kind == "table":
        a = draw(seed, F.col("id"), "a", 1 << 20) % code
        z = F.transform(asserted(), lambda s: F.concat(F.lit("(y == "), s.cast("string"), F.lit(")")))
        told = F.concat(F.lit("Write bit "), a.cast("string"), F.lit(" of the next state, and z, of this table.\n"), state_table(True, lower=lower))
        answer = F.concat(F.lit("  assign Y"), a.cast("string"), F.lit(" = "), encoded_next(a), F.lit(";\n  assign z = "), F.array_join(z, " | "), F.lit(";\n"))
    elif kind == "wave":
        inputs = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"), i.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(2)).cast("int"))
        rows = rows.withColumn("_in", inputs)
        start = F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("path"))
        step = lambda a, x: F.struct(F.element_at("edges", a.s * 2 + x + 1).getField("dst").alias("s"), F.concat(a.path, F.array(a.s)).alias("path"))
        rows = rows.withColumn("_path", F.aggregate("_in", start, step).path)
        rows = rows.withColumn("_out", F.transform("_path", lambda s: F.col("outs")[s])).where(F.exists("_out", lambda x: x != 0))
        line = lambda x, i: F.concat(F.rpad(F.concat((i * 10).cast("string"), F.lit("ns")), 16, " "), F.rpad(x.cast("string"), 16, " "), F.col("_out")[i].cast("string"))
        told = F.concat(F.lit("Implement the sequential circuit with this waveform; it starts in reset.\n" + "time".ljust(16) + "in".ljust(16) + "out\n"), F.array_join(F.transform("_in", line), "\n"))
        answer = _clocked("input clk, input in, input reset, output out", _whole(code, coin, False, output_logic()))
    else:
        raise ValueError(f"no kind {kind}")
    return rows.select("id", told.alias("input"), answer.alias("output"), key.alias("key"))


KINDS = {"logic": 4, "onehot": 4, "mealy": 4, "next_onehot": 6, "next_code": 6, "table": 5, "wave": 6, "wide_onehot": 10, "next_onehot_1": 6}


def generated(source: SparkSession | DataFrame, kind: str, n: int | None = None, seed: int | str = "1234", reference: DataFrame | None = None) -> DataFrame:
    """input, output of distinct machines (by key, the smallest id stays) that aren't among the reference's keys."""
    made = problems(machines(source, n, KINDS[kind], seed, 4 if kind == "wide_onehot" else 2), kind, seed)
    first = made.groupBy("key").agg(F.min_by(F.struct("id", "input", "output"), "id").alias("x")).select("key", "x.*")
    if reference is not None:
        first = looked(first, saved(reference.select("key").distinct(), "keys"), ["key"], "left_anti")
    return first.select("id", "input", "output", "key")


__all__ = ["KINDS", "generated", "machines", "problems"]

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from quernel.functions import boolean as B
from quernel.generators import logic, machines


def value(equation, **inputs):
    """A Verilog expression of one-bit operators, by Python's."""
    e = equation.replace("~", " 1 ^ ").replace("1'b0", "0").replace("1'b1", "1").replace("&&", "&").replace("||", "|")
    e = re.sub(r"1 \^ (\w+(?:\[\d+\])?)", r"(1 ^ \1)", e)
    return eval(e, {}, inputs) & 1  # noqa: S307


def assigned(text, name):
    return re.search(rf"assign {name} = (.*?);", text)[1]


def test_every_row_of_every_function(spark):
    parts = [("abcd", "f", logic.truth_tables(spark, 25)), ("cdab", "f", logic.karnaugh_maps(spark, 25)), ("wxyz", "f", logic.karnaugh_maps(spark, 25, "abcd", tuple("wxyz"), True)), ("abcd", "q", logic.waveforms(spark, 25))]
    for names, out, df in parts:
        for row in df.collect():
            assert 1 <= len(row.terms) <= 11 and not set(row.terms) & set(row.free)
            e = assigned(row.output, out)
            for i in range(16):
                inputs = {v: i >> (3 - k) & 1 for k, v in enumerate(names)}
                assert value(e, **inputs) == (i in row.terms)


def test_expressions(spark):
    row = spark.createDataFrame([([1, 2],)], "t array<int>").select(
        B.sum_of_products(F.col("t"), ["a", "b"], 0).alias("sop"), B.product_of_sums(B.complement(F.col("t"), 2), ["a", "b"]).alias("pos"),
        B.subsets(F.array(F.lit(7), F.lit(8)), 2).alias("subsets"), B.bits(F.lit(9), 2).alias("wide"), B.explained(F.col("t"), ["a", "b"]).alias("why"), B.one_hot(3).alias("hot"),
    ).first()
    assert row.sop == "a'b + ab'" and row.subsets == [[7], [8]] and row.wide == "1001" and row.hot == ["001", "010", "100"]
    for a in (0, 1):
        for b in (0, 1):
            assert value(row.pos, a=a, b=b) == a ^ b
    assert row.why == "01 => ~a & b\n10 => a & ~b"


def test_smallest_sums(spark):
    """Each fits its function, and no smaller number of products does."""
    r = random.Random(2)
    for _ in range(60):
        order = r.sample(range(8), 8)
        m, f = r.randint(1, 6), r.randint(0, 2)
        terms, free = order[:m], order[m : m + f]
        got = B.minimal_cover(terms, free, 3)
        whole = {c: {c[1] | s for s in range(8) if s & ~c[0] == 0} for c in itertools.product(range(8), range(8)) if not c[0] & c[1]}
        fits = [c for c, own in whole.items() if own <= set(terms) | set(free)]
        assert set(terms) <= set().union(*(whole[c] for c in got)) <= set(terms) | set(free)
        assert not any(set(terms) <= set().union(*(whole[c] for c in some)) for some in itertools.combinations(fits, len(got) - 1))
    assert B.minimal_cover([], [1], 2) == [] and B.minimal_cover([0, 1, 2, 3], [], 2) == [(3, 0)]
    for row in logic.karnaugh_maps(spark, 25, "abcd", tuple("wxyz"), True, True).collect():
        for i in set(range(16)) - set(row.free):
            assert value(row.minimal, **{v: i >> (3 - k) & 1 for k, v in enumerate("wxyz")}) == (i in row.terms)


def test_turned_maps_show_the_same_cells(spark):
    heads = set()
    for row in logic.karnaugh_maps(spark, 60, "turns", turned=True).collect():
        lines = row.input.split("\n")[1:]
        columns = lines[1].split()[1:]
        assert {int(c + x.split()[0], 2) for x in lines[2:] for c, v in zip(columns, x.split()[1:], strict=True) if v == "1"} == set(row.terms)
        heads.add((tuple(columns), tuple(x.split()[0] for x in lines[2:])))
    assert len(heads) > 8 and (("00", "01", "11", "10"), ("00", "01", "11", "10")) not in heads


def test_two_outputs_and_bits_from_one(spark):
    rows = machines.machines(spark, 15, 10, out_values=4)
    for row in machines.problems(rows, "wide_onehot").join(rows, "id").collect():
        for s in range(10):
            names = {chr(65 + i): i for i in range(10)} | {"state": s}
            for signal, bit in (("out1", 0), ("out2", 1)):
                got = eval(assigned(row.output, signal).replace("1'b0", "0").replace("||", " or "), {}, names)  # noqa: S307
                assert bool(got) == bool(row.outs[s] >> bit & 1)
    rows = machines.machines(spark, 15, 6)
    for row in machines.problems(rows, "next_onehot_1").join(rows, "id").collect():
        found = re.findall(r"assign Y(\d) = (.*?);", row.output)
        assert int(found[0][0]) in (1, 2, 3) and int(found[1][0]) in (4, 5, 6)
        for bit, e in found:
            for edge in row.edges:
                assert value(e, y=[int(i == edge.src + 1) for i in range(7)], w=edge.bit) == (edge.dst == int(bit) - 1)


def test_symbol_names():
    assert B.symbol_names(3) == ["a", "b", "c"] and B.symbol_names(3, "x", True, True, True) == ["X2", "X1", "X0"]


def test_karnaugh_cells(spark):
    text = spark.createDataFrame([([0, 5, 10],)], "t array<int>").select(B.karnaugh(F.col("t"), list("abcd"))).first()[0]
    lines = text.split("\n")
    columns = lines[1].split()[1:]
    seen = {int(c + line.split()[0], 2) for line in lines[2:] for c, v in zip(columns, line.split()[1:], strict=True) if v == "1"}
    assert seen == {0, 5, 10}


def test_machines_are_whole(spark):
    for row in machines.machines(spark, 60, 6).collect():
        goes = {(e.src, e.bit): e.dst for e in row.edges}
        assert len(goes) == 12 and all(goes[s, 0] != goes[s, 1] for s in range(6)) and set(row.outs) == {0, 1} and {e.out for e in row.edges} == {0, 1}
        seen, todo = {0}, [0]
        while todo:
            s = todo.pop()
            todo += [n for n in (goes[s, 0], goes[s, 1]) if n not in seen]
            seen |= {goes[s, 0], goes[s, 1]}
        assert seen == set(range(6))


def test_next_bits_of_every_state_and_input(spark):
    rows = machines.machines(spark, 20, 6)
    for kind in ("next_onehot", "next_code", "table"):
        for row in machines.problems(rows, kind).join(rows, "id").collect():
            for bit, e in re.findall(r"assign Y(\d) = (.*?);", row.output):
                for edge in row.edges:
                    want = edge.dst == int(bit) if kind == "next_onehot" else edge.dst >> int(bit) & 1
                    if kind == "next_onehot":
                        got = value(e, y=[int(i == edge.src) for i in range(6)], w=edge.bit)
                    else:
                        got = value(e, y=edge.src, w=edge.bit)
                    assert got == want


def test_circuits_follow_their_machines(spark):
    rows = machines.machines(spark, 20, 4)
    for kind in ("logic", "onehot", "mealy"):
        for row in machines.problems(rows, kind).join(rows, "id").collect():
            codes = dict(re.findall(r"(\w) = (\d+(?:'b\d+)?)", re.search(r"parameter (.*?);", row.output)[1]))
            assert len(set(codes.values())) == 4
            cases = {s: (one, zero) for s, one, zero in re.findall(r"(\w): next_state = in \? (\w) : (\w);", row.output)}
            for e in row.edges:
                assert cases[chr(65 + e.src)][1 - e.bit] == chr(65 + e.dst)
                out = assigned(row.output, "out").replace("1'b0", "0")
                names = {chr(65 + i): i for i in range(4)} | {"state": e.src, "IN": e.bit}
                got = eval(re.sub(r"~IN", "(1-IN)", re.sub(r"\bin\b", "IN", out)).replace("&&", " and ").replace("||", " or "), {}, names)  # noqa: S307
                assert bool(got) == bool(e.out if kind == "mealy" else row.outs[e.src])


def test_waves_toggle_and_keys_are_distinct(spark):
    for kind in machines.KINDS:
        got = machines.generated(spark, kind, 40).collect()
        assert got and len({x.key for x in got}) == len(got)
        again = machines.generated(spark, kind, 40, reference=spark.createDataFrame([(got[0].key,)], "key string"))
        assert again.count() == len(got) - 1
    for row in machines.generated(spark, "wave", 20).collect():
        lines = [x.split() for x in row.input.split("\n")[2:]]
        assert any(x[2] == "1" for x in lines) and len(lines) == 24


def test_unknown_kind(spark):
    with pytest.raises(ValueError, match="no kind"):
        machines.problems(machines.machines(spark, 1), "none")

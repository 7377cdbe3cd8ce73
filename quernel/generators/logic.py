"""Boolean problems with answers that are right by construction, as expressions over a range of seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions import boolean as B


def draw(seed: int | str, row: Column, turn: int | str, most: int) -> Column:
    """A whole number from 0 to most - 1 that seed, row and turn give, the same on any engine."""
    text = F.concat_ws("|", F.lit(str(seed)), row.cast("string"), F.lit(str(turn)))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(most)).cast("int")


def ids(source: SparkSession | DataFrame, n: int | None = None) -> DataFrame:
    """A column ``id``, which draws go by: the numbers below n, or those of a table."""
    return source.select("id") if isinstance(source, DataFrame) else source.range(n)


def minterms(source: SparkSession | DataFrame, n: int | None = None, variables: int = 4, seed: int | str = 0, free: bool = False) -> DataFrame:
    """id, terms, free (don't-cares): sorted arrays of values of so many bits, for n ids or each id of a table.

    There are 1 to 2**v - 5 terms, and with ``free`` 1 to 4 don't-cares, no more than terms less one or values
    left (none if that leaves none).
    """
    size = 1 << variables
    rows = ids(source, n)
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"), i.cast("string")).cast("binary")).alias("h"), i.alias("v"))))
    rows = rows.withColumn("_order", F.transform(order, lambda x: x.v))
    rows = rows.withColumn("_m", 1 + draw(seed, F.col("id"), "m", size - 5))
    most = F.least(F.lit(4), F.col("_m") - 1, F.lit(size) - F.col("_m"))
    some = F.when(most > 0, 1 + F.pmod(draw(seed, F.col("id"), "f", 1 << 20), F.greatest(most, F.lit(1)))).otherwise(0) if free else F.lit(0)
    rows = rows.withColumn("_f", some)
    terms = F.array_sort(F.slice("_order", F.lit(1), F.col("_m")))
    cares = F.array_sort(F.slice("_order", F.col("_m") + 1, F.col("_f")))
    return rows.select("id", terms.alias("terms"), cares.alias("free"))


def _module(ports: str, body: Column) -> Column:
    return F.concat(F.lit(f"module top_module ({ports});\n"), body, F.lit("\nendmodule\n"))


def truth_tables(source: SparkSession | DataFrame, n: int | None = None, seed: int | str = "1234", names: tuple[str, ...] = ("a", "b", "c", "d")) -> DataFrame:
    """input, output, terms: a truth table, and the sum of products that it stands for."""
    v = list(names)
    rows = minterms(source, n, len(v), seed)
    equation = F.concat(F.lit("  assign f = "), B.sum_of_products(F.col("terms"), v), F.lit(";"))
    told = F.concat(F.lit("Write a module for the function f of this truth table.\n"), B.truth_table(F.col("terms"), v, "f"))
    why = F.concat(F.lit("// rows where f is 1:\n// "), F.replace(B.explained(F.col("terms"), v), F.lit("\n"), F.lit("\n// ")), F.lit("\n"))
    return rows.select("id", told.alias("input"), F.concat(why, _module("input " + ", ".join(v) + ", output f", equation)).alias("output"), "terms", "free")


def karnaugh_maps(source: SparkSession | DataFrame, n: int | None = None, seed: int | str = "1234", names: tuple[str, ...] = ("c", "d", "a", "b"), free: bool = False, turned: bool = False) -> DataFrame:
    """input, output, terms, free, minimal: a Karnaugh map, a sum of products that fits it, and the smallest such sum.

    With ``turned``, each map has one drawn change of the order of its rows or columns.
    """
    v = list(names)
    rows = minterms(source, n, len(v), seed, free)
    equation = F.concat(F.lit("  assign f = "), B.sum_of_products(F.col("terms"), v), F.lit(";"))
    shown = B.karnaugh(F.col("terms"), v, F.col("free"))
    if turned:
        shown = B.drawn_karnaugh(F.col("terms"), v, draw(seed, F.col("id"), "kind", 4), draw(seed, F.col("id"), "turn", 1 << 20), F.col("free"))
    told = F.concat(F.lit("Write a module for the function f of this Karnaugh map" + (", where d is free" if free else "") + ".\n"), shown)
    minimal = B.minimised(F.col("terms"), F.col("free"), v)
    return rows.select("id", told.alias("input"), _module("input " + ", ".join(v) + ", output f", equation).alias("output"), "terms", "free", minimal.alias("minimal"))


def waveforms(source: SparkSession | DataFrame, n: int | None = None, seed: int | str = "1234", names: tuple[str, ...] = ("a", "b", "c", "d")) -> DataFrame:
    """input, output, terms: the values of a circuit over a sweep of its inputs, in steps of 5 ns."""
    v = list(names)
    rows = minterms(source, n, len(v), seed)
    cell = lambda x: F.rpad(x, 16, " ")

    def line(i: Column) -> Column:
        own = [cell(B.bit(i, k, len(v)).cast("string")) for k in range(len(v))]
        return F.concat(cell(F.concat((i * 5).cast("string"), F.lit("ns"))), *own, F.when(F.array_contains("terms", i), "1").otherwise("0"))

    sweep = F.array_join(F.transform(F.sequence(F.lit(0), F.lit((1 << len(v)) - 1)), line), "\n")
    head = "".join(x.ljust(16) for x in ("time", *v)) + "q\n"
    equation = F.concat(F.lit("  assign q = "), B.sum_of_products(F.col("terms"), v), F.lit(";"))
    told = F.concat(F.lit("Write a module for the combinational circuit with this waveform.\n" + head), sweep)
    return rows.select("id", told.alias("input"), _module("input " + ", ".join(v) + ", output q", equation).alias("output"), "terms", "free")

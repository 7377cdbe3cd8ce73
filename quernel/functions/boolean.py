"""Boolean functions of a few variables, as column expressions over sorted arrays of min-terms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def bits(value: Column, width: int) -> Column:
    """Binary digits, at least ``width`` of them; wider values keep all."""
    b = F.bin(value)
    return F.when(F.length(b) >= width, b).otherwise(F.lpad(b, width, "0"))


def bit(value: Column, place: int, width: int) -> Column:
    """Digit ``place``, from 0 at the left of ``width``."""
    return F.shiftright(value, width - 1 - place).bitwiseAND(F.lit(1))


def gray(n: int) -> Column:
    """The reflected Gray code of n bits, as an array."""
    return F.transform(F.sequence(F.lit(0), F.lit((1 << n) - 1)), lambda i: i.bitwiseXOR(F.shiftright(i, 1)))


def one_hot(n: int) -> Column:
    """Codes of n states, the first ...0001."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lpad(F.bin(F.call_function("shiftleft", F.lit(1), i)), n, "0"))


def complement(terms: Column, n: int, free: Column | None = None) -> Column:
    """Values of n bits in neither array."""
    rest = F.array_except(F.sequence(F.lit(0), F.lit((1 << n) - 1)), terms)
    return F.array_sort(rest if free is None else F.array_except(rest, free))


def subsets(items: Column, n: int) -> Column:
    """All choices of 1 to 2**n - 2 of n items, as arrays of arrays, by the bits of their number."""
    masks = F.sequence(F.lit(1), F.lit((1 << n) - 2))
    return F.transform(masks, lambda m: F.filter(items, lambda x, i: F.call_function("shiftright", m, i).bitwiseAND(F.lit(1)) == 1))


def _literal(name: str, on: Column, style: int) -> Column:
    return F.when(on == 1, F.lit(name)).otherwise(F.lit(f"~{name}" if style else f"{name}'"))


def product(term: Column, names: list[str], style: int = 1) -> Column:
    """A min-term's literals: ``~a & b``, or ``a'b`` with style 0."""
    own = [_literal(v, bit(term, i, len(names)), style) for i, v in enumerate(names)]
    return F.concat_ws(" & " if style else "", *own)


def sum_of_products(terms: Column, names: list[str], style: int = 1) -> Column:
    """``(~a & b) | (a & b)``, or ``a'b + ab`` with style 0; 0 without terms."""
    each = F.transform(terms, lambda t: F.concat(F.lit("("), product(t, names, style), F.lit(")")) if style else product(t, names, style))
    return F.when(F.size(terms) == 0, F.lit("0")).otherwise(F.array_join(each, " | " if style else " + "))


def product_of_sums(zeros: Column, names: list[str], style: int = 1) -> Column:
    """``(a | ~b) & (a | b)``, each sum 0 at its max-term; 1 without zeros."""

    def one(t: Column) -> Column:
        own = [F.when(bit(t, i, len(names)) == 0, F.lit(v)).otherwise(F.lit(f"~{v}" if style else f"{v}'")) for i, v in enumerate(names)]
        return F.concat(F.lit("("), F.concat_ws(" | " if style else " + ", *own), F.lit(")"))

    return F.when(F.size(zeros) == 0, F.lit("1")).otherwise(F.array_join(F.transform(zeros, one), " & " if style else ""))


def truth_table(terms: Column, names: list[str], out: str, free: Column | None = None, sign: str = "x", lead: str = "") -> Column:
    """A line of names, then a line for each input, digits between bars; don't-cares show ``sign``."""
    n = len(names)

    def line(i: Column) -> Column:
        value = F.when(F.array_contains(terms, i), F.lit("1"))
        if free is not None:
            value = value.when(F.array_contains(free, i), F.lit(sign))
        cells = [bit(i, k, n).cast("string") for k in range(n)]
        return F.concat(F.lit(lead), F.concat_ws(" | ", *cells, value.otherwise(F.lit("0"))))

    rows = F.transform(F.sequence(F.lit(0), F.lit((1 << n) - 1)), line)
    return F.concat(F.lit(lead + " | ".join([*names, out]) + "\n"), F.array_join(rows, "\n"))


def explained(terms: Column, names: list[str], style: int = 1, zero: bool = False) -> Column:
    """A line for each term: its digits, and the literals that they mean (their sum for zeros)."""

    def line(t: Column) -> Column:
        if not zero:
            return F.concat(bits(t, len(names)), F.lit(" => "), product(t, names, style))
        own = [F.when(bit(t, i, len(names)) == 0, F.lit(v)).otherwise(F.lit(f"~{v}" if style else f"{v}'")) for i, v in enumerate(names)]
        return F.concat(bits(t, len(names)), F.lit(" => "), F.concat_ws(" | " if style else " + ", *own))

    return F.array_join(F.transform(terms, line), "\n")


def minimal_cover(terms: list[int], free: list[int], n: int) -> list[tuple[int, int]]:
    """The fewest products that cover all terms and nothing but terms and don't-cares, as (mask, value): bits of the
    mask don't matter. Of several such covers the one of fewest literals, then the first in order."""
    size, held, need = 1 << n, set(terms) | set(free), sorted(set(terms))
    covers = {}
    for mask in range(size):
        for base in range(size):
            if not base & mask:
                own = frozenset(base | s for s in range(size) if s & ~mask == 0)
                if own <= held:
                    covers[mask, base] = own
    primes = [c for c, own in covers.items() if not any(own < other for other in covers.values()) and own & set(need)]
    best: tuple[tuple[int, int], list[tuple[int, int]]] | None = None

    def cost(chosen: list[tuple[int, int]]) -> tuple[int, int]:
        return len(chosen), sum(n - mask.bit_count() for mask, _ in chosen)

    def go(left: frozenset[int], chosen: list[tuple[int, int]]) -> None:
        nonlocal best
        if best is not None and len(chosen) + bool(left) > best[0][0]:
            return
        if not left:
            if best is None or (cost(chosen), sorted(chosen)) < best:
                best = cost(chosen), sorted(chosen)
            return
        hard = min(left, key=lambda t: sum(t in covers[p] for p in primes))
        for p in sorted((p for p in primes if hard in covers[p]), key=lambda p: (-len(covers[p] & left), p)):
            go(left - covers[p], [*chosen, p])

    go(frozenset(need), [])
    return best[1] if best else []


def minimised(terms: Column, free: Column, names: list[str]) -> Column:
    """``(a & ~b) | c`` of the fewest products; 0 without terms, 1 where one product is always true."""
    n = len(names)

    @F.pandas_udf("array<struct<mask:int,value:int>>")
    def cover(t: pd.Series, f: pd.Series) -> pd.Series:
        return pd.Series([[{"mask": m, "value": v} for m, v in minimal_cover(list(a), list(b), n)] for a, b in zip(t, f, strict=True)])

    def one(c: Column) -> Column:
        own = [F.when(bit(c.mask, i, n) == 0, _literal(v, bit(c.value, i, n), 1)) for i, v in enumerate(names)]
        text = F.array_join(F.filter(F.array(*own), lambda x: x.isNotNull()), " & ")
        return F.when(text == "", F.lit("1")).when(F.contains(text, F.lit("&")), F.concat(F.lit("("), text, F.lit(")"))).otherwise(text)

    return F.when(F.size(terms) == 0, F.lit("0")).otherwise(F.array_join(F.transform(cover(terms, free), one), " | "))


def map_orders(count: int) -> list[list[int]]:
    """Gray order of the codes, then reversed, then with each two of them swapped."""
    plain = [i ^ i >> 1 for i in range(count)]
    out = [plain, plain[::-1]]
    for i in range(count):
        for j in range(i):
            other = list(plain)
            other[i], other[j] = other[j], other[i]
            out.append(other)
    return out


def karnaugh(terms: Column, names: list[str], free: Column | None = None, row_turn: int = 0, column_turn: int = 0, rows: list[int] | None = None, columns: list[int] | None = None) -> Column:
    """The map as text: columns by the first half of the names, rows by the rest (one more, if they are odd), both in
    Gray order, turned by so many places, or in an order of their codes that is given; d for don't-cares."""
    n, across = len(names), len(names) // 2
    down = n - across
    columns = columns or map_orders(1 << across)[0]
    rows = rows or map_orders(1 << down)[0]
    columns = columns[column_turn:] + columns[:column_turn]
    rows = rows[row_turn:] + rows[:row_turn]
    head = "".join(names[:across])
    lines = [F.lit(" " * (down + 1) + head), F.lit("".join(names[across:]) + " " + " ".join(f"{c:0{across}b}" for c in columns))]
    for r in rows:
        cells = []
        for c in columns:
            v = F.lit(c << down | r)
            cell = F.when(F.array_contains(terms, v), F.lit("1"))
            if free is not None:
                cell = cell.when(F.array_contains(free, v), F.lit("d"))
            cells.append(F.concat(cell.otherwise(F.lit("0"))))
        lines.append(F.concat(F.lit(f"{r:0{down}b} "), F.concat_ws(" " * across if across > 1 else " ", *cells)))
    return F.concat_ws("\n", *lines)


def drawn_karnaugh(terms: Column, names: list[str], kind: Column, turn: Column, free: Column | None = None) -> Column:
    """The map with one change of four kinds: rows reversed (kind 0), columns reversed (1), two rows (2) or two
    columns (3) swapped, which ones by ``turn``."""
    across = len(names) // 2
    rows, columns = map_orders(1 << (len(names) - across)), map_orders(1 << across)
    out = F.when(kind == 0, karnaugh(terms, names, free, rows=rows[1])).when(kind == 1, karnaugh(terms, names, free, columns=columns[1]))
    for i, own in enumerate(rows[2:]):
        out = out.when((kind == 2) & (F.pmod(turn, F.lit(len(rows) - 2)) == i), karnaugh(terms, names, free, rows=own))
    for i, own in enumerate(columns[2:]):
        out = out.when((kind == 3) & (F.pmod(turn, F.lit(len(columns) - 2)) == i), karnaugh(terms, names, free, columns=own))
    return out


def symbol_names(n: int, letter: str = "a", upper: bool = False, number: bool = False, down: bool = False) -> list[str]:
    """a, b, c ... or x0, x1 ...; in capitals or in falling order if asked."""
    out = [f"{letter}{i}" if number else chr(ord(letter) + i) for i in range(n)]
    out = [x.upper() for x in out] if upper else out
    return out[::-1] if down else out

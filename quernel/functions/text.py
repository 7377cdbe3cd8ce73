"""Text out of model answers, as column expressions: nothing here leaves the JVM, but for a tokenizer that is given."""

from __future__ import annotations

import string
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a fenced block, its label line and its body.
FENCE = r"(?s)```.*?\n(.*?)```"
#: Fixed value: first module of a text.
MODULE = r"(?s)\bmodule\b.*?\bendmodule\b"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


#: Every character that Unicode calls white space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column | str) -> Column:
    """White space of any kind off both ends; only the ends are looked at."""
    return F.btrim(_col(text), F.lit(SPACES))


def _cut(text: Column, start: Column, end: Column) -> Column:
    """Characters from ``start`` up to before ``end``, counted from 1; empty if they cross."""
    return F.substring(text, start, F.greatest(end - start, F.lit(0)))


def tagged(text: Column | str, tag: str, close: str | None = None) -> Column:
    """What is between the first <tag> and the first </tag>, stripped; null if one is missing.

    A closing tag before the opening one gives an empty text. ``close`` is another closing mark, such as one
    that a length limit has cut off.
    """
    t, first, last = _col(text), f"<{tag}>", close or f"</{tag}>"
    ends = F.struct(F.instr(t, first).alias("a"), F.instr(t, last).alias("b"))
    return _once(ends, lambda x: F.when((x.a > 0) & (x.b > 0), strip(_cut(t, x.a + len(first), x.b))))


def problem(text: Column | str, tag: str = "PROBLEM", close: str = "</PROBL", compat: bool = False) -> Column:
    """The tagged problem, else the first fenced block, else the text.

    With ``compat``, a closing mark without an opening one still counts, and the text is cut from where an
    opening tag not found would end: character 9 on.
    """
    t = _col(text)
    plain = fenced(t)
    if not compat:
        return F.coalesce(tagged(t, tag, close), plain)
    a, b = F.instr(t, f"<{tag}>"), F.instr(t, close)
    begin = F.when(a > 0, a + len(tag) + 2).otherwise(len(tag) + 2)
    return F.when(b > 0, strip(_cut(t, begin, b))).otherwise(plain)


def solution_and_reason(text: Column | str, compat: bool = False) -> tuple[Column, Column]:
    """First tagged solution (its closing tag may be cut off) and first tagged reason; null where missing."""
    t = _col(text)
    if not compat:
        return tagged(t, "SOLUTION", "</SOLUT"), tagged(t, "REASON")
    out = []
    for tag, close in (("SOLUTION", "</SOLUT"), ("REASON", "</REASON>")):
        a, b = F.instr(t, f"<{tag}>"), F.instr(t, close)
        out.append(F.when(b > 0, strip(_cut(t, F.when(a > 0, a + len(tag) + 2).otherwise(len(tag) + 2), b))))
    return out[0], out[1]


def _last(text: Column, mark: str) -> Column:
    """Place of the last occurrence of ``mark``, 0 if there is none."""
    n = F.instr(F.reverse(text), mark[::-1])
    return F.when(n > 0, F.length(text) - n - len(mark) + 2).otherwise(0)


def lenient_solution_and_reason(text: Column | str) -> tuple[Column, Column]:
    """Solution up to the last closing tag, or from the last opening one on if none closes; null without an
    opening one. Reason up to its last closing tag, else up to the last <SOLUTION>, else what is before the
    first <SOLUTION>; null if there is none of these."""
    t = _col(text)
    a, z, b = F.instr(t, "<SOLUTION>"), _last(t, "<SOLUTION>"), _last(t, "</SOLUTION>")
    solution = F.when((a > 0) & (b > 0), strip(_cut(t, a + 10, b))).when(a > 0, strip(F.substring(t, z + 10, F.length(t))))
    r, e = F.instr(t, "<REASON>"), _last(t, "</REASON>")
    reason = F.when((r > 0) & (e > 0), strip(_cut(t, r + 8, e))).when((r > 0) & (a > 0), strip(_cut(t, r + 8, z)))
    return solution, reason.when(a > 0, strip(_cut(t, F.lit(1), a)))


def fenced(text: Column | str) -> Column:
    """Body of the first fenced block; the text as it is if there is none. An empty block gives ''."""
    t = _col(text)
    return F.when(F.rlike(t, F.lit(FENCE)), F.regexp_extract(t, FENCE, 1)).otherwise(t)


def without_header(code: Column | str) -> Column:
    """What follows the first ``);``, if the text has both ``module `` and ``);``."""
    c = _col(code)
    at = F.instr(c, ");")
    return F.when((F.instr(c, "module ") > 0) & (at > 0), F.substring(c, at + 2, F.length(c))).otherwise(c)


def completion(text: Column | str, rtllm: Column | bool = False) -> Column:
    """A completion as it is tested: cut after its last ``endmodule`` (or given one), out of its fence if the raw
    text has a Verilog one, and, but for rtllm rows with several modules, the first module without header."""
    t = _col(text)
    whole = rtllm if isinstance(rtllm, Column) else F.lit(rtllm)
    last = _last(t, "endmodule")
    cut = F.when(last > 0, F.substring(t, F.lit(1), last + 8)).otherwise(F.concat(t, F.lit("\nendmodule")))
    bare = F.when(F.contains(t, F.lit("```verilog")), fenced(cut)).otherwise(cut)
    ends = F.size(F.split(bare, "endmodule", -1)) - 1
    body = F.when(F.rlike(bare, F.lit(MODULE)), F.regexp_extract(bare, MODULE, 0)).otherwise(bare)
    return F.when(~whole | (ends == 1), without_header(body)).otherwise(bare)


def fingerprint(*values: Column | str, length: int | None = None) -> Column:
    """SHA-256, as hex, of the values' texts put together without separator; its first ``length`` digits."""
    whole = F.sha2(F.concat(*[F.coalesce(_col(v).cast("string"), F.lit("None")) for v in values]), 256)
    return whole if length is None else F.left(whole, F.lit(length))


def unescaped(text: Column | str, engine: str) -> Column:
    """``\\_`` as ``_``, for engines of the mixtral kind only."""
    t = _col(text)
    return F.replace(t, F.lit("\\_"), F.lit("_")) if "mixtral" in engine.lower() else t


def token_budget(tokens: Column | str, most_new: int, context: int, margin: int = 10) -> Column:
    """New tokens that fit beside a prompt of so many."""
    return F.least(F.lit(most_new), F.lit(context) - _col(tokens) - margin)


_TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


class Tokenizer(Protocol):
    """Any tokenizer with a vocabulary of its own; it is pickled to the tasks."""

    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...


def token_count(text: Column | str, tokenizer: Tokenizer | None = None) -> Column:
    """Tokens of a text; without a tokenizer, its words and single signs. A null text has null."""
    if tokenizer is None:
        return F.when(_col(text).isNotNull(), F.size(F.regexp_extract_all(_col(text), F.lit(_TOKEN), F.lit(0))))

    @F.pandas_udf("int")
    def count(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else len(tokenizer.encode(t))).astype("Int32")

    return count(_col(text))


def token_ids(text: Column | str, tokenizer: Tokenizer) -> Column:
    """The ids of a text's tokens. A null text has null."""

    @F.pandas_udf("array<int>")
    def ids(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else tokenizer.encode(t))

    return ids(_col(text))


def decoded(ids: Column | str, tokenizer: Tokenizer) -> Column:
    """The text of an array of ids. A null has null."""

    @F.pandas_udf("string")
    def text(x: pd.Series) -> pd.Series:
        return x.map(lambda own: None if own is None else tokenizer.decode(list(own)))

    return text(_col(ids))


def token_limited(text: Column | str, most: int, tokenizer: Tokenizer | None = None) -> Column:
    """The text up to its first ``most`` tokens."""
    if tokenizer is None:
        each = F.regexp_extract_all(_col(text), F.lit(rf"\s*(?:{_TOKEN})"), F.lit(0))
        return F.when(F.size(each) <= most, _col(text)).otherwise(F.array_join(F.slice(each, 1, most), ""))

    @F.pandas_udf("string")
    def cut(x: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            ids = [] if t is None else tokenizer.encode(t)
            return t if len(ids) <= most else tokenizer.decode(ids[:most])

        return x.map(one)

    return cut(_col(text))


def formatted(template: str, **values: Column | str) -> Column:
    """The template with {name} filled in, {{ and }} as braces; values aren't looked at again. An unknown name
    raises KeyError when the expression is made."""
    parts = []
    for plain, name, _, _ in string.Formatter().parse(template):
        if plain:
            parts.append(F.lit(plain))
        if name is not None:
            parts.append(_col(values[name]).cast("string"))
    return F.concat(*parts) if parts else F.lit("")


def repeats(code: Column | str, count: Column | int) -> Column:
    """Every ``repeat(N)`` with another count."""
    n = count.cast("string") if isinstance(count, Column) else F.lit(str(count))
    return F.regexp_replace(_col(code), F.lit(r"repeat\([0-9]*\)"), F.concat(F.lit("repeat("), n, F.lit(")")))


_MISMATCH = r"Mismatches: ([0-9]*) in ([0-9]*) samples"


def mismatches(log: Column | str) -> tuple[Column, Column]:
    """The two numbers of ``Mismatches: a in b samples``; null if there is no such line."""
    both = [F.nullif(F.regexp_extract(_col(log), _MISMATCH, i), F.lit("")).try_cast("int") for i in (1, 2)]
    return both[0], both[1]


def verdict(out: Column | str, err: Column | str, rtllm: Column | bool = False, timed_out: Column | None = None, error: Column | None = None) -> Column:
    """What a test run says: the first that holds of failed, timed out, syntax error, compile error (anything on
    stderr), passed (rtllm), mismatches, and no information."""
    o, e = F.coalesce(_col(out), F.lit("")), F.coalesce(_col(err), F.lit(""))
    special = rtllm if isinstance(rtllm, Column) else F.lit(rtllm)
    a, b = mismatches(o)
    chain = F.when(timed_out if timed_out is not None else F.lit(False), F.lit("timed out"))
    if error is not None:
        chain = chain.when(error.isNotNull(), F.concat(F.lit("failed: "), error))
    chain = chain.when(F.contains(e, F.lit("syntax error")), F.lit("failed: syntax error."))
    chain = chain.when(F.length(e) > 0, F.lit("failed: compile error."))
    chain = chain.when(special & F.contains(o, F.lit("Passed")), F.lit("passed"))
    chain = chain.when(a == 0, F.lit("passed"))
    chain = chain.when(a.isNotNull(), F.concat(F.lit("failed: "), a.cast("string"), F.lit(" out of "), b.cast("string"), F.lit(" samples.")))
    return chain.otherwise(F.lit("failed: info string not matched."))


def compiles(log: Column | str) -> Column:
    """Whether a compiler's log names no error and no giving up, in any case of letters."""
    return ~F.rlike(F.lower(_col(log)), F.lit("error|give up"))


def vendor_errors(log: Column | str, until: str = "Check for and fix") -> Column:
    """The lines with ``Error (``, each up to where ``until`` stands in it."""
    lines = F.filter(F.split(_col(log), "\n", -1), lambda x: F.contains(x, F.lit("Error (")))
    return F.array_join(F.transform(lines, lambda x: F.substring_index(x, until, 1)), "\n")


def rewards(text: Column | str) -> Column:
    """``k:v,k:v`` as a map of doubles; a value that is no number is null."""
    return F.transform_values(F.str_to_map(_col(text), F.lit(","), F.lit(":")), lambda _, v: v.try_cast("double"))


def sorted_lines(text: Column | str) -> Column:
    return F.array_join(F.array_sort(F.split(_col(text), "\n", -1)), "\n")


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), the value worked out once: a lambda would do it again for each element."""
    return F.transform(F.array(value), f)[0]


def swapped_lines(text: Column | str) -> Column:
    """Lines 1 and 2 swapped, 3 and 4, and so on; a line left over is dropped."""

    def swapped(lines: Column) -> Column:
        n = F.floor(F.size(lines) / 2).cast("int") * 2
        at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.array_join(F.transform(at, lambda i: F.get(lines, i + F.when(i % 2 == 0, 1).otherwise(-1))), "\n")

    return F.when(_col(text).isNotNull(), _once(F.split(_col(text), "\n", -1), swapped))


def chunked(values: Column | str, n: int) -> Column:
    """An array cut into arrays of n; a null array has none."""

    def cut(v: Column) -> Column:
        starts = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.size(v) - 1, F.lit(n))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.transform(F.sequence(i, F.least(i + n, F.size(v)) - 1), lambda k: F.get(v, k)))

    return _once(_col(values), cut)


def last_sign(line: Column | str) -> Column:
    """Last character, white space aside."""
    return F.right(F.regexp_replace(_col(line), r"\s+", ""), F.lit(1))


def placeholders(template: str) -> list[str]:
    """The names that a template asks for."""
    return [name for _, name, _, _ in string.Formatter().parse(template) if name is not None]




def element(html: Column | str, tag: str) -> Column:
    """What stands between the first opening and the next closing tag of a name without attributes; empty if there is none."""
    return F.regexp_extract(_col(html), f"(?s)<{tag}>(.*?)</{tag}>", 1)


def occurrences(text: Column | str, part: str) -> Column:
    """How often a text holds a part, from left to right without overlap. A null has null."""
    t = _col(text)
    return F.floor((F.length(t) - F.length(F.replace(t, F.lit(part), F.lit("")))) / len(part)).cast("long")

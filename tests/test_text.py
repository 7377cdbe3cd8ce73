import pytest
from pyspark.sql import functions as F

from quernel.functions import text as X

T = "```"


def one(spark, column, **values):
    names = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("a<P> x </P>b", "x"), ("a<P>x", None), ("x</P>", None), ("</P><P>x", ""), ("<P>1</P><P>2</P>", "1"),
        ("<P></P>", ""), ("<P>  x\n</P>", "x"), (None, None), ("", None),
    ],
)
def test_tagged(spark, raw, want):
    assert one(spark, X.tagged("t", "P"), t=raw) == want


def test_problem_and_compat(spark):
    assert one(spark, X.problem("t"), t="<PROBLEM>x</PROBL") == "x"
    assert one(spark, X.problem("t"), t="abcdefghij</PROBLEM>") == "abcdefghij</PROBLEM>"
    assert one(spark, X.problem("t", compat=True), t="abcdefghij</PROBLEM>") == "ij"
    assert one(spark, X.problem("t"), t=f"a{T}verilog\nb{T}") == "b"


@pytest.mark.parametrize(
    ("raw", "want"),
    [("no", "no"), (f"{T}\na{T}x{T}\nb{T}", "a"), (f"{T}verilog\nm\nn{T}", "m\nn"), (f"{T}\n{T}", ""), (f"{T}v\nopen", f"{T}v\nopen"), (f"{T}a b\nc\n{T}", "c\n")],
)
def test_fenced(spark, raw, want):
    assert one(spark, X.fenced("t"), t=raw) == want


def test_solutions(spark):
    s, r = X.solution_and_reason("t")
    t = "<SOLUTION>a</SOLUT..<REASON>b</REASON>"
    assert (one(spark, s, t=t), one(spark, r, t=t)) == ("a", "b")
    s, r = X.solution_and_reason("t", compat=True)
    assert one(spark, s, t="0123456789abc</SOLUTION>") == "9abc"
    s, r = X.lenient_solution_and_reason("t")
    assert one(spark, s, t="<SOLUTION>a</SOLUTION>b</SOLUTION>") == "a</SOLUTION>b"
    assert one(spark, s, t="x<SOLUTION>a<SOLUTION>b") == "b"
    assert one(spark, r, t="<REASON>why<SOLUTION>b") == "why"
    assert one(spark, r, t="why <SOLUTION>b</SOLUTION>") == "why"
    assert one(spark, s, t="none") is None


@pytest.mark.parametrize(
    ("raw", "rtllm", "want"),
    [
        ("x", False, "x\nendmodule"),
        ("module m(a);\nb\nendmodule tail", False, "\nb\nendmodule"),
        ("module m(a,\nb);c endmodule module n(d);e endmodule", False, "c endmodule"),
        ("module m(a);c endmodule module n(d);e endmodule", True, "module m(a);c endmodule module n(d);e endmodule"),
        ("module m;\nendmodule", False, "module m;\nendmodule"),
    ],
)
def test_completion(spark, raw, rtllm, want):
    assert one(spark, X.completion("t", rtllm), t=raw) == want


@pytest.mark.parametrize(
    ("out", "err", "rtllm", "want"),
    [
        ("", "x syntax error", False, "failed: syntax error."), ("Mismatches: 0 in 9 samples", "warning", False, "failed: compile error."),
        ("Mismatches: 0 in 9 samples", "", False, "passed"), ("Mismatches: 3 in 9 samples", "", False, "failed: 3 out of 9 samples."),
        ("Passed", "", True, "passed"), ("Passed", "", False, "failed: info string not matched."), (None, None, False, "failed: info string not matched."),
    ],
)
def test_verdict(spark, out, err, rtllm, want):
    assert one(spark, X.verdict("o", "e", rtllm), o=out, e=err) == want


def test_small_ones(spark):
    assert one(spark, X.without_header("t"), t="a);module x") == "module x"
    assert one(spark, X.without_header("t"), t="a);b") == "a);b"
    assert one(spark, X.fingerprint("t", "u", length=4), t="a", u="bc") == one(spark, X.fingerprint("t", "u", length=4), t="ab", u="c")
    assert one(spark, X.formatted("{{{t}}} {u}", t="t", u="u"), t="{u}", u="b") == "{{u}} b"
    with pytest.raises(KeyError):
        X.formatted("{nothing}")
    assert one(spark, X.repeats("t", 7), t="repeat(12) repeat()") == "repeat(7) repeat(7)"
    assert one(spark, X.swapped_lines("t"), t="1\n2\n3") == "2\n1"
    assert one(spark, X.last_sign("t"), t=" a b \t") == "b"
    assert one(spark, X.rewards("t"), t="a:1.5,b:x") == {"a": 1.5, "b": None}
    log = "Info\nError (1): a Check for and fix it\nWarning\nError (2)\nError (3): c Check for and fix b Check for and fix"
    assert one(spark, X.vendor_errors("t"), t=log) == "Error (1): a \nError (2)\nError (3): c "
    assert one(spark, X.vendor_errors("t", "Peak"), t="Error (1): a Peak virtual memory 5\nError (2)") == "Error (1): a \nError (2)"
    assert one(spark, X.compiles("t"), t="it timed out") is True
    assert one(spark, X.unescaped("t", "MIXTRAL"), t="a\\_b") == "a_b"
    assert one(spark, X.chunked(F.split("t", ","), 2), t="1,2,3") == [["1", "2"], ["3"]]
    assert one(spark, X.token_budget(F.lit(100), 50, 120), t="") == 10


class Letters:
    """A tokenizer of single characters."""

    def encode(self, text):
        return [ord(c) for c in text]

    def decode(self, ids):
        return "".join(map(chr, ids))


def test_tokens_by_rule_and_by_tokenizer(spark):
    assert one(spark, X.token_count("t"), t=" ab, cd\n") == 3 and one(spark, X.token_count("t", Letters()), t="ab c") == 4
    assert one(spark, X.token_limited("t", 2), t=" ab, cd\n") == " ab," and one(spark, X.token_limited("t", 3), t=" ab, cd\n") == " ab, cd\n"
    assert one(spark, X.token_limited("t", 2, Letters()), t="abc") == "ab" and one(spark, X.token_limited("t", 9, Letters()), t="abc") == "abc"
    null = spark.createDataFrame([(None,)], "t string").select(X.token_count("t").alias("a"), X.token_count("t", Letters()).alias("b"), X.token_limited("t", 1).alias("c"), X.token_limited("t", 1, Letters()).alias("d")).first()
    assert list(null) == [None] * 4


def test_strip_takes_all_white_space_off_both_ends(spark):
    for x in (*X.SPACES, X.SPACES):
        assert one(spark, X.strip("t"), t=f"{x}a{x}b{x}") == f"a{x}b"
    assert one(spark, X.strip("t"), t=X.SPACES) == "" and one(spark, X.strip("t"), t="\u200b a\u180e") == "\u200b a\u180e"

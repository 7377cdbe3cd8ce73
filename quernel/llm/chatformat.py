"""Chat transcripts as training text, by relational operations and Spark expressions alone.

Turns are collected into structs and sorted; neighbours of the same role become one block; blocks are put together
under a template whose control strings cannot come from a text. The output has the transcript, and its segments with
a flag that says which of them a model learns from (the loss mask). It can be read back to the turns it was made of.

A block is ``### Role: `` and its turns, each closed by ``</turn>``, then a line feed. Inside texts a backslash is
doubled, ``### `` becomes ``##\\# `` and ``</turn>`` becomes ``<\\/turn>``: what is left has no control string, and
taking each backslash before a sign away gives the text again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, CLOSE = "### ", "</turn>"
#: Roles that have a name of their own in the template; any other is given as it is, behind an @.
ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}


def escaped(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), (HEAD, "##\\# "), (CLOSE, "<\\/turn>")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _header(role: Column) -> Column:
    """Ends at its first colon with a space, as such in a role that isn't named are parted by a backslash."""
    out = F.concat(F.lit("@"), F.replace(escaped(role), F.lit(": "), F.lit(":\\ ")))
    for name, shown in ROLES.items():
        out = F.when(role == name, F.lit(shown)).otherwise(out)
    return F.concat(F.lit(HEAD), out, F.lit(": "))


def _role(shown: Column) -> Column:
    out = unescaped(_after(shown, 1))
    for name, own in ROLES.items():
        out = F.when(shown == own, F.lit(name)).otherwise(out)
    return out


def _after(text: Column, n: Column | int) -> Column:
    """The text without its first n characters."""
    return F.substr(text, F.lit(n) + 1)


def _once(value: Column, f) -> Column:
    """f(value), with value worked out once."""
    return F.transform(F.array(value), f)[0]


def merged(turns: Column) -> Column:
    """Runs of turns of one role, in order: array of (role, texts). Linear in the turns: each run is one slice."""

    def blocks(x: Column) -> Column:
        opens = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (F.get(x, i).role != F.get(x, i - 1).role))
        return _once(
            opens,
            lambda at: F.transform(
                at,
                lambda i, k: F.struct(
                    F.get(x, i).role.alias("role"),
                    F.transform(F.slice(x, i + 1, F.coalesce(F.get(at, k + 1), F.size(x)) - i), lambda t: t.text).alias("texts"),
                ),
            ),
        )

    return _once(turns, blocks)


def _segments(block: Column, learned: str) -> Column:
    """A block's header, and its texts with what closes each: only texts of the learned role are under the mask."""
    plain = lambda text: F.struct(text.alias("text"), F.lit(False).alias("loss"))
    last = F.size(block.texts) - 1
    texts = F.transform(
        block.texts,
        lambda t, i: F.array(F.struct(escaped(t).alias("text"), (block.role == learned).alias("loss")), plain(F.when(i == last, F.lit(CLOSE + "\n")).otherwise(F.lit(CLOSE)))),
    )
    return F.concat(F.array(plain(_header(block.role))), F.flatten(texts))


def formatted(turns: DataFrame, by: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", learned: str = "assistant") -> DataFrame:
    """(by, n_turns, segments, formatted): a row for each conversation.

    ``formatted`` is all segments' texts, one after the other; ``segments`` is an array of (text, loss). Turns are
    sorted by ``order`` (null first), ties by role and then by text, repeated rows each being a turn. A null text is
    an empty one, and so is a null role. Rows of null ``by`` are one conversation. An empty table has no row. Other
    columns don't come along. A conversation has to fit into one string (2 GB), as its transcript is one.
    """
    own = turns.select(
        F.col(by).alias("its_by"), F.struct(F.col(order).alias("at"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("one")
    )
    collected = own.groupBy("its_by").agg(F.array_sort(F.collect_list("one")).alias("turns"))
    segments = F.flatten(F.transform(merged(F.col("turns")), lambda b: _segments(b, learned)))
    out = collected.select("its_by", F.size("turns").cast("long").alias("n_turns"), segments.alias("segments"))
    whole = F.array_join(F.transform("segments", lambda s: s.text), "")
    return out.select(F.col("its_by").alias(by), "n_turns", "segments", whole.alias("formatted"))


def _turns(pieces: Column) -> Column:
    """The turns of one block, given what stands before each of its closes."""
    body = _after(F.ltrim(pieces[0], F.lit("\n")), len(HEAD))

    def each(body: Column) -> Column:
        shown = F.substring_index(body, ": ", 1)
        first = F.struct(_role(shown).alias("role"), unescaped(_after(body, F.length(shown) + 2)).alias("text"))
        more = F.transform(F.slice(pieces, 2, F.size(pieces)), lambda t: F.struct(first.role.alias("role"), unescaped(t).alias("text")))
        return F.concat(F.array(first), more)

    return _once(body, each)


def read_back(transcript: Column) -> Column:
    """The turns of a transcript, in order: array of (role, text). It is cut at closes, which no text holds; a piece
    that begins with a header (and, but for the first, a line feed before it) opens a block."""

    def turns(x: Column) -> Column:
        opens = F.filter(F.sequence(F.lit(0), F.size(x) - 2), lambda i: (i == 0) | F.startswith(F.get(x, i), F.lit("\n" + HEAD)))
        return F.flatten(_once(opens, lambda at: F.transform(at, lambda i, k: _turns(F.slice(x, i + 1, F.coalesce(F.get(at, k + 1), F.size(x) - 1) - i)))))

    none = F.array().cast("array<struct<role:string,text:string>>")
    return _once(F.split(transcript, CLOSE, -1), lambda x: F.when(F.size(x) > 1, turns(x)).otherwise(none))


def learned_text(segments: Column) -> Column:
    """All text under the loss mask, as it was before it was escaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s.loss), lambda s: unescaped(s.text)), "")


#: Numbers that are summed up one after the other before the sum is carried on; keeps copies of arrays short.
RUN = 512


def _starts(sizes: Column, first: Column) -> Column:
    """Sums of all sizes before each, and ``first``."""
    none = F.array().cast("array<bigint>")
    step = lambda a, n: F.struct((a.sum + n).alias("sum"), F.concat(a.all, F.array(a.sum)).alias("all"))
    return F.aggregate(sizes, F.struct(first.cast("bigint").alias("sum"), none.alias("all")), step, lambda a: a.all)


def loss_spans(segments: Column) -> Column:
    """The loss mask in code points of the transcript: array of (start, length), in order."""

    def spans(sizes: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / RUN)), lambda k: F.slice(sizes, (k * RUN + 1).cast("int"), RUN))

        def each(runs: Column) -> Column:
            sums = F.transform(runs, lambda r: F.aggregate(r, F.lit(0).cast("bigint"), lambda a, n: a + n))
            return F.flatten(F.zip_with(runs, _starts(sums, F.lit(0)), _starts))

        return _once(runs, each)

    sizes = F.transform(segments, lambda s: F.length(s.text).cast("bigint"))
    starts = _once(sizes, spans)
    both = F.zip_with(segments, starts, lambda s, at: F.struct(at.alias("start"), F.length(s.text).cast("bigint").alias("length"), s.loss.alias("loss")))
    return F.transform(F.filter(both, lambda x: x.loss), lambda x: F.struct(x.start, x.length))

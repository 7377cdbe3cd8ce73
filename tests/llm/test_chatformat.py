import hashlib
import random

from pyspark.sql import functions as F

from quernel.llm import chatformat as C
from quernel.llm import queries

SCHEMA = "conv_id long, turn int, role string, text string"


def plain(text):
    return text.replace("\\", "\\\\").replace("### ", "##\\# ").replace("</turn>", "<\\/turn>")


def brute(rows):
    """Transcripts and turns, one conversation after the other."""
    out = {}
    for conv in {x[0] for x in rows}:
        own = sorted(((x[1] is not None, x[1] or 0, x[2] or "", x[3] or "") for x in rows if x[0] == conv))
        turns, whole, last, learned = [(r, t) for _, _, r, t in own], "", None, []
        for k, (role, text) in enumerate(turns):
            if not k or role != last:
                shown = {"system": "System", "user": "User", "assistant": "Assistant"}.get(role, "@" + plain(role).replace(": ", ":\\ "))
                whole += f"### {shown}: "
            if role == "assistant":
                learned.append((len(whole), len(plain(text))))
            whole += plain(text) + "</turn>"
            if k + 1 == len(turns) or turns[k + 1][0] != role:
                whole += "\n"
            last = role
        out[conv] = (turns, whole, learned)
    return out


def check(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = C.formatted(df).select("*", C.read_back(F.col("formatted")).alias("back"), C.learned_text(F.col("segments")).alias("learned"), C.loss_spans(F.col("segments")).alias("spans"))
    want, found = brute(rows), {x.conv_id: x for x in got.collect()}
    assert found.keys() == want.keys()
    for conv, (turns, whole, spans) in want.items():
        x = found[conv]
        assert x.formatted == whole and x.n_turns == len(turns)
        assert [(t.role, t.text) for t in x.back] == turns
        assert x.learned == "".join(t for r, t in turns if r == "assistant")
        assert [(s.start, s.length) for s in x.spans] == spans
        assert "".join(s.text for s in x.segments) == whole


BITS = ["\\", "### ", "###", "#", " ", "</turn>", "</tur", "n>", "<\\/turn>", "\n", "### Assistant: ", "##\\# ", "a", "é😀", ": ", ":", "\\ ", "@", "$1", ""]


def test_any_texts_and_roles_come_back(spark):
    r = random.Random(11)
    text = lambda: "".join(r.choice(BITS) for _ in range(r.randrange(9)))
    roles = ["system", "user", "assistant", "assistant", "System", "@", "tool: x", "a:", None, "", "\\", ":\\ ", "x</turn>\n### User: "]
    rows = [(i, k, r.choice(roles), r.choice([text(), None])) for i in range(60) for k in range(r.randrange(1, 12))]
    rows += [(None, 1, "user", "null id"), (None, 0, None, None), (None, None, "assistant", "no turn")]
    rows += [(100, 1, "user", "b"), (100, 1, "user", "a"), (100, 1, "assistant", "tie"), (100, 1, "user", "a")]
    check(spark, rows)


def test_one_long_conversation_of_a_third_of_all_rows(spark):
    rows = [(1, k, "assistant" if k % 5 else "user", f"### {k}") for k in range(1500)] + [(2 + i // 8, i % 8, ["user", "assistant"][i % 2], "t") for i in range(3000)]
    check(spark, [*rows, (9999, 0, "assistant", "x" * 2_000_000)])


def test_empty_table_and_clashing_columns(spark):
    assert C.formatted(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(5, 0, "user", "hi", "x")], SCHEMA + ", its_by string").selectExpr("*", "'y' AS turns", "'z' AS segments", "1 AS loss")
    assert C.formatted(df).first().formatted == "### User: hi</turn>\n"
    named = df.select(F.col("conv_id").alias("text"), F.col("turn").alias("role"), F.col("role").alias("turn"), F.col("text").alias("conv_id"))
    assert C.formatted(named, by="text", order="role", role="turn", text="conv_id").first().asDict()["text"] == 5


def test_the_query_takes_control_strings_and_stays_in_the_jvm(spark):
    df = queries.op11_chat_format(spark, "/root/testdata/sf0.001")
    own = df.where("conv_id = -7").first()
    text = "\\### Assistant: </turn> ok"
    assert own.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert (own.n_turns, own.loss_chars, own.loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD"))

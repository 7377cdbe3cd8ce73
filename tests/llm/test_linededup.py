import random
import time

from cases import SCHEMA, odd

from quernel.llm import linededup


def brute(docs, size=3):
    seen, gone = {}, {i: set() for i, _ in docs}
    for i, t in sorted(docs):
        lines = (t or "").split("\n")
        for p in range(len(lines) - size + 1):
            w = "\n".join(lines[p : p + size])
            if not w.strip(" \t\r\n"):
                continue
            if w in seen:
                gone[i] |= set(range(p, p + size))
            seen[w] = True
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in docs}


def test_equal_to_one_pass_in_order(spark):
    r = random.Random(3)
    passage = [f"passage {i}" for i in range(6)]
    docs = []
    for i in range(60):
        lines = [f"line {r.randrange(25)}" for _ in range(r.randrange(0, 14))]
        if i % 3 == 0:
            p = r.randrange(len(lines) + 1)
            lines[p:p] = passage[r.randrange(3) :]
        docs.append((i, "\n".join(lines)))
    docs += [(80, "\n".join(["a"] * 9)), (81, "a\nb\na\nb\na\nb"), (82, None), (83, ""), (84, "\n\n\n\n\n"), (85, "x\ny"), (86, "x\ny")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = linededup.dedup_lines(df).collect()
    want = brute(docs)
    assert {x.doc_id: x.text for x in got} == want
    for x in got:
        before = dict(docs)[x.doc_id]
        assert x.n_lines == (0 if before is None else before.count("\n") + 1)
        kept = 0 if x.text is None else x.text.count("\n") + 1 if (x.text or x.n_removed < x.n_lines) else 0
        assert x.n_lines - x.n_removed == kept


def test_hot_windows_go_by_broadcast(spark, monkeypatch):
    from quernel import store

    monkeypatch.setattr(store, "HEAVY", 3)
    monkeypatch.setattr(store, "LIGHT", 1)
    docs = [(i, f"u{i}\nh1\nh2\nh3\nv{i}\nw{i}") for i in range(40)] + [(50, "p\nq\nr"), (51, "p\nq\nr")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {x.doc_id: x.text for x in linededup.dedup_lines(df).collect()} == brute(docs)


def test_odd_rows(spark):
    df = odd(spark)
    got = linededup.dedup_lines(df)
    assert got.columns == [*df.columns, "n_lines", "n_removed"] and got.count() == 19
    by = {x.doc_id: x for x in got.collect()}
    assert by[13].text == "same line" and by[7].n_removed == 0 and by[4].text is None and by[5].text == ""
    assert linededup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_columns_of_any_name_are_kept(spark):
    df = spark.createDataFrame([(1, "a\nb\nc\nd", "x", "y", "z", "s", "c"), (2, "a\nb\nc\ne", "x", "y", "z", "s", "c")], "doc_id long, text string, _hash string, own_hash string, Its_id string, starts string, clean string")
    got = linededup.dedup_lines(df)
    assert got.columns == [*df.columns, "n_lines", "n_removed"]
    assert [(x.doc_id, x.text, x.own_hash, x.Its_id, x.starts, x.clean) for x in got.orderBy("doc_id").collect()] == [(1, "a\nb\nc\nd", "y", "z", "s", "c"), (2, "e", "y", "z", "s", "c")]


def test_linear_in_the_lines_of_a_text(spark):
    """Megabytes in one text: its second half repeats the first, and ten times the lines take no hundred times as long."""

    def took(n):
        text = "\n".join([f"line {i} of a long text" for i in range(n)] * 2)
        df = spark.createDataFrame([(1, text), (2, "p\nq\nr\n" + text)], "doc_id long, text string")
        began = time.perf_counter()
        got = {x.doc_id: x.text for x in linededup.dedup_lines(df).collect()}
        assert got == {1: "\n".join(f"line {i} of a long text" for i in range(n)), 2: "p\nq\nr"}
        return time.perf_counter() - began

    small = min(took(4000), took(4000))
    assert took(40_000) < 10 * small + 5

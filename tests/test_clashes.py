"""Columns that have the names of operators' own helpers come through with their values, and one key may hold a third of
all rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quernel import store
from quernel.operators import dedup, models, order, report
from quernel.plans import tasks

NAMES = [
    "_node", "its_node", "node", "its_row", "_row", "its_draw", "_s", "own_key", "_key", "its_part", "_part", "its_at", "_at", "its_n", "_n", "its_first", "_first", "its_before",
    "own_part", "own_by0", "_by", "own_by", "its_turn", "_turn", "its_have", "_have", "its_found", "_found", "its_key", "its_lk", "_lk", "its_lv", "its_hk", "its_hv", "its_jk", "its_v", "_v",
    "both", "_text", "kept", "_kept", "its_talk", "_talk", "its_prompt", "its_most", "its_text", "bucket", "grp", "known", "its_index",
]
TEXTS = ["one long text of many words here", "one long text of many words here", "another text that is of its own", "", None, "short", "a third text, unlike the others"]


@pytest.fixture
def rows(spark):
    df = spark.createDataFrame([(i, TEXTS[i % 7], "ab"[i % 2], f"t{i % 3}") for i in range(21)], "id long, text string, grp_by string, task_id string").repartition(3)
    held = {n.lower(): n for n in NAMES}
    return df.select("*", *[F.concat(F.lit(n), F.col("id").cast("string")).alias(n) for n in held.values()])


def same(got, rows, but=()):
    """Ids of the rows got, each with its columns as they were."""
    own = {x.id: x for x in rows.collect()}
    found = got.collect()
    names = [c for c in rows.columns if c not in but]
    assert found and all(x[c] == own[x.id][c] for x in found for c in names)
    return sorted(x.id for x in found)


def test_near_and_exact_copies(spark, rows):
    other = rows.where("id = 2")
    assert same(dedup.near_dedup(rows, ["text"], "id"), rows) == [0, 2, 3, 4, 5, 6, 11, 18]
    assert same(dedup.near_dedup(rows, ["text"], "id", other.select("text", "_node")), rows) == [0, 3, 4, 5, 6, 11, 18]
    assert same(dedup.exact_first(rows, ["text"], "id"), rows) == [0, 2, 3, 4, 5, 6]
    left = [i for i in range(21) if i % 7 != 2]
    assert same(dedup.unseen(rows, F.col("text"), other, F.col("text")), rows) == left
    assert dedup.rouge_over(rows.select("*", F.lit(1).alias("w"), F.lit(2).alias("hashes")), other, "id").where("rouge = 1").count() == 3


def test_exact_first_takes_a_row_of_each_text(spark):
    df = spark.createDataFrame([(None, "a"), (2, "b"), (2, "b"), (1, "c"), (3, "c"), (3, "d")], "k int, t string")
    got = sorted(((x.t, x.k) for x in dedup.exact_first(df, ["t"], "k").collect()))
    assert got == [("a", None), ("b", 2), ("c", 1), ("d", 3)]


def test_order(spark, rows):
    numbered = order.numbered(rows, ["grp_by"], ["id"], "place")
    assert same(numbered, rows) == list(range(21)) and {x.id: x.place for x in numbered.collect()} == {i: i // 2 for i in range(21)}
    have = spark.createDataFrame([("a", 18), (None, 1)], "grp_by string, n long")
    assert same(order.quota(rows, have, "grp_by", 20, ["id"], 4), rows) == [0, 1, 2, 3, 5, 7]
    for most in (3, order.GROUP_LIMIT + 5):
        assert same(order.first_of_each(rows, ["grp_by"], ["id"], most, "place"), rows) == [i for i in range(21) if i // 2 < most]
        assert same(order.first_rows(rows, ["id"], most), rows) == list(range(21))[:most]
    assert len(same(order.one_each(rows, ["grp_by"], 3, "id"), rows)) == 2
    assert same(order.keep_first(rows, ["task_id"], ["id"], last=True), rows) == [18, 19, 20]
    assert same(order.remaining(rows, rows.where("id < 9"), "id"), rows) == list(range(9, 21))
    pool = spark.createDataFrame([(0, "x", "p"), (1, "y", "q")], "i int, shown string, its_turn string")
    drawn = order.cyclic(rows.withColumn("index", F.col("id")), pool)
    assert same(drawn, rows, ["its_turn"]) == list(range(21)) and {(x.id % 2, x.its_turn) for x in drawn.collect()} == {(0, "q"), (1, "p")}


def test_reports(spark, rows):
    told = spark.createDataFrame([(f"t{i}", f"told {i}", "n") for i in range(3)], "task_id string, said string, its_found string")
    got = report.looked_up(rows, told, ["task_id"], ["said"])
    assert same(got, rows) == list(range(21)) and all(x.said == f"told {x.id % 3}" for x in got.collect())
    both = rows.withColumn("completion", F.col("text")).withColumn("correct", F.col("text"))
    apart = same(report.distinct_trajectories(both, "id"), rows)
    assert {0, 2, 5, 6} <= set(apart) and len(apart) < 21
    assert same(report.accepted(rows.withColumn("passed", F.lit(True)), 2, "id"), rows) == [0, 1, 2, 3, 4, 5]
    sums = report.totals(rows, rows.where("id > 5"), ["grp_by"]).collect()
    assert sorted((x.grp_by, x.n_before, x.n_after) for x in sums) == [("a", 11, 8), ("b", 10, 7)]


def test_stages_that_ask(spark, rows):
    o = tasks.Options(models.Stub(lambda p: p.upper()), "say {text}")
    got = tasks.prompted(rows, o, text="text")
    assert same(got, rows) == list(range(21))
    assert {x.response for x in got.where("id = 5").collect()} == {"SAY SHORT"}
    said = models.judged(rows, F.col("text"), models.Stub(lambda p: "<VALID>True</VALID>"))
    assert same(said, rows) == list(range(21))


def test_a_key_of_a_third_of_all_rows(spark, monkeypatch):
    """With small bounds, so that nothing is broadcast but what is heavy."""
    monkeypatch.setattr(store, "MAX_BROADCAST_ROWS", 1)
    monkeypatch.setattr(store, "LIGHT", 20)
    monkeypatch.setattr(store, "HEAVY", 10)
    rows = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i % 200}" if i % 7 else None, i % 2 == 0) for i in range(3000)], "id long, k string, passed boolean").repartition(4)
    held = {x.id: x.k for x in rows.collect()}
    small = spark.createDataFrame([("hot", 1), ("k5", 2), ("k8", 3), ("no", 4)], "k string, v int")
    value = {"hot": 1, "k5": 2, "k8": 3}
    assert {x.id: x.v for x in store.looked(rows, small, ["k"]).collect()} == {i: value.get(k) for i, k in held.items()}
    assert {x.id: x.v for x in store.looked(rows.withColumn("v", F.lit("old")), small, ["k"], "inner").collect()} == {i: value[k] for i, k in held.items() if k in value}
    assert sorted(x.id for x in store.looked(rows, small, ["k"], "left_semi").collect()) == sorted(i for i, k in held.items() if k in value)
    assert sorted(x.id for x in store.looked(rows, small, ["k"], "left_anti").collect()) == sorted(i for i, k in held.items() if k not in value)
    assert sorted(x.id for x in dedup.unseen(rows, F.col("k"), small, F.col("k")).collect()) == sorted(i for i, k in held.items() if k not in value)
    assert order.remaining(rows, small.select("k"), "k").count() == sum(k not in value for k in held.values())
    assert report.looked_up(rows.where("k in ('hot', 'k5')"), small, ["k"], ["v"]).where("v in (1, 2)").count() == sum(k in ("hot", "k5") for k in held.values())
    with pytest.raises(Exception, match="no reference for k"):
        report.looked_up(rows.where("k is not null"), small, ["k"], ["v"]).collect()
    few = order.first_of_each(rows, ["k"], ["id"], 3, "turn")
    firsts = {}
    for i, k in sorted(held.items()):
        firsts.setdefault(k, []).append(i)
    assert sorted(x.id for x in few.collect()) == sorted(i for ids in firsts.values() for i in ids[:3])
    assert "WindowGroupLimit" in few._jdf.queryExecution().executedPlan().toString()


def test_trajectories_of_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(store, "MAX_BROADCAST_ROWS", 1)
    monkeypatch.setattr(store, "LIGHT", 20)
    monkeypatch.setattr(store, "HEAVY", 10)
    rows = [(i, "e", "b", 1, "hot" if i % 3 else f"t{i % 30}", "p", f"c{i}", i % 3 == 0 and i % 2 == 0) for i in range(900)]
    df = spark.createDataFrame(rows, "row_id long, exp string, benchmark string, step int, task_id string, prompt string, completion string, passed boolean")
    tasks_ = sorted({x[4] for x in rows})
    reference = spark.createDataFrame([(t, "b", f"right {t}") for t in tasks_], "task_id string, benchmark string, correct string")
    got = report.trajectories(df, reference).collect()
    low = {t for t in tasks_ if (p := [x[7] for x in rows if x[4] == t]) and sum(p) / len(p) < 0.2}
    assert {x.task_id for x in got} == low and len(got) == len(low) and all(x.correct == f"right {x.task_id}" and not x.passed for x in got)


def test_trajectories_against_plain_python(spark):
    """Nulls in every part of the key and in ``passed``, more columns with helpers' names, an old difficulty; one exchange
    of the results."""
    rows = []
    for i in range(1200):
        passed = None if i % 11 == 0 else i % 5 == 0 if i % 4 else i % 50 == 0
        rows.append((i, None if i % 97 == 0 else f"e{i % 2}", "b", None if i % 13 == 0 else i % 3, "hot" if i % 3 == 0 else f"t{i % 8}", f"p{i}", f"c{i}", passed, f"x{i}", "old"))
    rows.append((5000, "e9", "b", 1, "never ran", "p", "c", None, "x", "old"))
    names = "row_id long, exp string, benchmark string, step int, task_id string, prompt string, completion string, passed boolean, its_row string, difficulty string"
    df = spark.createDataFrame(rows, names).repartition(5)
    reference = spark.createDataFrame([(t, "b", f"right {t}") for t in {x[4] for x in rows}], "task_id string, benchmark string, correct string")

    def rate(some):
        known = [x[7] for x in some if x[7] is not None]
        return sum(known) / len(known) if known else None

    want = {}
    for key in {(x[1], x[4], x[3]) for x in rows if x[1] is not None and x[3] is not None}:
        own = [x for x in rows if (x[1], x[4], x[3]) == key]
        if (r := rate(own)) is not None and r < 0.2:
            one = min((x for x in own if x[7] is False), key=lambda x: (hashlib.md5(f"0|{x[0]}".encode()).hexdigest(), x[0]))
            whole = rate([x for x in rows if (x[1], x[4]) == key[:2]])
            want[one[0]] = "easy" if whole > 0.9 else "hard" if whole < 0.2 else "soso"
    found = report.trajectories(df, reference)
    got = found.collect()
    assert {x.row_id: x.difficulty for x in got} == want and len(got) == len(want) > 5 and len(set(want.values())) > 1
    assert all(x.completion == f"c{x.row_id}" and x.its_row == f"x{x.row_id}" and x.correct == f"right {x.task_id}" for x in got)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") + plan.count("Repartition 5") == 1  # the source, once
    assert report.trajectories(df.limit(0), reference).count() == 0


def test_lookups_in_several_references(spark):
    rows = spark.createDataFrame([(1, "a", "old"), (2, "b", "old"), (3, None, "old")], "id int, k string, v string")
    one, two = spark.createDataFrame([("a", "va"), ("b", "vb")], "k string, v string"), spark.createDataFrame([("a", "wa"), ("c", "wc"), (None, "wn")], "k string, w string")
    got = report.all_looked_up(rows, [(one, ["v"]), (two, ["w"])], ["k"], strict=False).collect()
    assert {(x.id, x.v, x.w) for x in got} == {(1, "va", "wa"), (2, "vb", None), (3, None, None)}
    assert report.all_looked_up(rows.where("id = 1"), [(one, ["v"]), (two, ["w"])], ["k"]).count() == 1
    with pytest.raises(Exception, match="no reference for b"):
        report.all_looked_up(rows.where("id = 2"), [(one, ["v"]), (two, ["w"])], ["k"]).collect()

import random

from pyspark.sql import functions as F

from quernel.operators import order, report


def test_numbered_with_a_hot_group_and_nulls(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["a", "a", "a", "b", None])) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, g string")
    got = {(x.g, x.i): x.n for x in order.numbered(df, ["g"], ["i"], "n").collect()}
    for g in ("a", "b", None):
        own = sorted(i for i, x in rows if x == g)
        assert [got[g, i] for i in own] == list(range(len(own)))
    assert order.numbered(df.limit(0), [], ["i"], "n").count() == 0


def test_shards_lose_nothing(spark):
    for n, shards, start in ((10, 3, 0), (2, 5, 0), (10, 3, 4)):
        df = spark.range(n).withColumnRenamed("id", "index")
        got = order.sharded(df, shards, n, start).collect()
        assert sorted(x["index"] for x in got) == list(range(start, n))
        assert all(0 <= x.shard < shards for x in got)


def test_shuffle_is_fixed_by_its_seed(spark):
    df = spark.range(50)
    a = [x.id for x in order.shuffled(df, 1, "id").orderBy("index").collect()]
    b = [x.id for x in order.shuffled(df.repartition(7), 1, "id").orderBy("index").collect()]
    c = [x.id for x in order.shuffled(df, 2, "id").orderBy("index").collect()]
    assert a == b and a != c and sorted(a) == list(range(50))


def test_cyclic_begins_with_the_second(spark):
    df = spark.range(5).withColumnRenamed("id", "index")
    pool = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "i long, t string")
    assert [x.t for x in order.cyclic(df, pool).orderBy("index").collect()] == ["y", "z", "x", "y", "z"]
    assert [x.t for x in order.cyclic(df, pool.limit(1)).collect()] == ["x"] * 5
    assert order.cyclic(df, pool.limit(0)).count() == 0


def test_quota(spark):
    df = spark.createDataFrame([("a", i) for i in range(30)] + [("b", i) for i in range(4)], "g string, i int")
    have = spark.createDataFrame([("a", 3), ("b", 40)], "g string, n long")
    got = order.quota(df, have, "g", 20, ["i"]).collect()
    assert sorted(x.i for x in got if x.g == "a") == list(range(10)) and not [x for x in got if x.g == "b"]


def test_first_and_remaining(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "i int, k string")
    assert sorted(x.i for x in order.keep_first(df, ["k"], ["i"]).collect()) == [1, 3]
    assert sorted(x.i for x in order.keep_first(df, ["k"], ["i"], last=True).collect()) == [2, 4]
    done = spark.createDataFrame([("a",)], "k string")
    assert sorted(x.i for x in order.remaining(df, done, "k").collect()) == [3, 4]


def test_tiers_at_their_limits(spark):
    rows = [("e", True)] * 10 + [("n", True)] * 9 + [("n", False)] + [("t", True)] + [("t", False)] * 4 + [("h", False)] * 3 + [("u", None)]
    df = spark.createDataFrame(rows, "task_id string, passed boolean")
    got = {x.task_id: x.difficulty for x in report.tiers(df, ["task_id"]).collect()}
    assert got == {"e": "easy", "n": "soso", "t": "soso", "h": "hard", "u": "soso"}


def test_strict_lookup_fails_on_a_missing_key(spark):
    import pytest

    df = spark.createDataFrame([(1,), (2,)], "k int")
    ref = spark.createDataFrame([(1, "a")], "k int, v string")
    assert {x.v for x in report.looked_up(df, ref, ["k"], ["v"], strict=False).collect()} == {"a", None}
    with pytest.raises(Exception, match="no reference"):
        report.looked_up(df, ref, ["k"], ["v"]).collect()


def test_verdicts_go_by_report(spark):
    reports = spark.createDataFrame([(1, "x"), (2, "y")], "report_id int, t string")
    verdicts = spark.createDataFrame([(2, True, "passed"), (1, False, "failed")], "report_id int, passed boolean, result string")
    assert {x.t: x.passed for x in report.by_report(reports, verdicts).collect()} == {"x": False, "y": True}
    assert report.ever(reports, ["t"], F.lit(None).cast("boolean"), "e").first().e is False


def test_broadcasts_are_bounded_in_rows_and_bytes(spark, monkeypatch):
    from quernel import store

    def marked(df):
        return "broadcast" in store.hinted(df)._jdf.queryExecution().analyzed().toString().lower()

    slim = spark.range(10).selectExpr("id", "repeat('x', 100) AS t")
    assert marked(slim) and not marked(slim.selectExpr("array(id) AS a"))
    monkeypatch.setattr(store, "MAX_BROADCAST_BYTES", 999)
    assert not marked(slim) and marked(slim.select("id"))
    monkeypatch.setattr(store, "MAX_BROADCAST_ROWS", 9)
    assert not marked(slim.select("id"))


def test_a_shared_folder_is_asked_for_on_a_cluster():
    import pytest

    from quernel import store

    class Conf:
        def __init__(self, **held):
            self.held = held

        def get(self, name, other=None):
            return self.held.get(name, other)

    class Session:
        conf = Conf(**{"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.shared_dir(Session())

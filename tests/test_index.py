import pytest
from pyspark.sql import functions as F

from quernel.operators import dedup
from quernel.operators.index import NearIndex


def texts(n=240):
    """Groups of near copies that go over several batches, and one text that a third of all rows have."""
    rows = []
    for i in range(n):
        g = i * 7 % 40
        body = " ".join(f"word{g}x{k * k % 97}" for k in range(60))
        rows.append((i, "the very same text of many rows" if i % 3 == 0 else body + (f" tail{i}" if i % 5 == 0 else ""), f"a{i}"))
    rows[7] = (7, None, "none")
    rows[11] = (11, "", "empty")
    rows[12] = (12, "", "empty")
    return rows


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(texts(), "doc_id long, text string, its_node string").repartition(3)


def ids(df):
    return sorted(x.doc_id for x in df.select("doc_id").collect())


def fed(spark, docs, folder, parts=3, **options):
    options = {"slots": 4, **options}
    size, out = -(-240 // parts), []
    for k in range(parts):
        index = NearIndex(spark, folder, **options)  # as a run of its own would
        out += ids(index.add(docs.where(F.col("doc_id").between(k * size, (k + 1) * size - 1)), f"b{k}", ["text"], "doc_id"))
    return sorted(out)


def test_batches_give_what_one_run_gives(spark, docs, tmp_path):
    want = ids(dedup.near_dedup(docs, ["text"], "doc_id"))
    assert fed(spark, docs, f"file://{tmp_path}/a") == want
    assert fed(spark, docs, f"file://{tmp_path}/b", parts=6, most_parts=2) == want  # merged on the way


def test_a_batch_run_again_changes_nothing(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/i"
    fed(spark, docs, folder)
    index = NearIndex(spark, folder)
    log, parts = index.log(), index._parts(index.log())
    first = docs.where("doc_id < 80")
    assert ids(index.add(first, "b0", ["text"], "doc_id")) == ids(dedup.near_dedup(first, ["text"], "doc_id"))
    assert index.log() == log and index._parts(index.log()) == parts
    assert index.add(first, "b0", ["text"], "doc_id").columns == docs.columns


def test_a_failed_batch_leaves_the_index_as_it_was(spark, docs, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/i"
    index = NearIndex(spark, folder, slots=4)
    index.add(docs.where("doc_id < 100"), "one", ["text"], "doc_id")
    log = index.log()
    with monkeypatch.context() as m:
        m.setattr(NearIndex, "_write", lambda self, name, value: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            index.add(docs.where("doc_id >= 100"), "two", ["text"], "doc_id")
    assert index.log() == log
    gone = index.vacuum()
    assert gone and index.vacuum() == []
    rest = ids(index.add(docs.where("doc_id >= 100"), "two", ["text"], "doc_id"))
    assert sorted(rest + ids(index.add(docs.where("doc_id < 100"), "one", ["text"], "doc_id"))) == ids(dedup.near_dedup(docs, ["text"], "doc_id"))


def test_only_the_new_batch_is_signed(spark, docs, tmp_path, monkeypatch):
    from quernel.operators import index as module

    signed = []
    monkeypatch.setattr(module, "banded", lambda texts, *a: (signed.append(texts.count()), dedup.banded(texts, *a))[1])
    fed(spark, docs, f"file://{tmp_path}/i")
    assert signed == [80] * 3


def test_reference_sets_and_checks(spark, docs, tmp_path):
    index = NearIndex(spark, f"file://{tmp_path}/i", slots=4)
    known = docs.where("doc_id in (1, 3, 6)").drop("its_node")
    assert ids(index.add(known, "benchmark", ["text"], "doc_id", all_rows=True)) == [1, 3, 6]
    hit = set(ids(docs)) - set(ids(index.check(docs, ["text"], "doc_id")))
    assert set(range(0, 240, 3)) - {12} <= hit and {1, 41, 81} - {81} <= hit and 7 not in hit and 11 not in hit
    kept = ids(index.add(docs, "docs", ["text"], "doc_id"))
    assert kept == ids(dedup.near_dedup(docs, ["text"], "doc_id", known))
    empty = docs.where("doc_id < 0")
    assert ids(index.add(empty, "none", ["text"], "doc_id")) == [] and len(index.log()) == 3


def test_a_lookup_does_not_move_the_index(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/i"
    NearIndex(spark, folder, slots=8).add(docs, "a", ["text"], "doc_id")
    index = NearIndex(spark, folder)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counts = dedup.banded(dedup.field_texts(docs, ["text"], "doc_id")).groupBy("bucket").agg(F.count("*").alias("n"))
        plan = counts.join(index._table(index._parts(index.log())[0]).select("bucket"), "bucket")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    theirs = plan[plan.rindex("Sort [") :]  # the index's side of the join
    assert "near_index_part" in theirs and "Bucketed: true" in theirs and "Exchange" not in theirs


def test_a_batch_in_one_part_of_the_input_is_signed_by_all_cores(spark, tmp_path, monkeypatch):
    """And only buckets that several rows, or the index, have go through the greedy rounds."""
    from quernel.operators import index as module

    parts, contested = [], []
    banded, rounds = module.banded, module.rounds
    monkeypatch.setattr(module, "banded", lambda texts, threshold: parts.append(texts.rdd.getNumPartitions()) or banded(texts, threshold))
    monkeypatch.setattr(module, "rounds", lambda left: contested.append(left.count()) or rounds(left))
    own = [(i, f"text {i} of its own, {i * i} and {i ** 3} are in it") for i in range(40)] + [(90, "text 3 of its own, 9 and 27 are in it")]
    df = spark.createDataFrame(own, "id long, text string").coalesce(1)
    index = module.NearIndex(spark, f"file://{tmp_path}/spread", slots=4)
    kept = {x.id for x in index.add(df.where("id < 20"), "a", ["text"], "id").collect()} | {x.id for x in index.add(df.where("id >= 20"), "b", ["text"], "id").collect()}
    assert kept == {x.id for x in dedup.near_dedup(df, ["text"], "id").collect()} and 90 not in kept
    assert min(parts) >= spark.sparkContext.defaultParallelism and max(contested) < 14 * 10

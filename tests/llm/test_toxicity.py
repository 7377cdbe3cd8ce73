import numpy as np
from cases import SCHEMA, odd, prose

from quernel.llm import toxicity


def test_fit_reaches_the_least_loss():
    """Grades 0 to 2 that two features raise: thresholds rise, severities follow, and the slope at the end is flat."""
    r = np.random.default_rng(1)
    x = r.random((600, 3)) < 0.4
    grade = np.clip((2.5 * x[:, 0] + 1.5 * x[:, 1] + r.logistic(size=600) > 1).astype(int) + (2.5 * x[:, 0] + 1.5 * x[:, 1] + r.logistic(size=600) > 3), 0, 2)
    owner, index = np.nonzero(x)
    weights, cuts = toxicity.fit_ordinal(index, owner, grade, 3, 3)
    assert cuts[0] < cuts[1] and weights[0] > weights[1] > abs(weights[2])

    def loss(w, t):
        above = 1 / (1 + np.exp(t[None] - (x @ w)[:, None]))
        edge = np.hstack([np.ones((600, 1)), above, np.zeros((600, 1))])
        return -np.log(edge[np.arange(600), grade] - edge[np.arange(600), grade + 1]).sum() + 0.15 * w @ w

    here = loss(weights, cuts)
    for i in range(3):
        for step in (-0.05, 0.05):
            assert loss(weights + step * np.eye(3)[i], cuts) > here - 1e-3
    for i in range(2):
        for step in (-0.05, 0.05):
            assert loss(weights, cuts + step * np.eye(2)[i]) > here - 1e-3


def _docs(spark):
    rows = [(i, prose(i, 40) + (" you vilest wretches " if i % 3 == 0 else " ") + prose(-i, 40)) for i in range(240)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(180)], "doc_id long, quality int, toxic int")


def test_rows_without_a_label_are_told_apart(spark):
    docs, labels = _docs(spark)
    # a row of two grades, one of none, and one of no document are left out
    labels = labels.unionAll(spark.createDataFrame([(1, 1, 1), (2, 1, None), (None, 1, 1), (9999, 1, 1)], labels.schema))
    got = toxicity.severity(docs, toxicity.fit(docs, labels), ["doc_id"]).collect()
    assert len(got) == 240
    assert all(x.toxic == (x.doc_id % 3 == 0) and x.grade == int(x.toxic) and 0 <= x.severity <= 1 for x in got)


def test_rows_that_share_a_key_are_bounded_too(spark):
    docs, labels = _docs(spark)
    hot = spark.createDataFrame([(3, f"hot row {i} vilest") for i in range(500)], docs.schema)
    model = toxicity.fit(docs.unionAll(hot), labels, max_docs=100, max_words=None)
    assert len(model.words)
    assert toxicity.severity(docs, model, ["doc_id"]).count() == 240


def test_odd_rows_and_empty_tables(spark):
    docs, labels = _docs(spark)
    model = toxicity.fit(docs, labels)
    got = toxicity.severity(odd(spark).selectExpr("*", "1 AS severity"), model, ["doc_id", "n"]).collect()
    assert len(got) == 19
    of = {x.doc_id: x for x in got if x.doc_id is not None}
    assert of[4].severity is None and of[4].toxic is None and of[5].severity == of[6].severity is not None
    empty = spark.createDataFrame([], SCHEMA)
    assert toxicity.severity(empty, model, ["doc_id"]).count() == 0
    nothing = toxicity.fit(docs, labels.where("toxic = 0"))
    assert {x.severity for x in toxicity.severity(docs, nothing, ["doc_id"]).collect()} == {0.0}
    assert {x.severity for x in toxicity.severity(docs, toxicity.fit(empty, labels), ["doc_id"]).collect()} == {0.0}

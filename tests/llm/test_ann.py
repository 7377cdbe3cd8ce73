import numpy as np

from quernel.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, code string, vector int, rank int"


def table(spark, vectors, first=0):
    rows = [(first + i, None if v is None else [float(x) for x in v], 0, "c", 1, 2) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def brute(rows, k=5):
    """Exact answers of (vec_id, vector), over all pairs."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    norm = np.sqrt((x * x).sum(1))
    out = {}
    for q in np.flatnonzero(ids % 50 == 0):
        score = x @ x[q] / (norm * norm[q])
        others = [(-s, int(i)) for s, i in zip(score, ids, strict=True) if i != ids[q]]
        out[int(ids[q])] = [(i, -s) for s, i in sorted(others)[:k]]
    return out


def test_recall_and_exact_scores(spark):
    """With the registered parameters, over several groups of codes and blocks of queries."""
    r = np.random.default_rng(1)
    centres = r.normal(size=(300, 32))
    vectors = [centres[r.integers(300)] + 0.9 * r.normal(size=32) for _ in range(14_000)]
    got = ann.nearest(table(spark, vectors)).collect()
    want = brute(list(enumerate(vectors)))
    by = {}
    for x in got:
        by.setdefault(x.query_id, []).append(x)
    hits = 0
    for q, best in want.items():
        own = sorted(by[q], key=lambda x: x["rank"])
        assert [x["rank"] for x in own] == [1, 2, 3, 4, 5]
        assert [x.score for x in own] == sorted((x.score for x in own), reverse=True)
        hits += len({x.vec_id for x in own} & {i for i, _ in best})
        exact = dict(best)
        assert all(abs(x.score - exact[x.vec_id]) < 1e-12 for x in own if x.vec_id in exact)
    assert hits >= 0.97 * 5 * len(want)


def test_rows_that_codes_hardly_tell_apart(spark):
    """Tight clusters, a common offset, and queries whose cosines are all below zero: nothing is missed."""
    r = np.random.default_rng(8)
    clusters = np.repeat(r.normal(size=(3, 16)), 1500, axis=0) + 0.01 * r.normal(size=(4500, 16))
    offset = 1 + 0.03 * r.normal(size=(4500, 24))
    away = r.normal(size=12) + 0.05 * r.normal(size=(700, 12))
    away[::50] *= -1
    away = away[np.arange(700) % 50 != 0], away[::50][:1]
    for vectors in (clusters, offset, np.concatenate([away[1], away[0]])):
        rows = [(i, v) for i, v in enumerate(vectors)]
        want, got = brute(rows), {}
        for x in sorted(ann.nearest(table(spark, vectors)).collect(), key=lambda x: (x.query_id, x["rank"])):
            got.setdefault(x.query_id, []).append(x.vec_id)
        assert got == {q: [i for i, _ in best] for q, best in want.items()}


def test_a_hot_vector_and_a_hot_key(spark):
    """A third of all rows are one vector, another third one row: the smallest keys win ties, repeats count."""
    r = np.random.default_rng(2)
    same = r.normal(size=16)
    vectors = [same if i % 3 == 0 else r.normal(size=16) for i in range(3000)]
    repeated = spark.createDataFrame([(7, [float(x) for x in -same], 0, "c", 1, 2)] * 1500, SCHEMA)
    got = ann.nearest(table(spark, vectors).unionAll(repeated)).collect()
    for q in range(0, 3000, 150):  # queries that are the hot vector
        own = sorted((x for x in got if x.query_id == q), key=lambda x: x["rank"])
        assert [x.vec_id for x in own] == [i for i in range(0, 21, 3) if i != q][:5]
    far = spark.createDataFrame([(50, [float(x) for x in -same], 0, "c", 1, 2)], SCHEMA)
    got = ann.nearest(far.unionAll(repeated)).collect()
    assert [(x.query_id, x["rank"], x.vec_id) for x in sorted(got, key=lambda x: x["rank"])] == [(50, i, 7) for i in range(1, 6)]


def test_rows_that_take_no_part_ties_and_repeats(spark):
    same = [1.0, 2.0, 0.5]
    vectors = [same] * 8 + [None, [0.0, 0.0, 0.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0], [1.0, 2.0], [-1.0, 0.0, 0.0]]
    got = sorted(ann.nearest(table(spark, vectors)).collect(), key=lambda x: x["rank"])
    assert [(x.query_id, x.vec_id) for x in got] == [(0, i) for i in (1, 2, 3, 4, 5)]
    assert all(abs(x.score - 1) < 1e-12 for x in got)
    twice = table(spark, [same, same]).unionAll(table(spark, [same, same]))
    assert [(x.query_id, x["rank"], x.vec_id) for x in sorted(ann.nearest(twice).collect(), key=lambda x: x["rank"])] == [(0, 1, 1), (0, 2, 1)]


def test_equal_vectors_score_equally_wherever_they_stand(spark):
    r = np.random.default_rng(5)
    for n in range(5, 21):
        x = r.normal(size=(n, 64))
        for at in range(n):
            some = x.copy()
            some[[at, (at + 1) % n, n - 1, 0]] = x[2]
            got = ann._cosines(some, r.normal(size=64))
            assert len({got[i] for i in (at, (at + 1) % n, n - 1, 0)}) == 1
    same, query = r.normal(size=64), r.normal(size=64)
    vectors = [query, same, same, r.normal(size=64), same, query / 3, same, -query]
    got = sorted(ann.nearest(table(spark, vectors, 100)).collect(), key=lambda x: x["rank"])
    own = [x for x in got if x.query_id == 100 and x.vec_id in (101, 102, 104, 106)]
    assert len({x.score for x in own}) == 1 and [x.vec_id for x in own] == sorted(x.vec_id for x in own)


def test_very_small_and_very_large_components(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(8, 6))
    want = brute([(i, v) for i, v in enumerate(x)])
    for scale in (1e-200, 1e-310, 1e200, 1.0):
        rows = [(i, [float(c) for c in v * (scale if i % 2 else 1.0)]) for i, v in enumerate(x)]
        got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
        own = sorted(got, key=lambda x: x["rank"])
        assert [y.vec_id for y in own] == [i for i, _ in want[0]] and all(abs(y.score - s) < 1e-6 for y, (_, s) in zip(own, want[0], strict=True))


def test_no_usable_rows(spark):
    assert ann.nearest(table(spark, [None, [0.0, 0.0]])).count() == 0
    assert ann.nearest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_loss_weighs_the_parallel_residual():
    """Codes chosen by the score-aware loss leave less error along the vector than the nearest codewords do."""
    r = np.random.default_rng(3)
    x = r.normal(size=(2000, 32))
    x /= np.sqrt((x * x).sum(1))[:, None]
    made = ann.train(x, threshold=0.5)
    assert made.weight > 5

    def along(codes):
        kept = made.books[np.arange(codes.shape[1])[None], codes].reshape(len(x), -1)
        return np.abs(((x - kept) * x).sum(1)).mean()

    assert along(made.codes(x)) < 0.5 * along(made.codes(x, passes=0))
    code = made.codes(x[:50])
    tables = made.tables(x[:4])
    whole = made.books[np.arange(code.shape[1])[None], code].reshape(50, -1)
    scanned = sum(tables[:, j][:, ann.packed(code)[:, j]] for j in range(tables.shape[1]))
    assert np.allclose(scanned, x[:4] @ whole.T, atol=1e-5)

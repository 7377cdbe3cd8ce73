"""Tables that have columns of the names that operators use for helpers: they come through, and nothing fails."""

import pytest
from cases import edited, prose
from pyspark.sql import functions as F

from quernel.llm import chatformat, decontam, langid, linededup, minhash, pieces, resample, sharding, spelling, tokencount, toxicity, warc
from quernel.llm.queries import PIECE_MODEL, RANKS

NAMES = [
    "_text", "own_text", "Own_Text", "_id", "its_id", "own_row", "its_h1", "its_h2", "own_h", "_h", "_d", "own_d", "own_range", "_range", "own_hash", "_hash", "starts",
    "clean", "place", "_key", "_k", "_own", "own_edits", "own_sizes", "own_counts", "hash", "node", "label", "grp", "window", "row", "probe",
]
TEXTS = [prose(1, 60), edited(prose(1, 60), 3), prose(2, 60), "a\nb\nc\nd", "x\na\nb\nc\n", None]


@pytest.fixture
def docs(spark):
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string")
    held = {n.lower(): n for n in NAMES}
    return df.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in held.values()])


def unchanged(got, docs, but=()):
    """Each row that is left has its columns as they were."""
    own = {x.doc_id: x for x in docs.collect()}
    names = [c for c in docs.columns if c not in but]
    rows = got.collect()
    assert rows and all(x[c] == own[x.doc_id][c] for x in rows for c in names)
    return sorted(x.doc_id for x in rows)


def test_row_operators_keep_all_columns(spark, docs):
    bench = spark.createDataFrame([(1, prose(2, 60), "x")], "item_id long, text string, _id string")
    assert unchanged(linededup.dedup_lines(docs), docs, ["text"]) == [0, 1, 2, 3, 4, 5]
    assert unchanged(sharding.histogram_shards(docs, 2), docs) == [0, 1, 2, 3, 4, 5]
    assert unchanged(minhash.one_of_each(docs), docs) == [0, 2, 3, 4, 5]
    assert unchanged(langid.identified(docs), docs) == [0, 1, 2, 3, 4]
    assert unchanged(decontam.decontaminated(docs, bench), docs) == [0, 1, 3, 4, 5]
    plain = docs.select("doc_id", "text")
    by_id = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()))
    assert by_id(decontam.report(docs, bench)) == by_id(decontam.report(plain, bench.drop("_id")))
    assert by_id(minhash.classes(docs)) == by_id(minhash.classes(plain))


def test_archives_and_new_operators(spark, docs):
    by_id = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)
    pages = docs.select("*", F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a.b/"), "doc_id").alias("url"), F.col("text").alias("html"))
    assert by_id(warc.archived(pages)) == by_id(warc.archived(pages.select("page_id", "url", "html")))
    turns = docs.select("*", F.lit(1).alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("user").alias("role"))
    assert by_id(chatformat.formatted(turns)) == by_id(chatformat.formatted(turns.select("conv_id", "turn", "role", "text")))
    plain = docs.select("doc_id", "text")
    assert by_id(spelling.variants(docs, letters=1, every=0)) == by_id(spelling.variants(plain, letters=1, every=0))
    assert by_id(resample.resampled(docs, plain)) == by_id(resample.resampled(plain, plain))


def test_columns_that_are_kept_on_request(spark, docs):
    keep = [c for c in docs.columns if c != "text"]
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, least=1)
    edits = docs.withColumn("edits", F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("length"), F.lit("zz").alias("insert"))))
    for got in (
        pieces.encode(docs, PIECE_MODEL, keep), pieces.round_trip(docs, PIECE_MODEL, keep), toxicity.severity(docs, model, keep),
        langid.with_language(docs, langid.fit(docs), keep), tokencount.counted_edits(edits, RANKS, keep), tokencount.grow(docs, RANKS, keep),
    ):
        assert unchanged(got, docs, ["text"]) == [0, 1, 2, 3, 4, 5]
    ids = pieces.encode(docs, PIECE_MODEL, keep)
    assert unchanged(pieces.decode(ids.withColumn("own_ids", F.lit("o")), PIECE_MODEL, keep), docs, ["text"]) == [0, 1, 2, 3, 4, 5]

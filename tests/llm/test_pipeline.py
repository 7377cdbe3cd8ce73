import corpus_pipeline
import sentencepiece
from cases import edited, odd_documents, prose

from quernel.llm.queries import PIECE_MODEL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, folder, docs, items):
    rows = [(i, t, "en", "web", None if t is None else len(t)) for i, t in docs]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_each_stage_takes_what_it_should(spark, tmp_path):
    """What is planted for a stage goes there, and clean documents come through whole."""
    passage = "\n".join(prose(i, 20) for i in (901, 902, 903))
    item = prose(950, 30)
    docs = [
        (0, prose(1, 200)), (1, edited(prose(1, 200), 5)), (2, prose(1, 200)), (3, None), (4, ""), (5, "123 %%"),
        (6, passage + "\n" + prose(2, 150)), (7, prose(3, 150) + "\n" + passage), (8, prose(4, 100) + " " + " ".join(item.split(" ")[5:16]) + " " + prose(5, 100)),
        (9, prose(6, 180)), (10, prose(7, 100) + " " + " ".join(item.split(" ")[5:14]) + " " + prose(8, 100)),
    ]
    folder = written(spark, tmp_path, docs, [(1, item), (2, None), (3, "")])
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, folder).collect()}
    text = dict(docs) | {7: prose(3, 150)}
    assert sorted(got) == [0, 6, 7, 9, 10]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    for i, x in got.items():
        assert x.ids == library.encode(text[i]) and x.n_tokens == len(x.ids) and x.restored


def test_odd_rows_and_empty_tables(spark, tmp_path):
    docs = [(i, t) for i, t, *_ in odd_documents()]
    got = corpus_pipeline.run(spark, written(spark, tmp_path / "odd", docs, [(1, prose(777, 20))])).collect()
    assert {x.doc_id for x in got if x.doc_id is not None} == {0, 3, 8, 11, 12, 13, 14, 15}
    empty = written(spark, tmp_path / "none", [], [])
    assert corpus_pipeline.run(spark, empty).count() == 0

from quernel import queries


def test_whole_texts_in_every_form(spark, tmp_path):
    """Long texts of many lines come through whole, each in all eight forms."""
    texts = {i: "\n".join(f"line {k} of text {i}" for k in range(2000)) for i in range(3)}
    rows = [(i, t, "en", "web", len(t)) for i, t in texts.items()] + [(9, None, "en", "web", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, 0) for i in texts], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    run = lambda name: {(x.doc_id, x.form): x for x in queries.QUERIES[name](spark, str(tmp_path)).collect()}
    tagged, solved, completed = (run(n) for n in ("whole_tagged_problems", "whole_solutions_and_reasons", "whole_completions"))
    for got in (tagged, solved, completed):
        assert sorted(got) == [(i, f) for i in (0, 1, 2, 9) for f in range(8)]
    for i, t in texts.items():
        assert tagged[i, 0].tag == t and tagged[i, 1].problem == t and tagged[i, 3].code == t + "\n" and tagged[i, 7].code == t
        assert solved[i, 4].solution == t and solved[i, 4].reason == "for web"
        assert solved[i, 5].lenient.endswith(t)
        assert completed[i, 6].code.strip() == t + "\nendmodule"
    prompts = {x.doc_id: x.prompt for x in queries.whole_templates(spark, str(tmp_path)).collect()}
    assert all(prompts[i] == "In en {web}: " + t for i, t in texts.items())
    assert {x.row_id: x.prompt for x in queries._results(spark, str(tmp_path)).collect()} == texts

from terramark.llm import pii


def test_short_names_and_numbers_are_terms(spark, tmp_path):
    texts = [f"common words here ann@x.org Rossi, 李明 k4711 +49 30 1234567 end {i}" for i in range(3)] + [f"common words here end {i}" for i in range(60)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.spans for r in pii.op10_pii(spark, str(tmp_path)).collect()}
    at = lambda w: f"term:{texts[0].index(w)}:{texts[0].index(w) + len(w)}"
    terms = [x for x in got[0].split(",") if x.startswith("term")]
    assert terms == [at("Rossi"), at("李明"), at("k4711")] and got[10] == ""

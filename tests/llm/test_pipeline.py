"""The pipeline's stages, each against a brute-force version on what the one before it kept."""

import re

import corpus_pipeline
import duckdb
from pyspark.sql import functions as F

from terramark.llm import language_id, mixing, sentencepiece

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def kept(frame, path):
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def one_of_each(rows):
    """The smallest ids of the groups of five-word similarity 0.8, by comparing all pairs."""
    sets, top = {r.doc_id: grams(r.text) for r in rows}, {r.doc_id: r.doc_id for r in rows}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            if len(sets[i] & sets[j]) * 1.8 >= 0.8 * (len(sets[i]) + len(sets[j])) - 1e-9:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {find(i) for i in ids}


def test_stages_match_brute_force(spark, tmp_path):
    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{DATA}/documents.parquet")
    assert list(stages) == ["language_id", "exact_dedup", "simhash", "mixing", "sentencepiece"]
    first = kept(stages["language_id"](spark, docs, DATA), f"{tmp_path}/1")
    rows = docs.collect()
    lang, _ = language_id.predict(language_id.fit(docs), [r.text for r in rows])
    assert {r.doc_id: r.lang for r in first.collect()} == {r.doc_id: k for r, k in zip(rows, lang) if k != "und"} and first.columns == COLUMNS

    second = kept(stages["exact_dedup"](spark, first, DATA), f"{tmp_path}/2")
    best = {}
    for r in first.collect():
        key, rank = re.sub(r"[\x20\x09-\x0D]", "", r.text), (-len(r.text), r.doc_id)
        best[key] = min(best.get(key, rank), rank)
    assert {r.doc_id for r in second.collect()} == {i for _, i in best.values()} and second.columns == COLUMNS

    third = kept(stages["simhash"](spark, second, DATA), f"{tmp_path}/3")
    assert {r.doc_id for r in third.collect()} == one_of_each(second.collect()) and third.columns == COLUMNS

    fourth = kept(stages["mixing"](spark, third, DATA), f"{tmp_path}/4")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/3/*.parquet'")
    want = db.execute(mixing.mix_sql()).fetchdf()
    assert {r.doc_id for r in fourth.collect()} == set(want[want.kept].doc_id) and fourth.columns == COLUMNS

    vocabulary = sentencepiece.Vocabulary.read()
    for r in stages["sentencepiece"](spark, fourth, DATA).collect():
        assert r.token_ids == vocabulary.encode(r.text) and r.round_trip and vocabulary.decode(r.token_ids) == r.text


def test_empty_tables_and_clashing_names(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(25)
    odd = docs.withColumns({c: F.lit(7) for c in ("__lang", "__kept_id", "__tokens", "__row", "bucket", "h", "topic", "kept", "n_tokens", "component", "fp")})
    for name, frame in (("odd", odd), ("empty", odd.limit(0))):
        now = frame
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = kept(stage(spark, now, DATA), f"{tmp_path}/{name}{k}")
            assert set(odd.columns) <= set(now.columns)
        assert now.count() == 0 if name == "empty" else now.filter("`__lang` != 7 OR `__row` != 7 OR fp != 7").count() == 0

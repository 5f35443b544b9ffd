import hashlib
import io
import zlib

import numpy as np
import pytest
import sentencepiece as library
from pyspark.sql import functions as F

from terramark.llm import language_id, media, mixing, sentencepiece

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def longest_parse(sample, text):
    count, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at:at + n + 1] in sample:
            n += 1
        count, at = count + 1, at + n
    return count


def test_phrase_counts_match_direct_search():
    samples = (("a", b" the cat sat on the mat and the dog"), ("b", b" der hund und die katze auf der matte"))
    texts = ["The dog sat!", "katze und hund", "zzz qq", "x" * 1300, "the   mat,,on DER"]
    got, size = language_id.phrase_counts(samples, texts)
    for t, row, n in zip(texts, got, size):
        x = np.frombuffer(language_id.letters(t), np.uint8)
        x = x[language_id._single_blanks(x)].tobytes()
        assert n == len(x)
        parts = [x[i:i + language_id.SEGMENT] for i in range(0, len(x), language_id.SEGMENT)]
        for (_, s), c in zip(samples, row):
            assert c == sum(longest_parse(s, p) for p in parts)


def test_language_accuracy_and_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs)
    got = language_id.with_language(docs, model).filter("crc32(cast(doc_id as string)) % 4 = 2").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 34 !?", None), (None, "the text", "en")], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language_id.with_language(odd, model).collect()][:3] == [("und", 0.0)] * 3
    assert language_id.with_language(odd, ()).filter("lang_pred != 'und'").count() == 0
    assert language_id.fit(docs.limit(0)) == ()
    kept = language_id.identified(docs.limit(20).withColumn("score", F.lit("x")))
    assert kept.columns == [*docs.columns, "score"] and kept.count() == 20


def test_mixing_meets_its_marginals(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).toPandas()
    assert len(rows) == docs.count() and rows.probability.between(0, 1).all()
    raked = rows.assign(w=rows.weight * rows.n_tokens)
    for k, power in mixing.POWERS.items():
        share = (rows.groupby(k).n_tokens.sum() / rows.n_tokens.sum()) ** power
        assert np.allclose(raked.groupby(k).w.sum() / raked.w.sum(), share / share.sum(), atol=0.02)
    expected = (rows.probability * rows.n_tokens).sum() / rows.n_tokens.sum()
    assert abs(expected - mixing.KEEP_SHARE) < 0.01
    assert abs((rows.n_tokens * rows.kept).sum() / rows.n_tokens.sum() - mixing.KEEP_SHARE) < 0.06


@pytest.mark.parametrize("few", [100_000, 0])
def test_mixing_meets_given_targets(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", few)
    shares = {"source": {"a": 0.7, "b": 0.2, "c": 0.1}, "lang": {"x": 0.4, "y": 0.6}, "topic": {"p": 0.5, "q": 0.5}}
    rng = np.random.default_rng(9)
    cells = [(s, l, t, int(rng.integers(1, 500))) for s in "abc" for l in "xy" for t in "pq"] + [("z", "x", "p", 80), ("a", "x", "p0", 0)]
    frame = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    given = shares | {"lang": spark.createDataFrame(list(shares["lang"].items()), "lang string, t double")}
    got = mixing.raked(frame, rounds=200 if few else 8, targets=given, tolerance=1e-9 if few else 1e-3).toPandas()
    assert len(got) == 13 and got.probability.between(0, 1).all()
    for k, want in shares.items():
        held = got.groupby(k).weight.sum() / got.weight.sum()
        assert all(abs(held.get(v, 0) - x) < (1e-6 if few else 0.02) for v, x in want.items())
    assert got[got.source == "z"].weight.sum() == 0 and abs((got.probability * got.tokens).sum() / got.tokens.sum() - 0.5) < 0.01


def test_mixing_cases(spark):
    odd = [(1, None, None, None, 0), (2, "", "en", "s", 0), (3, "a b", None, "s", 3), (3, "a b", None, "s", 3), (None, "x", "en", None, 1)]
    got = mixing.mix(spark.createDataFrame(odd, SCHEMA)).collect()
    assert len(got) == 5 and {r.probability for r in got if r.n_tokens == 0 and r.source == "(none)"} == {0.0}
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mixed(spark.createDataFrame(odd, SCHEMA).withColumn("topic", F.lit(1))).columns[-1] == "topic"


@pytest.fixture(scope="module")
def vocabulary():
    return sentencepiece.Vocabulary.read()


def best_score(v, word, known):
    """The best sum over all segmentations, by direct recursion over the characters."""
    if not word:
        return 0.0
    options = [known[word[:n]] + best_score(v, word[n:], known) for n in range(1, min(16, len(word)) + 1) if word[:n] in known]
    if word[0] not in known:
        options.append(v.unknown + best_score(v, word[1:], known))
    return max(options)


def test_best_path_is_the_best_segmentation(vocabulary, spark):
    lib = library.SentencePieceProcessor(model_file=sentencepiece.MODEL_PATH)
    ids = [i for i in range(lib.get_piece_size()) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))]
    known = {lib.id_to_piece(i): vocabulary.scores[i] for i in ids}
    assert abs(sum(np.exp(s) for s in known.values()) - 1) < 1e-6
    texts = " ".join(r.text[:300] for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(40).collect())
    words = {w for w in texts.split() if len(w) <= 12} | {"中€", "x🙂y", "aé"}
    for w in words:
        w = sentencepiece.MARK + w
        got, score = vocabulary.best_path(w), 0.0
        at = 0
        while at < len(got):
            if got[at] in vocabulary.byte_ids:
                first = vocabulary.byte_ids.index(got[at])
                at += 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                score += vocabulary.unknown
            else:
                score += vocabulary.scores[got[at]]
                at += 1
        assert abs(score - best_score(vocabulary, w, known)) < 1e-9, w


def test_side_by_side_equals_best_path(vocabulary, spark):
    texts = [r.text[:4000] for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()] + ["中€ x🙂y aé 中文字符 ▁", "z" * 70, "é" * 31]
    words = sorted({sentencepiece.MARK + w for t in texts for w in t.split()} | {sentencepiece.MARK * k for k in (1, 2, 9)})
    flat, at = vocabulary.best_paths(words)
    assert [tuple(flat[a:b]) for a, b in zip(at, at[1:])] == [vocabulary.best_path(w) for w in words]


def test_likeliest_segmentation_takes_few_pieces(vocabulary, spark):
    lib = library.SentencePieceProcessor(model_file=sentencepiece.MODEL_PATH)
    assert [lib.id_to_piece(int(i)) for i in vocabulary.encode("Hello world")] == ["▁Hello", "▁world"]
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if r.text]
    assert sum(len(vocabulary.encode(t)) for t in texts) <= 1.02 * sum(len(lib.encode(t)) for t in texts)


def test_round_trip(vocabulary, spark):
    texts = ["", " ", "▁", "a▁ ▁b", " ▁", "née\x00\x01", "퟿\U0001f600", "  two  ", "long " * 30_000, None]
    frame = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id int, text string, n_tokens int")
    got = sentencepiece.tokenised(frame)
    assert got.columns == ["doc_id", "text", "token_ids", "n_tokens", "n_byte_tokens", "round_trip"]
    rows = sentencepiece.decoded(got).orderBy("doc_id").collect()
    assert [r.decoded for r in rows] == texts
    assert all(r.round_trip for r in rows if r.text is not None)
    assert rows[-1].token_ids is None and rows[0].n_tokens == 0
    assert sentencepiece.tokenised(frame.limit(0)).count() == 0


def test_double_array_finds_all_keys():
    keys = [b"a", b"ab", b"abc", b"b", b"\xff\x00", b"bca", b"\x00"]
    base, check, value = sentencepiece.double_array([(k, i) for i, k in enumerate(keys)])
    for i, k in enumerate(keys):
        s = 0
        for c in k:
            t = base[s] + c + 1
            assert check[t] == s
            s = t
        assert value[s] == i


def brute_mean(grey, height, width):
    h, w = grey.shape
    big = np.kron(grey.astype(float), np.ones((height, width)))
    return big.reshape(height, h, width, w).mean(axis=(1, 3))


def test_codecs_and_resize():
    rng = np.random.default_rng(3)
    grey = rng.integers(0, 256, (7, 11), dtype=np.uint8)
    rgb = rng.integers(0, 256, (5, 6, 3), dtype=np.uint8)
    for x in (grey, rgb):
        assert (media.decode(media.encode_netpbm(x)) == x).all() and (media.decode(media.encode_bmp(x)) == x).all()
    assert media.decode(b"P1\n# c\n3 2\n1 0 1\n010").tolist() == [[1, 0, 1], [0, 1, 0]]
    assert media.decode(b"P2 2 1 255 7 9").tolist() == [[7, 9]]
    assert media.decode(b"P4\n10 1\n\xaa\x80").tolist() == [[1, 0, 1, 0, 1, 0, 1, 0, 1, 0]]
    assert media.decode(b"P5 1 1 65535\n\x01\x02").tolist() == [[258]]
    assert np.allclose(media.area_resize(grey, 4, 5), brute_mean(grey, 4, 5))
    assert np.load(io.BytesIO(media.tile_of(grey))).shape == (media.TILE, media.TILE)
    for bits, data in ((1, b"\xa0\0\0\0\x40\0\0\0"), (4, b"\x12\x30\0\0\x01\x20\0\0")):
        palette = bytes(x for g in range(1 << bits) for x in (g * 15, g * 15, g * 15, 0))
        head = media.struct.pack("<IiiHHIIiiII", 40, 3, 2, 1, bits, 0, 8, 1, 1, 0, 0)
        bmp = b"BM" + media.struct.pack("<IHHI", 0, 0, 0, 54 + len(palette)) + head + palette + data
        want = [[0, 1, 0], [1, 0, 1]] if bits == 1 else [[0, 1, 2], [1, 2, 3]]
        assert (media.decode(bmp) == np.array(want) * 15).all()
    for bad in (b"GIF89a", b"P5\n0 0\n255\n", b"P5 1 1 0 x"):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_media_query_cases(spark):
    texts = [None, "", "a", "x" * 64, "é" * 40, "y" * 300_000, "a"]
    frame = spark.createDataFrame([(i, t, b"z") for i, t in enumerate(texts)], "doc_id int, text string, media binary")
    rows = media.media_features(media.text_media(frame)).orderBy("doc_id").collect()
    for r, t in zip(rows, texts):
        data = (t or "").encode()
        payload = data + bytes(64 - len(data) if len(data) < 64 else -len(data) % 64)
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        stored = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        small = np.round(brute_mean(np.frombuffer(payload, np.uint8).reshape(-1, 64), 8, 9), 6) if len(payload) < 5000 else None
        if small is not None:
            assert r.feature == np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()
    assert rows[2].asDict() | {"doc_id": 0} == rows[6].asDict() | {"doc_id": 0}
    tiles = media.images_to_tiles(spark.createDataFrame([(bytearray(media.store(b"hello")),), (None,), (bytearray(b"junk"),), (bytearray(b"P5\n0 0\n255\n"),)], "media binary")).collect()
    assert [t.height for t in tiles] == [1, None, None, None]

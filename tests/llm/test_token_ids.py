import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from terramark.llm import token_ids as T

DATA = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def words():
    return T.Words(PATH)


def brute(tokenizer, rows):
    """(doc_id, start, n_tokens, crc) of rows (doc_id, text) by the tokenizer itself, null ids first."""
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=3000))
def test_words_give_back_their_ids(ids):
    ids = np.array(ids, np.uint64)
    words, offsets, escapes = T.pack(ids)
    assert (T.unpack(words, offsets, len(ids), escapes) == ids).all()
    assert len(offsets) == -(-len(ids) // T.BLOCK) + 1
    assert len(escapes) == int((ids >= 1 << 60).sum())


def test_selectors_hold_the_widest_run():
    for count, width in zip(T.COUNTS[1:], T.WIDTHS[1:]):
        words, _, _ = T.pack(np.full(int(count), 2 ** int(width) - 1, np.uint64))
        assert len(words) == 1 and int(words[0]) >> 60 == list(T.COUNTS[1:]).index(count) + 1


def test_files_are_read_in_part_and_checked():
    ids = np.random.default_rng(5).integers(0, 50257, 700_000).astype(np.uint64)
    ids[[3, 5000, 650_000]] = 2**63 + 5
    data = T.to_bytes([7, None], np.array([100, len(ids) - 100]), ids, 12)
    found = T.TokenFile(data)
    assert (found.ids() == ids).all() and found.before == 12 and list(found.counts) == [100, len(ids) - 100]
    assert list(found.known) == [True, False] and found.names[0] == 7
    for a, b in ((0, 1), (1023, 1025), (4990, 5010), (649_000, 700_000), (5, 5)):
        assert (found.ids(a, b) == ids[a:b]).all()
    with pytest.raises(ValueError):
        T.TokenFile(data[:5000] + bytes([data[5000] ^ 1]) + data[5001:])
    with pytest.raises(ValueError):
        T.TokenFile(b"something else" * 20)


ALPHABET = [*"abéßÑ×÷ÿа字.,;:!?'\" \t\n\r\x0b\x0c\x1c\x85\xa0 0129-_#s", *map(chr, (0x180E, 0x1680, 0x200B, 0x2003, 0x2060, 0x3000, 0xFEFF, 0xE01, 0x1D4B3)), "<|endoftext|>", "'ll", "  ", " the", "tre", "\n the"]


def ids_of(words, texts):
    return [list(x) for x in words(pa.array(texts, pa.string()))]


@settings(max_examples=400, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.lists(st.sampled_from(ALPHABET), max_size=50).map("".join), max_size=8))
def test_texts_cut_into_words_have_the_ids_of_the_whole(words, texts):
    assert ids_of(words, texts) == [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_texts_in_pieces_and_words_forgotten(monkeypatch):
    words = T.Words(PATH)
    texts = ["one two, three é字 x\n" * 400, "x" * 5000 + " y", "no.space" * 700, "", " " * 999, "é字" * 3000]
    want = [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(T, "AT_ONCE", 13)
    monkeypatch.setattr(T, "KNOWN", 4)
    for _ in range(4):
        assert ids_of(words, texts) == want
        assert ids_of(words, ["new words each time two, three"]) == [words.tokenizer.encode("new words each time two, three", add_special_tokens=False).ids]
    assert b" two" in words.known


def test_other_tokenizers_get_whole_texts():
    other = T.Words(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Upper Case,  and\nspace ", "", "ends."]
    assert not other.cuts and ids_of(other, texts) == [other.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_query_equals_the_tokenizer(spark, words):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = brute(words.tokenizer, [(r.doc_id, r.text) for r in docs])
    got = T.op11_token_ids(spark, DATA)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_nulls_repeats_and_small_files(spark, words, tmp_path):
    rows = [(2, "b b", "s"), (None, "of none", "s"), (1, None, None), (2, "b b", "s"), (3, "", "s"), (-5, "before all " * 300, "s"), (2**63 - 1, "last<|endoftext|>", "s"), (4, " \n ", "s")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    folder = tmp_path.as_uri()
    manifest = T.write_token_files(docs, PATH, folder, file_ids=20)
    got = T.read_token_files(manifest, folder, with_ids=True).orderBy("start").collect()
    want = brute(words.tokenizer, [r[:2] for r in rows])
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want
    assert got[1].doc_id == -5 and got[1].ids == [*words.tokenizer.encode("before all " * 300, add_special_tokens=False).ids, 0]
    assert manifest.count() > 2 and not list(tmp_path.glob("_*"))
    assert sorted(str(p) for p in tmp_path.glob("*.tok")) == sorted(r.path for r in manifest.collect())


def test_empty_table_and_clashing_names(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert T.read_token_files(T.write_token_files(none, PATH, tmp_path.as_uri()), tmp_path.as_uri()).count() == 0
    rows = spark.createDataFrame([(1, "a text", 5, 6, 7, 8)], "doc_id long, text string, tie long, part long, path long, start long")
    got = T.read_token_files(T.write_token_files(rows, PATH, tmp_path.as_uri()), tmp_path.as_uri()).collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(1, 0, 3)]

import hashlib
from collections import Counter

import numpy as np

from terramark.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string, mark long, kept long"


def brute(docs):
    data = [(t or "").encode() for _, t in docs]
    seen = Counter(d[i:i + 400] for d in data for i in range(len(d) - 399))
    out = []
    for (i, _), d in zip(docs, data):
        gone = np.zeros(len(d) + 1, bool)
        for k in range(len(d) - 399):
            if seen[d[k:k + 400]] > 1:
                gone[k:k + 400] = True
        kept = bytes(x for x, g in zip(d, gone) if not g)
        out.append((i, len(d), int(gone.sum()), int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(d) else 0, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, docs, **more):
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], SCHEMA).repartition(4)
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.suffix_dedup(frame, **more).collect()], key=str)


def test_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    text = lambda n: "".join(rng.choice(list("abcdefgh éü"), n))
    passage, other = text(900), text(420)
    docs = [(i, text(int(rng.integers(0, 1500)))) for i in range(25)]
    docs += [(30 + i, text(int(rng.integers(0, 300))) + passage[int(rng.integers(0, 200)):int(rng.integers(500, 900))] + text(200)) for i in range(12)]
    docs += [(50, text(50) + other), (51, other + text(50)), (52, other[:399] + text(9)), (53, text(9) + other[:399]), (54, text(7) + other[10:410] + text(3))]
    docs += [(60, "z" * 900), (61, "ab" * 500), (62, "abc" * 300 + "q"), (63, None), (64, ""), (65, passage), (65, passage), (None, passage), (66, passage + passage)]
    assert run(spark, docs) == brute(docs)
    assert run(spark, []) == []


def test_matches_brute_force_on_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert run(spark, docs) == brute(docs)


def test_transform_finds_common_blocks():
    rng = np.random.default_rng(8)
    shared = rng.integers(0, 4, 500, dtype=np.uint8).tobytes()
    one = rng.integers(0, 4, 100, dtype=np.uint8).tobytes() + shared[:450]
    two = shared[20:490]
    got = S.repeated_strings([one, two], np.array([len(one) - 399, len(two) - 399]), np.array([200, 80]))
    assert [list(g) for g in got] == [list(range(120, 151)), list(range(0, 31))]


def test_full_buckets_are_cut(spark):
    """One passage in many contexts: its pieces are cut until buckets hold, with the same result."""
    rng = np.random.default_rng(6)
    text = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    passage = text(600)
    docs = [(i, text(300) + passage + text(300)) for i in range(60)] + [(90, text(100) + passage[:430]), (91, passage[170:] + text(90))]
    assert run(spark, docs, bucket_bytes=4000) == brute(docs)

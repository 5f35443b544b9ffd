import hashlib

import numpy as np

from terramark.llm import substring_dedup as S

SCHEMA = "doc_id long, text string, mark long, place long"


def brute(docs):
    first = {}
    for i, t in docs:
        w = (t or "").encode().split()
        for k in range(len(w) - 12):
            key = tuple(w[k:k + 13])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, t in docs:
        w = (t or "").encode().split()
        gone = {k + d for k in range(len(w) - 12) if first[tuple(w[k:k + 13])] < i for d in range(13)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in docs], SCHEMA).repartition(5)


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "FLUSH", 500)
    rng = np.random.default_rng(2)
    passage = [f"p{k}" for k in range(40)]
    docs = []
    for i in range(120):
        w = [f"w{k}" for k in rng.integers(0, 2000, rng.integers(0, 90))]
        if i % 3 == 0:
            w[5:5] = passage[: rng.integers(10, 40)]
        docs.append((i * 7 % 120, " ".join(w)))
    docs += [(200, None), (201, ""), (202, "a b " * 30), (203, "a b " * 30), (204, "x " * 20_000), (-1, "x " * 14)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in S.substring_dedup(frame(spark, docs)).collect()}
    assert got == brute(docs)


def test_cases(spark):
    assert S.substring_dedup(frame(spark, [])).count() == 0
    text = " ".join(map(str, range(30)))
    rows = S.substring_dedup(frame(spark, [(1, text), (1, text), (2, text + " z"), (2, text + " z"), (None, text)])).collect()
    assert sorted((r.doc_id or 99, r.n_removed) for r in rows) == [(1, 0), (1, 0), (2, 30), (2, 30), (99, 30)]


def test_sketch_never_underestimates(spark):
    texts = [" ".join(f"w{k}" for k in range(s, s + 20)) for s in (0, 5, 300, 600)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    rows = S.sketch(df, 16, lambda t: S.window_hashes(t)[0])
    a = [S.window_hashes([t])[0] for t in texts]
    both = np.intersect1d(a[0], a[1])
    assert len(both) == 3
    assert S.seen_twice(rows, both, 16).all() and S.seen_twice(rows, a[3], 16).sum() < 3
    cells = np.sort(np.array([0, 0, 3, 254, 255, 256, 1000, 1000, 70_000]))
    assert (S._from_gaps(S._gaps(cells)) == cells).all()

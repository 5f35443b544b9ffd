import hashlib
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from terramark.llm import exact_dedup, simhash

SCHEMA = "doc_id long, text string, fp string, h long"
SPACE = re.compile(r"[\x20\x09-\x0D]")


def rows(spark, texts, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in texts], schema)


def test_exact_dedup_cases(spark):
    texts = [(1, "a b"), (2, "ab"), (3, " a\tb "), (4, None), (5, ""), (6, " \x0b"), (7, "abc"), (8, "a b"),
             (9, "x" * 200_000), (10, "x " * 200_000), (None, "abc"), (11, "a b"), (-5, "neg"), (-6, "neg"), (2**63 - 1, "top"), (None, "top"), (-2**63, "low"), (3**20, "low")] + [(100 + i, "hot copy") for i in range(60)]
    got = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_dedup(rows(spark, texts), bucket_bytes=8).collect()}
    assert len(got) == len(texts)
    groups = {}
    for i, t in texts:
        groups.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), 2**63 if i is None else i))
    for i, t in texts:
        n = SPACE.sub("", t or "")
        r = got[i, hashlib.sha256(n.encode()).hexdigest()]
        keep = min(groups[n])[1]
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(groups[n]), i == keep)
    stay = exact_dedup.deduplicated(rows(spark, texts))
    assert stay.columns == ["doc_id", "text", "fp", "h"] and stay.count() == len(groups)


def test_exact_dedup_empty_and_repeated_rows(spark):
    assert exact_dedup.exact_dedup(rows(spark, [])).count() == 0
    same = exact_dedup.exact_dedup(rows(spark, [(1, "a"), (1, "a")])).collect()
    assert [(r.keep_id, r.group_size, r.kept) for r in same] == [(1, 2, True)] * 2


def test_directory_doubles_until_buckets_fit(spark):
    posts = spark.range(4000).select(F.xxhash64("id").alias("h"), F.lit(10).cast("long").alias("n_bytes"))
    found = exact_dedup.directory(posts, bucket_bytes=2000, max_depth=12)
    held = posts.withColumn("slot", F.shiftrightunsigned("h", 52).cast("int")).join(found, "slot").groupBy("bucket").agg(F.sum("n_bytes").alias("b")).collect()
    assert sum(r.b for r in held) == 40_000 and max(r.b for r in held) <= 2000 and len(held) < 80


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(prints):
    comp = {i: i for i in prints}
    ids, moved = sorted(prints), True
    while moved:
        moved = False
        for a in ids:
            for b in ids:
                if bin(prints[a] ^ prints[b]).count("1") <= 3 and comp[b] > comp[a]:
                    comp[b], moved = comp[a], True
    return comp


def test_simhash_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    vocab = ["Wort%d" % i for i in range(60)]
    texts = []
    for i in range(60):
        words = [vocab[k] for k in rng.integers(0, 60, rng.integers(1, 150))]
        texts.append(" ".join(words))
        texts.append(" ".join(words[:-1] + ["neu"]))
    texts += [None, "", " \t", "a", "A", "a b", "a\nb", "Ä b c d"] + ["same text here now"] * 9
    docs = list(enumerate(texts))
    got = {r.doc_id: r for r in simhash.near_duplicates(rows(spark, docs), home_size=2).collect()}
    prints = {i: brute_print(t) for i, t in docs}
    comp = brute_components(prints)
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in got.items()} == comp
    assert {r.doc_id for r in simhash.deduplicated(rows(spark, docs)).collect()} == set(comp.values())
    assert simhash.near_duplicates(rows(spark, [])).count() == 0


def test_anchors_lose_no_link(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 150, dtype=np.uint64)
    fps = [int(b) for b in base]
    for b in base:
        for flips in (1, 2, 3, 4):
            x = int(b)
            for k in rng.choice(64, flips, replace=False):
                x ^= 1 << int(k)
            fps.append(x)
    fps = np.array(sorted(set(fps)), np.uint64)
    n = len(fps)
    for levels in (1, 2, 3):
        row, anchor, left, home = np.arange(n), np.zeros(n, np.int64), np.full(n, 3), np.ones(n, bool)
        for level in range(levels):
            at, anchor, left, home = simhash.visits(fps[row], anchor, left, home, level)
            row = row[at]
        assert home.sum() == n
        root = {int(f): int(f) for f in fps}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        order = np.argsort(anchor, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(anchor[order])) + 1):
            if len(at) == 1:
                continue
            for m, r in simhash.stars(fps[row[at]], home[at], 3):
                root[top(int(m))] = top(int(r))
        far = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
        want = {int(f): int(f) for f in fps}
        for i, j in zip(*np.nonzero(far)):
            a, b = int(fps[i]), int(fps[j])
            assert top(a) == top(b)
            while want[a] != a:
                a = want[a]
            while want[b] != b:
                b = want[b]
            want[a] = b
        assert len({top(int(f)) for f in fps}) == sum(want[k] == k for k in want)


def test_each_word_has_one_home():
    """The code is perfect: every pattern of up to three bits has a syndrome of its own."""
    start, word, cost = simhash._patterns(3)
    assert (np.add.reduceat(cost == 0, start[:-1]) == 1).all() and (cost[start[:-1]] == 0).all()
    assert (np.bitwise_count(word[start[:-1]]) <= simhash.RADIUS).all()

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terramark.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, g string, v int, tile int, i int"


def brute(rows):
    """The contract, pair by pair; rows: (vec_id, embedding, label)."""
    own = []
    for i, e, label in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        own.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in e]))
    out = []
    for n, (a, label, v) in enumerate(own):
        if a % 100:
            continue
        rated = sorted(((-sum(x * y for x, y in zip(v, w)), b, other) for m, (b, other, w) in enumerate(own) if m != n))
        for s, p, _ in [r for r in rated if r[2] == label][:5]:
            some = [r for r in rated if r[2] != label and 80 * -s <= 100 * -r[0] <= 100 * -s][:5]
            out += [(a, p, k + 1, r[1], -s, -r[0]) for k, r in enumerate(some)]
    return sorted(out)


def run(spark, rows):
    full = [(*r, "x", 1, 2, 3) for r in rows]
    e = spark.createDataFrame(full, SCHEMA)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = H.hard_negatives(H.taking_part(e, F.col("vec_id"), F.col("embedding"), label, F.col("vec_id") % 100 == 0))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def vectors(n, wide, seed, labels=4):
    r = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in np.round(r.normal(0.1, 0.2, wide), 2)], int(r.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("wide", [3, 40, 300])
def test_small_tiles_equal_brute_force(spark, monkeypatch, wide):
    """Many tiles of rows and anchors, one chunk of dimensions and several; one label has half of all rows."""
    monkeypatch.setattr(H, "ANCHORS", 2)
    monkeypatch.setattr(H, "ROWS", 64)
    rows = [(i, e, 0 if i % 2 else k) for i, e, k in vectors(501, wide, wide)]
    want = brute(rows)
    assert len(want) > 40 and run(spark, rows) == want


def test_nulls_ties_repeats_and_lengths(spark):
    rows = vectors(330, 5, 8)
    rows += [(None, [0.1] * 5, 1), (331, None, 1), (332, [0.1] * 5, None), (333, [0.1, None, 0.1, 0.1, 0.1], 1), (334, [float("nan")] * 5, 1), (335, [float("inf")] * 5, 2), (336, [-float("inf")] * 5, 2)]
    rows += [(400, [0.5] * 5, 1)] * 2 + [(k, [0.25] * 5, k % 3) for k in range(401, 440)]  # a repeated anchor, and equal scores
    rows += [(500, [], 1), (501, [], 2), (502, [0.1] * 9, 1), (600, [0.2] * 2, 2), (-100, [0.3] * 5, 0)]
    assert run(spark, rows) == brute(rows)


def test_few_rows_and_none(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []  # no anchor
    assert run(spark, [(100, [1.0], 0), (1, [1.0], 1)]) == []  # no positive
    assert run(spark, [(100, [1.0], 0), (1, [1.0], 0), (2, [0.9], 1), (3, [-1.0], 0)]) == [(100, 1, 1, 2, 256 * 256, 230 * 256)]


def test_vectors_beyond_exact_scores_are_an_error(spark):
    with pytest.raises(Exception, match="too long"):
        run(spark, [(100, [1e30, 1.0], 0), (1, [1.0, 1.0], 0)])
    rows = [(100, [300000.0, 1.0], 0), (1, [299999.0, 1.0], 0), (2, [299998.0, 7.0], 1)]  # beyond doubles' sums, within longs
    assert run(spark, rows) == brute(rows)


def test_products_of_whole_numbers_stay_exact():
    r = np.random.default_rng(2)
    for top in (100, 1 << 26, 1 << 29):
        a, b = r.integers(-top, top, (7, 16)), r.integers(-top, top, (9, 16))
        want = np.array([[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a], dtype=object)
        assert (H._product(H._narrow(a), H._narrow(b)).astype(object) == want).all()

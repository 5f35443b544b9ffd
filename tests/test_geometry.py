"""Spans, burned shapes, distances, sampled windows and percentiles against brute force."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from terramark.operators import factors, focal
from terramark.plans import catalog

RINGS = "feature_id long, coords array<array<double>>"


def grid(spark, h, w, values=None):
    v = np.ones((h, w), int) if values is None else values
    return spark.createDataFrame([(i * w + j, i, j, int(v[i, j])) for i in range(h) for j in range(w)], "cell_id long, r long, c long, v int")


def inside(rings, r, c):
    """The even-odd rule in whole fractions: a crossing to the right counts."""
    x, y, hit = Fraction(2 * c + 1, 2), Fraction(2 * r + 1, 2), False
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]]):
            a, b, p, q = (Fraction(v) for v in (x0, y0, x1, y1))
            if min(b, q) <= y < max(b, q) and x < a + (y - b) * (p - a) / (q - b):
                hit = not hit
    return hit


def shapes(seed, n, size):
    """Rings that cross themselves and each other, with corners on centres and borders of cells."""
    rng = np.random.default_rng(seed)
    return [[[float(x) / 4, float(y) / 4] for x, y in rng.integers(-8, 4 * size + 8, (int(rng.integers(3, 9)), 2))] for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_spans_equal_the_rule_cell_by_cell(spark, monkeypatch, seed):
    monkeypatch.setattr(factors, "TILE", 5)
    rings = shapes(seed, 3, 30)
    frame = spark.createDataFrame([(1, r) for r in rings], RINGS)
    got = {r.cell_id for r in factors.inside_polygons(grid(spark, 30, 30), factors.ring_edges(frame)).collect()}
    assert got == {r * 30 + c for r in range(30) for c in range(30) if inside(rings, r, c)}
    spans = factors.row_spans(factors.ring_edges(frame)).collect()
    by_row = {}
    for s in spans:
        assert not any(s.first <= b and a <= s.last for a, b in by_row.setdefault(s.r, []))
        by_row[s.r].append((s.first, s.last))


def test_burned_polygons_are_a_union_of_features(spark):
    rings = shapes(7, 6, 20)
    frame = spark.createDataFrame([(k % 3, r) for k, r in enumerate(rings)], RINGS)
    got = {(r.r, r.c) for r in factors.burn_polygons(frame).collect()}
    want = {(r, c) for r in range(-3, 25) for c in range(-3, 25) if any(inside(rings[k::3], r, c) for k in range(3))}
    assert got == want
    assert factors.burn_polygons(frame.limit(0)).count() == 0 and factors.burn_polygons(spark.createDataFrame([(1, [[0.0, 0.0], [9.0, 9.0]])], RINGS)).count() == 0


def test_a_ring_of_many_corners(spark):
    """100,000 corners in a few rows: as many crossings as edges cross rows, and spans within the circle."""
    n = 100_000
    ring = [[50 + 40 * math.cos(2 * math.pi * k / n), 50 + 40 * math.sin(2 * math.pi * k / n)] for k in range(n)]
    spans = factors.row_spans(factors.ring_edges(spark.createDataFrame([(1, ring)], RINGS))).collect()
    assert len(spans) == 80
    for s in spans:
        half = math.sqrt(1600 - (s.r + 0.5 - 50) ** 2)
        assert -1e-6 < s.first + 0.5 - (50 - half) < 1.001 and -1e-6 < 50 + half - (s.last + 0.5) < 1.001


def test_clip_keeps_all_cells(spark):
    ring = [(1.5, 1.0), (9.0, 3.25), (4.0, 11.0)]
    got = {r.cell_id: r.v for r in factors.clip(grid(spark, 12, 10), ring, "v").collect()}
    assert got == {r * 10 + c: int(inside([ring], r, c)) for r in range(12) for c in range(10)}


def touched(a, b):
    """The cells, with their upper and left borders, that hold a point of a segment, in whole fractions."""
    (x0, y0), (x1, y1) = [[Fraction(v) for v in p] for p in (a, b)]
    out = set()
    for c in range(math.floor(min(x0, x1)), math.floor(max(x0, x1)) + 1):
        for r in range(math.floor(min(y0, y1)), math.floor(max(y0, y1)) + 1):
            low, high, low_open, high_open = Fraction(0), Fraction(1), False, False
            ok = True
            for at, way, k in ((x0, x1 - x0, c), (y0, y1 - y0, r)):
                if way == 0:
                    ok = ok and k <= at < k + 1
                    continue
                enter, leave = (k - at) / way, (k + 1 - at) / way
                e_open, l_open = False, True
                if way < 0:
                    enter, leave, e_open, l_open = leave, enter, True, False
                if (enter, e_open) > (low, low_open):
                    low, low_open = enter, e_open
                if leave < high or (leave == high and l_open):
                    high, high_open = leave, l_open
            if ok and (low < high or (low == high and not low_open and not high_open)):
                out.add((r, c))
    return out


def test_burned_lines_equal_the_cells_of_their_segments(spark):
    rng = np.random.default_rng(5)
    lines = [[[float(x) / 8, float(y) / 8] for x, y in rng.integers(-40, 120, (int(rng.integers(1, 5)), 2))] for _ in range(60)]
    lines += [[[0.0, 0.0], [5.0, 5.0]], [[5.0, 5.0], [0.0, 0.0]], [[0.0, 5.0], [5.0, 0.0]], [[2.0, 1.0], [2.0, 6.0]], [[1.0, 3.0], [7.5, 3.0]], [[3.0, 3.0]], [[1.25, 1.25], [1.25, 1.25]], []]
    for k in range(0, len(lines), 17):
        some = lines[k:k + 17]
        want = set()
        for line in some:
            for a, b in zip(line, line[1:] or line):
                want |= touched(a, b)
        frame = spark.createDataFrame([(n, x) for n, x in enumerate(some)], RINGS)
        assert {(r.r, r.c) for r in factors.burn_lines(frame).collect()} == want


@pytest.mark.parametrize("columns", [1, 7, 64, 1000])
def test_distances_in_blocks_of_columns(spark, columns):
    rng = np.random.default_rng(columns)
    v = (rng.random((11, 130)) < 0.01).astype(int)
    v[5, 3] = v[2, 128] = 1
    got = factors.distance(grid(spark, 11, 130, v), F.col("v") == 1, 1.0, block_rows=4, block_columns=columns).collect()
    where = np.argwhere(v == 1)
    assert len(got) == v.size
    for r in got:
        assert abs(r.distance - math.sqrt(((where - [r.r, r.c]) ** 2).sum(1).min())) < 1e-9


def test_distances_on_long_rows(spark):
    """5,000 columns: blocks of 1,024, of which most have nothing burned."""
    cells = spark.range(3 * 5000).select(F.col("id").alias("cell_id"), F.floor(F.col("id") / 5000).alias("r"), (F.col("id") % 5000).alias("c"))
    burned = ((F.col("r") == 1) & (F.col("c") == 4990)) | ((F.col("r") == 0) & (F.col("c") == 17))
    for r in factors.distance(cells, burned, 2.0).collect():
        assert abs(r.distance - 2 * min(math.hypot(r.r - 1, r.c - 4990), math.hypot(r.r, r.c - 17))) < 1e-9
    assert {r.distance for r in factors.distance(cells, F.lit(False), block_columns=512).collect()} == {None}


def test_windows_at_sampled_cells(spark):
    v = np.random.default_rng(9).choice([0, 1, 2, 8], (40, 23))
    g = grid(spark, 40, 23, v)
    sample = g.filter("cell_id % 7 = 3 OR r = 0")
    for size in (3, 5):
        got = focal.sampled_fractions(g, sample, "v", list(range(1, 10)), size)
        want = focal.neighbour_fractions(g, "v", list(range(1, 10)), size).join(sample.select("cell_id"), "cell_id", "left_semi")
        assert sorted(map(tuple, got.select(*sorted(got.columns)).collect())) == sorted(map(tuple, want.select(*sorted(got.columns)).collect()))
    assert focal.sampled_fractions(g, sample.limit(0), "v", [1]).count() == 0
    with pytest.raises(ValueError):
        focal.sampled_fractions(g, sample, "v", [1], 4)


def test_sampled_windows_equal_neighbour_all(spark):
    d = "/root/testdata/sf0.001"
    rows = catalog.cells(spark, d).filter("cell_id % 41 = 0")
    got = focal.sampled_fractions(catalog.cells(spark, d), rows, "v_base", list(range(1, 10))).select("cell_id", *[F.round(f"frac_{k}", 6) for k in range(1, 10)])
    want = catalog.neighbour_all(spark, d).filter("cell_id % 41 = 0")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and rows.count() > 100


@pytest.mark.parametrize("small", [1 << 16, 4])
def test_percentiles_of_any_spread(spark, monkeypatch, small):
    monkeypatch.setattr(factors, "SMALL", small)
    monkeypatch.setattr(factors, "SLOTS", 16)
    rng = np.random.default_rng(3)
    for x in (rng.normal(size=400), np.append(rng.random(300), 1e9), np.append(1e6 + rng.random(300) * 1e-6, [-1e12, 1e300, -1e300]), rng.integers(-2, 3, 200).astype(float), np.array([5e-324, 0.0, -0.0, 1.7e308, -1.7e308]), np.array([2.0])):
        frame = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double").repartition(3)
        shares = [0.0, 0.02, 0.37, 0.5, 0.98, 1.0]
        assert np.allclose(factors.percentiles(frame, "x", shares), np.quantile(x, shares), rtol=1e-9, atol=0)
    assert factors.percentiles(frame.limit(0), "x", [0.5]) is None


def test_an_outlier_leaves_no_task_with_most_values(spark):
    """Of two million values and one outlier, no task gets more than SMALL rows to order, and few passes are made."""
    frame = spark.range(2_000_000).select(F.when(F.col("id") == 7, 1e9).otherwise(F.rand(5) + 1).alias("x"))
    low, high = factors.percentiles(frame, "x", [0.02, 0.98])
    assert abs(low - 1.02) < 0.002 and abs(high - 1.98) < 0.002

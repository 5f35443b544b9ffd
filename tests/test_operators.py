import numpy as np
import pytest
from pyspark.sql import functions as F

from terramark.functions import expressions as E
from terramark.operators import allocate, crosstab, delta_grid, demand, factors, focal, models, sampling
from terramark.plans import catalog
from terramark.plans.scenario import Scenario, driver_year, forest_stem, weight_code, windows
from terramark.sources import tables
from terramark.sources.grid import PROFILE, Profile

CELLS = "cell_id long, r long, c long, v int"


def grid(spark, array):
    h, w = array.shape
    return spark.createDataFrame([(i * w + j, i, j, int(array[i, j])) for i in range(h) for j in range(w)], CELLS)


@pytest.fixture(scope="module")
def small(spark):
    return np.random.default_rng(1).choice([0, 1, 2, 5, 8], (23, 17), p=[0.1, 0.4, 0.2, 0.1, 0.2])


def test_apportion():
    assert demand.apportion(10, {1: 1, 2: 1, 3: 1}, {1: 2, 2: 20, 3: 20}) == {1: 2, 2: 4, 3: 4}
    assert demand.apportion(2, {1: 0.2, 2: 0.5, 3: 0.3}, {1: 5, 2: 5, 3: 5}) == {1: 0, 2: 2, 3: 0}
    assert demand.apportion(3, {}, {1: 1, 2: 2}) == {1: 1, 2: 2}
    assert demand.apportion(9, {1: 1}, {1: 2, 2: 3}) == {1: 2, 2: 3}
    assert demand.source_weights({1: 3, 2: 4}, {}, 8) == {1: 3.0, 2: 4.0}


def test_rounding_ties(spark):
    p = spark.createDataFrame([(1, k, 1 / 3) for k in (1, 2, 3)], "from_code int, to_code int, p double")
    base = spark.createDataFrame([(1, 10)], "class_code int, n long")
    assert [r.flow for r in demand.rounded_flows(p, base).orderBy("to_code").collect()] == [4, 3, 3]
    assert [r.flow for r in demand.rounded_flows(p, base, ties_high=True).orderBy("to_code").collect()] == [3, 3, 4]


def test_empty_class_stays(spark):
    g = spark.createDataFrame([(0, 1, 2), (1, 1, 1)], "cell_id long, a int, b int")
    p = {(r.from_code, r.to_code): r.p for r in crosstab.transition_probabilities(crosstab.crosstab(g, "a", "b")).collect()}
    assert p[1, 2] == 0.5 and p[9, 9] == 1.0 and p[9, 1] == 0.0


def test_neighbours_across_blocks(spark, small):
    sums = {"n": F.col("v").between(1, 9), "n8": F.col("v") == 8}
    got = {(r.r, r.c): (r.n, r.n8) for r in focal.box_sums(grid(spark, small), sums, 5, block_rows=4).collect()}
    assert len(got) == small.size
    for (i, j), (n, n8) in got.items():
        box = small[max(0, i - 2):i + 3, max(0, j - 2):j + 3]
        assert n == (box > 0).sum() - (small[i, j] > 0) and n8 == (box == 8).sum() - (small[i, j] == 8)
    with pytest.raises(ValueError):
        focal.box_sums(grid(spark, small), sums, 4)
    wide = np.random.default_rng(4).choice([0, 1, 8], (3, 500))
    for r in focal.box_sums(grid(spark, wide), sums, 7, block_rows=2).collect():
        box = wide[max(0, r.r - 3):r.r + 4, max(0, r.c - 3):r.c + 4]
        assert (r.n, r.n8) == ((box > 0).sum() - (wide[r.r, r.c] > 0), (box == 8).sum() - (wide[r.r, r.c] == 8))


def test_gradient_across_blocks(spark, small):
    got = focal.gradient(grid(spark, small), "v", block_rows=4).collect()
    by_row, by_column = np.gradient(small.astype(float))
    assert len(got) == small.size
    for r in got:
        assert abs(r.gradient - np.hypot(by_row[r.r, r.c], by_column[r.r, r.c])) < 1e-12


def test_random_allocation_equals_sorting(spark, small):
    flows = [(1, 1, 90), (1, 2, 7), (1, 5, 0), (1, 8, 500), (2, 8, 3), (2, 2, 1), (5, 5, 10_000), (7, 1, 4)]
    cells = grid(spark, small).withColumn("from_code", F.lit("x"))
    drawn = {r.cell_id: r.d for r in cells.select("cell_id", E.draw(F.col("cell_id"), 42).alias("d")).collect()}
    want = dict.fromkeys(drawn, 0)
    for k in (1, 2, 5, 8):
        order = sorted((i for i in drawn if small.flat[i] == k), key=lambda i: (drawn[i], i))
        targets = [t for f, t, n in sorted(flows) if f == k for _ in range(n)]
        want |= dict(zip(order, targets))
    got = sampling.allocate_random(cells, "v", spark.createDataFrame(flows, "from_code int, to_code int, flow long")).collect()
    assert {r.cell_id: r.allocated for r in got} == want and len(got) == small.size
    assert sampling.allocate_random(cells.limit(0), "v", spark.createDataFrame(flows, "from_code int, to_code int, flow long")).count() == 0


def test_distance_is_exact(spark, small):
    got = factors.distance(grid(spark, small), F.col("v") == 5, 1.0, block_rows=4).collect()
    assert len(got) == small.size
    wide = np.zeros((9, 400), int)
    wide[4, [3, 399]] = 5
    for r in factors.distance(grid(spark, wide), F.col("v") == 5, 2.0, block_rows=2).collect():
        assert abs(r.distance - 2 * min(np.hypot(r.r - 4, r.c - 3), np.hypot(r.r - 4, r.c - 399))) < 1e-9
    where = np.argwhere(small == 5)
    for r in got:
        assert abs(r.distance - np.sqrt(((where - [r.r, r.c]) ** 2).sum(1).min())) < 1e-9
    assert {r.distance for r in factors.distance(grid(spark, small), F.lit(False)).collect()} == {None}


def test_factors(spark):
    flat = grid(spark, np.full((3, 3), 4))
    assert {r.x for r in factors.percentile_normalise(flat, "v", "x").collect()} == {0.0}
    coarse = spark.createDataFrame([(0, 0, 0.0), (0, 1, 1.0), (1, 0, 2.0), (1, 1, 3.0)], "r long, c long, v2 double")
    fine = factors.resample(grid(spark, np.ones((4, 4), int)), coarse, 2.0, "v2").orderBy("cell_id").collect()
    assert fine[0].v2 == 0.0 and abs(fine[5].v2 - (0.25 * 1 + 0.25 * 2 * 1.0)) < 1e-9 and fine[15].v2 == 3.0
    clipped = factors.clip(flat, [(0, 0), (2, 0), (2, 2), (0, 2)], "v").agg(F.sum("v")).first()[0]
    assert clipped == 16
    lines = spark.createDataFrame([(1, [[0.5, 0.5], [2.5, 0.5]])], "feature_id long, coords array<array<double>>")
    assert sorted((r.r, r.c) for r in factors.burn_lines(lines).collect()) == [(0, 0), (0, 1), (0, 2)]
    low = factors.low_slope(grid(spark, np.arange(25).reshape(5, 5)), "v")
    assert low.filter("low_slope between 0 and 1").count() == 25


def test_simulation_meets_demand_and_keeps_nodata(spark, small):
    g = grid(spark, small)
    have = {k: int((small == k).sum()) for k in range(1, 10)}
    goal = have | {1: have[1] - 20, 8: have[8] + 15, 2: have[2] + 5}
    end, log = allocate.simulate(g, "v", goal, {(1, 8): 0.2, (1, 2): 0.1}, iterations=2)
    got = {r.current: r.n for r in end.groupBy("current").agg(F.count("*").alias("n")).collect()}
    assert all(got.get(k, 0) == n for k, n in goal.items()) and got[0] == (small == 0).sum()
    assert end.filter("v = 0 and current != 0").count() == 0 and [x["changed_pixels"] for x in log[::9]] == [11, 9]
    end, log = allocate.simulate_pooled(g, "v", goal, lambda near, _, jitter: E.score_plain(near, jitter), iterations=2)
    assert end.count() == small.size and log[-1]["max_abs_demand_error_pixels"] <= 20


def test_draws_of_any_cell_number(spark):
    ids = [0, 7, 2**31 - 1, 2**31, 9_000_000_000, 2**62]
    got = [r.d for r in spark.createDataFrame([(i,) for i in ids], "cell_id long").select(E.draw(F.col("cell_id"), 42, 3).alias("d")).collect()]
    want = [((i * 1103515245 + 12345 + 42 * 7919 + 3 * 104729) % 2**31 * 48271 + 3) % (2**31 - 1) / (2**31 - 1) for i in ids]
    assert got == want


def test_best_rows_by_slot(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(1, 4)), float(rng.choice([0.1, 0.25, 0.5, rng.random()]))) for i in range(3000)]
    frame = spark.createDataFrame(rows, "cell_id long, current int, __score double").repartition(5)
    take = {1: 100, 2: 5000, 3: 0}
    got = {r.cell_id for r in delta_grid.best(frame, F.col("current"), take).collect()}
    want = {i for k, n in take.items() for i, _, _ in sorted((r for r in rows if r[1] == k), key=lambda r: (-r[2], r[0]))[:n]}
    assert got == want


def test_pool_falls_back_when_no_unchanged_surplus_cell_is_left(spark):
    """One cell above demand is used up for class 2; class 3 then takes from any other class."""
    g = grid(spark, np.array([[1, 4, 4, 4]]))
    goal = {1: 0, 2: 1, 3: 1, 4: 2}
    end, log = allocate.simulate_pooled(g, "v", goal, lambda near, _, jitter: near + jitter, iterations=1, size=3)
    got = sorted(r.current for r in end.collect())
    assert got == [2, 3, 4, 4] and end.columns == ["cell_id", "r", "c", "v", "current"]
    goal = {1: 0, 2: 1, 3: 1, 4: 3}
    end, log = allocate.simulate_pooled(g, "v", goal, lambda near, _, jitter: near + jitter, iterations=1, size=3)
    assert sorted(r.current for r in end.collect()) == [2, 3, 4, 4] and log[0]["max_abs_demand_error_pixels"] == 1


def test_samples_by_slot(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 4)), int(rng.integers(1, 3))) for i in range(2000)]
    frame = spark.createDataFrame(rows, "cell_id long, a int, b int").repartition(3)
    drawn = {r.cell_id: r.d for r in frame.select("cell_id", E.draw(F.col("cell_id"), 42).alias("d")).collect()}
    got = {r.cell_id for r in sampling.stratified(frame, "a", "b", 40, 300).collect()}
    want = set()
    for a in (1, 2, 3):
        for b in (1, 2):
            want |= set(sorted((i for i, x, y in rows if (x, y) == (a, b)), key=lambda i: (drawn[i], i))[:300 if a == b else 40])
    assert got == want
    assert sampling.stratified(frame.limit(0), "a", "b").count() == 0


def test_percentiles_equal_sorting(spark):
    rng = np.random.default_rng(8)
    for x in (rng.normal(size=501), np.array([3.0]), rng.integers(0, 3, 90).astype(float), np.append(rng.random(200), 1e9)):
        frame = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double").repartition(3)
        assert np.allclose(factors.percentiles(frame, "x", [0.02, 0.5, 0.98, 1.0]), np.quantile(x, [0.02, 0.5, 0.98, 1.0]), rtol=1e-12)
    assert factors.percentiles(frame.limit(0), "x", [0.5]) is None


def test_polygons_and_boxes(spark):
    g = grid(spark, np.ones((12, 9), int))
    rings = spark.createDataFrame([([[1.0, 1.0], [8.0, 1.0], [8.0, 11.0], [1.0, 11.0]],), ([[3.0, 3.0], [6.0, 3.0], [6.0, 7.0], [3.0, 7.0]],)], "coords array<array<double>>")
    inside = factors.inside_polygons(g, factors.ring_edges(rings))
    want = {r * 9 + c for r in range(1, 11) for c in range(1, 8) if not (3 <= r < 7 and 3 <= c < 6)}
    assert {r.cell_id for r in inside.collect()} == want
    cut = factors.crop(g, inside, "v").collect()
    assert len(cut) == 70 and sum(r.v for r in cut) == len(want)
    features = spark.createDataFrame([(1, [[0.0, 0.0], [2.0, 2.0]]), (2, [[9.0, 9.0]]), (3, []), (4, None)], "feature_id long, coords array<array<double>>")
    assert [r.feature_id for r in factors.within(features, (1.0, 1.0, 3.0, 3.0)).collect()] == [1]


def test_one_vs_rest_adds_up_to_one(spark):
    rng = np.random.default_rng(2)
    rows = [(float(x), float(y), float(1 + (x > 0) + 3 * (y > 1))) for x, y in rng.normal(size=(200, 2))]
    frame = spark.createDataFrame(rows, "x double, y double, label double")
    trained = models.train_one_vs_rest(frame, ["x", "y"], "label")
    got = models.one_vs_rest_probabilities(frame, trained).toPandas()
    p = got[[f"p_{k}" for k in range(1, 10)]].to_numpy()
    assert np.allclose(p.sum(axis=1), 1) and (p[:, 5:] == 0).all() and (p.argmax(axis=1) + 1 == got.label).mean() > 0.8


def test_forest_weights(spark):
    rows = [(float(i % 7), 1.0 if i % 10 else 2.0, 1.0 + i % 3) for i in range(300)]
    frame = spark.createDataFrame(rows, "x double, label double, w double")
    share = {k: models.with_probabilities(frame.limit(1), models.train_forest(frame, ["x"], "label", trees=5, depth=1, weight="w", class_weight=k)).first().p_2 for k in (None, "balanced")}
    assert share["balanced"] > 0.3 > share[None]
    for bad in ({"class_weight": "none"}, {"depth": 31}, {"leaf": 0}):
        with pytest.raises(ValueError):
            models.train_forest(frame, ["x"], "label", **bad)


def test_split_and_weights(spark):
    rows = spark.createDataFrame([(i, i % 2, 1, i % 4 + 1) for i in range(80)], "cell_id long, label int, a int, b int")
    got = sampling.split(rows, "label").groupBy("label", "validation").count().collect()
    assert {(r.label, r.validation): r["count"] for r in got} == {(0, False): 30, (0, True): 10, (1, False): 30, (1, True): 10}
    w = sampling.transition_weights(rows, rows.filter("cell_id < 20"), "a", "b")
    weighted = sampling.with_weights(rows, w, "a", "b").agg(F.avg("train_weight"), F.min("weight")).first()
    assert abs(weighted[0] - 1) < 1e-9 and weighted[1] == 4.0


def test_scenario():
    s = Scenario(2015, 2020, 2025, neighbour_weight=0.65, other_weight=0.125)
    assert s.stem("ca") == "ca_fit_2015_2020_predict_2025_n5_i5_nw065_sw12p5" and weight_code(1.0) == "100"
    assert s.plain_stem("markov") == "markov_fit_2015_2020_predict_2025" and s.plain_stem("logistic_ca") == "logistic_ca_fit_2015_2020_predict_2025_n5_i5"
    assert forest_stem(2015, 2020, 2020) == "rf_fit_2015_2020_driver2020_n5_sampseed42_rf300_depthnone_leaf1_wtransition_trainseed42"
    assert windows([2010, 2000, 2005, 2015]) == [(2000, 2005, 2010), (2005, 2010, 2015)]
    assert driver_year({2020}, 2025, 2020)[0] == 2020
    for bad in ({"size": 4}, {"iterations": 0}, {"neighbour_weight": 0, "other_weight": 0}):
        with pytest.raises(ValueError):
            Scenario(1, 2, 3, **bad)
    moved = Profile(PROFILE.width, PROFILE.height, PROFILE.crs, (30.0, 0.0, 1e-12, 0.0, -30.0, 0.0))
    assert PROFILE.aligned(moved) and not PROFILE.aligned(moved, exact=True) and abs(PROFILE.pixel_area_km2() - 0.0009) < 1e-12


def test_source_discovery(spark, tmp_path):
    profile = Profile(4, 3, "EPSG:32651", (30.0, 0.0, 1.0, 0.0, -30.0, 2.0))
    tables.write_profile(spark, profile, str(tmp_path / "night_2020.json"))
    assert tables.read_profile(spark, str(tmp_path / "night_2020.json")) == profile
    tables.write_profile(spark, profile, str(tmp_path / "night_2020_b.json"))
    assert tables.find_one(spark, f"{tmp_path}/*2019*", f"{tmp_path}/*2020.json").endswith("night_2020.json")
    assert tables.find_one(spark, f"{tmp_path}/*2020*", first=True).endswith("night_2020.json")
    with pytest.raises(ValueError, match="2 files"):
        tables.find_one(spark, f"{tmp_path}/*2020*")
    with pytest.raises(FileNotFoundError):
        tables.find_one(spark, f"{tmp_path}/*2019*")
    features = spark.createDataFrame([("Alpha", None, "1"), (None, "ALPHA", None), ("Beta", "b", "7"), (None, None, None)], "a string, b string, code string")
    assert tables.boundary(features, "alpha", ("a", "b")).count() == 2
    assert tables.boundary(features, "alpha", ("a", "b"), "7").count() == 3


def test_matrices_leave_out_other_codes(spark):
    cells = spark.createDataFrame([(1, 1), (1, 0), (0, 2), (2, 17), (None, 1), (1, None), (9, 9)], "a int, b int")
    got = {(r.from_code, r.to_code): r.n for r in crosstab.crosstab(cells, "a", "b").collect()}
    assert len(got) == 81 and {k: n for k, n in got.items() if n} == {(1, 1): 1, (9, 9): 1}
    assert {r.class_code: r.n for r in crosstab.class_counts(cells, "b").collect() if r.n} == {1: 2, 2: 1, 9: 1}


def test_tables(spark, small, tmp_path):
    g = grid(spark, small)
    tables.write_cells(g, f"{tmp_path}/g", block_rows=4)
    assert tables.read_cells(spark, f"{tmp_path}/g", (5, 9), 4).count() == 4 * 17
    with pytest.raises(Exception, match="(?i)already exists"):
        tables.write_cells(g, f"{tmp_path}/g")
    tables.write_report(spark.createDataFrame([(1, 0.5), (2, None)], "k int, x double"), f"{tmp_path}/r")
    assert [(r.k, r.x) for r in tables.read_report(spark, f"{tmp_path}/r").orderBy("k").collect()] == [(1, 0.5), (2, None)]
    assert tables.read_typed(spark, f"{tmp_path}/r", "k int, x double").orderBy("k").first().x == 0.5
    tables.write_samples(g.select(F.col("v").alias("from_class"), F.col("v").alias("to_class")), f"{tmp_path}/s")
    assert tables.read_samples(spark, f"{tmp_path}/s").count() == small.size
    with pytest.raises(ValueError, match="samples without"):
        tables.read_samples(spark, f"{tmp_path}/s", ("label",))
    made = []
    make = lambda: made.append(1) or g
    assert [tables.cached(spark, f"{tmp_path}/c", make).count() for _ in range(2)] == [small.size] * 2 and made == [1]
    assert tables.cached(spark, f"{tmp_path}/none", lambda: None) is None and tables.cached(spark, f"{tmp_path}/c", make, skip=True) is None
    tables.write_profile(spark, PROFILE, f"{tmp_path}/p")
    assert tables.read_aligned(spark, f"{tmp_path}/c", f"{tmp_path}/p", PROFILE).count() == small.size
    with pytest.raises(ValueError, match="another grid"):
        tables.read_aligned(spark, f"{tmp_path}/c", f"{tmp_path}/p", Profile(1, 1, "x", PROFILE.transform))
    tables.write_metadata(spark, {"a": [1]}, f"{tmp_path}/m")
    with pytest.raises(Exception, match="(?i)already exists"):
        tables.write_metadata(spark, {"a": [1]}, f"{tmp_path}/m")
    with pytest.raises(ValueError, match="metadata without"):
        tables.read_metadata(spark, f"{tmp_path}/m", ("features",))
    assert tables.read_metadata(spark, f"{tmp_path}/m") == {"a": [1]}
    odd = spark.createDataFrame([(float("nan"),), (-9999.0,), (None,), (2.0,), (0.4,)], "x double").select(tables.clean_factor("x").alias("x"))
    assert [r.x for r in odd.collect()] == [0.0, 0.0, 0.0, 1.0, 0.4]


@pytest.mark.parametrize("name", ["distance_to_barren", "pooled_simulation", "suitability_simulation", "logistic_coefficients", "forest_importance", "one_vs_rest"])
def test_other_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("name", ["forest_simulation", "logistic_simulation"])
def test_simulated_maps(spark, name):
    """Cells stay what and how many they are, NoData stays, and the forest's run meets its demand."""
    rows = catalog.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    g = catalog.cells(spark, "/root/testdata/sf0.001")
    assert len(rows) == g.count() and rows.cell_id.is_unique
    assert ((rows.v_base == 0) == (rows.predicted == 0)).all() and rows.predicted.between(0, 9).all()
    goal, _ = catalog._goal(g)
    counts = rows.predicted.value_counts()
    off = max(abs(counts.get(k, 0) - n) for k, n in goal.items())
    assert off == 0 if name == "forest_simulation" else off < 0.01 * len(rows)


def test_allocated_counts_equal_the_map(spark):
    """Without a pass over the map: slots are whole or read again, classes may have fewer or more cells than their flows."""
    rng = np.random.default_rng(6)
    rows = [(i, int(rng.choice([0, 1, 2, 5])), int(rng.integers(0, 4))) for i in range(6000)]
    cells = spark.createDataFrame(rows, "cell_id long, v int, w int").repartition(3)
    n = {k: sum(v == k for _, v, _ in rows) for k in (1, 2, 5)}
    for flows in ([(1, 1, n[1] - 100), (1, 2, 60), (1, 8, 40), (2, 8, n[2])], [(1, 2, 5), (1, 3, 1), (2, 2, n[2] + 50), (5, 1, 1), (5, 4, n[5] - 2), (7, 1, 3)], []):
        frame = spark.createDataFrame(flows, "from_code int, to_code int, flow long")
        counts = sampling.drawn_counts(cells, "v", 42, "w")
        got = {(r.allocated, r.v, r.w): r.n for r in sampling.allocated_counts(cells, "v", frame, counts, ["w"]).collect()}
        want = {(r.allocated, r.v, r.w): r.n for r in sampling.allocate_random(cells, "v", frame).groupBy("allocated", "v", "w").agg(F.count("*").alias("n")).collect()}
        assert got == want


def test_samples_cut_to_a_total_and_their_report(spark):
    rows = [(i, 1 + i % 3, 1 + i % 2) for i in range(900)] + [(1000, 0, 1), (1001, 1, 17)]
    frame = spark.createDataFrame(rows, "cell_id long, a int, b int")
    draws = {s: {r.cell_id: r.d for r in frame.select("cell_id", E.draw(F.col("cell_id"), s).alias("d")).collect()} for s in (42, 43)}
    first = [i for a in (1, 2, 3) for b in (1, 2) for i in sorted((i for i, x, y in rows if (x, y) == (a, b)), key=lambda i: (draws[42][i], i))[:90 if a == b else 30]]
    want = set(sorted(first, key=lambda i: (draws[43][i], i))[:200])
    sample = sampling.stratified(frame, "a", "b", 30, 90, total_cap=200)
    assert {r.cell_id for r in sample.collect()} == want
    report = {(r.from_code, r.to_code): r for r in sampling.sample_report(frame, sample, "a", "b").collect()}
    assert len(report) == 81 and sum(r.sampled_pixels for r in report.values()) == 200 and report[1, 1].is_stay == "yes" and report[1, 2].is_stay == "no"
    assert report[1, 1].available_pixels == 150 and report[9, 9].available_pixels == 0 and report[2, 1].from_name == "Forest"
    assert sampling.stratified(frame, "a", "b", 0, 5).filter("a != b").count() == 0 and sampling.stratified(frame, "a", "b", 0, 5).count() == 10


def test_top_cells_by_slot(spark):
    rng = np.random.default_rng(12)
    rows = [(i, int(rng.integers(1, 4)), float(rng.choice([0.2, 0.2000001, rng.random()]))) for i in range(2000)]
    frame = spark.createDataFrame(rows, "cell_id long, v int, s double").repartition(4)
    quotas = spark.createDataFrame([(1, 150), (2, 5000), (4, 3)], "class_code int, take int")
    got = sampling.top_per_source(frame, "v", "s", quotas)
    want = {i for k, n in ((1, 150), (2, 5000)) for i, _, _ in sorted((r for r in rows if r[1] == k), key=lambda r: (-r[2], r[0]))[:n]}
    assert {r.cell_id for r in got.collect()} == want and got.columns == frame.columns


def test_split_orders_no_label(spark):
    """The share of each label by draw, as sorting gives it; a label of one row puts all rows together."""
    rows = [(i, 1 if i < 600 else 2) for i in range(640)]
    frame = spark.createDataFrame(rows, "cell_id long, label int").repartition(3)
    drawn = {r.cell_id: r.d for r in frame.select("cell_id", E.draw(F.col("cell_id"), 42, 1).alias("d")).collect()}
    for some in (rows, rows[:601]):
        groups = [[i for i, k in some if k == 1], [i for i, k in some if k == 2]] if len(some) > 601 else [[i for i, _ in some]]
        train = {i for g in groups for i in sorted(g, key=lambda i: (drawn[i], i))[:round(len(g) * 0.75)]}
        got = sampling.split(frame.filter(F.col("cell_id") < len(some)), "label").collect()
        assert {r.cell_id for r in got if not r.validation} == train and len(got) == len(some)

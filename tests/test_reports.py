"""Report tables in their fixed columns, out-of-bag votes, factor sets, colours, payloads and logs."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from terramark.functions import expressions as E
from terramark.operators import crosstab, factors, models, report, sampling
from terramark.plans import catalog
from terramark.plans.scenario import Scenario, run_log
from terramark.sources import ascii_grid

DATA = "/root/testdata/sf0.001"


def test_summary_and_log_tables(spark):
    confusion = spark.createDataFrame([(a, b, 10 if a == b else 1) for a in (1, 2) for b in (1, 2)], "from_code int, to_code int, n long")
    got = report.summary_table(spark, "city", Scenario(2015, 2020, 2025), "out/map", 3, crosstab.accuracy(confusion))
    assert got.columns == ["city", "mode", "has_observed_target", "fit_from", "base_year", "target_year", "neighborhood_size", "iterations", "random_weight", "overall_accuracy", "kappa",
                           "total_pixels", "max_abs_demand_error_pixels", "output_raster"]
    assert tuple(got.first()) == ("city", "validation", "yes", 2015, 2020, 2025, 5, 5, 0.03, "0.909091", "0.818182", 22, 3, "out/map")
    assert tuple(report.summary_table(spark, "city", Scenario(2015, 2020, 2030), "o", 0).first())[1:3] + tuple(report.summary_table(spark, "c", Scenario(1, 2, 3), "o", 0).first())[9:12] == ("projection", "no", None, None, None)
    log = report.log_table(spark.createDataFrame([(1, 7, 2, 5, 6, -1), (1, 7, 1, 9, 8, 1)], "iteration int, changed_pixels long, class_code int, predicted_pixels long, demand_pixels long, difference_pixels long"))
    assert log.columns == ["iteration", "changed_pixels", "class_code", "class_name", "predicted_pixels", "markov_demand_pixels", "difference_pixels"]
    assert [tuple(r) for r in log.collect()] == [(1, 7, 1, "Cropland", 9, 8, 1), (1, 7, 2, "Forest", 5, 6, -1)]


def test_metrics_equal_their_formulas(spark):
    rng = np.random.default_rng(1)
    rows = [(int(a), int(a if rng.random() < 0.7 else rng.integers(1, 4)), float(w)) for a, w in zip(rng.integers(1, 4, 300), rng.integers(1, 9, 300))]
    got = report.metrics_table(spark.createDataFrame(rows, "a int, b int, w double"), "validation", "a", "b", "w")
    assert got.columns == ["split", "sample_count", "weighted_pixel_count", "overall_accuracy", "weighted_overall_accuracy", "kappa", "weighted_kappa", "macro_f1", "weighted_f1"]
    r = got.first()
    hit, w = np.array([a == b for a, b, _ in rows]), np.array([w for *_, w in rows])
    assert (r.sample_count, r.weighted_pixel_count) == (300, f"{w.sum():.6f}")
    assert r.overall_accuracy == f"{hit.mean():.6f}" and r.weighted_overall_accuracy == f"{(hit * w).sum() / w.sum():.6f}"
    share = lambda k, i: sum(x[2] for x in rows if x[i] == k) / w.sum()
    chance = sum(share(k, 0) * share(k, 1) for k in (1, 2, 3))
    assert abs(float(r.weighted_kappa) - ((hit * w).sum() / w.sum() - chance) / (1 - chance)) < 1e-6


def test_model_tables(spark):
    got = report.importance_table(spark, [(1, "b", 0.75), (2, "a", 0.25)])
    assert [tuple(r) for r in got.collect()] == [(1, "b", "0.75000000"), (2, "a", "0.25000000")]
    got = report.coefficients_table(spark, [(8, "x", -0.5)])
    assert got.columns == ["target_class_code", "target_class_name", "feature", "coefficient"] and tuple(got.first()) == (8, "Impervious", "x", "-0.50000000")
    per = crosstab.per_class_accuracy(spark.createDataFrame([(1, 1, 4), (1, 2, 1), (2, 2, 5)], "from_code int, to_code int, n long"))
    both = report.tagged({"one": per, "two": per}).filter("class_code = 2").orderBy("model").collect()
    assert [(r.model, r.class_name, round(r.precision, 6), r.recall) for r in both] == [("one", "Forest", 0.833333, 1.0), ("two", "Forest", 0.833333, 1.0)]


def test_payload_comes_back(spark, tmp_path):
    frame = spark.createDataFrame([(2, "b", None), (1, "ä", 0.5)], "k int, name string, x double")
    report.payload(spark, {"title": "T"}, f"{tmp_path}/p", areas=(frame, ["k"]), empty=(frame.limit(0), ["k"]))
    want = {"meta": {"title": "T"}, "areas": [{"k": 1, "name": "ä", "x": 0.5}, {"k": 2, "name": "b", "x": None}], "empty": []}
    assert report.read_payload(spark, f"{tmp_path}/p") == want
    with open(f"{tmp_path}/data.js", "w") as f:
        f.write("window.DATA = " + json.dumps(want, indent=1) + ";\n")
    assert report.read_payload(spark, f"{tmp_path}/data.js") == want
    with pytest.raises(Exception, match="(?i)exists"):
        report.payload(spark, {}, f"{tmp_path}/p")


def test_ramp(spark):
    stops = [(0.0, (0, 0, 0)), (0.5, (100, 200, 50)), (1.0, (255, 255, 255))]
    rows = spark.createDataFrame([(-1.0,), (0.0,), (0.25,), (0.5,), (0.75,), (2.0,), (None,), (float("nan"),)], "x double")
    got = [r.c for r in rows.select(E.ramp(F.col("x"), stops).alias("c")).collect()]
    assert got == ["#000000", "#000000", "#326419", "#64c832", "#b2e499", "#ffffff", None, None]


def test_draws_of_trees_are_poisson(spark):
    got = spark.range(200_000).select(models.poisson_weight(F.col("id"), 42, 3).alias("w")).groupBy("w").count().collect()
    share = {r.w: r["count"] / 200_000 for r in got}
    for k, p in enumerate([0.3679, 0.3679, 0.1839, 0.0613]):
        assert abs(share[float(k)] - p) < 0.01


def test_draws_of_trees_are_not_bound_to_a_sample(spark):
    """A sample has the least draws of its cells; each tree still draws each row for itself."""
    rows = spark.range(4_000_000).filter(E.draw(F.col("id"), 42) < 0.001)
    n, *zeros = rows.agg(F.count("*"), *[F.avg((models.poisson_weight(F.col("id"), 42, t) == 0).cast("int")) for t in range(10)]).first()
    assert 3000 < n < 5000 and all(abs(z - 0.3679) < 0.04 for z in zeros)
    both = rows.agg(F.avg(((models.poisson_weight(F.col("id"), 42, 0) == 0) & (models.poisson_weight(F.col("id"), 42, 1) == 0)).cast("int"))).first()[0]
    assert abs(both - 0.3679 ** 2) < 0.03


def test_out_of_bag_is_near_to_held_out(spark):
    """On the test grid's sample, within 0.02 of the accuracy of rows that no tree was given."""
    rows = catalog._model_sample(spark, DATA)
    sample, names = models.forest_features(rows, "v_fit")
    parts = spark.createDataFrame(sampling.split(sample.select("cell_id", "label", *names), "label", 0.4).toPandas())
    train, held = parts.filter("NOT validation"), parts.filter("validation")
    trees = models.train_bagged(train, names, "label", trees=12, depth=6)
    voted = models.out_of_bag(train, trees, "label", at_once=5)
    seen = voted.agg(F.avg((F.col("votes") > 0).cast("int")), F.avg("votes")).first()
    assert seen[0] > 0.99 and 4.0 < seen[1] < 4.9  # each tree leaves out 0.37 of the rows
    p = [F.col(f"p_{k}") for k in range(1, 10)]
    total = held
    for t, m in enumerate(trees):
        total = models.with_probabilities(total, m).withColumns({f"s{t}_{k + 1}": x for k, x in enumerate(p)}).drop(*[f"p_{k}" for k in range(1, 10)])
    sums = F.array(*[sum((F.col(f"s{t}_{k}") for t in range(len(trees))), F.lit(0.0)) for k in range(1, 10)])
    accuracy = total.agg(F.avg((F.array_position(sums, F.array_max(sums)) == F.col("label")).cast("double"))).first()[0]
    assert abs(models.out_of_bag_score(voted, "label") - accuracy) < 0.02
    assert models.out_of_bag_score(voted.limit(0), "label") is None


def test_factor_sets(spark, tmp_path):
    cells = spark.createDataFrame([(r * 9 + c, r, c) for r in range(12) for c in range(9)], "cell_id long, r long, c long")
    features = spark.createDataFrame([(1, "polygon", [[1.0, 1.0], [3.0, 1.0], [3.0, 3.0], [1.0, 3.0]]), (2, "line", [[8.5, 0.5], [8.5, 11.5]])], "feature_id long, kind string, coords array<array<double>>")
    made = []

    def water():
        made.append("water")
        return factors.vector_closeness(cells, features, 1000.0, name="water")

    makers = {"water": water, "road": lambda: factors.vector_closeness(cells, features.limit(0), 1500.0, name="road"), "night": lambda: made.append("night")}
    for _ in range(2):
        got = factors.factor_set(cells, makers, str(tmp_path), skip={"night"})
        assert got.columns == ["cell_id", "r", "c", "water"]
        burned = [(r, c) for r in (1, 2) for c in (1, 2)] + [(r, 8) for r in range(12)]
        for x in got.collect():
            d = 30 * min(np.hypot(x.r - r, x.c - c) for r, c in burned)
            assert abs(x.water - np.exp(-d / 1000)) < 1e-12
    assert made == ["water"]


def test_unzipped_once_and_log(tmp_path):
    path = f"{tmp_path}/g.asc.gz"
    with gzip.open(path, "wt") as f:
        f.write("ncols 1\nnrows 1\ncellsize 1\n5\n")
    found = ascii_grid.unzipped(path, f"{tmp_path}/cache")
    assert found == f"{tmp_path}/cache/g.asc" and ascii_grid.read_header(found).rows == 1
    with gzip.open(path, "wt") as f:
        f.write("changed")
    assert ascii_grid.read_header(ascii_grid.unzipped(path, f"{tmp_path}/cache")).rows == 1 and ascii_grid.unzipped("x.asc", "y") == "x.asc"
    for k in range(2):
        run_log("test", f"{tmp_path}/log").info("message %d", k)
    with open(f"{tmp_path}/log") as f:
        assert [x.strip().split(" ", 2)[2] for x in f] == ["message 0", "message 1"]


def test_five_models_in_one_frame(spark, monkeypatch):
    """Each model's frame equals the report of its own map; here the maps are made by rules, so that the test is short."""
    for k, name in enumerate(("ca_markov_map", "suitability_map", "logistic_simulation", "forest_simulation")):
        monkeypatch.setattr(catalog, name, lambda s, d, k=k: catalog.cells(s, d).select("cell_id", F.when(F.col("cell_id") % 5 == k, 1).otherwise(F.col("v_base")).alias("predicted")))
    got = catalog.class_accuracy_union(spark, DATA).collect()
    by_model = {m: {r.class_code: r for r in got if r.model == m} for m in {r.model for r in got}}
    assert sorted(by_model) == ["CA-Markov", "CA-Markov suitability", "Logistic-CA", "Markov baseline", "RF-CA"] and all(len(x) == 9 for x in by_model.values())
    want = {r.class_code: (r.user_accuracy, r.producer_accuracy, r.f1_score) for r in catalog.per_class_accuracy(spark, DATA).collect()}
    assert {k: (r.precision, r.recall, r.f1_score) for k, r in by_model["Markov baseline"].items()} == want
    g = catalog.cells(spark, DATA).select("cell_id", "v_base", "v_target").toPandas()
    for n, model in enumerate(("CA-Markov", "CA-Markov suitability", "Logistic-CA", "RF-CA")):
        p = g.v_base.where(g.cell_id % 5 != n, 1)
        both = g.v_target.between(1, 9) & p.between(1, 9)
        for k, r in by_model[model].items():
            hit = ((g.v_target == k) & (p == k) & both).sum()
            for value, of in ((r.precision, ((p == k) & both).sum()), (r.recall, ((g.v_target == k) & both).sum())):
                assert abs(value - (hit / of if of else 0.0)) < 1e-6


def test_out_of_bag_query(spark):
    r = catalog.out_of_bag_accuracy(spark, DATA).first()
    assert r.split == "out_of_bag" and 0.5 < float(r.overall_accuracy) < 1 and r.sample_count > 5000 and float(r.weighted_pixel_count) >= r.sample_count

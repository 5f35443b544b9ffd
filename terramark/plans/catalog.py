"""The queries over the test grid, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..operators import allocate, crosstab, demand, factors, focal, models, report, sampling
from ..sources import scratch, tables
from ..sources.grid import CLASS_SQL, GRID_SQL, WIDTH, cells
from . import scenario

KM2 = 0.0009
#: Caps of the samples: changed and unchanged pairs; cells of a class, changed cells.
CHANGE_CAP, STAY_CAP, PER_CLASS, CHANGED = 8000, 8000, 40_000, 100_000
#: Cells of the stratified sample at most, where it is cut to a total; seed of the draws.
TOTAL_CAP, SEED = 20_000, 42
#: The same of the models of one class against all others.
OWN_PER_CLASS, OWN_CHANGED = 20_000, 60_000


def _local(df: DataFrame) -> DataFrame:
    """A frame of classes (a thousand rows at most) as a local relation, so that it is computed once."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def _census(g: DataFrame) -> DataFrame:
    """(v_fit, v_base, v_target, n): every count of classes that the reports need, in one pass."""
    return _local(g.groupBy("v_fit", "v_base", "v_target").agg(F.count("*").alias("n")))


def _transition(g: DataFrame) -> DataFrame:
    return crosstab.transition_probabilities(crosstab.crosstab(g, "v_fit", "v_base"))


def _slots(g: DataFrame) -> DataFrame:
    """(slot, v_base, v_fit, v_target, n), written: census, flows and cuts all come from this one pass."""
    path = scratch.folder(g.sparkSession, "slots")
    return scratch.written(sampling.drawn_counts(g, "v_base", SEED, "v_fit", "v_target"), path)


def _flows(census: DataFrame) -> DataFrame:
    p = crosstab.transition_probabilities(crosstab.crosstab(census, "v_fit", "v_base", "n"))
    return demand.rounded_flows(p, crosstab.class_counts(census, "v_base", weight="n"))


def _demand(g: DataFrame) -> tuple[DataFrame, DataFrame]:
    flows = _flows(_census(g))
    return flows, demand.markov_demand(flows)


def _predicted(g: DataFrame) -> DataFrame:
    """Every cell with its class by the non-spatial model."""
    slots = _slots(g)
    return sampling.allocate_random(g, "v_base", _local(_flows(_summed(slots))), SEED, slots)


def _summed(slots: DataFrame) -> DataFrame:
    return _local(slots.groupBy("v_fit", "v_base", "v_target").agg(F.sum("n").alias("n")))


def _predicted_counts(g: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(allocated, v_base, v_target, n), flows and census: the same counted, from one pass and the slots in which flows end."""
    slots = _slots(g)
    census = _summed(slots)
    flows = _local(_flows(census))
    return _local(sampling.allocated_counts(g, "v_base", flows, slots, ["v_target"], SEED)), flows, census


def class_counts(s, d):
    return crosstab.class_counts(cells(s, d), "v_base")


def class_summary(s, d):
    return crosstab.class_summary(cells(s, d), {2015: "v_fit", 2020: "v_base", 2025: "v_target"})


def transition_counts(s, d):
    return crosstab.crosstab(cells(s, d), "v_fit", "v_base")


def transition_probabilities(s, d):
    return _transition(cells(s, d)).select("from_code", "to_code", F.round("p", 8).alias("p"))


def transition_series(s, d):
    g = cells(s, d)
    parts = [crosstab.crosstab(g, a, b).withColumn("from_year", F.lit(y)) for a, b, y in (("v_fit", "v_base", 2015), ("v_base", "v_target", 2020))]
    return parts[0].unionByName(parts[1])


def rounded_flows(s, d):
    return _demand(cells(s, d))[0]


def markov_demand(s, d):
    return _demand(cells(s, d))[1]


def nonspatial_allocation(s, d):
    return _predicted(cells(s, d)).select("cell_id", "v_base", "allocated")


def confusion(s, d):
    return crosstab.crosstab(_predicted_counts(cells(s, d))[0], "v_target", "allocated", "n")


def accuracy(s, d):
    out = crosstab.accuracy(confusion(s, d))
    return out.select(F.col("total").cast("long").alias("total"), *[F.round(c, 6).alias(c) for c in ("overall_accuracy", "kappa", "macro_f1", "weighted_f1")])


def per_class_accuracy(s, d):
    out = crosstab.per_class_accuracy(confusion(s, d))
    return out.select("class_code", "actual_pixels", "predicted_pixels", "correct_pixels", *[F.round(c, 6).alias(c) for c in ("producer_accuracy", "user_accuracy", "f1_score")])


def row_percent(s, d):
    return crosstab.row_percent(confusion(s, d)).select("from_code", "to_code", F.round("percent", 6).alias("percent"))


def area_projection(s, d):
    predicted, flows, census = _predicted_counts(cells(s, d))
    known = {c: crosstab.class_counts(census, c, weight="n") for c in ("v_base", "v_target")}
    return crosstab.area_projection(crosstab.class_counts(predicted, "allocated", weight="n"), known["v_base"], demand.markov_demand(flows), known["v_target"], KM2)


def max_demand_error(s, d):
    return crosstab.max_demand_error(area_projection(s, d))


def change_maps(s, d):
    return _predicted(cells(s, d)).select("cell_id", E.agreement("v_target", "allocated").alias("agreement"), E.two_models("v_target", "v_base", "allocated").alias("two_models"), E.change("v_base", "allocated").alias("change"))


def _thin(s: SparkSession, d: str, *more: Column) -> DataFrame:
    """What neighbourhoods need of the cells: every column that a cell has with it is shuffled."""
    return cells(s, d, in_order=True).select("cell_id", "r", "c", "v_base", *more)


def neighbour_fraction(s, d):
    return focal.neighbour_fractions(_thin(s, d), "v_base", [8]).select("cell_id", "n_valid", F.round("frac_8", 6).alias("frac_8"))


def same_class_support(s, d):
    return focal.same_class_support(_thin(s, d), "v_base").select("cell_id", F.round("support", 6).alias("support"))


def gradient_slope(s, d):
    return focal.gradient(cells(s, d), "elevation").select("cell_id", F.round("gradient", 6).alias("gradient"))


def percentile_normalised(s, d):
    return factors.percentile_normalise(cells(s, d), "elevation", "elevation_norm").select("cell_id", F.round("elevation_norm", 6).alias("elevation_norm"))


def factor_summary(s, d):
    return crosstab.factor_summary(cells(s, d), "road", "water", "night")


def suitability_maps(s, d):
    found = E.suitability(E.valid("v_base"), "slope", "road", "water", "night")
    return cells(s, d).select("cell_id", *[F.round(x, 6).alias(f"suit_{k}") for k, x in found.items()])


def distance_to_barren(s, d):
    """Exact distance to the nearest barren cell, and closeness."""
    g = factors.distance(_thin(s, d), F.col("v_base") == 7)
    return g.select("cell_id", F.round("distance", 4).alias("distance"), F.round(factors.closeness("distance", 1000.0), 6).alias("closeness"))


def preview(s, d):
    """The whole grid with at most 500 cells on its longer side."""
    g = cells(s, d)
    last = g.agg(F.max("r")).first()[0]
    return tables.preview(g, 1 if last is None else last + 1, WIDTH, 500).select("pr", "pc", "cell_id", "v_base")


def stratified_sample(s, d):
    return sampling.stratified(cells(s, d), "v_fit", "v_base", CHANGE_CAP, STAY_CAP).select("cell_id", "v_fit", "v_base")


def class_balanced_sample(s, d):
    return sampling.class_balanced(cells(s, d), "v_fit", "v_base", PER_CLASS, CHANGED).select("cell_id", "v_base")


def sample_report(s, d):
    """All 81 pairs of classes of the stratified sample, cut to a number of all cells."""
    g = cells(s, d)
    return sampling.sample_report(g, sampling.stratified(g, "v_fit", "v_base", CHANGE_CAP, STAY_CAP, total_cap=TOTAL_CAP), "v_fit", "v_base")


def capped_sample(s, d):
    return sampling.stratified(cells(s, d), "v_fit", "v_base", CHANGE_CAP, STAY_CAP, total_cap=TOTAL_CAP).select("cell_id", "v_fit", "v_base")


def transition_weights(s, d):
    g = cells(s, d)
    out = sampling.transition_weights(g, sampling.stratified(g, "v_fit", "v_base", CHANGE_CAP, STAY_CAP), "v_fit", "v_base")
    return out.withColumn("weight", F.round("weight", 6))


def score_step(s, d):
    """The best 200 cropland and 100 forest cells for class 8, by neighbours and suitability."""
    suit = E.suitability(E.valid("v_base"), "slope", "road", "water", "night")[8]
    g = focal.neighbour_fractions(_thin(s, d, suit.alias("p")), "v_base", [8])
    g = g.withColumn("score", F.round(E.score_mixed(F.col("frac_8"), F.col("p"), E.draw(F.col("cell_id"), 42, 1)), 9))
    quotas = s.sql("SELECT * FROM (VALUES (1, 200), (2, 100)) AS q(class_code, take)")
    return sampling.top_per_source(g.select("cell_id", "v_base", "score"), "v_base", "score", quotas).select("cell_id", "v_base", F.round("score", 6).alias("score"))


def score_plain_step(s, d):
    """The best 200 cropland and 100 forest cells for class 8, by neighbours alone."""
    g = focal.neighbour_fractions(_thin(s, d), "v_base", [8])
    g = g.withColumn("score", F.round(E.score_plain(F.col("frac_8"), E.draw(F.col("cell_id"), 42, 1)), 9))
    quotas = s.sql("SELECT * FROM (VALUES (1, 200), (2, 100)) AS q(class_code, take)")
    return sampling.top_per_source(g.select("cell_id", "v_base", "score"), "v_base", "score", quotas).select("cell_id", "v_base", F.round("score", 6).alias("score"))


def neighbour_all(s, d):
    """The shares of all nine classes."""
    g = focal.neighbour_fractions(_thin(s, d), "v_base", list(range(1, 10)))
    return g.select("cell_id", *[F.round(f"frac_{k}", 6).alias(f"frac_{k}") for k in range(1, 10)])


def weighted_metrics(s, d):
    """Persistence judged with weights of cells."""
    g = cells(s, d).withColumn("w", F.col("cell_id") % 3 + 1)
    out = crosstab.accuracy(crosstab.crosstab(g, "v_target", "v_base", "w"))
    return out.select(F.col("total").cast("long").alias("total"), *[F.round(c, 6).alias(c) for c in ("overall_accuracy", "kappa", "macro_f1", "weighted_f1")])


def rolling_validation(s, d):
    """The non-spatial model over each three epochs, drawn with a seed of its target year."""
    g, epochs, out = cells(s, d), {2015: "v_fit", 2020: "v_base", 2025: "v_target"}, []
    for fit, base, target in scenario.windows(list(epochs)):
        p = crosstab.transition_probabilities(crosstab.crosstab(g, epochs[fit], epochs[base]))
        flows = demand.rounded_flows(p, crosstab.class_counts(g, epochs[base]))
        found = crosstab.accuracy(crosstab.crosstab(sampling.allocate_random(g, epochs[base], flows, 42 + target), epochs[target], "allocated"))
        out.append(found.select(*[F.lit(y).alias(n) for n, y in (("fit_year", fit), ("base_year", base), ("target_year", target))],
                                F.round("overall_accuracy", 6).alias("overall_accuracy"), F.round("kappa", 6).alias("kappa")))
    return reduce(DataFrame.unionByName, out)


def training_weights(s, d):
    """The stratified sample with its weights and the same scaled to a mean of one."""
    g = cells(s, d)
    rows = sampling.stratified(g, "v_fit", "v_base", CHANGE_CAP, STAY_CAP)
    found = sampling.with_weights(rows, sampling.transition_weights(g, rows, "v_fit", "v_base"), "v_fit", "v_base")
    return found.select("cell_id", F.round("weight", 6).alias("weight"), F.round("train_weight", 6).alias("train_weight"))


def clipped(s, d):
    """The base epoch within a polygon."""
    return factors.clip(cells(s, d), [(2.0, 40.0), (18.0, 40.0), (18.0, 900.0), (2.0, 900.0)], "v_base").select("cell_id", "v_base")


def model_comparison(s, d):
    found, _, census = _predicted_counts(cells(s, d))
    tables_ = {"persistence": crosstab.crosstab(census, "v_target", "v_base", "n"), "markov": crosstab.crosstab(found, "v_target", "allocated", "n")}
    rows = [crosstab.accuracy(x).select(F.lit(name).alias("model"), "overall_accuracy", "kappa") for name, x in tables_.items()]
    out = crosstab.compare_models(rows[0].unionByName(rows[1]), "persistence")
    return out.select("model", *[F.round(c, 6).alias(c) for c in ("overall_accuracy", "kappa", "delta_oa", "delta_kappa")])


def history_union(s, d):
    predicted, flows, census = _predicted_counts(cells(s, d))
    projected = crosstab.area_projection(crosstab.class_counts(predicted, "allocated", weight="n"), crosstab.class_counts(census, "v_base", weight="n"), demand.markov_demand(flows), None, KM2)
    return crosstab.history(crosstab.class_summary(census, {2015: "v_fit", 2020: "v_base"}, weight="n"), projected, 2030)


def _log(s: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    return s.createDataFrame([tuple(x.values()) for x in rows], schema)


_QUOTA_LOG = "iteration int, changed_pixels long, class_code int, predicted_pixels long, demand_pixels long, difference_pixels long"


def _quota_run(s: SparkSession, d: str, suitable: bool) -> tuple[DataFrame, list[dict]]:
    """Map and log of the automaton: neighbours alone with repair, or with rule suitability and without."""
    g = cells(s, d, in_order=True)
    goal, table, have = _planned(g)
    if not suitable:
        return allocate.simulate(g.select("cell_id", "r", "c", "v_base"), "v_base", goal, table)
    suit = E.suitability(E.valid("v_base"), "slope", "road", "water", "night")
    thin = g.select("cell_id", "r", "c", "v_base", *[suit[k].alias(f"s_{k}") for k in sorted({t for t, _ in _moves(goal, table, have, False)})])
    return allocate.simulate(thin, "v_base", goal, table, _by_target("s", E.score_mixed), repair=False, reads=_read(thin), keep=["cell_id", "v_base"])


def _moves(goal: dict[int, int], table: dict[tuple[int, int], float], have: dict[int, int], repair: bool = True) -> list[tuple[int, dict[int, int]]]:
    """(target, quotas) of a quota automaton's moves: what other classes would read or be read for need not be made."""
    return [(step[2], {k: n for k, n in step[3].items() if n}) for step in allocate.quota_steps(have, {k: goal.get(k, 0) for k in range(1, 10)}, table, repair=repair) if step[0] == "move"]


def _read(thin: DataFrame) -> tuple[str, ...]:
    return tuple(thin.columns[4:])


def _by_target(name: str, score: Callable) -> allocate.Score:
    """A score of neighbours, the target's own column `name`_<target> and draws."""
    return lambda near, target, jitter, at: score(near, at[f"{name}_{target}"], jitter)


def _pooled_run(s: SparkSession, d: str) -> tuple[DataFrame, list[dict]]:
    g = cells(s, d, in_order=True)
    return allocate.simulate_pooled(g.select("cell_id", "r", "c", "v_base"), "v_base", _goal(g)[0], lambda near, _, jitter: E.score_plain(near, jitter, 0.02))


def _map(end: DataFrame) -> DataFrame:
    return end.select("cell_id", "v_base", F.col("current").alias("predicted"))


def ca_markov_simulation(s, d):
    return _log(s, _quota_run(s, d, False)[1], _QUOTA_LOG)


def ca_markov_map(s, d):
    """One row per cell."""
    return _map(_quota_run(s, d, False)[0])


def pooled_simulation(s, d):
    return _log(s, _pooled_run(s, d)[1], "iteration int, max_abs_demand_error_pixels long, changed_pixels long")


def pooled_map(s, d):
    return _map(_pooled_run(s, d)[0])


def suitability_simulation(s, d):
    """Neighbours and rule suitability, without repair."""
    return _log(s, _quota_run(s, d, True)[1], _QUOTA_LOG)


def suitability_map(s, d):
    return _map(_quota_run(s, d, True)[0])


def _with_support(g: DataFrame, column: str) -> DataFrame:
    """The shares of all classes around each cell, and the one of its own class."""
    return _own_share(focal.neighbour_fractions(g, column, list(range(1, 10))).drop("n_valid"), column)


def _with_factors(g: DataFrame) -> DataFrame:
    """The five factors of the models; a missing one is 0, as on reading a factor."""
    g = g.withColumn("elevation_norm", F.col("elevation") / 500).withColumn("low_slope", F.col("slope"))
    return g.withColumns({c: tables.clean_factor(c) for c in models.FACTORS})


def _drivers(s: SparkSession, d: str) -> DataFrame:
    """The grid with the five factors as they are; cells without one of them fail `_known`."""
    return cells(s, d, in_order=True).withColumn("elevation_norm", F.col("elevation") / 500).withColumn("low_slope", F.col("slope"))


def _known() -> Column:
    return E.valid_drivers(*models.FACTORS)


def _own_share(g: DataFrame, column: str) -> DataFrame:
    """The share of its own class around each cell."""
    own = F.element_at(F.array(*[f"frac_{k}" for k in range(1, 10)]), F.greatest(F.col(column).cast("int"), F.lit(1)))
    return g.withColumn("support", F.when(F.col(column) > 0, own).otherwise(0.0))


def _model_sample(s: SparkSession, d: str) -> DataFrame:
    """The stratified sample of cells with all factors; only around sampled cells neighbours are counted."""
    g = _drivers(s, d)
    return _with_shares(g, sampling.stratified(g.filter(_known()), "v_fit", "v_base", CHANGE_CAP, STAY_CAP))


def _with_shares(g: DataFrame, rows: DataFrame) -> DataFrame:
    """A sample with its label and the shares around its cells, written once: models read it several times, and
    each time the grid would be scanned and shuffled again."""
    rows = scratch.written(rows.withColumn("label", F.col("v_base").cast("double")), scratch.folder(g.sparkSession, "drawn"))
    found = _own_share(focal.sampled_fractions(g, rows, "v_fit", list(range(1, 10))).drop("n_valid"), "v_fit")
    return scratch.written(found, scratch.folder(g.sparkSession, "sample"))


def _goal(g: DataFrame) -> tuple[dict[int, int], dict[tuple[int, int], float]]:
    return _planned(g)[:2]


def _planned(g: DataFrame) -> tuple[dict[int, int], dict[tuple[int, int], float], dict[int, int]]:
    """Demand, transition probabilities and cells of the base epoch, on the driver: nine, 81 and nine numbers."""
    census = _census(g)
    table = {(r.from_code, r.to_code): r.p for r in crosstab.transition_probabilities(crosstab.crosstab(census, "v_fit", "v_base", "n")).collect()}
    have = {r.class_code: r.n for r in crosstab.class_counts(census, "v_base", weight="n").collect()}
    return {r.class_code: r.demand for r in demand.markov_demand(_flows(census)).collect()}, table, have


def forest_simulation(s, d, trees: int = 30, depth: int = 8):
    """The forest's automaton from sample to map: weights of transitions, probabilities of the nine
    classes by blocks of the base epoch, quotas, repair. One row per cell.

    Weights count the cells that could be sampled, those with all factors; cells without get
    probability 0, and so the least score.
    """
    g = _drivers(s, d)
    rows = _model_sample(s, d)
    weights = sampling.transition_weights(g.filter(_known()), rows, "v_fit", "v_base")
    sample, names = models.forest_features(sampling.with_weights(rows, weights, "v_fit", "v_base"), "v_fit")
    # Written, as training reads it several times and the weights come of a pass over the grid.
    sample = scratch.written(sample.select("label", "train_weight", *names), scratch.folder(s, "weighted"))
    model = models.train_forest(sample, names, "label", trees=trees, depth=depth, weight="train_weight")
    known = g.withColumn("known", _known()).withColumns({c: tables.clean_factor(c) for c in models.FACTORS}).select("cell_id", "r", "c", "v_base", "known", *models.FACTORS)
    goal, table, have = _planned(g)
    moves = _moves(goal, table, have)
    thin = models.forest_rates(known.withColumn("known", F.col("known") & E.valid("v_base")), "v_base", model, sorted({t for t, _ in moves}), sorted({k for _, q in moves for k in q}))
    score = lambda near, p, jitter: E.score_forest_of(p, near, jitter)
    end, _ = allocate.simulate(thin, "v_base", goal, table, _by_target("p", score), reads=_read(thin), keep=["cell_id", "v_base"])
    return _map(end)


def logistic_simulation(s, d):
    """The logistic automaton from sample to map: probabilities of the live state with its support
    frozen at the start of an iteration, a pool of candidates, a last pass of repair. One row per cell."""
    g = _with_factors(cells(s, d, in_order=True))
    sample, names = models.logistic_features(_with_shares(g, sampling.class_balanced(g, "v_fit", "v_base", PER_CLASS, CHANGED)), "v_fit")
    model = models.train_logistic(sample, names, "label")
    goal, table = _goal(g)
    probability = models.probability_of(model, names)
    moves = np.array([[float(table.get((a, b), 0.0)) for b in range(10)] for a in range(10)])
    score = lambda near, target, jitter, at: E.score_logistic(probability(at, target), near, moves[at["source"], target], jitter)
    thin = g.select("cell_id", "r", "c", "v_base", *models.FACTORS)
    end, _ = allocate.simulate_pooled(thin, "v_base", goal, score, repair=lambda near, target, jitter, at: probability(at, target),
                                      reads=("current", "source", "support", *models.FACTORS), keep=["cell_id", "v_base"])
    return _map(end)


def one_vs_rest(s, d):
    """Probabilities of the nine classes for the base epoch, by a logistic model for each class, from a sample of its own size."""
    g = _with_factors(cells(s, d, in_order=True))
    sample, names = models.logistic_features(_with_shares(g, sampling.class_balanced(g, "v_fit", "v_base", OWN_PER_CLASS, OWN_CHANGED)), "v_fit")
    trained = models.train_one_vs_rest(sample, names, "label")
    thin = g.select("cell_id", "r", "c", "v_base", *models.FACTORS)
    state, _ = models.logistic_features(_with_support(thin, "v_base"), "v_base")
    return models.one_vs_rest_probabilities(state, trained).select("cell_id", *[F.when(E.valid("v_base"), F.col(f"p_{k}")).otherwise(0.0).alias(f"p_{k}") for k in range(1, 10)])


def _rated_step(s, d, score) -> DataFrame:
    """The best 200 cropland and 100 forest cells for class 8; suitability stands for the probability."""
    p = E.suitability(E.valid("v_base"), "slope", "road", "water", "night")[8]
    g = score(focal.neighbour_fractions(_thin(s, d, p.alias("p")), "v_base", [8])).withColumn("score", F.round("score", 9))
    quotas = s.sql("SELECT * FROM (VALUES (1, 200), (2, 100)) AS q(class_code, take)")
    return sampling.top_per_source(g.select("cell_id", "v_base", "score"), "v_base", "score", quotas).select("cell_id", "v_base", F.round("score", 6).alias("score"))


def score_forest_step(s, d):
    return _rated_step(s, d, lambda g: g.withColumn("score", E.score_forest(F.col("p"), F.col("frac_8"), E.draw(F.col("cell_id"), 42, 1))))


def score_logistic_step(s, d):
    """With the transition probability looked up by a join on the source class."""
    def score(g: DataFrame) -> DataFrame:
        move = _transition(cells(s, d)).filter("to_code = 8").select(F.col("from_code").alias("v_base"), F.col("p").alias("move"))
        found = g.join(F.broadcast(move), "v_base")  # nine rows
        return found.withColumn("score", E.score_logistic(F.col("p"), F.col("frac_8"), F.col("move"), E.draw(F.col("cell_id"), 42, 1)))

    return _rated_step(s, d, score)


def weighted_per_class(s, d):
    """Persistence judged class by class, plain and with weights of cells."""
    g = cells(s, d).filter(E.valid("v_target", "v_base")).withColumn("w", F.col("cell_id") % 3 + 1)
    out = crosstab.weighted_report(g, "v_target", "v_base", "w")
    return out.select("class_code", "support_samples", *[F.round(c, 6).alias(c) for c in (
        "estimated_support_pixels", "precision", "recall", "f1_score", "weighted_precision", "weighted_recall", "weighted_f1_score")])


def positions(s, d):
    """Row and column decoded from the number of a cell, and both scaled."""
    g = cells(s, d)
    last = g.agg(F.max("r")).first()[0]
    at = E.position(F.col("cell_id"), WIDTH, 1 if last is None else last + 1)
    return g.select("cell_id", at["r"].cast("long").alias("r"), at["c"].cast("long").alias("c"), F.round(at["r_scaled"], 6).alias("r_scaled"), F.round(at["c_scaled"], 6).alias("c_scaled"))


def transition_table(s, d):
    """Transition probabilities as a wide report with eight decimals."""
    return report.matrix_table(_transition(cells(s, d)), "p", 8)


def area_table(s, d):
    """The area report in its fixed columns."""
    return report.area_table(area_projection(s, d), "markov", KM2)


def per_class_table(s, d):
    return report.per_class_table(crosstab.per_class_accuracy(confusion(s, d)), "forest")


def largest_changes(s, d):
    """Classes in use by the size of their projected change."""
    return crosstab.changes(area_projection(s, d)).select("class_code", "base_pixels", "predicted_pixels", "change_pixels")


def classes_first_seen(s, d):
    return crosstab.first_seen(cells(s, d).select(F.col("v_base").alias("class_code"), "cell_id"), "class_code", "cell_id")


def factor_average(s, d):
    """Roads and night lights by weight, and the nearer of two waters."""
    return cells(s, d).select("cell_id", F.round(E.weighted([(F.col("road"), 0.6), (F.col("night"), 0.4)]), 6).alias("attraction"), F.round(factors.nearer("road", "water"), 6).alias("nearer"))


def cropped(s, d):
    """The base epoch within a polygon with a hole, cut to its rows and columns."""
    g = cells(s, d)
    rings = s.sql("""SELECT array(array(2D, 40D), array(18D, 40D), array(18D, 900D), array(2D, 900D)) AS coords
                     UNION ALL SELECT array(array(5D, 100D), array(9D, 100D), array(9D, 300D), array(5D, 300D))""")
    return factors.crop_polygons(g, factors.ring_edges(rings), "v_base").select("cell_id", "v_base")


def logistic_coefficients(s, d):
    rows, names = models.logistic_features(_model_sample(s, d), "v_fit")
    return s.createDataFrame(models.coefficients(models.train_logistic(rows, names, "label"), names), "class_code int, feature string, coefficient double")


def forest_importance(s, d):
    rows, names = models.forest_features(_model_sample(s, d), "v_fit")
    return s.createDataFrame(models.feature_importance(models.train_forest(rows, names, "label", trees=30, depth=8), names), "rank int, feature string, importance double")


def class_accuracy_union(s, d):
    """Per-class accuracy of the five models against the target epoch, told apart by name."""
    g = cells(s, d)
    truth = g.select("cell_id", "v_target")
    judged = lambda end: crosstab.per_class_accuracy(_local(crosstab.crosstab(end.select("cell_id", "predicted").join(truth.hint("merge"), "cell_id"), "v_target", "predicted")))
    maps = {"CA-Markov": ca_markov_map, "CA-Markov suitability": suitability_map, "Logistic-CA": logistic_simulation, "RF-CA": forest_simulation}
    reports = {"Markov baseline": crosstab.per_class_accuracy(confusion(s, d))} | {name: judged(f(s, d)) for name, f in maps.items()}
    return report.tagged(reports).select("model", "class_code", "class_name", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1_score")])


def out_of_bag_accuracy(s, d):
    """The stratified sample judged by the trees that have not seen a row, plain and by the weights of pairs."""
    rows = _model_sample(s, d)
    weights = sampling.transition_weights(_drivers(s, d).filter(_known()), rows, "v_fit", "v_base")
    sample, names = models.forest_features(sampling.with_weights(rows, weights, "v_fit", "v_base"), "v_fit")
    sample = scratch.written(sample.select("cell_id", "label", "weight", "train_weight", *names), scratch.folder(s, "sample"))
    voted = models.out_of_bag(sample, models.train_bagged(sample, names, "label", 10, 8, "train_weight"), "label")
    return report.metrics_table(voted.filter("votes > 0"), "out_of_bag", "label", "predicted", "weight")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    class_counts, class_summary, transition_counts, transition_probabilities, transition_series, rounded_flows, markov_demand,
    nonspatial_allocation, confusion, accuracy, per_class_accuracy, row_percent, area_projection, max_demand_error, change_maps,
    neighbour_fraction, same_class_support, gradient_slope, percentile_normalised, factor_summary, suitability_maps,
    distance_to_barren, preview, stratified_sample, capped_sample, sample_report, class_balanced_sample, transition_weights, score_step,
    score_plain_step, neighbour_all, weighted_metrics, rolling_validation, training_weights, clipped, suitability_simulation, model_comparison,
    history_union, score_forest_step, score_logistic_step, weighted_per_class, positions, transition_table, area_table, per_class_table, largest_changes, classes_first_seen, factor_average, cropped,
    one_vs_rest, forest_simulation, logistic_simulation, ca_markov_simulation, ca_markov_map, suitability_map, pooled_simulation, pooled_map, logistic_coefficients, forest_importance, class_accuracy_union, out_of_bag_accuracy)}

_CTES = {
    "g": GRID_SQL,
    "dim": CLASS_SQL,
    "pairs": "SELECT a.class_code AS from_code, b.class_code AS to_code FROM dim a CROSS JOIN dim b",
    "tc": "SELECT from_code, to_code, coalesce(n, 0) AS n FROM pairs LEFT JOIN (SELECT v_fit AS from_code, v_base AS to_code, count(*) AS n FROM g WHERE v_fit BETWEEN 1 AND 9 AND v_base BETWEEN 1 AND 9 GROUP BY ALL) USING (from_code, to_code)",
    "tp": "SELECT from_code, to_code, CASE WHEN t > 0 THEN n / t WHEN from_code = to_code THEN 1 ELSE 0 END AS p FROM (SELECT *, sum(n) OVER (PARTITION BY from_code) AS t FROM tc)",
    "bc": "SELECT class_code, coalesce(n, 0) AS n FROM dim LEFT JOIN (SELECT v_base AS class_code, count(*) AS n FROM g GROUP BY 1) USING (class_code)",
    "fl0": "SELECT from_code, to_code, p * n AS x, CAST(floor(p * n) AS BIGINT) AS low, n FROM tp JOIN bc ON from_code = class_code",
    "fl": "SELECT from_code, to_code, CAST(low + CASE WHEN row_number() OVER (PARTITION BY from_code ORDER BY round(x - low, 9) DESC, to_code) <= n - sum(low) OVER (PARTITION BY from_code) THEN 1 ELSE 0 END AS BIGINT) AS flow FROM fl0",
    "dm": "SELECT to_code AS class_code, CAST(sum(flow) AS BIGINT) AS demand FROM fl GROUP BY 1",
    "cuts": "SELECT from_code, to_code, high - flow AS low, high FROM (SELECT *, sum(flow) OVER (PARTITION BY from_code ORDER BY to_code) AS high FROM fl WHERE flow > 0)",
    "rk": f"SELECT *, row_number() OVER (PARTITION BY v_base ORDER BY {E.draw_sql('cell_id', 42)}, cell_id) AS nth FROM g",
    "al": "SELECT rk.* EXCLUDE (nth), CAST(coalesce(to_code, 0) AS INTEGER) AS allocated FROM rk LEFT JOIN cuts ON v_base = from_code AND nth > low AND nth <= high",
    "cm": "SELECT from_code, to_code, coalesce(n, 0) AS n FROM pairs LEFT JOIN (SELECT v_target AS from_code, allocated AS to_code, count(*) AS n FROM al WHERE v_target BETWEEN 1 AND 9 AND allocated BETWEEN 1 AND 9 GROUP BY ALL) USING (from_code, to_code)",
    "pc": "SELECT class_code, CAST(a AS BIGINT) AS actual_pixels, CAST(p AS BIGINT) AS predicted_pixels, CAST(k AS BIGINT) AS correct_pixels, CASE WHEN a > 0 THEN k / a ELSE 0 END AS pa, CASE WHEN p > 0 THEN k / p ELSE 0 END AS ua FROM (SELECT class_code, (SELECT sum(n) FROM cm WHERE from_code = class_code) AS a, (SELECT sum(n) FROM cm WHERE to_code = class_code) AS p, (SELECT sum(n) FROM cm WHERE from_code = class_code AND to_code = class_code) AS k FROM dim)",
    "pf": "SELECT *, CASE WHEN pa + ua > 0 THEN 2 * pa * ua / (pa + ua) ELSE 0 END AS f1 FROM pc",
    "ac": "SELECT t, oa, (oa - e) / (1 - e) AS kappa, mf, wf FROM (SELECT sum(actual_pixels) AS t, sum(correct_pixels) / sum(actual_pixels) AS oa, sum(actual_pixels::DOUBLE * predicted_pixels) / (sum(actual_pixels)::DOUBLE * sum(actual_pixels)) AS e, sum(f1) / 9 AS mf, sum(actual_pixels * f1) / sum(actual_pixels) AS wf FROM pf)",
    "ps": "SELECT sum(n) FILTER (a = b) / sum(n) AS oa, 0 AS z FROM (SELECT v_target AS a, v_base AS b, count(*) AS n FROM g WHERE v_target > 0 AND v_base > 0 GROUP BY ALL)",
    "pe": "SELECT sum(x.n::DOUBLE * y.n) / (SELECT count(*)::DOUBLE * count(*) FROM g WHERE v_target > 0 AND v_base > 0) AS e FROM (SELECT v_target AS k, count(*) AS n FROM g WHERE v_target > 0 AND v_base > 0 GROUP BY 1) x JOIN (SELECT v_base AS k, count(*) AS n FROM g WHERE v_target > 0 AND v_base > 0 GROUP BY 1) y USING (k)",
    "nb": "SELECT a.cell_id, a.v_base, count(*) FILTER (b.v_base BETWEEN 1 AND 9) AS n_valid, count(*) FILTER (b.v_base = 8) AS n8, count(*) FILTER (b.v_base = a.v_base) AS own FROM g a JOIN (VALUES (-2), (-1), (0), (1), (2)) i(dr) ON true JOIN (VALUES (-2), (-1), (0), (1), (2)) j(dc) ON dr <> 0 OR dc <> 0 LEFT JOIN g b ON b.r = a.r + dr AND b.c = a.c + dc GROUP BY 1, 2",
    "st": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY v_fit, v_base ORDER BY {E.draw_sql('cell_id', 42)}, cell_id) AS nth FROM g WHERE v_fit > 0 AND v_base > 0) WHERE nth <= CASE WHEN v_fit = v_base THEN {STAY_CAP} ELSE {CHANGE_CAP} END",
    "sc": f"SELECT * EXCLUDE (mth) FROM (SELECT *, row_number() OVER (ORDER BY {E.draw_sql('cell_id', 43)}, cell_id) AS mth FROM st) WHERE mth <= {TOTAL_CAP}",
    "sh": "SELECT cell_id, v_base, coalesce(slope, 0.5) AS l, coalesce(road, 0.5) AS rd, coalesce(water, 0.5) AS w, coalesce(night, 0.5) AS nt FROM g",
    "su": "SELECT cell_id, v_base, 0.40 * l + 0.45 * dev + 0.15 * (1 - w) AS s1, 0.70 * dev + 0.30 * (1 - rd) AS s2, 0.5 AS s3, 0.55 * dev + 0.45 * l AS s4, 0.80 * w + 0.20 * l AS s5, 0.5 AS s6, 0.55 * (1 - w) + 0.45 * dev AS s7, 0.35 * rd + 0.45 * nt + 0.20 * l AS s8, 0.75 * w + 0.25 * dev AS s9 FROM (SELECT *, 1 - greatest(nt, 0.7 * rd) AS dev FROM sh)",
}


def _needs(text: str) -> set[str]:
    import re

    found = {k for k in _CTES if re.search(rf"\b{k}\b", text)}
    for k in list(found):
        found |= _needs(_CTES[k]) if k != "g" and k != "dim" else set()
    return found


def _sql(text: str) -> str:
    used = _needs(text)
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in _CTES.items() if k in used) + "\n" + text


_SUMMARY = "SELECT {y} AS year, {c} AS class_code, coalesce(class_name, 'Unknown') AS class_name, count(*) AS pixel_count, round(count(*) * 0.0009, 6) AS area_km2 FROM g LEFT JOIN dim ON {c} = class_code WHERE {c} <> 0 GROUP BY ALL"
_AREA = "SELECT class_code, class_name, n AS base_pixels, demand AS demand_pixels, pp AS predicted_pixels, ap AS actual_pixels, round(pp * 0.0009, 6) AS predicted_area_km2, round((pp - ap) * 0.0009, 6) AS area_difference_km2, pp - demand AS demand_error FROM (SELECT dim.*, n, demand, (SELECT count(*) FROM al WHERE allocated = dim.class_code) AS pp, (SELECT count(*) FROM al WHERE v_target = dim.class_code) AS ap FROM dim JOIN bc USING (class_code) JOIN dm USING (class_code))"
SQL: dict[str, str] = {k: _sql(v) for k, v in {
    "class_counts": "SELECT class_code, class_name, n FROM dim JOIN bc USING (class_code)",
    "class_summary": " UNION ALL ".join(_SUMMARY.format(y=y, c=c) for y, c in ((2015, "v_fit"), (2020, "v_base"), (2025, "v_target"))),
    "transition_counts": "SELECT * FROM tc",
    "transition_probabilities": "SELECT from_code, to_code, round(p, 8) AS p FROM tp",
    "transition_series": "SELECT from_code, to_code, n, 2015 AS from_year FROM tc UNION ALL SELECT from_code, to_code, coalesce(n, 0), 2020 FROM pairs LEFT JOIN (SELECT v_base AS from_code, v_target AS to_code, count(*) AS n FROM g WHERE v_base > 0 AND v_target > 0 GROUP BY ALL) USING (from_code, to_code)",
    "rounded_flows": "SELECT * FROM fl",
    "markov_demand": "SELECT * FROM dm",
    "nonspatial_allocation": "SELECT cell_id, v_base, allocated FROM al",
    "confusion": "SELECT * FROM cm",
    "accuracy": "SELECT CAST(t AS BIGINT) AS total, round(oa, 6) AS overall_accuracy, round(kappa, 6) AS kappa, round(mf, 6) AS macro_f1, round(wf, 6) AS weighted_f1 FROM ac",
    "per_class_accuracy": "SELECT class_code, actual_pixels, predicted_pixels, correct_pixels, round(pa, 6) AS producer_accuracy, round(ua, 6) AS user_accuracy, round(f1, 6) AS f1_score FROM pf",
    "row_percent": "SELECT from_code, to_code, round(CASE WHEN t > 0 THEN 100 * n / t ELSE 0 END, 6) AS percent FROM (SELECT *, sum(n) OVER (PARTITION BY from_code) AS t FROM cm)",
    "area_projection": _AREA,
    "max_demand_error": f"SELECT max(abs(demand_error)) AS max_abs_demand_error_pixels FROM ({_AREA})",
    "change_maps": "SELECT cell_id, CASE WHEN v_target = 0 OR allocated = 0 THEN 0 WHEN v_target = allocated THEN 1 ELSE 2 END AS agreement, CASE WHEN v_target = 0 OR allocated = 0 OR v_base = 0 THEN 0 WHEN v_base = v_target AND allocated = v_target THEN 1 WHEN v_base = v_target THEN 2 WHEN allocated = v_target THEN 3 ELSE 4 END AS two_models, CASE WHEN v_base = 0 OR allocated = 0 THEN 0 WHEN v_base = allocated THEN 1 ELSE 2 END AS change FROM al",
    "neighbour_fraction": "SELECT cell_id, n_valid, round(CASE WHEN n_valid > 0 THEN n8 / n_valid ELSE 0 END, 6) AS frac_8 FROM nb",
    "same_class_support": "SELECT cell_id, round(CASE WHEN v_base > 0 AND n_valid > 0 THEN own / n_valid ELSE 0 END, 6) AS support FROM nb",
    "gradient_slope": "SELECT cell_id, round(sqrt(dr * dr + dc * dc), 6) AS gradient FROM (SELECT cell_id, CASE WHEN u IS NULL THEN n - e WHEN n IS NULL THEN e - u ELSE (n - u) / 2 END AS dr, CASE WHEN w IS NULL THEN x - e WHEN x IS NULL THEN e - w ELSE (x - w) / 2 END AS dc FROM (SELECT cell_id, elevation AS e, lag(elevation) OVER (PARTITION BY c ORDER BY r) AS u, lead(elevation) OVER (PARTITION BY c ORDER BY r) AS n, lag(elevation) OVER (PARTITION BY r ORDER BY c) AS w, lead(elevation) OVER (PARTITION BY r ORDER BY c) AS x FROM g))",
    "percentile_normalised": "SELECT cell_id, round(CASE WHEN hi <= lo THEN 0 ELSE greatest(0, least(1, (elevation - lo) / (hi - lo))) END, 6) AS elevation_norm FROM g, (SELECT quantile_cont(elevation::DOUBLE, 0.02) AS lo, quantile_cont(elevation::DOUBLE, 0.98) AS hi FROM g)",
    "factor_summary": " UNION ALL ".join(f"SELECT '{f}' AS factor, round(min({f})::DOUBLE, 6) AS min, round(max({f})::DOUBLE, 6) AS max, round(avg({f}), 6) AS mean FROM g" for f in ("road", "water", "night")),
    "suitability_maps": "SELECT cell_id, " + ", ".join(f"round(CASE WHEN v_base > 0 THEN greatest(0, least(1, s{k}::DOUBLE)) ELSE 0 END, 6) AS suit_{k}" for k in range(1, 10)) + " FROM su",
    "preview": f"SELECT CAST(pr AS BIGINT) AS pr, CAST(pc AS BIGINT) AS pc, cell_id, v_base FROM (SELECT g.*, h, nr, nc, floor(r * nr / h) AS pr, floor(c * nc / {WIDTH}) AS pc FROM g, (SELECT h, greatest(1, floor(h / scale)) AS nr, greatest(1, floor({WIDTH} / scale)) AS nc FROM (SELECT h, greatest(1::DOUBLE, greatest(h, {WIDTH})::DOUBLE / 500) AS scale FROM (SELECT max(r) + 1 AS h FROM g)))) WHERE r = floor((2 * pr + 1) * h / (2 * nr)) AND c = floor((2 * pc + 1) * {WIDTH} / (2 * nc))",
    "stratified_sample": "SELECT cell_id, v_fit, v_base FROM st",
    "capped_sample": "SELECT cell_id, v_fit, v_base FROM sc",
    "sample_report": "SELECT from_code, a.class_name AS from_name, to_code, b.class_name AS to_name, CASE WHEN from_code = to_code THEN 'yes' ELSE 'no' END AS is_stay, tc.n AS available_pixels, (SELECT count(*) FROM sc WHERE v_fit = from_code AND v_base = to_code) AS sampled_pixels FROM tc JOIN dim a ON a.class_code = from_code JOIN dim b ON b.class_code = to_code",
    "class_balanced_sample": f"SELECT cell_id, v_base FROM (SELECT cell_id, v_base, row_number() OVER (PARTITION BY v_base ORDER BY {E.draw_sql('cell_id', 42)}, cell_id) AS nth FROM g WHERE v_fit > 0 AND v_base > 0) WHERE nth <= {PER_CLASS} UNION SELECT cell_id, v_base FROM (SELECT cell_id, v_base, row_number() OVER (ORDER BY {E.draw_sql('cell_id', 42)}, cell_id) AS nth FROM g WHERE v_fit > 0 AND v_base > 0 AND v_fit <> v_base) WHERE nth <= {CHANGED}",
    "transition_weights": "SELECT v_fit AS from_code, v_base AS to_code, available, sampled, round(available / sampled, 6) AS weight FROM (SELECT v_fit, v_base, count(*) AS available FROM g WHERE v_fit > 0 AND v_base > 0 GROUP BY ALL) JOIN (SELECT v_fit, v_base, count(*) AS sampled FROM st GROUP BY ALL) USING (v_fit, v_base)",
    "score_step": f"SELECT cell_id, v_base, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY v_base ORDER BY score DESC, cell_id) AS nth FROM (SELECT nb.cell_id, nb.v_base, round((0.9::DOUBLE * CASE WHEN n_valid > 0 THEN n8 / n_valid ELSE 0 END + 0.1::DOUBLE * s8::DOUBLE) / (0.9::DOUBLE + 0.1::DOUBLE) + 0.03::DOUBLE * ({E.draw_sql('nb.cell_id', 42, 1)}), 9) AS score FROM nb JOIN su USING (cell_id) WHERE nb.v_base IN (1, 2))) WHERE nth <= CASE v_base WHEN 1 THEN 200 ELSE 100 END",
    "model_comparison": "SELECT model, round(oa, 6) AS overall_accuracy, round(k, 6) AS kappa, round(oa - first_value(oa) OVER (ORDER BY nr), 6) AS delta_oa, round(k - first_value(k) OVER (ORDER BY nr), 6) AS delta_kappa FROM (SELECT 1 AS nr, 'persistence' AS model, oa, (oa - e) / (1 - e) AS k FROM ps, pe UNION ALL SELECT 2, 'markov', oa, kappa FROM ac)",
    "score_forest_step": f"SELECT cell_id, v_base, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY v_base ORDER BY score DESC, cell_id) AS nth FROM (SELECT nb.cell_id, nb.v_base, round((0.3::DOUBLE * CASE WHEN n_valid > 0 THEN n8 / n_valid ELSE 0 END + 0.7::DOUBLE * greatest(s8::DOUBLE, 1e-6::DOUBLE)) / (0.3::DOUBLE + 0.7::DOUBLE) + 0.02::DOUBLE * ({E.draw_sql('nb.cell_id', 42, 1)}), 9) AS score FROM nb JOIN su USING (cell_id) WHERE nb.v_base IN (1, 2))) WHERE nth <= CASE v_base WHEN 1 THEN 200 ELSE 100 END",
    "score_logistic_step": f"SELECT cell_id, v_base, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY v_base ORDER BY score DESC, cell_id) AS nth FROM (SELECT nb.cell_id, nb.v_base, round(0.65::DOUBLE * s8::DOUBLE + 0.3::DOUBLE * CASE WHEN n_valid > 0 THEN n8 / n_valid ELSE 0 END + 0.05::DOUBLE * p + 0.02::DOUBLE * ({E.draw_sql('nb.cell_id', 42, 1)}), 9) AS score FROM nb JOIN su USING (cell_id) JOIN tp ON from_code = nb.v_base AND to_code = 8 WHERE nb.v_base IN (1, 2))) WHERE nth <= CASE v_base WHEN 1 THEN 200 ELSE 100 END",
    "weighted_per_class": "SELECT class_code, support_samples, round(sw, 6) AS estimated_support_pixels, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 6) AS f1_score, round(wp, 6) AS weighted_precision, round(wq, 6) AS weighted_recall, round(CASE WHEN wp + wq > 0 THEN 2 * wp * wq / (wp + wq) ELSE 0 END, 6) AS weighted_f1_score FROM (SELECT class_code, count(*) FILTER (v_target = class_code) AS support_samples, coalesce(sum(w) FILTER (v_target = class_code), 0)::DOUBLE AS sw, coalesce(count(*) FILTER (v_target = class_code AND v_base = class_code) / nullif(count(*) FILTER (v_base = class_code), 0), 0) AS p, coalesce(count(*) FILTER (v_target = class_code AND v_base = class_code) / nullif(count(*) FILTER (v_target = class_code), 0), 0) AS q, coalesce(sum(w) FILTER (v_target = class_code AND v_base = class_code) / nullif(sum(w) FILTER (v_base = class_code), 0), 0)::DOUBLE AS wp, coalesce(sum(w) FILTER (v_target = class_code AND v_base = class_code) / nullif(sum(w) FILTER (v_target = class_code), 0), 0)::DOUBLE AS wq FROM dim LEFT JOIN (SELECT v_target, v_base, cell_id % 3 + 1 AS w FROM g WHERE v_target > 0 AND v_base > 0) ON true GROUP BY class_code)",
    "positions": f"SELECT cell_id, r, c, round(r / greatest(h - 1, 1), 6) AS r_scaled, round(c / {WIDTH - 1}, 6) AS c_scaled FROM g, (SELECT max(r) + 1 AS h FROM g)",
    "transition_table": "SELECT class_code AS from_code, class_name AS from_name, " + ", ".join(f"(SELECT printf('%.8f', p::DOUBLE) FROM tp WHERE from_code = class_code AND to_code = {k}) AS to_{k}" for k in range(1, 10)) + " FROM dim",
    "area_table": f"SELECT class_code, class_name, base_pixels, demand_pixels AS markov_projected_pixels, predicted_pixels AS predicted_raster_pixels, actual_pixels, printf('%.6f', demand_pixels * 0.0009::DOUBLE) AS markov_projected_area_km2, printf('%.6f', actual_pixels * 0.0009::DOUBLE) AS actual_area_km2, printf('%.6f', (predicted_pixels - actual_pixels) * 0.0009::DOUBLE) AS area_difference_km2 FROM ({_AREA})",
    "per_class_table": "SELECT class_code, class_name, actual_pixels, predicted_pixels, correct_pixels, printf('%.6f', ua::DOUBLE) AS precision, printf('%.6f', pa::DOUBLE) AS recall, printf('%.6f', f1::DOUBLE) AS f1_score FROM pf JOIN dim USING (class_code)",
    "largest_changes": f"SELECT class_code, base_pixels, predicted_pixels, predicted_pixels - base_pixels AS change_pixels FROM ({_AREA}) WHERE base_pixels > 0 OR predicted_pixels > 0",
    "classes_first_seen": "SELECT v_base AS class_code, min(cell_id) AS first_place FROM g GROUP BY 1",
    "factor_average": "SELECT cell_id, round(CASE WHEN road IS NULL THEN night ELSE 0.6::DOUBLE * road + 0.4::DOUBLE * night END, 6) AS attraction, round(greatest(coalesce(road, 0), water), 6) AS nearer FROM g",
    "cropped": "SELECT cell_id, CASE WHEN c BETWEEN 5 AND 8 AND r BETWEEN 100 AND 299 THEN 0 ELSE v_base END AS v_base FROM g WHERE r BETWEEN 40 AND 899 AND c BETWEEN 2 AND 17",
    "distance_to_barren": "SELECT cell_id, round(d, 4) AS distance, round(exp(-d / 1000), 6) AS closeness FROM (SELECT a.cell_id, 30 * sqrt(min((a.c - b.c) * (a.c - b.c) + b.gap * b.gap)) AS d FROM g a LEFT JOIN (SELECT r, c, least(r - max(CASE WHEN v_base = 7 THEN r END) OVER (PARTITION BY c ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), min(CASE WHEN v_base = 7 THEN r END) OVER (PARTITION BY c ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - r) AS gap FROM g) b ON a.r = b.r GROUP BY 1)",
    "score_plain_step": f"SELECT cell_id, v_base, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY v_base ORDER BY score DESC, cell_id) AS nth FROM (SELECT cell_id, v_base, round(CASE WHEN n_valid > 0 THEN n8 / n_valid ELSE 0 END + 0.03::DOUBLE * ({E.draw_sql('cell_id', 42, 1)}), 9) AS score FROM nb WHERE v_base IN (1, 2))) WHERE nth <= CASE v_base WHEN 1 THEN 200 ELSE 100 END",
    "neighbour_all": "SELECT a.cell_id, " + ", ".join(f"round(CASE WHEN count(*) FILTER (b.v_base > 0) > 0 THEN count(*) FILTER (b.v_base = {k}) / count(*) FILTER (b.v_base > 0) ELSE 0 END, 6) AS frac_{k}" for k in range(1, 10)) + " FROM g a JOIN (VALUES (-2), (-1), (0), (1), (2)) i(dr) ON true JOIN (VALUES (-2), (-1), (0), (1), (2)) j(dc) ON dr <> 0 OR dc <> 0 LEFT JOIN g b ON b.r = a.r + dr AND b.c = a.c + dc GROUP BY 1",
    "training_weights": "SELECT cell_id, round(w, 6) AS weight, round(w / avg(w) OVER (), 6) AS train_weight FROM (SELECT st.cell_id, available / count(*) OVER (PARTITION BY st.v_fit, st.v_base) AS w FROM st JOIN (SELECT v_fit, v_base, count(*) AS available FROM g GROUP BY ALL) USING (v_fit, v_base))",
    "clipped": "SELECT cell_id, CASE WHEN r BETWEEN 40 AND 899 AND c BETWEEN 2 AND 17 THEN v_base ELSE 0 END AS v_base FROM g",
    "history_union": " UNION ALL ".join("SELECT *, 'observed' AS source FROM (" + _SUMMARY.format(y=y, c=c) + ")" for y, c in ((2015, "v_fit"), (2020, "v_base"))) + " UNION ALL SELECT 2030, class_code, class_name, (SELECT count(*) FROM al WHERE allocated = class_code), round((SELECT count(*) FROM al WHERE allocated = class_code) * 0.0009, 6), 'projected' FROM dim",
}.items()}

_ACCURACY = SQL["accuracy"]
SQL["weighted_metrics"] = _ACCURACY.replace(_CTES["cm"], _CTES["cm"].replace("allocated", "v_base").replace("count(*)", "sum(cell_id % 3 + 1)").replace("FROM al", "FROM g"))
SQL["rolling_validation"] = _sql("SELECT 2015 AS fit_year, 2020 AS base_year, 2025 AS target_year, round(oa, 6) AS overall_accuracy, round(kappa, 6) AS kappa FROM ac").replace(E.draw_sql("cell_id", 42), E.draw_sql("cell_id", 42 + 2025))


def _log_sql(repair: bool) -> str:
    """The log of a quota automaton, which follows from nine counts: a step of the recursion is one
    round of an apportionment, or the choice of the next target or iteration."""
    last = 6 if repair else 5
    steps = f"""
pm AS (SELECT list(ps ORDER BY to_code) AS pr FROM (SELECT to_code, list(p ORDER BY from_code) AS ps FROM tp GROUP BY to_code)),
sim AS (
  SELECT 1 AS it, 1 AS rep, 'start' AS ph, (SELECT list(n ORDER BY class_code) FROM bc) AS cn, (SELECT list(demand ORDER BY class_code) FROM dm) AS want, (SELECT pr FROM pm) AS pr,
    CAST([] AS BIGINT[]) AS todo, CAST([] AS BIGINT[]) AS need, 0::BIGINT AS tgt, CAST([] AS BIGINT[]) AS caps, CAST([] AS DOUBLE[]) AS w, CAST([] AS BIGINT[]) AS given, 0::BIGINT AS rest, 0::BIGINT AS moved
  UNION ALL
  SELECT CASE WHEN ph = 'end' THEN CASE WHEN it < 5 AND moved > 0 THEN it + 1 ELSE 6 END ELSE it END,
    CASE WHEN ph = 'end' AND it = 6 THEN rep + 1 ELSE rep END,
    CASE ph WHEN 'start' THEN 'pick' WHEN 'pick' THEN CASE WHEN len(todo) = 0 THEN 'end' ELSE 'round' END WHEN 'round' THEN CASE WHEN rest = 0 THEN 'pick' ELSE 'round' END
      ELSE CASE WHEN it < 5 AND moved > 0 THEN 'start' WHEN {last} = 6 AND it < 6 THEN 'start' WHEN it = 6 AND moved > 0 AND rep < 9 THEN 'start' ELSE 'done' END END,
    CASE WHEN ph = 'round' AND rest = 0 THEN list_transform(range(1, 10), lambda k: cn[k] - given[k] + CASE WHEN k = tgt THEN list_sum(given)::BIGINT ELSE 0 END) ELSE cn END,
    want, pr,
    CASE WHEN ph = 'start' THEN list_transform(list_sort(list_transform(list_filter(range(1, 10), lambda k: need1[k] > 0), lambda k: {{'n': -need1[k], 'k': k}})), lambda x: x.k) WHEN ph = 'pick' THEN todo[2:] ELSE todo END,
    CASE WHEN ph = 'start' THEN need1 ELSE need END,
    CASE WHEN ph = 'pick' AND len(todo) > 0 THEN todo[1] ELSE tgt END,
    CASE WHEN ph = 'pick' THEN caps1 ELSE caps END,
    CASE WHEN ph = 'pick' THEN CASE WHEN list_sum(w1) > 0 THEN w1 ELSE CAST(caps1 AS DOUBLE[]) END ELSE w END,
    CASE WHEN ph = 'pick' THEN list_transform(range(1, 10), lambda k: 0::BIGINT) WHEN ph = 'round' AND rest > 0 THEN list_transform(range(1, 10), lambda k: given[k] + part[k]) ELSE given END,
    CASE WHEN ph = 'pick' THEN greatest(0, least(need[next], want[next] - cn[next], list_sum(caps1)::BIGINT)) WHEN ph = 'round' AND rest > 0 THEN rest - list_sum(part)::BIGINT ELSE rest END,
    CASE WHEN ph = 'start' THEN 0 WHEN ph = 'round' AND rest = 0 THEN moved + list_sum(given)::BIGINT ELSE moved END
  FROM (
    SELECT *, CASE WHEN list_sum(fl) > 0 THEN fl ELSE list_transform(range(1, 10), lambda k: CASE WHEN list_contains(best, k) THEN 1::BIGINT ELSE 0 END) END AS part
    FROM (
      SELECT *, list_transform(range(1, 10), lambda k: CASE WHEN sc[k] > 0 THEN least(caps[k] - given[k], CAST(floor(rest * sc[k] / list_sum(sc)) AS BIGINT)) ELSE 0 END) AS fl,
        list_transform(list_sort(list_transform(list_filter(range(1, 10), lambda k: caps[k] > given[k]), lambda k: {{'s': -sc[k], 'k': k}}))[1:rest], lambda x: x.k) AS best
      FROM (
        SELECT *, list_transform(range(1, 10), lambda k: caps1[k] * pr[next][k]) AS w1,
          CASE WHEN list_sum(sc0) > 0 THEN sc0 ELSE list_transform(range(1, 10), lambda k: (caps[k] - given[k])::DOUBLE) END AS sc
        FROM (
          SELECT *, coalesce(todo[1], 1) AS next,
            list_transform(range(1, 10), lambda k: CASE WHEN k <> coalesce(todo[1], 0) AND cn[k] > want[k] THEN cn[k] - want[k] ELSE 0 END) AS caps1,
            list_transform(range(1, 10), lambda k: CASE WHEN len(caps) > 0 AND caps[k] > given[k] THEN w[k] ELSE 0::DOUBLE END) AS sc0,
            list_transform(range(1, 10), lambda k: CASE WHEN want[k] <= cn[k] THEN 0 WHEN it <= 5 THEN CAST(ceil((want[k] - cn[k]) / (6 - it)) AS BIGINT) ELSE want[k] - cn[k] END) AS need1
          FROM sim WHERE ph <> 'done')))))"""
    rows = "SELECT it AS iteration, moved AS changed_pixels, CAST(k AS INTEGER) AS class_code, cn[k] AS predicted_pixels, want[k] AS demand_pixels, cn[k] - want[k] AS difference_pixels FROM sim, range(1, 10) AS t(k) WHERE ph = 'end' AND moved > 0"
    used = _needs("tp bc dm")
    return "WITH RECURSIVE " + ",\n".join(f"{k} AS ({v})" for k, v in _CTES.items() if k in used) + "," + steps + "\n" + rows


SQL["ca_markov_simulation"] = _log_sql(True)
SQL["suitability_simulation"] = _log_sql(False)

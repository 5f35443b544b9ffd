"""Plans and tasks that must not grow with a grid: what is shuffled, broadcast and dealt out."""

import re

from pyspark.sql import functions as F

from terramark.operators import delta_grid, factors, focal, sampling
from terramark.plans import catalog
from terramark.sources import grid

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan(df))


def test_grids_are_not_broadcast(spark):
    """Spark takes a cell for a few bytes; grids of some million cells were broadcast."""
    g = catalog.cells(spark, DATA)
    assert "Broadcast" not in plan(factors.distance(g, F.col("v_base") == 7))
    assert "Broadcast" not in plan(focal.sampled_fractions(g, g.filter("cell_id % 41 = 0"), "v_base", [8]))


def test_neighbours_take_one_shuffle_of_few_columns(spark):
    for name in ("neighbour_fraction", "neighbour_all", "same_class_support"):
        found = catalog.QUERIES[name](spark, DATA)
        assert len([x for x in exchanges(found) if "__tr" in x]) == 1 and "Window" not in plan(found)
        assert "slope" not in plan(found) and "v_target" not in plan(found)


def test_only_cells_around_a_sample_are_shuffled(spark, monkeypatch):
    """A bitmap keeps all other cells of the grid, here 30,000, where they are."""
    seen, written = [], focal.scratch.written
    monkeypatch.setattr(focal.scratch, "written", lambda df, path: seen.append(df) or written(df, path))
    g = catalog.cells(spark, DATA)
    found = focal.sampled_fractions(g, g.filter("cell_id % 6007 = 100"), "v_base", [8])
    assert 4 * 9 < seen[0].count() <= 5 * 24 + 5 and found.count() == 5


def test_distances_move_packed_tiles_once(spark):
    """Cells are shuffled as packed rows alone; next to them there are two numbers for each column and block of rows."""
    found = plan(catalog.distance_to_barren(spark, DATA))
    dealt = [x for x in found.splitlines() if re.search(r"Exchange hashpartitioning", x)]
    assert not re.search(r"SortMergeJoin", found) and len([x for x in dealt if "(__tr" in x and "c#" not in x]) == 2
    assert "FlatMapCoGroupsInArrow" in found and "MapInArrow" in found


def test_cropping_to_polygons_moves_no_cells(spark):
    assert "Join [cell_id" not in plan(catalog.cropped(spark, DATA)) and not [x for x in exchanges(catalog.cropped(spark, DATA)) if "cell_id" in x]


def test_tasks_of_a_grid_follow_its_size(spark, monkeypatch):
    monkeypatch.setattr(grid, "ORDERS_AT_ONCE", 100)
    assert grid.cells(spark, DATA).rdd.getNumPartitions() == 15


def test_an_automaton_shuffles_its_changes_alone(spark):
    """The base of a grid is dealt out once; a step's pass moves changed cells and no others."""
    g = delta_grid.DeltaGrid(catalog.cells(spark, DATA).select("cell_id", "r", "c", "v_base", "slope"), "v_base")
    assert g.change(g.now(8).filter("current = 1").orderBy("cell_id").limit(5), 8, 1) == {1: 5}
    for now in (g.now(8), g.now(8, start=0)):
        assert len(re.findall(r"Exchange ", plan(now))) == 1 and "slope" not in "".join(exchanges(now))
    assert g.now(8).filter("changed_in = 1 AND current = 8").count() == 5
    assert g.now(8, start=0).filter("source = 1 AND current = 8").count() == 5


def test_a_tile_is_shuffled_as_packed_cells(spark):
    """A row for each tile that a task sees, in place of a row for each cell: by ranges of rows these are few."""
    thin = catalog._thin(spark, DATA)
    rows = focal.packed(thin, 5)
    assert rows.count() <= 2 * (3 + thin.rdd.getNumPartitions())
    found = rows.groupBy("__tr", "__tc").applyInArrow(lambda t: focal.unpacked(t).append_column("__tr", [t["__tr"].combine_chunks().slice(0, 1).to_pylist() * focal.unpacked(t).num_rows]), thin.schema.add("__own", "boolean").add("__tr", "long"))
    asked = focal.tiled(thin, 5).select(*found.columns)
    assert found.count() == asked.count() and not found.exceptAll(asked).count()
    for name in ("neighbour_fraction", "same_class_support"):
        assert "v_base" not in "".join(x for x in plan(catalog.QUERIES[name](spark, DATA)).splitlines() if "Exchange hash" in x)
        assert re.search(r"(?s)Exchange hashpartitioning\(__tr.*MapInArrow", plan(catalog.QUERIES[name](spark, DATA)))


def test_few_scores_are_written_for_a_small_share(spark, monkeypatch):
    """Each task leaves out what its own rows exceed; ties, missing scores and large shares are as before."""
    g = spark.range(40_000, numPartitions=4).selectExpr("id AS cell_id", "int(id % 3) AS k", "IF(id % 9973 = 0, NULL, (id * 7919 % 1000) / 1000D) AS score")
    quotas = spark.sql("SELECT * FROM (VALUES (1, 50), (2, 7)) AS q(class_code, take)")
    monkeypatch.setattr(sampling, "HELD", 3000)
    rated = g.filter("k > 0").withColumn("__score", F.col("score"))
    kept = sampling._foremost(rated, "k", {1: 50, 2: 7})
    missing = rated.filter("score IS NULL").count()
    assert kept.count() <= 4 * 57 + missing and kept.filter("score IS NULL").count() == missing
    few = sorted(map(str, sampling.top_per_source(g, "k", "score", quotas).collect()))
    monkeypatch.setattr(sampling, "HELD", 0)
    assert len(few) == 57 and few == sorted(map(str, sampling.top_per_source(g, "k", "score", quotas).collect()))


def test_a_mask_of_drivers_names_each_once(spark):
    """A filter repeats a column's expression for each mention; beyond 8000 bytes the JVM does not compile the method (8426 before)."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # its plans show no code before they run
    found = catalog._drivers(spark, DATA).filter(catalog._known()).filter("v_fit BETWEEN 1 AND 9 AND v_base BETWEEN 1 AND 9")
    text = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenString(found._jdf.queryExecution().executedPlan())
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text))) < 8000
    odd = spark.sql("SELECT * FROM (VALUES (1, 0D), (2, NULL), (3, double('NaN')), (4, -9999D), (5, -0D), (6, double('Infinity'))) AS t(i, x)")
    assert [r.i for r in odd.filter(catalog.E.valid_drivers("x")).orderBy("i").collect()] == [1, 5, 6]


def test_a_sample_of_a_model_is_written_once(spark):
    """Training reads it several times; neither the grid nor its neighbours are looked at again for that."""
    found = plan(catalog._model_sample(spark, DATA))
    assert "Join" not in found and "orders.parquet" not in found


def test_a_pass_for_the_best_rates_a_row_once(spark, monkeypatch):
    """A filter below the score repeats its expression for each mention, and a model's score is most of a pass."""
    seen, written = [], delta_grid.scratch.written
    monkeypatch.setattr(delta_grid.scratch, "written", lambda df, path: seen.append(df) or written(df, path))
    rated = spark.range(100).select(F.col("id").alias("cell_id"), (F.col("id") % 3).alias("current"), (F.sqrt("id") / 20).alias("__score"))
    found = delta_grid.best(rated, F.when(F.col("current") < 2, F.col("current")), {0: 10, 1: 40})
    assert sorted(r.cell_id for r in found.collect()) == sorted([*range(72, 100, 3), *range(1, 100, 3)])
    filters = [x for x in plan(seen[0]).splitlines() if "Filter" in x]
    assert sum(x.count("SQRT") for x in filters) == 1
    assert delta_grid.best(rated, F.when(F.col("current") < 2, F.col("current")), {5: 3}).count() == 0

"""Counts, transition and confusion matrices in long form, and the reports made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.grid import PROFILE, classes


def class_counts(cells: DataFrame, column: str, name: str = "n", weight: str | None = None) -> DataFrame:
    """(class_code, class_name, n) of all nine classes, absent ones with 0."""
    # Other codes drop out in the join: a filter would compute the class twice for derived grids.
    found = cells.groupBy(F.col(column).cast("int").alias("class_code")).agg((F.sum(weight) if weight else F.count("*")).alias(name))
    return classes(cells.sparkSession).join(found, "class_code", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def class_summary(cells: DataFrame, years: dict[int, str], km2: float = 0.0009, weight: str | None = None) -> DataFrame:
    """(year, class_code, class_name, pixel_count, area_km2): present values but NoData; unknown codes stay."""
    # Cells are counted by all epochs at once, so only these few counts are unfolded into years.
    counts = cells.groupBy(*years.values()).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    long = counts.select(F.explode(F.array(*[F.struct(F.lit(y).alias("year"), F.col(c).cast("int").alias("class_code"), "n") for y, c in years.items()])).alias("x")).select("x.*")
    n = long.filter("class_code != 0").groupBy("year", "class_code").agg(F.sum("n").alias("pixel_count"))
    return n.join(classes(cells.sparkSession), "class_code", "left").select(
        "year", "class_code", F.coalesce("class_name", F.lit("Unknown")).alias("class_name"), "pixel_count", F.round(F.col("pixel_count") * km2, 6).alias("area_km2"))


def crosstab(cells: DataFrame, rows: str, cols: str, weight: str | None = None) -> DataFrame:
    """(from_code, to_code, n): all 81 pairs of classes valid in both layers, absent ones with 0."""
    n = F.sum(weight) if weight else F.count("*")
    found = cells.groupBy(F.col(rows).cast("int").alias("from_code"), F.col(cols).cast("int").alias("to_code")).agg(n.alias("n"))
    dim = classes(cells.sparkSession)
    pairs = dim.select(F.col("class_code").alias("from_code")).crossJoin(dim.select(F.col("class_code").alias("to_code")))
    return pairs.join(found, ["from_code", "to_code"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast(found.schema["n"].dataType)))


def transition_probabilities(counts: DataFrame) -> DataFrame:
    """(from_code, to_code, n, p): rows scaled to one; a class without cells stays what it is."""
    total = F.sum("n").over(Window.partitionBy("from_code"))
    return counts.withColumn("p", F.when(total > 0, F.col("n") / total).otherwise((F.col("from_code") == F.col("to_code")).cast("double")))


def row_percent(confusion: DataFrame) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy("from_code"))
    return confusion.withColumn("percent", F.when(total > 0, 100 * F.col("n") / total).otherwise(0.0))


def per_class_accuracy(confusion: DataFrame) -> DataFrame:
    """Producer's and user's accuracy and F1 of each class of (from_code actual, to_code predicted, n)."""
    both = confusion.select(F.explode(F.array(
        F.struct(F.col("from_code").alias("class_code"), F.col("n").alias("actual"), (F.col("n") * 0).alias("predicted"), F.when(F.expr("from_code = to_code"), F.col("n")).otherwise(0).alias("correct")),
        F.struct(F.col("to_code").alias("class_code"), (F.col("n") * 0).alias("actual"), F.col("n").alias("predicted"), (F.col("n") * 0).alias("correct")))).alias("x")).select("x.*")
    sums = both.groupBy("class_code").agg(*[F.sum(c).alias(f"{c}_pixels") for c in ("actual", "predicted", "correct")])
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = sums.withColumn("producer_accuracy", share(F.col("correct_pixels"), F.col("actual_pixels"))).withColumn(
        "user_accuracy", share(F.col("correct_pixels"), F.col("predicted_pixels")))
    p, u = F.col("producer_accuracy"), F.col("user_accuracy")
    return out.withColumn("f1_score", share(2 * p * u, p + u))


def accuracy(confusion: DataFrame) -> DataFrame:
    """One row: total, overall_accuracy, kappa, macro_f1 and weighted_f1 over all nine classes."""
    per = per_class_accuracy(confusion)
    a, p, c = F.col("actual_pixels").cast("double"), F.col("predicted_pixels").cast("double"), F.col("correct_pixels").cast("double")
    s = per.agg(F.sum(a).alias("total"), F.sum(c).alias("correct"), F.sum(a * p).alias("ap"), (F.sum("f1_score") / 9).alias("macro_f1"), F.sum(a * F.col("f1_score")).alias("af"))
    oa = F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(0.0)
    by_chance = F.when(F.col("total") > 0, F.col("ap") / (F.col("total") * F.col("total"))).otherwise(0.0)
    return s.select("total", oa.alias("overall_accuracy"), F.when(by_chance >= 1, 0.0).otherwise((oa - by_chance) / (1 - by_chance)).alias("kappa"),
                    "macro_f1", F.when(F.col("total") > 0, F.col("af") / F.col("total")).otherwise(0.0).alias("weighted_f1"))


def area_projection(predicted: DataFrame, base: DataFrame, demand: DataFrame, actual: DataFrame | None = None, km2: float | None = None) -> DataFrame:
    """Pixels and areas of each class: base, demand, predicted and, if there is one, actual.

    predicted, base, actual: class_counts, which can come of one pass over the cells.
    """
    km2 = PROFILE.pixel_area_km2() if km2 is None else km2
    named = lambda df, name: df.select("class_code", F.col("n").alias(name))
    out = base.select("class_code", "class_name", F.col("n").alias("base_pixels")).join(demand.select("class_code", F.col("demand").alias("demand_pixels")), "class_code", "left")
    out = out.join(named(predicted, "predicted_pixels"), "class_code")
    out = out.join(named(actual, "actual_pixels"), "class_code") if actual is not None else out.withColumn("actual_pixels", F.lit(None).cast("long"))
    return out.withColumn("predicted_area_km2", F.round(F.col("predicted_pixels") * km2, 6)).withColumn(
        "area_difference_km2", F.round((F.col("predicted_pixels") - F.col("actual_pixels")) * km2, 6)).withColumn(
        "demand_error", F.col("predicted_pixels") - F.coalesce("demand_pixels", F.lit(0)))


def weighted_report(sample: DataFrame, actual: str, predicted: str, weight: str) -> DataFrame:
    """Support, precision, recall and F1 of each class of a held-out sample, plain and weighted, in one pass."""
    pairs = sample.groupBy(F.col(actual).cast("int").alias("from_code"), F.col(predicted).cast("int").alias("to_code")).agg(F.count("*").alias("n"), F.sum(F.col(weight).cast("double")).alias("w"))
    dim = classes(sample.sparkSession)
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("from_code").alias("class_code"), F.lit(1).alias("a"), F.lit(0).alias("p"), (F.col("from_code") == F.col("to_code")).cast("int").alias("k"), "n", "w"),
        F.struct(F.col("to_code").alias("class_code"), F.lit(0).alias("a"), F.lit(1).alias("p"), F.lit(0).alias("k"), "n", "w"))).alias("x")).select("x.*")
    sums = sides.groupBy("class_code").agg(*[F.sum(F.col(f) * F.col(v)).alias(f"{v}_{f}") for v in "nw" for f in "apk"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = dim.join(sums, "class_code", "left").select("class_code", "class_name", zero("n_a").cast("long").alias("support_samples"), zero("w_a").cast("double").alias("estimated_support_pixels"),
                                                       *[share(zero(f"{v}_k"), zero(f"{v}_{f}")).alias(name) for v, f, name in (
                                                           ("n", "p", "precision"), ("n", "a", "recall"), ("w", "p", "weighted_precision"), ("w", "a", "weighted_recall"))])
    f1 = lambda p, r: share(2 * F.col(p) * F.col(r), F.col(p) + F.col(r))
    return out.withColumn("f1_score", f1("precision", "recall")).withColumn("weighted_f1_score", f1("weighted_precision", "weighted_recall"))


def changes(projection: DataFrame, first: int | None = None) -> DataFrame:
    """Classes in use by the size of their change, then class; the first few if asked for."""
    used = projection.filter((F.col("base_pixels") > 0) | (F.col("predicted_pixels") > 0)).withColumn("change_pixels", F.col("predicted_pixels") - F.col("base_pixels"))
    used = used.orderBy(F.desc(F.abs("change_pixels")), "class_code")
    return used.limit(first) if first else used


def first_seen(rows: DataFrame, column: str, order: str) -> DataFrame:
    """The distinct values of a column by their first place."""
    return rows.groupBy(column).agg(F.min(order).alias("first_place")).orderBy("first_place")


def max_demand_error(projection: DataFrame) -> DataFrame:
    return projection.agg(F.max(F.abs("demand_error")).alias("max_abs_demand_error_pixels"))


def factor_summary(cells: DataFrame, *factors: str) -> DataFrame:
    """(factor, min, max, mean) over finite values, in one pass."""
    finite = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    row = cells.agg(*[f(finite(c)).alias(f"{n}_{c}") for c in factors for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("factor"), *[F.round(f"{n}_{c}", 6).alias(n) for n in ("min", "max", "mean")]) for c in factors])).alias("x")).select("x.*")


def compare_models(models: DataFrame, baseline: str) -> DataFrame:
    """(model, overall_accuracy, kappa) with the differences to the baseline's."""
    base = models.filter(F.col("model") == baseline).select(F.col("overall_accuracy").alias("oa0"), F.col("kappa").alias("k0"))
    return models.crossJoin(F.broadcast(base.limit(1))).select("model", "overall_accuracy", "kappa", (F.col("overall_accuracy") - F.col("oa0")).alias("delta_oa"), (F.col("kappa") - F.col("k0")).alias("delta_kappa"))


def history(summary: DataFrame, projection: DataFrame, year: int) -> DataFrame:
    """Observed areas of all years with the projected ones, told apart by `source`."""
    later = projection.select(F.lit(year).alias("year"), "class_code", "class_name", F.col("predicted_pixels").alias("pixel_count"), F.col("predicted_area_km2").alias("area_km2"))
    return summary.withColumn("source", F.lit("observed")).unionByName(later.withColumn("source", F.lit("projected")), allowMissingColumns=True)

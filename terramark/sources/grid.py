"""Class grids: the class dimension, the grid profile, alignment, and a grid over the test tables.

A grid is dense: NoData cells (class 0) stay as rows, since neighbourhoods count on them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Class codes and names.
CLASSES = {
    1: "Cropland", 2: "Forest", 3: "Shrub", 4: "Grassland", 5: "Water",
    6: "Snow/Ice", 7: "Barren", 8: "Impervious", 9: "Wetland",
}
CLASS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in CLASSES.items()) + ") AS t(class_code, class_name)"
WIDTH = 20
#: Orders whose cells are one task.
ORDERS_AT_ONCE = 1 << 17


@dataclass(frozen=True)
class Profile:
    """Size, coordinate system and affine transform (a, b, c, d, e, f) of a grid."""

    width: int
    height: int
    crs: str
    transform: tuple[float, float, float, float, float, float]
    nodata: float | None = 0

    def aligned(self, other: Profile, exact: bool = False) -> bool:
        """Two layers can be joined cell by cell; transforms are compared to 9 decimals."""
        same = (lambda t: t) if exact else (lambda t: tuple(round(x, 9) for x in t))
        return (self.width, self.height, self.crs, same(self.transform)) == (other.width, other.height, other.crs, same(other.transform))

    def pixel_area_km2(self, rotated: bool = True) -> float:
        a, b, _, d, e, _ = self.transform
        return abs(a * e - (b * d if rotated else 0)) / 1e6


#: 30 m cells, as a plain north-up grid.
PROFILE = Profile(WIDTH, 0, "EPSG:32651", (30.0, 0.0, 0.0, 0.0, -30.0, 0.0))

#: A grid over `orders` in SQL: a row of WIDTH cells per order, three epochs and five factors.
GRID_SQL = f"""
SELECT cell_id, r, c, v_fit, v_base,
  CASE WHEN v_base = 0 THEN 0 WHEN u2 < 40 AND v_base IN (1, 4, 7) THEN 8 WHEN u2 BETWEEN 40 AND 59 AND v_base IN (2, 5) THEN 1
       WHEN u2 BETWEEN 60 AND 69 AND v_base = 1 THEN 5 ELSE v_base END AS v_target,
  CASE WHEN (r * 13 + c) % 997 = 0 THEN NULL ELSE ((r * 37 + c * 11) % 101) / CAST(100 AS DOUBLE) END AS road,
  ((r * 53 + c * 29) % 101) / CAST(100 AS DOUBLE) AS water, ((r * 17 + c * 71 + k) % 101) / CAST(100 AS DOUBLE) AS night,
  CAST((r * 7 + c * 43) % 500 AS DOUBLE) AS elevation, ((r * 3 + c * 97) % 101) / CAST(100 AS DOUBLE) AS slope
FROM (
  SELECT *, CASE WHEN v_fit = 0 THEN 0 WHEN u1 < 50 AND v_fit IN (1, 4) THEN 8 WHEN u1 BETWEEN 50 AND 79 AND v_fit IN (2, 5) THEN 1
            WHEN u1 BETWEEN 80 AND 89 AND v_fit = 1 THEN 2 ELSE v_fit END AS v_base
  FROM (
    SELECT *, CASE WHEN s < 50 THEN 1 WHEN s < 62 THEN 2 WHEN s < 64 THEN 4 WHEN s < 72 THEN 5 WHEN s < 73 THEN 7 WHEN s < 98 THEN 8 ELSE 0 END AS v_fit
    FROM (
      SELECT o_orderkey * {WIDTH} + c AS cell_id, o_orderkey AS r, CAST(c AS BIGINT) AS c, o_custkey AS k,
        CAST((o_orderkey - o_orderkey % 6) / 6 * 131 + (c - c % 6) / 6 * 17 AS BIGINT) % 100 AS s,
        (o_orderkey * 7919 + c * 104729 + o_custkey * 31) % 1000 AS u1,
        (o_orderkey * 15485863 + c * 32452843 + o_custkey * 17 + 7) % 1000 AS u2
      FROM orders CROSS JOIN (VALUES {', '.join(f'({i})' for i in range(WIDTH))}) AS w(c)
    ) a
  ) b
) d
"""


def _fit_class(s: int) -> int:
    return next(k for limit, k in ((50, 1), (62, 2), (64, 4), (72, 5), (73, 7), (98, 8), (100, 0)) if s < limit)


def _base_class(k: int, band: int) -> int:
    return 8 if band < 5 and k in (1, 4) else 1 if 5 <= band < 8 and k in (2, 5) else 2 if band == 8 and k == 1 else k


def _target_class(k: int, band: int) -> int:
    return 8 if band < 4 and k in (1, 4, 7) else 1 if 4 <= band < 6 and k in (2, 5) else 5 if band == 6 and k == 1 else k


def _pick(codes: list[int], at: F.Column) -> F.Column:
    """The code at a position from 0: a lookup in an array that is one literal in the plan."""
    return F.get(F.array(*[F.lit(k) for k in codes]), at.cast("int"))


def _step(rule, before: str, draw: F.Column) -> F.Column:
    """The class that follows a class, by class and tens of a draw; from 90 on nothing changes."""
    codes = [rule(k, band) for k in range(10) for band in range(10)]
    return _pick(codes, F.col(before) * 10 + F.least((draw - draw % 10) / 10, F.lit(9.0)))


def cells(spark: SparkSession, sf_dir: str, in_order: bool = False) -> DataFrame:
    """The grid over the orders of a test data folder, as GRID_SQL has it.

    Orders are dealt out by row before they become cells, into one part for each core and at least
    one for each ORDERS_AT_ONCE of them, so that a task's cells don't grow with the table; windows
    along rows need no further shuffle then. With `in_order` a part holds a range of rows, which takes one more look
    at the orders. Classes are looked up in literal arrays, so that filters pushed below the projections stay small code.
    """
    orders, cores = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("r"), F.col("o_custkey").alias("k")), spark.sparkContext.defaultParallelism
    parts = max(cores, -(-orders.count() // ORDERS_AT_ONCE))
    if orders.rdd.getNumPartitions() < parts:
        orders = orders.repartitionByRange(parts, "r") if in_order else orders.repartition(parts, "r")
    r, c, k = F.col("r"), F.col("c"), F.col("k")
    share = lambda x: (x % 101) / F.lit(100.0)
    found = orders.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(WIDTH - 1).cast("long"))))
    s = ((r - r % 6) / 6 * 131 + (c - c % 6) / 6 * 17).cast("long") % 100
    found = found.withColumn("v_fit", _pick([_fit_class(x) for x in range(100)], s))
    found = found.withColumn("v_base", _step(_base_class, "v_fit", (r * 7919 + c * 104729 + k * 31) % 1000))
    found = found.withColumn("v_target", _step(_target_class, "v_base", (r * 15485863 + c * 32452843 + k * 17 + 7) % 1000))
    return found.select(
        (r * WIDTH + c).alias("cell_id"), "r", "c", "v_fit", "v_base", "v_target", F.when((r * 13 + c) % 997 != 0, share(r * 37 + c * 11)).alias("road"),
        share(r * 53 + c * 29).alias("water"), share(r * 17 + c * 71 + k).alias("night"), ((r * 7 + c * 43) % 500).cast("double").alias("elevation"), share(r * 3 + c * 97).alias("slope"))


def classes(spark: SparkSession) -> DataFrame:
    return spark.sql(CLASS_SQL)

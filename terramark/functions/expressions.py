"""Column expressions: masks, change maps, random draws, scores and rule suitability."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def valid(*columns: str) -> Column:
    """Every layer's class lies in 1 to 9."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).between(1, 9)
    return out


def valid_drivers(*columns: str, nodata: float = -9999.0) -> Column:
    """Each column holds a number; it is named once, since a filter repeats its expression for each mention, and
    methods beyond 8000 bytes are not compiled by the JVM."""
    out = F.lit(True)
    for c in columns:
        out = out & ~F.coalesce(F.col(c).cast("double").isin(float("nan"), nodata), F.lit(True))
    return out


def agreement(actual: str, predicted: str) -> Column:
    """0 invalid, 1 right, 2 wrong."""
    return F.when(~valid(actual, predicted), 0).when(F.col(actual) == F.col(predicted), 1).otherwise(2)


def two_models(actual: str, first: str, second: str) -> Column:
    """0 invalid, 1 both right, 2 the first alone, 3 the second alone, 4 neither."""
    a, b = F.col(first) == F.col(actual), F.col(second) == F.col(actual)
    return F.when(~valid(actual, first, second), 0).when(a & b, 1).when(a, 2).when(b, 3).otherwise(4)


def change(before: str, after: str) -> Column:
    """0 invalid, 1 unchanged, 2 changed."""
    return F.when(~valid(before, after), 0).when(F.col(before) == F.col(after), 1).otherwise(2)


def draw(cell_id: Column, seed: int, step: int = 0) -> Column:
    """A number in [0, 1) that depends on cell, seed and step alone."""
    # The id is reduced first: the product of a large one would leave the range of a long.
    mixed = (cell_id % 2147483648 * 1103515245 + 12345 + seed * 7919 + step * 104729) % 2147483648
    return ((mixed * 48271 + step) % 2147483647) / 2147483647.0


def drawn(cell_id: np.ndarray, seed: int, step: int = 0) -> np.ndarray:
    """`draw` of an array; remainders have the sign of the number, as Spark's have."""
    ids, more = cell_id.astype(np.int64), 12345 + seed * 7919 + step * 104729
    if len(ids) and ids.min() >= 0 and more >= 0 and step >= 0:
        mixed = ((ids & 0x7FFFFFFF) * 1103515245 + more & 0x7FFFFFFF) * 48271 + step
        mixed = (mixed & 0x7FFFFFFF) + (mixed >> 31)  # the remainder by 2^31 - 1, or that much more
        return np.where(mixed >= 2147483647, mixed - 2147483647, mixed) / 2147483647.0
    mixed = np.fmod(np.fmod(ids, 2147483648) * 1103515245 + more, 2147483648)
    return np.fmod(mixed * 48271 + step, 2147483647) / 2147483647.0


def draw_sql(cell_id: str, seed: int, step: int = 0) -> str:
    return f"(((({cell_id} % 2147483648 * 1103515245 + {12345 + seed * 7919 + step * 104729}) % 2147483648) * 48271 + {step}) % 2147483647) / 2147483647.0"


def one_hot(column: str) -> list[Column]:
    return [(F.col(column) == k).cast("double").alias(f"current_is_{k}") for k in range(1, 10)]


def weighted(parts: list[tuple[Column, float]]) -> Column:
    """The weighted mean of the parts that aren't null, within [0, 1]; none or no weight: 0.5."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for x, w in parts:
        total = total + F.coalesce(x * w, F.lit(0.0))
        weight = weight + F.when(x.isNotNull(), F.lit(float(w))).otherwise(0.0)
    return F.when(weight > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), total / weight))).otherwise(0.5)


def suitability(valid_cell: Column, low_slope: str, road: str, water: str, night: str) -> dict[int, Column]:
    """The rule suitability of each class; a missing factor counts 0.5, invalid cells 0."""
    L, R, W, N = (F.coalesce(F.col(c), F.lit(0.5)) for c in (low_slope, road, water, night))
    dev, far = 1 - F.greatest(N, 0.7 * R), 1 - W
    rules = {  # fixed values: the weights of the rules
        1: 0.40 * L + 0.45 * dev + 0.15 * far,
        2: 0.70 * dev + 0.30 * (1 - R),
        3: F.lit(0.5),
        4: 0.55 * dev + 0.45 * L,
        5: 0.80 * W + 0.20 * L,
        6: F.lit(0.5),
        7: 0.55 * far + 0.45 * dev,
        8: 0.35 * R + 0.45 * N + 0.20 * L,
        9: 0.75 * W + 0.25 * dev,
    }
    return {k: F.when(valid_cell, F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).otherwise(0.0) for k, x in rules.items()}


# These four are plain arithmetic, so they take arrays as well, as the automata do within tiles.
def score_plain(neighbour: Column, jitter: Column, weight: float = 0.03) -> Column:
    return neighbour + weight * jitter


def score_mixed(neighbour: Column, other: Column, jitter: Column, nw: float = 0.9, ow: float = 0.1, weight: float = 0.03) -> Column:
    """Neighbourhood and suitability (or a probability), scaled by their weights."""
    return (nw * neighbour + ow * other) / (nw + ow) + weight * jitter


def score_forest(probability: Column, neighbour: Column, jitter: Column, rw: float = 0.7, nw: float = 0.3) -> Column:
    """A forest's probability, of 1e-6 at least, and the neighbourhood."""
    return score_forest_of(F.greatest(probability, F.lit(1e-6)), neighbour, jitter, rw, nw)


def score_forest_of(probability: Column, neighbour: Column, jitter: Column, rw: float = 0.7, nw: float = 0.3) -> Column:
    """The same of a probability that is 1e-6 at least."""
    return score_mixed(neighbour, probability, jitter, nw, rw, 0.02)


def score_logistic(probability: Column, neighbour: Column, transition: Column, jitter: Column) -> Column:
    """Not scaled by its weights."""
    return 0.65 * probability + 0.30 * neighbour + 0.05 * transition + 0.02 * jitter


def position(cell_id: Column, width: int, height: int) -> dict[str, Column]:
    """Row and column of a cell's number, and both scaled to [0, 1]."""
    r, c = F.floor(cell_id / width), cell_id % width
    return {"r": r, "c": c, "r_scaled": r / float(max(height - 1, 1)), "c_scaled": c / float(max(width - 1, 1))}


def first_known(*columns: str) -> Column:
    """The first of the columns that holds a number."""
    return F.coalesce(*[F.expr(f"try_cast({c} AS double)") for c in columns])


def hex_colour(red: Column, green: Column, blue: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(x.cast("long")), 2, "0")) for x in (red, green, blue)])


def ramp(value: Column, stops: list[tuple[float, tuple[int, int, int]]]) -> Column:
    """A colour between the stops (value, colour) around a number; before the first and after the last, theirs; a missing number has none."""
    def part(i: int) -> Column:
        out = F.lit(float(stops[-1][1][i]))
        for (a, low), (b, high) in reversed(list(zip(stops, stops[1:]))):
            out = F.when(value <= b, low[i] + (high[i] - low[i]) * (value - a) / (b - a)).otherwise(out)
        return F.round(F.when(value <= stops[0][0], float(stops[0][1][i])).otherwise(out))

    return F.when(value.isNotNull() & ~F.isnan(value), hex_colour(*[part(i) for i in range(3)]))

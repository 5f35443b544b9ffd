"""Driver factors: percentile scaling, distances, closeness, slope, resampling, clipping."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch, tables
from .focal import BLOCK_ROWS, dealt, gradient, places, unpacked


#: Slots into which a range of values is cut, and values that one task may order.
SLOTS, SMALL = 1 << 12, 1 << 16
#: Columns of a tile in which cells meet spans.
TILE = 64
#: Columns of a block of a distance's second pass at least (or the root of the width), and cells of a group.
BLOCK_COLUMNS, CELLS_AT_ONCE = 1024, 1 << 14


def percentiles(cells: DataFrame, column: str, shares: list[float]) -> list[float] | None:
    """Exact percentiles with linear interpolation; None without a value.

    One pass counts values by sign and logarithm, which also gives their number. The slots that hold
    an asked rank are then cut into equal slots between their own least and largest value, again and
    again, until they are small or hold one value. So neither outliers nor clusters of values put
    much of a column into one slot, and no task orders more than SMALL values.
    """
    x = F.col(column).cast("double")
    known = cells.select(x.alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    power = F.floor(F.greatest(F.lit(-1000.0), F.least(F.lit(1100.0), F.log2(F.abs("x")))) * 16) + 20000
    slot = F.when(F.col("x") == 0, 0).when(F.col("x") > 0, power).otherwise(-power)

    def counted(df: DataFrame, slot: F.Column) -> list[tuple]:
        """(slot, least value, largest value, number), in order of the values."""
        found = df.groupBy(slot.alias("slot")).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n")).collect()
        return sorted((r.low, r.high, r.n) for r in found)

    slots = counted(known, slot)
    n = sum(m for *_, m in slots)
    if not n:
        return None
    ranks = sorted({k for q in shares for k in (int(q * (n - 1)), min(n - 1, int(q * (n - 1)) + 1))})
    value: dict[int, float] = {}

    def place(slots: list[tuple], first: int, asked: list[int]) -> Iterator[tuple]:
        """(least, largest, number, rank of the least, asked ranks) of slots that hold an asked rank."""
        for low, high, m in slots:
            inner = [k for k in asked if first <= k < first + m]
            if low == high:
                value.update(dict.fromkeys(inner, low))
            elif inner:
                yield low, high, m, first, inner
            first += m

    todo = list(place(slots, 0, ranks))
    while large := [t for t in todo if t[2] > SMALL]:
        part = F.lit(None).cast("long")
        for k, (low, high, *_) in enumerate(large):
            # Halves keep the range of a slot finite.
            within = F.least(F.floor((F.col("x") / 2 - low / 2) / (high / 2 - low / 2) * SLOTS), F.lit(SLOTS - 1))
            part = F.when(F.col("x").between(low, high), within + k * SLOTS).otherwise(part)
        found = counted(known.withColumn("part", part).filter("part is not null"), F.col("part"))
        finer = [t for low, high, m, first, inner in large for t in place([s for s in found if low <= s[0] <= high], first, inner)]
        todo = [t for t in todo if t[2] <= SMALL] + finer
    if todo:
        hit, of = F.lit(False), F.lit(0)
        for k, (low, high, *_) in enumerate(todo):
            of = F.when(F.col("x").between(low, high), k).otherwise(of)
            hit = hit | F.col("x").between(low, high)
        own = Window.partitionBy("of").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
        some = known.filter(hit).groupBy(of.alias("of"), "x").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(own))
        asked = F.lit(False)
        for k, (_, _, _, first, inner) in enumerate(todo):
            for rank in inner:
                asked = asked | ((F.col("of") == k) & (F.col("upto") > rank - first) & (F.col("upto") - F.col("n") <= rank - first))
        for r in some.filter(asked).collect():
            first, inner = todo[r.of][3:]
            value.update({rank: r.x for rank in inner if r.upto - r.n <= rank - first < r.upto})
    out = []
    for q in shares:
        at = q * (n - 1)
        a, b = value[int(at)], value[min(n - 1, int(at) + 1)]
        out.append(a + (b - a) * (at - int(at)))
    return out


def percentile_normalise(cells: DataFrame, column: str, name: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """`column` scaled to [0, 1] between two exact percentiles; missing values 0, no range: all 0."""
    found = percentiles(cells, column, [low, high])
    if found is None or found[1] <= found[0]:
        return cells.withColumn(name, F.lit(0.0))
    x = F.col(column).cast("double")
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - found[0]) / (found[1] - found[0])))
    return cells.withColumn(name, F.when(x.isNull() | F.isnan(x), 0.0).otherwise(scaled))


def low_slope(cells: DataFrame, elevation: str) -> DataFrame:
    """elevation_norm, and low_slope as one less the scaled gradient of it."""
    found = gradient(percentile_normalise(cells, elevation, "elevation_norm"), "elevation_norm")
    return percentile_normalise(found, "gradient", "__g").withColumn("low_slope", 1 - F.col("__g")).drop("__g", "gradient")


def _envelope(x: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which parabolas (at - x)^2 + f are lowest somewhere, in order of x; where each begins to be)."""
    hull, edge = [0], [-np.inf]
    for q in range(1, len(x)):
        while True:
            p = hull[-1]
            s = (f[q] + x[q] ** 2 - f[p] - x[p] ** 2) / (2 * (x[q] - x[p]))
            if s > edge[-1]:
                break
            hull.pop()
            edge.pop()
        hull.append(q)
        edge.append(s)
    return np.array(hull), np.array(edge)


def distance(cells: DataFrame, burned: F.Column, pixel: float = 30.0, block_rows: int = BLOCK_ROWS, block_columns: int | None = None) -> DataFrame:
    """`cells` with the exact distance to the nearest burned cell (null if there is none).

    Along columns the nearest burned row comes from windows within blocks of rows; what lies beyond
    a block is its neighbours' last or first burned row, of which there is one for each column and
    block. Along rows it is the lower envelope of the parabolas of all columns. Rows are cut into
    blocks of columns: a block sends to each other block the parabolas of its own envelope that are
    lowest somewhere in it, so a group holds a few rows of one block and what was sent to it.

    Grids of no more columns than a tile are dealt out once, as packed tiles of whole rows (`_narrow_distance`).
    """
    width = (cells.agg(F.max("c")).first()[0] or 0) + 1
    if width <= BLOCK_COLUMNS and (block_columns or width) >= width:
        return _narrow_distance(cells, burned, pixel, block_rows)
    rows = cells.select("r", "c", F.floor(F.col("r") / block_rows).alias("block"), F.when(burned, F.col("r")).alias("at"))
    ends = rows.filter("at is not null").groupBy("c", "block").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    column = Window.partitionBy("c").orderBy("block")
    # Blocks without a burned row need their neighbours' as well.
    # Grids are guessed far smaller than they are, so Spark would broadcast one unasked.
    ends = rows.select("c", "block").distinct().join(ends.hint("merge"), ["c", "block"], "left")
    ends = ends.select("c", "block", F.max("high").over(column.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
                       F.min("low").over(column.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    up = Window.partitionBy("c", "block").orderBy("r")
    above = F.last("at", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first("at", ignorenulls=True).over(up.rowsBetween(0, Window.unboundedFollowing))
    near = rows.select("r", "c", "block", above.alias("above"), below.alias("below")).join(ends.hint("merge"), ["c", "block"])
    gap = F.least(F.col("r") - F.coalesce("above", "before"), F.coalesce("below", "after") - F.col("r"))
    wide = block_columns or max(BLOCK_COLUMNS, math.isqrt(width))
    rows_at_once = max(1, CELLS_AT_ONCE // min(wide, width))
    keys = ["rows", "part"]
    rows = near.select(F.floor(F.col("r") / rows_at_once).alias("rows"), F.floor(F.col("c") / wide).alias("part"), "r", "c", gap.cast("double").alias("gap"), F.lit(True).alias("own"))

    def by_row(b: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        r, x, gap = b["r"].to_numpy(), b["c"].to_numpy(float), b["gap"].to_numpy(float)
        for at in np.split(np.arange(len(b)), np.flatnonzero(np.diff(r)) + 1):
            known = at[~np.isnan(gap[at])]
            yield at, x[known], gap[known] ** 2

    def send(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["r", "c"])
        home, out = int(b["part"].iloc[0]), []
        for at, x, f in by_row(b):
            if len(x):
                hull, edge = _envelope(x, f)
                low = np.maximum(np.ceil(edge), 0)
                high = np.minimum(np.append(np.ceil(edge[1:]) - 1, np.inf), width - 1)
                some = low <= high
                first, last = (low[some] // wide).astype(int), (high[some] // wide).astype(int)
                n = last - first + 1
                which = np.repeat(hull[some], n)
                part = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                away = part != home
                out.append(pd.DataFrame({"part": part[away], "r": b["r"].iloc[at[0]], "c": x[which[away]].astype(np.int64), "gap": np.sqrt(f[which[away]])}))
        sent = pd.concat(out) if out else pd.DataFrame({"part": [], "r": [], "c": [], "gap": []})
        return sent.assign(rows=b["rows"].iloc[0], own=False)[["rows", "part", "r", "c", "gap", "own"]]

    def meet(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["r", "c"])
        c, own, out = b["c"].to_numpy(float), b["own"].to_numpy(bool), np.full(len(b), np.nan)
        for at, x, f in by_row(b):
            if len(x):
                hull, edge = _envelope(x, f)
                mine = at[own[at]]
                best = hull[np.searchsorted(edge, c[mine], side="right") - 1]
                out[mine] = np.sqrt((c[mine] - x[best]) ** 2 + f[best]) * pixel
        return pd.DataFrame({"r": b["r"], "c": b["c"], "distance": out})[own]

    if width > wide:
        rows = scratch.written(rows, scratch.folder(cells.sparkSession, "gaps"))  # read twice
        # Whole numbers are sent exactly: the squares of gaps are rounded back.
        sent = rows.groupBy(*keys).applyInPandas(send, "rows long, part long, r long, c long, gap double, own boolean")
        rows = rows.unionByName(sent.withColumn("gap", F.round("gap")))
    found = rows.groupBy(*keys).applyInPandas(meet, "r long, c long, distance double")
    return cells.join(found.withColumn("distance", F.nanvl("distance", F.lit(None).cast("double"))).hint("merge"), ["r", "c"])


def _narrow_distance(cells: DataFrame, burned: F.Column, pixel: float, block_rows: int) -> DataFrame:
    """`distance` where a block of whole rows fits a task: it gets the nearest burned rows beyond it, one number up and one down for
    each of its columns. Along rows each cell looks one column further, left and right, until no block's cell can be nearer."""
    some = cells.select("*", F.coalesce(burned, F.lit(False)).alias("__burned"))
    at = F.when(F.col("__burned"), F.col("r"))
    column = Window.partitionBy("c").orderBy("__tr")
    ends = some.groupBy(F.floor(F.col("r") / block_rows).alias("__tr"), "c").agg(F.min(at).alias("low"), F.max(at).alias("high"))
    ends = ends.select("__tr", "c", F.max("high").over(column.rowsBetween(Window.unboundedPreceding, -1)).cast("double").alias("before"),
                       F.min("low").over(column.rowsBetween(1, Window.unboundedFollowing)).cast("double").alias("after"))
    names = ["r", "c", *[x for x in cells.columns if x not in ("r", "c")]]

    def work(pieces: pa.Table, beyond: pa.Table) -> pa.Table:
        t = unpacked(pieces)
        where, shape, top, left = places(t)
        hit, near = t.column("__burned").to_numpy(), np.full(shape, -np.inf)
        row = np.arange(top, top + shape[0], dtype=float)[:, None]
        near.ravel()[where[hit]] = t.column("r").to_numpy()[hit]
        below = np.where(np.isinf(near), np.inf, near)
        for name, line, join in (("before", near[0], np.maximum), ("after", below[-1], np.minimum)):
            known = beyond.filter(beyond.column(name).is_valid())
            join.at(line, known.column("c").to_numpy() - left, known.column(name).to_numpy())
        gap = np.minimum(row - np.maximum.accumulate(near), np.minimum.accumulate(below[::-1])[::-1] - row) ** 2
        best = gap.copy()
        for d in range(1, shape[1]):
            if d * d >= best.max():
                break
            np.minimum(best[:, d:], gap[:, :-d] + d * d, out=best[:, d:])
            np.minimum(best[:, :-d], gap[:, d:] + d * d, out=best[:, :-d])
        found = np.sqrt(best.ravel()[where]) * pixel
        return t.select(names).append_column("distance", pa.array(found, mask=np.isinf(found)))

    schema = cells.select(*names).schema.add("distance", "double")
    return dealt(some, 0, block_rows).groupBy("__tr").cogroup(ends.groupBy("__tr")).applyInArrow(work, schema)


def closeness(distance_column: str, decay: float) -> F.Column:
    """exp(-d / decay); roads use 1500 m, water 1000 m."""
    return F.exp(-F.col(distance_column) / decay)


def nearer(*columns: str) -> F.Column:
    """The larger of several closenesses, such as those to water areas and to rivers; missing ones don't count."""
    return F.greatest(*[F.coalesce(F.col(c), F.lit(0.0)) for c in columns])


def within(features: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Features (coords: array of [x, y]) with a point, whose own box meets (x0, y0, x1, y1)."""
    some = features.filter(F.col("coords").isNotNull() & (F.size("coords") > 0))
    low = lambda i: F.array_min(F.transform("coords", lambda p: p[i]))
    high = lambda i: F.array_max(F.transform("coords", lambda p: p[i]))
    return some.filter((low(0) <= box[2]) & (high(0) >= box[0]) & (low(1) <= box[3]) & (high(1) >= box[1]))


def row_spans(edges: DataFrame, *keys: str) -> DataFrame:
    """(keys, r, first, last): the columns whose cells' centres lie inside, by the even-odd rule over all edges of a key.

    edges: x0, y0, x1, y1 in cell units, of outer rings and holes alike. Each edge gives the place at
    which it crosses the middle of each row; a row's places in order are the starts and ends of its
    spans. The work grows with the rows that edges cross, not with the cells or with pairs of edges.
    """
    rows = edges.withColumn("lo", F.least("y0", "y1")).withColumn("hi", F.greatest("y0", "y1"))
    rows = rows.withColumn("top", F.ceil(F.col("lo") - 0.5)).withColumn("bottom", F.ceil(F.col("hi") - 0.5) - 1).filter("top <= bottom")
    crossed = rows.select(*keys, "x0", "y0", "x1", "y1", F.explode(F.sequence("top", "bottom")).alias("r"))
    at = F.col("x0") + (F.col("r") + 0.5 - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    order = Window.partitionBy(*keys, "r").orderBy("x")
    spans = crossed.select(*keys, "r", at.alias("x")).withColumn("end", F.lead("x").over(order)).withColumn("nth", F.row_number().over(order))
    return spans.filter("nth % 2 = 1").select(*keys, "r", F.ceil(F.col("x") - 0.5).alias("first"), (F.ceil(F.col("end") - 0.5) - 1).alias("last")).filter("first <= last")


def filled(cells: DataFrame, spans: DataFrame, name: str) -> DataFrame:
    """`cells` with whether they lie in spans (r, first, last) that don't overlap.

    Cells and spans meet by row and tile of columns, where a cell has fewer spans to look at than the
    tile has columns.
    """
    parts = spans.select("r", "first", "last", F.explode(F.sequence(F.floor(F.col("first") / TILE), F.floor(F.col("last") / TILE))).alias("__tile"))
    parts = parts.select(F.col("r").alias("__r"), "__tile", F.col("first").alias("__first"), F.col("last").alias("__last"))
    here = cells.withColumn("__tile", F.floor(F.col("c") / TILE))
    met = (here["r"] == parts["__r"]) & (here["__tile"] == parts["__tile"]) & (here["c"] >= parts["__first"]) & (here["c"] <= parts["__last"])
    return here.join(parts, met, "left").select(*[here[c] for c in cells.columns], parts["__r"].isNotNull().alias(name))


def inside_polygons(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """The cell_id of cells whose centre lies in polygons, by the even-odd rule over all their rings."""
    return filled(cells.select("cell_id", "r", "c"), row_spans(edges), "__in").filter("__in").select("cell_id")


def burn_polygons(rings: DataFrame) -> DataFrame:
    """(r, c) of the cells whose centre lies in any polygon (feature_id, coords: a ring; a polygon's holes are rings of its own id)."""
    spans = row_spans(ring_edges(rings, "feature_id"), "feature_id")
    return spans.select("r", F.explode(F.sequence("first", "last")).alias("c")).distinct()


def ring_edges(rings: DataFrame, *keys: str) -> DataFrame:
    """The edges of closed rings (coords: array of [x, y]), with the rings' keys."""
    pairs = F.expr("transform(sequence(0, size(coords) - 1), i -> struct(coords[i] AS a, coords[(i + 1) % size(coords)] AS b))")
    e = rings.filter("size(coords) > 2").select(*keys, F.explode(pairs).alias("e"))
    return e.select(*keys, F.col("e.a")[0].alias("x0"), F.col("e.a")[1].alias("y0"), F.col("e.b")[0].alias("x1"), F.col("e.b")[1].alias("y1"))


def crop(cells: DataFrame, inside: DataFrame, column: str) -> DataFrame:
    """`column` with 0 outside, cut to the rows and columns that `inside` (cell_id) reaches."""
    marked = cells.join(inside.select("cell_id", F.lit(True).alias("__in")).hint("merge"), "cell_id", "left")
    return _cut(marked.withColumn("__in", F.col("__in").isNotNull()), column).select(*cells.columns)


def crop_polygons(cells: DataFrame, edges: DataFrame, column: str) -> DataFrame:
    """`crop` to the cells whose centre lies in polygons: cells meet spans, of which there are few, where they are."""
    return _cut(filled(cells, row_spans(edges), "__in"), column).select(*cells.columns)


def _cut(marked: DataFrame, column: str) -> DataFrame:
    box = marked.filter("__in").agg(*[f(c).alias(f"{n}_{c}") for c in "rc" for n, f in (("lo", F.min), ("hi", F.max))]).first()
    cut = marked.filter(F.col("r").between(box.lo_r, box.hi_r) & F.col("c").between(box.lo_c, box.hi_c))
    return cut.withColumn(column, F.when(F.col("__in"), F.col(column)).otherwise(0))


def resample(cells: DataFrame, source: DataFrame, scale: float, column: str) -> DataFrame:
    """Bilinear values of a coarser grid (r, c, column) at the centres of `cells`; missing corners are left out."""
    y, x = (F.col("r") + 0.5) / scale - 0.5, (F.col("c") + 0.5) / scale - 0.5
    corners = F.explode(F.array(*[F.struct((F.floor(y) + a).alias("sr"), (F.floor(x) + b).alias("sc"),
                                           ((1 - F.abs(y - F.floor(y) - a)) * (1 - F.abs(x - F.floor(x) - b))).alias("w")) for a in (0, 1) for b in (0, 1)]))
    asked = cells.select("cell_id", corners.alias("k")).select("cell_id", "k.*").filter("w > 0")
    known = source.select(F.col("r").alias("sr"), F.col("c").alias("sc"), F.col(column).alias("v")).filter("v is not null")
    found = asked.join(known.hint("merge"), ["sr", "sc"]).groupBy("cell_id").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias(column))
    return cells.join(found.hint("merge"), "cell_id", "left")


def burn_lines(lines: DataFrame) -> DataFrame:
    """(r, c) of the cells that lines (coords: array of [x, y] in cell units) pass through.

    A segment is followed from cell border to cell border: it lies in the cells of the points in which
    it crosses a border, of the middles between these, and of its ends. A cell has its upper and left
    borders; a line of one point is that point.
    """
    pairs = F.expr("transform(sequence(0, greatest(size(coords) - 2, 0)), i -> struct(coords[i] AS a, coords[least(i + 1, size(coords) - 1)] AS b))")
    e = lines.filter("size(coords) > 0").select(F.explode(pairs).alias("e"))
    e = e.select(F.col("e.a")[0].alias("x0"), F.col("e.a")[1].alias("y0"), (F.col("e.b")[0] - F.col("e.a")[0]).alias("dx"), (F.col("e.b")[1] - F.col("e.a")[1]).alias("dy"))

    def borders(at: str, way: str) -> F.Column:
        """The border lines that a segment crosses along an axis, as the shares of its length at which it does."""
        low, high = F.least(F.col(at), F.col(at) + F.col(way)), F.greatest(F.col(at), F.col(at) + F.col(way))
        first, last = F.ceil(low), F.floor(high)
        lines_ = F.when((F.col(way) != 0) & (first <= last), F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(lines_, lambda k: F.struct(((k - F.col(at)) / F.col(way)).alias("t"), k.alias("k")))

    point = lambda r, c: F.struct(F.floor(r).alias("r"), F.floor(c).alias("c"))
    down, across = borders("y0", "dy"), borders("x0", "dx")
    e = e.withColumn("down", down).withColumn("across", across)
    shares = F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.transform("down", lambda b: b["t"]), F.transform("across", lambda b: b["t"])))
    e = e.withColumn("ts", shares)
    # On a border its own number is used, so that rounding can't put the point on the other side.
    on = F.concat(F.transform("down", lambda b: point(b["k"], F.col("x0") + F.col("dx") * (b["k"] - F.col("y0")) / F.col("dy"))),
                  F.transform("across", lambda b: point(F.col("y0") + F.col("dy") * (b["k"] - F.col("x0")) / F.col("dx"), b["k"])),
                  F.array(point(F.col("y0"), F.col("x0")), point(F.col("y0") + F.col("dy"), F.col("x0") + F.col("dx"))))
    # Two borders that are met in one corner have no middle between them.
    apart = F.filter(F.transform(F.slice("ts", F.lit(2), F.size("ts") - 1), lambda t, i: F.struct(F.col("ts")[i].alias("a"), t.alias("b"))), lambda p: p["b"] - p["a"] > 1e-12)
    middles = F.transform(apart, lambda p: point(F.col("y0") + F.col("dy") * (p["a"] + p["b"]) / 2, F.col("x0") + F.col("dx") * (p["a"] + p["b"]) / 2))
    return e.select(F.explode(F.concat(on, middles)).alias("p")).select("p.r", "p.c").distinct()


def clip(cells: DataFrame, ring: list[tuple[float, float]], column: str) -> DataFrame:
    """`column` with 0 outside a polygon ring, by the even-odd rule at cell centres."""
    rings = cells.sparkSession.createDataFrame([([[float(x), float(y)] for x, y in ring],)], "coords array<array<double>>")
    found = filled(cells, row_spans(ring_edges(rings)), "__in")
    return found.withColumn(column, F.when(F.col("__in"), F.col(column)).otherwise(0)).drop("__in")


def vector_closeness(cells: DataFrame, features: DataFrame, decay: float, pixel: float = 30.0, name: str = "closeness") -> DataFrame | None:
    """(r, c, `name`): closeness to features (feature_id, kind, coords: parts in cell units); None if no cell is burned.

    Polygons are burned by their spans, lines and points by the cells they pass through.
    """
    areas, others = features.filter("kind = 'polygon'"), features.filter("kind != 'polygon'")
    burned = burn_polygons(areas).unionByName(burn_lines(others)).distinct()
    burned = scratch.written(burned, scratch.folder(cells.sparkSession, "burned"))
    met = cells.select("r", "c").join(burned.withColumn("__hit", F.lit(True)).hint("merge"), ["r", "c"], "left")
    if met.filter("__hit").isEmpty():
        return None
    return distance(met, F.col("__hit"), pixel).select("r", "c", closeness("distance", decay).alias(name))


def factor_set(cells: DataFrame, makers: dict[str, Callable[[], DataFrame | None]], folder: str, skip: set[str] | frozenset[str] = frozenset()) -> DataFrame:
    """`cells` with a column for each factor that isn't skipped and has a source.

    A maker gives (r, c, factor); what it gives is written to the folder once and read from there in
    later runs.
    """
    out = cells
    for name, make in makers.items():
        found = tables.cached(cells.sparkSession, f"{folder}/{name}", make, skip=name in skip)
        if found is not None:
            out = out.join(found.select("r", "c", name).hint("merge"), ["r", "c"], "left")
    return out.select(*cells.columns, *[c for c in out.columns if c not in cells.columns])

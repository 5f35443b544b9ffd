"""Neighbourhoods: box sums over a dense grid.

Cells are dealt to tiles of rows and columns with the neighbouring cells copied in: one shuffle of
the cells, and a tile is all that a task holds at once. Within a tile sums are made by numpy. What a
task has of a tile is shuffled as one row of compressed Arrow bytes, so cells that come in the order of
their rows are neither sorted nor spilled one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch

BLOCK_ROWS = 512
#: Columns of a tile.
BLOCK_COLUMNS = 1024
#: Cells that a task deals to tiles at once.
AT_ONCE = 1 << 18
#: Words of 64 bits of a bitmap of places at most, whatever the grid.
WORDS_OF_BITS = 1 << 20


def tiled(cells: DataFrame, size: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`cells` with their tile (__tr, __tc) and __own; those near a border are in their neighbours' tiles as well, not as their own."""
    if size % 2 == 0 or size < 3:
        raise ValueError("the window must be odd and at least 3")
    k = size // 2
    part = lambda c, wide, by=0: F.floor((F.col(c) + by) / wide)
    reach = lambda c, wide: F.explode(F.sequence(part(c, wide, -k), part(c, wide, k)))
    spread = cells.withColumn("__tr", reach("r", block_rows)).withColumn("__tc", reach("c", BLOCK_COLUMNS))
    return spread.withColumn("__own", (F.col("__tr") == part("r", block_rows)) & (F.col("__tc") == part("c", BLOCK_COLUMNS)))


_PIECE = pa.schema([("__tr", pa.int64()), ("__tc", pa.int64()), ("cells", pa.binary())])


def arrow_bytes(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(t)
    return sink.getvalue().to_pybytes()


def _pieces(t: pa.Table, k: int, block_rows: int) -> pa.RecordBatch:
    """The cells of each tile, k rows and columns around it included, as a row of _PIECE."""
    r, c = t.column("r").to_numpy(), t.column("c").to_numpy()
    top, bottom, left, right = (r - k) // block_rows, (r + k) // block_rows, (c - k) // BLOCK_COLUMNS, (c + k) // BLOCK_COLUMNS
    at, tr, tc = [], [], []
    for i in range(int((bottom - top).max()) + 1):
        for j in range(int((right - left).max()) + 1):
            some = np.flatnonzero((top + i <= bottom) & (left + j <= right))
            at.append(some)
            tr.append(top[some] + i)
            tc.append(left[some] + j)
    at, tr, tc = (np.concatenate(x).astype(np.int64) for x in (at, tr, tc))
    # A stable sort of numbers that come in runs is fast; a tile's cells are put in order when all are together.
    order = np.argsort((tr - tr.min()) * (int(tc.max()) - int(tc.min()) + 1) + (tc - tc.min()), kind="stable")
    at, tr, tc = at[order], tr[order], tc[order]
    own = (tr == r[at] // block_rows) & (tc == c[at] // BLOCK_COLUMNS)
    dealt = t.take(pa.array(at)).append_column("__own", pa.array(own))
    first = np.flatnonzero(np.append(True, (np.diff(tr) != 0) | (np.diff(tc) != 0)))
    last = np.append(first[1:], len(at))
    return pa.RecordBatch.from_arrays([pa.array(tr[first]), pa.array(tc[first]), pa.array([arrow_bytes(dealt.slice(a, b - a)) for a, b in zip(first, last)], pa.binary())], schema=_PIECE)


def packed(cells: DataFrame, size: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(__tr, __tc, cells): `cells` dealt as `tiled` deals them, those that a task holds of a tile at once packed into a row (see `unpacked`)."""
    if size % 2 == 0 or size < 3:
        raise ValueError("the window must be odd and at least 3")
    return dealt(cells, size // 2, block_rows)


def dealt(cells: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`packed` with k rows and columns around each tile, or none."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= AT_ONCE:
                yield _pieces(pa.Table.from_batches(held).combine_chunks(), k, block_rows)
                held, n = [], 0
        if n:
            yield _pieces(pa.Table.from_batches(held).combine_chunks(), k, block_rows)

    return cells.mapInArrow(pack, "__tr long, __tc long, cells binary")


def unpacked(t: pa.Table) -> pa.Table:
    """The cells of a tile, with __own, from all its rows of `packed`."""
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in t.column("cells")]).combine_chunks()


def places(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, tuple[int, int], int, int]:
    """(place of each cell in a dense array, the array's shape, its first row and column)."""
    r, c = t.column("r").to_numpy(), t.column("c").to_numpy()
    top, left = int(r.min()), int(c.min())
    shape = int(r.max()) - top + 1, int(c.max()) - left + 1
    return (r - top).astype(np.int64) * shape[1] + (c - left), shape, top, left


def framed(x: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """A grid with k zeros around it, row after row in one array with k zeros more at its end, and the length of a row."""
    h, w = x.shape
    out = np.zeros((h + 2 * k) * (w + 2 * k) + 2 * k, x.dtype)
    out[:(h + 2 * k) * (w + 2 * k)].reshape(h + 2 * k, w + 2 * k)[k:k + h, k:k + w] = x
    return out, w + 2 * k


def box(x: np.ndarray, k: int) -> np.ndarray:
    """Sums over the square of 2k + 1 rows and columns around each place."""
    h, w = x.shape
    flat, wide = framed(x, k)
    n = h * wide  # rows may be short, so they are added end to end
    across = flat[:len(flat) - 2 * k].copy()
    for j in range(1, 2 * k + 1):
        across += flat[j:len(flat) - 2 * k + j]
    out = across[:n].copy()
    for i in range(1, 2 * k + 1):
        out += across[i * wide:i * wide + n]
    return out.reshape(h, wide)[:, :w]


def same_around(x: np.ndarray, k: int) -> np.ndarray:
    """How many places of the square around each place hold the same number, itself left out."""
    h, w = x.shape
    flat, wide = framed(x, k)
    n = (h - 1) * wide + w
    own = flat[k * wide + k:k * wide + k + n]
    out = np.zeros(h * wide, np.int32)
    for i in range(2 * k + 1):
        for j in range(2 * k + 1):
            if i != k or j != k:
                out[:n] += own == flat[i * wide + j:i * wide + j + n]
    return out.reshape(h, wide)[:, :w]


def summed(at: np.ndarray, shape: tuple[int, int], x: np.ndarray, k: int) -> np.ndarray:
    """For each cell the sum of x over its box, the cell itself left out; whole numbers stay whole."""
    dense = np.bincount(at, x, shape[0] * shape[1]).astype(x.dtype)
    return box(dense.reshape(shape), k).ravel()[at] - x


def by_tile(cells: DataFrame, extra: list[str], made: str, size: int, block_rows: int, make: Callable[[pa.Table, np.ndarray, tuple[int, int]], list]) -> DataFrame:
    """`cells` without the columns `extra` and with those that `make` gives for a tile's cells."""
    kept = [c for c in cells.columns if c not in extra]

    def work(t: pa.Table) -> pa.Table:
        t = unpacked(t)
        own = t.column("__own").combine_chunks()
        at, shape, *_ = places(t)
        found = make(t, at, shape)
        out = t.select(kept)
        for name, x in zip(names, found):
            out = out.append_column(name, pa.array(x))
        return out.filter(own)

    schema = cells.select(*kept).schema
    names = [x.split()[0] for x in made.split(", ")]
    for x in made.split(", "):
        schema = schema.add(*x.split())
    return packed(cells, size, block_rows).groupBy("__tr", "__tc").applyInArrow(work, schema)


def box_sums(cells: DataFrame, columns: dict[str, F.Column], size: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`cells` with, for each name, the sum of its expression over the size x size box, the centre left out."""
    names = list(columns)
    rows = cells.select("*", *[x.cast("double").alias(f"__x_{n}") for n, x in columns.items()])

    def make(t: pa.Table, at: np.ndarray, shape: tuple[int, int]) -> list:
        return [summed(at, shape, t.column(f"__x_{n}").fill_null(0.0).to_numpy(), size // 2) for n in names]

    return by_tile(rows, [f"__x_{n}" for n in names], ", ".join(f"{n} double" for n in names), size, block_rows, make)


def _classes(t: pa.Table | pa.RecordBatch, column: str) -> np.ndarray:
    return t.column(column).fill_null(0).to_numpy()


def neighbour_fractions(cells: DataFrame, column: str, targets: list[int], size: int = 5) -> DataFrame:
    """`cells` with n_valid and frac_<class>: the share of the valid neighbours, 0 without any."""
    def make(t: pa.Table, at: np.ndarray, shape: tuple[int, int]) -> list:
        x = _classes(t, column)
        valid = summed(at, shape, ((x >= 1) & (x <= 9)).astype(np.int32), size // 2)
        return [valid.astype(np.int64), *[summed(at, shape, (x == k).astype(np.int32), size // 2) / np.maximum(valid, 1) for k in targets]]

    return by_tile(cells, [], ", ".join(["n_valid long", *[f"frac_{k} double" for k in targets]]), size, BLOCK_ROWS, make)


def sampled_fractions(cells: DataFrame, sample: DataFrame, column: str, targets: list[int], size: int = 5) -> DataFrame:
    """`sample`, some of the `cells`, with n_valid and frac_<class> as `neighbour_fractions` has them.

    The cells around the sample are asked for by their places, and all classes are counted at once. Other cells
    are left out by a bitmap of bounded size before anything is shuffled; what is left is written and met by place,
    so the work grows with the sample, and `cells` is only scanned, once. The sample is read several times.
    """
    if size % 2 == 0 or size < 3:
        raise ValueError("the window must be odd and at least 3")
    k = size // 2
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-k, k + 1) for j in range(-k, k + 1) if i or j])
    # A sample is small as a file, and what is asked for around it is some 24 times as many rows: hence a task for each core.
    asked = sample.select(F.col("r").alias("__r"), F.col("c").alias("__c")).repartition(cells.sparkSession.sparkContext.defaultParallelism, "__r", "__c").distinct()
    halo = asked.select("__r", "__c", F.explode(around).alias("at"))
    halo = halo.select("__r", "__c", (F.col("__r") + F.col("at.i")).alias("r"), (F.col("__c") + F.col("at.j")).alias("c"))
    place = F.xxhash64(F.col("r").cast("long"), F.col("c").cast("long"))
    word, bit = F.pmod(F.shiftright(place, 6), F.lit(WORDS_OF_BITS)).alias("__word"), place.bitwiseAND(63).cast("int").alias("__bit")
    bits = halo.select(word, bit).groupBy("__word").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__bits"))
    thin = cells.select("r", "c", F.col(column).alias("__class"), word, bit).join(F.broadcast(bits), "__word").filter("shiftrightunsigned(__bits, __bit) & 1 = 1").select("r", "c", "__class")
    thin = scratch.written(thin, scratch.folder(cells.sparkSession, "around"))
    # The sizes of grids are guessed far too low, so Spark would broadcast them unasked.
    counts = halo.hint("merge").join(thin, ["r", "c"]).groupBy("__r", "__c").agg(F.count_if(F.col("__class").between(1, 9)).alias("n_valid"), *[F.count_if(F.col("__class") == t).alias(f"__n_{t}") for t in targets])
    met = sample.join(counts.hint("merge"), (sample["r"] == counts["__r"]) & (sample["c"] == counts["__c"]), "left")
    share = [F.when(F.col("n_valid") > 0, F.col(f"__n_{t}") / F.col("n_valid")).otherwise(0.0).alias(f"frac_{t}") for t in targets]
    return met.select(*[sample[c] for c in sample.columns], F.coalesce("n_valid", F.lit(0)).cast("long").alias("n_valid"), *share)


def same_class_support(cells: DataFrame, column: str, size: int = 5) -> DataFrame:
    """`cells` with the share of neighbours that have the cell's own class."""
    def make(t: pa.Table, at: np.ndarray, shape: tuple[int, int]) -> list:
        x, same = _classes(t, column), np.zeros(t.num_rows)
        known = (x >= 1) & (x <= 9)
        valid = np.maximum(summed(at, shape, known.astype(np.int32), size // 2), 1)
        for k in np.unique(x[known]):
            same = np.where(x == k, summed(at, shape, (x == k).astype(np.int32), size // 2) / valid, same)
        return [same]

    return by_tile(cells, [], "support double", size, BLOCK_ROWS, make)


def gradient(cells: DataFrame, column: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`cells` with the gradient's magnitude: central differences, one-sided at the edges."""
    def along(axis: str, *line: str) -> F.Column:
        w = Window.partitionBy(*line).orderBy(axis)
        before, after = F.lag(column).over(w), F.lead(column).over(w)
        return F.when(before.isNull(), after - F.col(column)).when(after.isNull(), F.col(column) - before).otherwise((after - before) / 2)

    rows = cells.withColumn("__dc", along("c", "r"))
    spread = rows.withColumn("__home", F.floor(F.col("r") / block_rows)).withColumn(
        "__block", F.explode(F.array_distinct(F.array(*[F.floor((F.col("r") + d) / block_rows) for d in (-1, 0, 1)]))))
    out = spread.withColumn("__dr", along("r", "c", "__block")).filter("__block = __home")
    return out.withColumn("gradient", F.sqrt(F.col("__dr") * F.col("__dr") + F.col("__dc") * F.col("__dc"))).drop("__dr", "__dc", "__home", "__block")

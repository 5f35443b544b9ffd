"""Hard negatives by a two-dimensional block product of anchors and all rows.

Rows are dealt to tiles of rows, and their components to chunks of dimensions. A block of anchors
meets a block of rows of the same chunk and gives a partial tile of scores; partial tiles of a pair of
tiles are shuffled together and added as int64. Each full tile is reduced at once to the few best
rows of each anchor (of its own label: positives) or of each anchor and positive (of other labels,
within the window that the positive's score sets), and the tiles' few are ranked once more.

Only rows of the same group of labels are multiplied for the positives. Blocks are bounded, whatever
a label's share of the rows, and no scores are kept but the reduced ones.

Defined results: a row without id, label or vector, or with a null or non-finite component, takes no
part; components that a shorter vector lacks are 0, so an empty vector's scores are 0; repeated rows
are rows of their own; ties go by smaller id. Vectors so long that a score could leave the range of
exact whole numbers (a sum of squares of 2^54) are an error. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import written

#: Rows of a tile of anchors and of a tile of all rows, numbers in a block of rows.
ANCHORS, ROWS, NUMBERS = 256, 2048, 1 << 22
#: Dimensions of a chunk at least; chunks at most; groups of labels.
CHUNK, CHUNKS, GROUPS = 32, 8, 16
#: A tile's number is its group times this, and its place in the group.
PLACES = 1 << 40
LARGEST = float(2**54)


def taking_part(vectors: DataFrame, vec_id: Column, vector: Column, label: Column, anchor: Column, scale: float = 256.0) -> DataFrame:
    """(__row, vec_id, label, anchor, v, g): the rows that take part, with whole components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    rows = vectors.filter(vec_id.isNotNull() & label.isNotNull() & vector.isNotNull() & finite)
    rows = rows.select(vec_id.cast("long").alias("vec_id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), whole.alias("v"))
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = rows.withColumn("v", F.when(squares < LARGEST, F.col("v")).otherwise(F.raise_error(F.lit("a vector is too long for exact scores"))))
    return written(rows.select(F.monotonically_increasing_id().alias("__row"), "*", F.pmod(F.xxhash64("label"), F.lit(GROUPS)).alias("g")), "vectors")


def _blocks(rows: DataFrame, tile: Column, width: int, name: str) -> DataFrame:
    """(tile, k, rows, ids, labels, bits, numbers): a tile's rows, by id, with one block for each chunk of dimensions."""
    schema = pa.schema([("tile", pa.int64()), ("k", pa.int64()), ("rows", pa.binary()), ("ids", pa.binary()), ("labels", pa.binary()), ("bits", pa.int64()), ("numbers", pa.binary())])

    def pack(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        order = np.lexsort((t["__row"].to_numpy(), t["vec_id"].to_numpy()))
        lists = t["v"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        ends, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
        sizes = np.diff(ends)
        wide = max(1, int(sizes.max(initial=0)))
        full = np.zeros((len(sizes), -(-wide // width) * width), np.int64)
        at = np.repeat(np.arange(len(sizes)), sizes)
        full[at, np.arange(len(at)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat[ends[0]:ends[-1]]
        full = full[order]
        shown = [t[c].to_numpy()[order].astype("<i8").tobytes() for c in ("__row", "vec_id", "label")]
        out = []
        for k in range(full.shape[1] // width):
            part = np.ascontiguousarray(full[:, k * width:(k + 1) * width])
            if k == 0 or part.any():
                small = _narrow(part)
                out.append((int(t["tile"][0].as_py()), k, *(shown if k == 0 else (None, None, None)), small.itemsize * 8, small.tobytes()))
        return pa.Table.from_pylist([dict(zip(schema.names, r)) for r in out], schema)

    found = rows.withColumn("tile", tile).select("tile", "__row", "vec_id", "label", "v").groupBy("tile").applyInArrow(
        pack, "tile long, k long, rows binary, ids binary, labels binary, bits long, numbers binary")
    return written(found, name)


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in as few bytes as hold them all."""
    top = int(np.abs(x).max(initial=0))
    return x.astype("<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8")


def _read(data: bytes, bits: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{bits // 8}")


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exact: in doubles where no sum can leave their whole numbers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _tiles(anchors: DataFrame, rows: DataFrame, width: int, parts: int, reduce: Callable, schema: str) -> DataFrame:
    """What `reduce` makes of each full tile. anchors: blocks with the tile `j` they meet, and `more` of
    the first chunk; rows: blocks with the tile `i` of anchors they meet."""
    a = anchors.select(F.col("tile").alias("i"), "j", "k", *[F.col(c).alias(f"a_{c}") for c in ("rows", "ids", "labels", "bits", "numbers")], "more")
    b = rows.select("i", F.col("tile").alias("j"), "k", *[F.col(c).alias(f"b_{c}") for c in ("rows", "ids", "labels", "bits", "numbers")])
    met = a.repartition(parts, "i", "j", "k").join(b.repartition(parts, "i", "j", "k"), ["i", "j", "k"])
    kept = ["a_rows", "a_ids", "a_labels", "b_rows", "b_ids", "b_labels", "more"]
    names = ["i", "j", "k", *kept, "bits", "scores"]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                r = batch.slice(n, 1)
                get = lambda c: r.column(c)[0].as_py()
                part = _narrow(_product(_read(get("a_numbers"), get("a_bits")).reshape(-1, width), _read(get("b_numbers"), get("b_bits")).reshape(-1, width)))
                yield pa.RecordBatch.from_arrays([*(r.column(c) for c in ("i", "j", "k", *kept)), pa.array([part.itemsize * 8], pa.int64()), pa.array([part.tobytes()], pa.binary())], names)

    def add(t: pa.Table) -> pa.Table:
        first = t.filter(pc.equal(t["k"], 0)).to_pylist()[0]
        ids = {c: _read(first[c], 64) for c in kept if c != "more"}
        scores = np.zeros((len(ids["a_rows"]), len(ids["b_rows"])), np.int64)
        for bits, part in zip(t["bits"].to_pylist(), t["scores"]):
            scores += _read(part.as_buffer(), bits).reshape(scores.shape)
        return reduce(scores, ids, first["more"])

    binary = ", ".join(f"{c} binary" for c in kept)
    tiles = met.mapInArrow(multiply, f"i long, j long, k long, {binary}, bits long, scores binary")
    return tiles.groupBy("i", "j").applyInArrow(add, schema)


def hard_negatives(rows: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of `taking_part`.

    An anchor's positives are its best other rows of its label; a positive's negatives are the best
    rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    spark = rows.sparkSession
    facts = rows.groupBy("g").agg(F.count("*").alias("n"), F.count_if("anchor").alias("a"), F.max(F.size("v")).alias("wide")).collect()
    wide = max([1, *(r.wide for r in facts)])
    width = max(CHUNK, -(-wide // CHUNKS))
    per_tile = max(64, min(ROWS, NUMBERS // wide))
    tiles = {r.g: max(1, -(-r.n // per_tile)) for r in facts}
    a_tiles = {r.g: max(1, -(-r.a // ANCHORS)) for r in facts if r.a}
    plain = max(1, -(-sum(r.a for r in facts) // ANCHORS))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def dealt(counts: dict[int, int]) -> Column:
        """The tile of a row: its group, and a place by its key."""
        n = F.coalesce(*[F.when(F.col("g") == g, F.lit(n)) for g, n in counts.items()], F.lit(1))
        return F.col("g") * PLACES + F.pmod(F.xxhash64("__row"), n)

    def all_of(counts: dict[int, int]) -> Column:
        return F.flatten(F.array(*[F.sequence(F.lit(g * PLACES), F.lit(g * PLACES + n - 1)) for g, n in counts.items()]))

    def own(counts: dict[int, int]) -> Column:
        """The tiles of the group of a block; none for a group without any."""
        g = F.floor(F.col("tile") / PLACES)
        n = F.coalesce(*[F.when(g == k, F.lit(n)) for k, n in counts.items()], F.lit(0))
        return F.when(n > 0, F.sequence(g * PLACES, g * PLACES + n - 1))

    schema = "a_row long, anchor_id long, vec_id long, score long, b_row long"
    if not a_tiles:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    blocks = _blocks(rows, dealt(tiles), width, "row-blocks")
    anchors = rows.filter("anchor")
    by_label = _blocks(anchors, dealt(a_tiles), width, "anchor-blocks")
    by_key = _blocks(anchors, F.pmod(F.xxhash64("__row"), F.lit(plain)).cast("long"), width, "anchor-blocks")

    def best_of_label(scores: np.ndarray, ids: dict[str, np.ndarray], _: bytes) -> pa.Table:
        out = []
        for n in range(len(scores)):
            at = np.flatnonzero((ids["b_labels"] == ids["a_labels"][n]) & (ids["b_rows"] != ids["a_rows"][n]))
            at = at[np.argsort(-scores[n, at], kind="stable")[:positives]]  # rows of a tile are in order of their ids
            out.append((np.full(len(at), ids["a_rows"][n]), np.full(len(at), ids["a_ids"][n]), ids["b_ids"][at], scores[n, at], ids["b_rows"][at]))
        return pa.Table.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out)], ["a_row", "anchor_id", "vec_id", "score", "b_row"])

    first = _tiles(by_label.withColumn("more", F.lit(None).cast("binary")).withColumn("j", F.explode(own(tiles))),
                   blocks.withColumn("i", F.explode(own(a_tiles))), width, parts, best_of_label, schema)
    nth = F.row_number().over(Window.partitionBy("a_row").orderBy(F.desc("score"), "vec_id", "b_row"))
    found = written(first.withColumn("nth", nth).filter(F.col("nth") <= positives), "positives")

    # The windows of a tile of anchors, a few for each of its anchors, go with its first block.
    pack = lambda t: pa.Table.from_pydict({"i": t["i"][:1], "more": pa.array([np.stack([t[c].to_numpy() for c in ("a_row", "nth", "vec_id", "score")]).astype("<i8").tobytes()], pa.binary())})
    windows = found.select(F.pmod(F.xxhash64(F.col("a_row").alias("__row")), F.lit(plain)).cast("long").alias("i"), "a_row", F.col("nth").cast("long").alias("nth"), "vec_id", "score")
    windows = windows.groupBy("i").applyInArrow(pack, "i long, more binary").select(F.col("i").alias("tile"), F.lit(0).cast("long").alias("k"), "more")

    def best_of_windows(scores: np.ndarray, ids: dict[str, np.ndarray], more: bytes | None) -> pa.Table:
        rows_, nth_, ids_, tops = (_read(more, 64) if more else np.zeros(0, np.int64)).reshape(4, -1)
        place = {int(r): n for n, r in enumerate(ids["a_rows"])}
        of = np.array([place[int(r)] for r in rows_], np.int64)
        bottoms = -(-low * tops // 100)
        tops_in = high * tops // 100
        least, most = np.full(len(scores), 1 << 62), np.full(len(scores), -(1 << 62))
        np.minimum.at(least, of, bottoms)
        np.maximum.at(most, of, tops_in)
        n, m = np.nonzero((scores >= least[:, None]) & (scores <= most[:, None]) & (ids["b_labels"] != ids["a_labels"][:, None]))
        order = np.lexsort((m, -scores[n, m], n))
        n, m = n[order], m[order]
        value = scores[n, m]
        begins = np.searchsorted(n, np.arange(len(scores) + 1))
        out = []
        for w in range(len(of)):
            a, b = begins[of[w]], begins[of[w] + 1]
            start = a + np.searchsorted(-value[a:b], -tops_in[w])
            some = slice(start, min(b, start + negatives))
            keep = value[some] >= bottoms[w]
            out.append((np.full(keep.sum(), w), m[some][keep], value[some][keep]))
        w, m, value = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in out)]) for k in range(3))
        names = {int(r): int(i) for r, i in zip(ids["a_rows"], ids["a_ids"])}
        columns = [rows_[w], np.array([names[int(r)] for r in rows_[w]], np.int64), nth_[w], ids_[w], tops[w], ids["b_ids"][m], value, ids["b_rows"][m]]
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in columns], ["a_row", "anchor_id", "nth", "positive_id", "positive_score", "negative_id", "negative_score", "b_row"])

    second = _tiles(by_key.join(windows, ["tile", "k"], "left").withColumn("j", F.explode(all_of(tiles))),
                    blocks.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(plain - 1).cast("long")))), width, parts, best_of_windows,
                    "a_row long, anchor_id long, nth long, positive_id long, positive_score long, negative_id long, negative_score long, b_row long")
    rank = F.row_number().over(Window.partitionBy("a_row", "nth").orderBy(F.desc("negative_score"), "negative_id", "b_row"))
    return second.withColumn("rank", rank).filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the embeddings: every hundredth id is an anchor, every seventh has the next label."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(taking_part(e, F.col("vec_id"), F.col("embedding"), label, F.col("vec_id") % 100 == 0))


OP12_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS nr, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
),
s AS (
  SELECT a.nr AS a, a.vec_id AS anchor_id, b.nr AS b, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.nr <> b.nr
  WHERE a.vec_id % 100 = 0
),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, b) AS nth FROM s WHERE same) WHERE nth <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.a, p.nth ORDER BY s.score DESC, s.vec_id, s.b) AS rank
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

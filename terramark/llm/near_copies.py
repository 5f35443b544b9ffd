r"""The pipeline's near-dedup: five-word shingles, exact Jaccard similarity of at least 0.8.

SimHash fingerprints of such pairs differ by some ten bits of 64, too many for a covering code to
tell them from strangers; at three bits the anchors of simhash.py find the closest copies, and
min-hashes add the others. Every candidate pair is checked on its shingles. Words and case as in
simhash.py.

1. *Signatures*: a fingerprint, BANDS hashes of RUN min-hashes each, and a byte of the first SKETCH
   min-hashes. A pair of similarity s shares a band with probability 1 - (1 - s**RUN)**BANDS: over
   0.999 at 0.8, and more above.
2. *Classes*: rows of equal shingle sets (by 64 bits and number) are one node.
3. *Small bands*: links of the anchors, and all pairs within bands of at most FEW nodes.
4. *Large bands*: by what nodes differ in from a common set, see `differing`. No pair is left out,
   and copies that were changed in different places never meet.
5. *Rows*: of each component the row with the smallest id stays (nulls last), told by a row key, so
   that repeated or null ids are no hindrance.

Before its shingles are compared, a pair must agree in LEAST bytes of the sketch: at similarity 0.8
that is over four standard deviations below the mean. Shingles are compared by 64 bits of hash.

Defined cases: null texts and texts without words are one class; texts of fewer than five words are
one shingle; repeated rows are one class; very long texts are taken whole; an empty table stays
empty; other columns pass through, whatever their names, but for `__terramark_row`, the row's key.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import components, keyed, short_batches, written
from .simhash import fingerprint_links

WORDS, BANDS, RUN, SKETCH, LEAST = 5, 24, 6, 144, 94
#: Nodes of a band whose pairs are all compared.
FEW = 16
#: Words of 64 bits of a bitmap of rows at most, whatever the input.
WORDS_OF_BITS = 1 << 21
#: Similarity 4/5: 9 * common >= 4 * (n_a + n_b).
SAME = "9 * common >= 4 * (a_n + b_n)"
SIZES = "5 * least(a_n, b_n) >= 4 * greatest(a_n, b_n)"
_FACTORS = np.random.default_rng(42).integers(1, 1 << 63, (BANDS * RUN, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_SIGNATURE = T.StructType([T.StructField("digest", T.LongType()), T.StructField("n", T.LongType()), T.StructField("fp", T.LongType()),
                           T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order (fewer words: the whole sequence)."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = list(itertools.accumulate(len(p) + 1 for p in parts))
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(joined[a:b - 1], 42) for a, b in zip([0, *ends], ends[words - 1:] or ends[-1:])], np.uint64))


def min_hashes(found: np.ndarray) -> np.ndarray:
    low = np.full(BANDS * RUN, np.iinfo(np.uint64).max)
    for at in range(0, len(found), 256):
        low = np.minimum(low, (found[at:at + 256] * _FACTORS).min(axis=1))
    return low


def bands(low: np.ndarray) -> list[int]:
    """The hashes of the bands of min-hashes."""
    return [xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(low.reshape(BANDS, RUN))]


def fingerprint_of(found: np.ndarray) -> np.int64:
    """The SimHash of a set of shingles."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), 1 << 16):
        ones += np.unpackbits(found[at:at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(found)).view(">i8")[0].astype(np.int64)


@F.pandas_udf(_SIGNATURE)
def _signatures(texts: pd.Series) -> pd.DataFrame:
    out = []
    for t in texts:
        found = shingles(t)
        low = min_hashes(found)
        own = np.array(bands(low) if len(found) else [], np.uint64).view(np.int64)
        sketch = (low[:SKETCH] >> np.uint64(40)).astype(np.uint8).tobytes()
        out.append((np.uint64(xxhash.xxh64_intdigest(found.tobytes())).view(np.int64), len(found), fingerprint_of(found), own, sketch))
    return pd.DataFrame(out, columns=["digest", "n", "fp", "bands", "sketch"])


@F.pandas_udf(T.IntegerType())
def _agreeing(a: pd.Series, b: pd.Series) -> pd.Series:
    """How many bytes of two sketches agree."""
    flat = lambda x: np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1)
    return pd.Series((flat(a) == flat(b)).sum(axis=1).astype(np.int32) if len(a) else np.zeros(0, np.int32))


@F.pandas_udf(T.ArrayType(T.LongType()))
def _shingle_sets(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles(t).view(np.int64) for t in texts], dtype=object)


def marked(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """`rows` with __marked: whether a row may be among `keys` (__terramark_row); never false for one that is.

    A bitmap of bounded size is broadcast, so that rows which aren't asked for aren't shuffled.
    """
    word, bit = F.pmod(F.shiftright("__terramark_row", 6), F.lit(WORDS_OF_BITS)), F.col("__terramark_row").bitwiseAND(63).cast("int")
    placed = keys.select(word.alias("__word"), bit.alias("__bit"))
    bits = written(placed.groupBy("__word").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__bits")), "bitmap")
    found = rows.withColumn("__word", word).withColumn("__bit", bit).join(F.broadcast(bits), "__word", "left")
    return found.withColumn("__marked", F.coalesce(F.expr("shiftrightunsigned(__bits, __bit) & 1 = 1"), F.lit(False))).drop("__word", "__bit", "__bits")


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those (a, b) of `pairs`, each a node's key, whose sizes allow the similarity and whose sketches agree."""
    of = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"{k}_n"), F.col("sketch").alias(f"{k}_sketch"))
    found = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(of("a"), "a").join(of("b"), "b")
    return written(found.filter(SIZES).filter(_agreeing("a_sketch", "b_sketch") >= LEAST).select("a", "b"), "pairs")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(src, dst): those (a, b) of `pairs` whose shingle sets have the similarity."""
    both = (pairs.join(sets.select(F.col("node").alias("b"), F.col("s").alias("t")), "b")
            .join(sets.select(F.col("node").alias("a"), "s"), "a"))
    sized = both.select("a", "b", F.size("s").alias("a_n"), F.size("t").alias("b_n"), F.size(F.array_intersect("s", "t")).alias("common"))
    return sized.filter(SAME).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def references(large: DataFrame) -> DataFrame:
    """(ref, node): the nodes of large bands (h, node, members) by a node that stands for theirs; all of a band have one in common.

    It is the node that shares bands with most others, such as the text that all copies were made of:
    of a band, and then of all bands of that one, so that most bands of a group of copies have the same.
    """
    weights = large.groupBy("node").agg(F.sum("members").alias("weight"))
    tops = written(large.join(weights, "node").groupBy("h").agg(F.max(F.struct("weight", "node")).alias("top")), "tops")
    above = large.join(tops, "h").groupBy("node").agg(F.max("top").alias("above"))
    chosen = tops.select("h", F.col("top.node").alias("node")).join(above, "node").select("h", F.col("above.node").alias("ref"))
    return written(large.join(chosen, "h").select("ref", "node").distinct(), "references")


def differing(named: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, pairs): nodes of a group (ref, node) that are similar for certain, and all other pairs that can be.

    D is what a node's set and a common set R differ in; two nodes differ in the difference of their Ds.
    Nodes are similar if they differ in at most (a_n + b_n) / 9 shingles, so with G = 9 |D| - n they are if
    G_a + G_b <= 0, and else must have (G_a + G_b) / 18 of their Ds in common. All that are similar
    for certain to the node of least G are linked with it. Of any other pair at least one node isn't, so its
    Ds share a shingle, and the sizes say how many; so the first few of each D, in one order, share one as
    well. R has the shingles of over half of the group, and those of a D that R lacks come first, being rare.
    """
    per_ref = lambda df: df.join(sets.select("node", "s"), "node")
    either = lambda a, b: F.concat(F.array_except(a, b), F.array_except(b, a))
    own = named.select("ref").distinct().join(sets.select(F.col("node").alias("ref"), F.col("s").alias("r")), "ref")
    sizes = named.groupBy("ref").agg(F.count("*").alias("group"))
    rough = per_ref(named).join(own, "ref").select("ref", F.explode(either("s", "r")).alias("e")).groupBy("ref", "e").agg(F.count("*").alias("times"))
    turned = rough.join(sizes, "ref").filter("2 * times > group").groupBy("ref").agg(F.collect_list("e").alias("turned"))
    common = written(own.join(turned, "ref", "left").select("ref", F.when(F.col("turned").isNull(), F.col("r")).otherwise(either("r", "turned")).alias("r")), "common")
    found = per_ref(named).join(common, "ref").select("ref", "node", F.size("s").alias("n"), either("s", "r").alias("d"))
    found = written(found.withColumn("g", 9 * F.size("d") - F.col("n")), "differences")
    least = found.groupBy("ref").agg(F.min(F.struct("g", "node")).alias("least"))
    placed = found.join(least, "ref").withColumn("linked", F.col("g") + F.col("least.g") <= 0)
    links = placed.filter("linked AND node != least.node").select(F.col("node").alias("src"), F.col("least.node").alias("dst"))

    # What Ds must have in common at least: with a node that isn't linked, and of such a node with a linked one.
    by_size = F.size("d") - F.floor(F.col("n") / 4)
    first = lambda shared: F.greatest(F.lit(0), F.size("d") - F.greatest(F.lit(1), shared, by_size) + 1).cast("int")
    short, long = first(F.floor((F.col("g") - F.col("least.g")) / 18) + 1), first(F.ceil((F.col("g") + F.col("least.g")) / 18))
    held = placed.withColumn("short", short).withColumn("held", F.when(F.col("linked"), short).otherwise(F.greatest(short, long)))
    firsts = written(held.select("ref", "node", "linked", "short", F.posexplode(F.slice("d", F.lit(1), F.col("held"))).alias("at", "e")), "firsts")
    side = lambda k: firsts.select("ref", "e", F.col("node").alias(k), F.col("linked").alias(f"{k}_linked"), (F.col("at") < F.col("short")).alias(f"{k}_short"))
    met = side("a").join(side("b"), ["ref", "e"]).filter("NOT a_linked AND (b_linked OR (a_short AND b_short AND a < b))")
    return links, met.select("a", "b").distinct()


def groups(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__terramark_row, id, component) for each of `rows`, which have a key __terramark_row."""
    prints = written(rows.select("__terramark_row", rows[id_col].cast("long").alias("id"), _signatures(F.col(text_col).cast("string")).alias("p"))
                     .select("__terramark_row", "id", "p.*"), "signatures")
    first = prints.groupBy("digest", "n").agg(F.min("__terramark_row").alias("__terramark_row"))
    nodes = written(prints.join(first.select("__terramark_row"), "__terramark_row", "left_semi").withColumnRenamed("__terramark_row", "node").drop("id"), "nodes")

    fps = written(nodes.filter("n > 0").groupBy("fp").agg(F.min("node").alias("low")), "fps")
    low = lambda k: fps.select(F.col("fp").alias(k), F.col("low").alias(f"{k}_low"))
    close = fingerprint_links(fps.select("fp")).join(low("src"), "src").join(low("dst"), "dst").select(F.col("src_low").alias("a"), F.col("dst_low").alias("b"))
    same = nodes.join(fps, "fp").filter("node != low").select(F.col("low").alias("a"), F.col("node").alias("b"))

    entries = nodes.select("node", F.explode("bands").alias("h"))
    hits = written(entries.withColumn("members", F.count("*").over(Window.partitionBy("h"))).filter("members > 1"), "hits")
    few, large = hits.filter(F.col("members") <= FEW), hits.filter(F.col("members") > FEW)
    side = lambda k: few.select("h", F.col("node").alias(k))
    pairs = likely(close.unionByName(same).unionByName(side("a").join(side("b"), "h").filter("a < b").select("a", "b")), nodes)
    named = references(large)
    asked = written(pairs.select(F.explode(F.array("a", "b")).alias("__terramark_row")).unionByName(named.select(F.col("node").alias("__terramark_row"))).distinct(), "asked")
    texts = marked(rows.select("__terramark_row", F.col(text_col).cast("string").alias("text")), asked).filter("__marked")
    sets = written(texts.join(asked, "__terramark_row", "left_semi").select(F.col("__terramark_row").alias("node"), _shingle_sets("text").alias("s")), "sets")
    links, others = differing(named, sets)
    near = written(links.unionByName(similar(pairs.unionByName(likely(others, nodes)).distinct(), sets)), "near")

    found = components(near)
    whole = nodes.join(found, "node", "left").select("digest", "n", F.coalesce("component", "node").alias("component"))
    return prints.select("__terramark_row", "id", "digest", "n").join(whole, ["digest", "n"]).select("__terramark_row", "id", "component")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, one of each group of near copies."""
    short_batches(docs.sparkSession)
    rows = keyed(docs)
    found = written(groups(rows, id_col, text_col), "groups")
    kept = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "__terramark_row")).alias("best")).select(F.col("best.__terramark_row").alias("__terramark_row"))
    gone = written(found.select("__terramark_row").join(kept, "__terramark_row", "left_anti"), "gone")
    seen = marked(rows, gone)
    stay = seen.filter("NOT __marked").union(seen.filter("__marked").join(gone, seen["__terramark_row"] == gone["__terramark_row"], "left_anti"))
    return stay.drop("__terramark_row", "__marked")

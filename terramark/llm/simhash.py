r"""SimHash near-dedup by anchor points of a covering code.

Fingerprints: A-Z lower-cased, words `[^\x20\x09-\x0D]+`, 3-word shingles with repeats joined by
one space (fewer words: the whole sequence; none: fingerprint zero), XXH64 with seed 42; a bit of
the fingerprint is 1 if it is set in over half of the hashes.

Links: the anchors are the words of the binary Golay code, a perfect code of 23 bits and covering
radius 3: each block of 23 bits has one nearest word, its home. A fingerprint also visits every
anchor that a fingerprint at most `distance` bits away can have as its home, that is those within
covering radius plus threshold, so a pair always meets at the home of one of them. The first block
alone makes 4096 anchors; an anchor that is home to more than `home_size` fingerprints is split by
the words of the second block, and then of the third (the last 18 bits), with what is left of the
threshold. A fingerprint thus has the same number of visits at any size until anchors are overfull.
Only distinct fingerprints are replicated; inside an anchor a breadth-first search joins linked
fingerprints by as many links as there are fingerprints, never all pairs.

Defined cases: a null text has no words; repeated rows and equal fingerprints belong together;
null ids take part, but the component's name is the smallest id that isn't null; other columns
are ignored, whatever their names; an empty table gives none.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import components, id_text, short_batches, written

DISTANCE = 3
HOME_SIZE = 4096
#: Length and covering radius of the code, and its generator polynomial.
BITS, RADIUS, GENERATOR = 23, 3, 0b101011100011
#: First bit of each block of the fingerprint.
BLOCKS = (0, 23, 46)


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = list(itertools.accumulate(len(p) + 1 for p in parts))
    starts = [0, *ends]
    h = xxhash.xxh64_intdigest
    last = ends[words - 1:] or ends[-1:]
    hashes = np.array([h(joined[a:b - 1], 42) for a, b in zip(starts, last)], dtype=">u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduce(bits, axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([_signed(fingerprint(t)) for t in texts], dtype="int64")


def _remainder(x: np.ndarray) -> np.ndarray:
    """The syndrome: what is left of words divided by the generator."""
    x = x.astype(np.int64)
    for k in range(BITS - 1, 10, -1):
        x = np.where(x >> k & 1, x ^ (GENERATOR << (k - 11)), x)
    return x


@functools.lru_cache(maxsize=4)
def _patterns(distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each syndrome, where its patterns begin; the patterns of up to RADIUS + distance bits,
    and how many bits of the threshold each costs. The first pattern of a syndrome costs none."""
    words = [0]
    for n in range(1, RADIUS + distance + 1):
        words += [sum(1 << k for k in some) for some in itertools.combinations(range(BITS), n)]
    word = np.array(words, np.int64)
    syndrome = _remainder(word)
    order = np.argsort(syndrome, kind="stable")
    cost = np.maximum(0, np.bitwise_count(word).astype(np.int64) - RADIUS)
    return np.searchsorted(syndrome[order], np.arange(2049)), word[order], cost[order]


def home_anchors(fps: np.ndarray, level: int, distance: int = DISTANCE) -> np.ndarray:
    """The message bits of the nearest code word of a block."""
    start, word, _ = _patterns(distance)
    block = (fps >> np.uint64(BLOCKS[level]) & np.uint64((1 << BITS) - 1)).astype(np.int64)
    return (block ^ word[start[_remainder(block)]]) >> 11


def visits(fps: np.ndarray, anchor: np.ndarray, left: np.ndarray, home: np.ndarray, level: int,
           distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, left of the threshold, is home) of each visit, one level further down.

    Of two fingerprints at home in one anchor so far, the one with the larger home visits the
    other's, so such visits go to anchors below the own home only; guests visit all in reach.
    """
    start, word, cost = _patterns(distance)
    block = (fps >> np.uint64(BLOCKS[level]) & np.uint64((1 << BITS) - 1)).astype(np.int64)
    syndrome = _remainder(block)
    times = start[syndrome + 1] - start[syndrome]
    row = np.repeat(np.arange(len(fps)), times)
    at = np.repeat(start[syndrome] - np.cumsum(times) + times, times) + np.arange(len(row))
    own = (block ^ word[start[syndrome]]) >> 11
    code = (block[row] ^ word[at]) >> 11
    rest = left[row] - cost[at]
    is_home = home[row] & (code == own[row])
    fits = (rest >= 0) & (is_home | ~home[row] | (code < own[row]))
    row, code, rest, is_home = row[fits], code[fits], rest[fits], is_home[fits]
    return row, anchor[row] | code + 1 << 13 * level, rest, is_home


def stars(fps: np.ndarray, home: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links (from, to) that join all linked fingerprints, each of a home fingerprint and any other."""
    edges: list[tuple[int, int]] = []
    guests, homes = fps[~home], fps[home]
    while len(homes):
        queue, homes = [(homes[0], True)], homes[1:]
        while queue:
            x, at_home = queue.pop()
            near = np.bitwise_count(homes ^ x) <= distance
            if near.any():
                queue += [(y, True) for y in homes[near]]
                edges += [(y, x) for y in homes[near]]
                homes = homes[~near]
            if at_home:
                near = np.bitwise_count(guests ^ x) <= distance
                if near.any():
                    queue += [(y, False) for y in guests[near]]
                    edges += [(y, x) for y in guests[near]]
                    guests = guests[~near]
    return edges


def fingerprint_links(fps: DataFrame, distance: int = DISTANCE, home_size: int = HOME_SIZE) -> DataFrame:
    """Links (src, dst) that join all linked fingerprints; `fps` holds distinct ones as `fp`."""
    schema = "anchor long, fp long, left_bits long, home boolean"

    def sent(level: int):
        def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                own, n = b["fp"].to_numpy(np.int64), len(b)
                before = (b["anchor"].to_numpy(np.int64), b["left_bits"].to_numpy(np.int64), b["home"].to_numpy(bool)) if level else (
                    np.zeros(n, np.int64), np.full(n, distance), np.ones(n, bool))
                row, anchor, left, home = visits(own.view(np.uint64), *before, level, distance)
                yield pd.DataFrame({"anchor": anchor, "fp": own[row], "left_bits": left, "home": home})
        return send

    def compare(b: pd.DataFrame) -> pd.DataFrame:
        found = stars(b["fp"].to_numpy(np.int64).view(np.uint64), b["home"].to_numpy(bool), distance)
        return pd.DataFrame(np.array(found, np.uint64).reshape(-1, 2).view(np.int64), columns=["src", "dst"])

    @F.pandas_udf("long")
    def first_home(fp: pd.Series) -> pd.Series:
        return pd.Series(home_anchors(fp.to_numpy(np.int64).view(np.uint64), 0, distance) + 1)

    now = fps.select("fp").mapInPandas(sent(0), schema)
    homes = fps.select(first_home("fp").alias("anchor"))
    done = []
    for level in range(1, len(BLOCKS)):
        full = written(homes.groupBy("anchor").count().filter(F.col("count") > home_size).select("anchor"), "overfull")
        if full.isEmpty():
            break
        done.append(now.join(full, "anchor", "left_anti"))
        now = written(now.join(full, "anchor", "left_semi").mapInPandas(sent(level), schema), "visits")
        homes = now.filter("home").select("anchor")
    every = functools.reduce(DataFrame.unionByName, [*done, now])
    return every.select("anchor", "fp", "home").groupBy("anchor").applyInPandas(compare, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    distance: int = DISTANCE, home_size: int = HOME_SIZE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    short_batches(docs.sparkSession)
    prints = written(id_text(docs, id_col, text_col).select("doc_id", _fingerprints("text").alias("fp")), "prints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    links = components(fingerprint_links(classes.select("fp"), distance, home_size))
    linked = classes.join(links, classes["fp"] == links["node"], "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("component"))
    names = linked.groupBy("component").agg(F.min("low").alias("component_id"))
    named = written(linked.join(names, "component").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay: of each component the smallest doc_id (and null ids alone)."""
    found = near_duplicates(docs, id_col, text_col).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = found.select(F.col("doc_id").alias("__terramark_kept_id")).distinct()
    return docs.join(kept, docs[id_col].cast("long").eqNullSafe(F.col("__terramark_kept_id")), "left_semi")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

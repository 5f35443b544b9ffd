r"""Substring dedup with a count-min prefilter.

Words are `[^\x20\x09-\x0D]+`, a window is 13 consecutive words of one document. A word goes if
some window over it has a word sequence that also starts in a document with a smaller id.

1. *Sketch*: each task counts its windows in a count-min sketch of two rows; counts saturate at
   two, so a row is two bitmaps (seen, seen twice). Merged over all tasks they overestimate, never
   underestimate: a window whose cells aren't both seen twice occurs once and is out.
2. *Grouping*: only windows estimated repeated go on, as 96 bits of hash with document and place.
   Within a task all but the smallest document of a window are decided at once, so a frequent
   window leaves each task once; buckets of hashes then find the smallest document overall.
3. *Removal*: decisions go back to the chunk they came from, become runs of words for each
   document, and are joined to the texts.

The sketch has as many cells as the text has bytes over four, as a power of two, at most MAX_CELLS
(64 MB to broadcast); on inputs beyond that it lets more single windows through to the grouping,
which decides exactly, so results stay whole.

Defined cases: a null text has no words; documents of fewer than 13 words lose none; a null id
counts as larger than all others; windows within documents of one id don't count against each
other, and rows that repeat id and text get the same result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import id_text, short_batches

WORDS, MAX_CELLS, SLICE = 13, 1 << 28, 1 << 22
FLUSH = 1_000_000
NULL_ID = 2**63 - 1


def window_hashes(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each window (64 and 32 bits), its text's number and its first word's place."""
    parts = [t.encode().split() for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    flat = np.empty(int(sizes.sum()), object)
    flat[:] = [w for p in parts for w in p]
    n = len(flat) - words + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32)
    one = pd.util.hash_array(flat)
    a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for k in range(words):
        a = a * np.uint64(0x9E3779B97F4A7C15) + one[k:k + n]
        a ^= a >> np.uint64(29)
        b = (b ^ one[k:k + n]) * np.uint64(0xD6E8FEB86659FD93)
        b ^= b >> np.uint64(32)
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = np.flatnonzero(place[:n] + words <= sizes[owner[:n]])
    return a[inside], b[inside].astype(np.uint32), owner[inside], place[inside].astype(np.int32)


def _cells(a: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The window's cell in either row of the sketch."""
    return (a >> np.uint64(64 - bits)).astype(np.int64), (a & np.uint64((1 << bits) - 1)).astype(np.int64)


def _gaps(cells: np.ndarray) -> bytes:
    """Sorted cells as steps of a byte; 255 goes on, a step of 0 is the same cell again."""
    steps = np.diff(cells, prepend=0)
    more = steps // 255
    out = np.full(len(cells) + int(more.sum()), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = steps % 255
    return out.tobytes()


def _from_gaps(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps < 255]


def sketch(texts: DataFrame, bits: int, hashes: Callable[[list[str]], np.ndarray]) -> list[np.ndarray]:
    """The merged rows' bitmaps of cells seen at least twice, for the hashes of all `texts`."""
    size = min(SLICE, 1 << bits)
    parts = texts.rdd.getNumPartitions()
    salts = math.isqrt(parts) if parts > 256 else 1  # many sketches are merged in two steps
    names = ["row", "slice", "salt", "cells", "seen", "twice"]
    schema = "row int, slice int, salt int, cells binary, seen binary, twice binary"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        me, held, n = TaskContext.get().partitionId() % salts, [], 0

        def flush() -> Iterator[pd.DataFrame]:
            a = np.concatenate(held)
            for row, cells in enumerate(_cells(a, bits)):
                cells = np.sort(cells)
                cut = np.searchsorted(cells, np.arange(0, (1 << bits) + 1, size))
                for k in np.flatnonzero(cut[1:] > cut[:-1]):
                    yield pd.DataFrame([(row, k, me, _gaps(cells[cut[k]:cut[k + 1]] - k * size), None, None)], columns=names)

        for b in batches:
            held.append(hashes(list(b["text"])))
            n += len(held[-1])
            if n > 3 * FLUSH:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    def merge(b: pd.DataFrame) -> pd.DataFrame:
        seen, twice = np.zeros(size, bool), np.zeros(size, bool)
        for c, s, t in zip(b["cells"], b["seen"], b["twice"]):
            if c is not None:
                cells = _from_gaps(c)
                again = np.concatenate([[False], cells[1:] == cells[:-1]])
                twice[cells[again]] = True
                cells = cells[~again]
                twice[cells[seen[cells]]] = True
                seen[cells] = True
            else:
                s, t = (np.unpackbits(np.frombuffer(zlib.decompress(x), np.uint8)).astype(bool) for x in (s, t))
                twice |= t | (seen & s)
                seen |= s
        s, t = (zlib.compress(np.packbits(x), 1) for x in (seen, twice))
        return pd.DataFrame([(b["row"].iloc[0], b["slice"].iloc[0], b["salt"].iloc[0], None, s, t)], columns=names)

    merged = texts.select("text").mapInPandas(count, schema).groupBy("row", "slice", "salt").applyInPandas(merge, schema)
    if salts > 1:
        merged = merged.groupBy("row", "slice").applyInPandas(merge, schema)
    rows = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(2)]
    for r in merged.select("row", "slice", "twice").toLocalIterator():
        rows[r["row"]][r["slice"] * size // 8:(r["slice"] + 1) * size // 8] = np.frombuffer(zlib.decompress(r["twice"]), np.uint8)
    return rows


def seen_twice(rows: list[np.ndarray], a: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes the sketch estimates as repeated."""
    twice = np.ones(len(a), bool)
    for bitmap, cell in zip(rows, _cells(a, bits)):
        twice &= (bitmap[cell >> 3] >> (7 - (cell & 7)) & 1).astype(bool)
    return twice


def _groups(*keys: np.ndarray) -> np.ndarray:
    """The group number of each element of arrays sorted by `keys`."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


_SENT = "bucket int, chunk long, decided boolean, a binary, b binary, doc binary, mark binary, place binary"


def _row(bucket: int, chunk: int, decided: bool, a, b, doc, mark, place) -> tuple:
    order = np.lexsort((place, mark, doc))  # runs of one document compress well
    return (bucket, chunk, decided, *(x[order].tobytes() if len(x) else b"" for x in (a, b, doc, mark, place)))


def _send(shared, bits: int, buckets: int, words: int):
    """The task that estimates, decides what it can by itself, and sends the rest to buckets."""
    def flush(held: list[tuple[np.ndarray, ...]], chunk: int) -> pd.DataFrame:
        a, b, doc, mark, place = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((doc, b, a))
        a, b, doc, mark, place = a[order], b[order], doc[order], mark[order], place[order]
        group = _groups(a, b)
        low = doc[np.searchsorted(group, np.arange(group[-1] + 1))]
        gone = doc > low[group]
        none = np.zeros(0, np.uint8)
        rows = [_row(((chunk >> 32) * 7919 + (chunk & 0xFFFFFFFF)) % buckets, chunk, True, none, none, doc[gone], mark[gone], place[gone])] if gone.any() else []
        a, b, doc, mark, place = (x[~gone] for x in (a, b, doc, mark, place))
        to = (a >> np.uint64(20)).astype(np.int64) % buckets
        for k in np.unique(to):
            at = to == k
            rows.append(_row(int(k), chunk, False, a[at], b[at], doc[at], mark[at], place[at]))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _SENT.split(", ")])

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = shared.value
        held, n, chunk = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            a, b, owner, place = window_hashes(list(batch["text"]), words)
            twice = seen_twice(rows, a, bits)
            owner = owner[twice]
            held.append((a[twice], b[twice], batch["doc_id"].to_numpy(np.int64)[owner], batch["mark"].to_numpy(np.int64)[owner], place[twice]))
            n += len(owner)
            if n > FLUSH:
                yield flush(held, chunk)
                held, n, chunk = [], 0, chunk + 1
        if n:
            yield flush(held, chunk)

    return send


def _decide(b: pd.DataFrame) -> pd.DataFrame:
    """In a bucket: which windows also start in a smaller document. Back to each one's chunk."""
    out = [(r.chunk, r.doc, r.mark, r.place) for r in b[b["decided"]].itertuples()]
    asked = b[~b["decided"]]
    if len(asked):
        read = lambda name, kind: [np.frombuffer(x, kind) for x in asked[name]]
        a, c, doc, mark, place = (read(n, k) for n, k in (("a", np.uint64), ("b", np.uint32), ("doc", np.int64), ("mark", np.int64), ("place", np.int32)))
        nth = np.repeat(np.arange(len(a)), [len(x) for x in a])
        a, c, doc, mark, place = (np.concatenate(x) for x in (a, c, doc, mark, place))
        order = np.lexsort((doc, c, a))
        group = _groups(a[order], c[order])
        low = doc[order][np.searchsorted(group, np.arange(group[-1] + 1))]
        gone = np.zeros(len(a), bool)
        gone[order] = doc[order] > low[group]
        chunks, gone = asked["chunk"].to_numpy(), np.flatnonzero(gone)
        for at in np.split(gone, np.flatnonzero(np.diff(nth[gone])) + 1):
            if len(at):
                out.append((chunks[nth[at[0]]], doc[at].tobytes(), mark[at].tobytes(), place[at].tobytes()))
    return pd.DataFrame(out, columns=["chunk", "doc", "mark", "place"])


def _runs_of(words: int):
    def runs(b: pd.DataFrame) -> pd.DataFrame:
        """For each document of the chunk the maximal runs of removed words: starts and ends."""
        doc, mark, place = (np.concatenate([np.frombuffer(x, k) for x in b[n]]) for n, k in (("doc", np.int64), ("mark", np.int64), ("place", np.int32)))
        order = np.lexsort((place, mark, doc))
        doc, mark, place = doc[order], mark[order], place[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]) | (place[1:] > place[:-1] + words)
        first = np.flatnonzero(new)
        ends = place[np.append(first[1:], len(doc)) - 1] + words
        rows = pd.DataFrame({"doc_id": doc[first], "mark": mark[first], "start": place[first], "end": ends})
        return rows.groupby(["doc_id", "mark"], sort=False).agg(list).reset_index().rename(columns={"start": "starts", "end": "ends"})

    return runs


def removed_runs(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, mark, starts, ends): the removed words of documents that lose some.

    texts: doc_id (not null), mark (a hash of the text) and text.
    """
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = min(int(math.log2(MAX_CELLS)), max(16, math.ceil(math.log2(max(4, size) / 4))))
    buckets = max(48, size >> 23)
    shared = spark.sparkContext.broadcast(sketch(texts, bits, lambda t: window_hashes(t, words)[0]))
    sent = texts.mapInPandas(_send(shared, bits, buckets, words), _SENT)
    decided = sent.groupBy("bucket").applyInPandas(_decide, "chunk long, doc binary, mark binary, place binary")
    runs = decided.groupBy("chunk").applyInPandas(_runs_of(words), "doc_id long, mark long, starts array<int>, ends array<int>")
    # Rows that repeat id and text lie in several chunks, with the same decisions.
    return runs.groupBy("doc_id", "mark").agg(F.max("starts").alias("starts"), F.max("ends").alias("ends"))


def marked_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_text(docs, id_col, text_col).select(
        F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), F.xxhash64("text").alias("mark"), "text")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per document: doc_id, text (kept words joined by one space), n_words, n_removed,
    kept_sha256, starts and ends of the removed runs of words."""
    short_batches(docs.sparkSession)
    texts = marked_texts(docs, id_col, text_col)

    @F.pandas_udf("kept string, n_words long, n_removed long, kept_sha256 string")
    def cut(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        rows = []
        for t, s, e in zip(text, starts, ends):
            found = t.encode().split()
            kept, at = [], 0
            for x, y in zip(s if s is not None else (), e if e is not None else ()):
                kept += found[at:x]
                at = y
            kept += found[at:]
            joined = b" ".join(kept)
            rows.append((joined.decode(), len(found), len(found) - len(kept), hashlib.sha256(joined).hexdigest()))
        return pd.DataFrame(rows, columns=["kept", "n_words", "n_removed", "kept_sha256"])

    joined = texts.join(removed_runs(texts, words), ["doc_id", "mark"], "left").withColumn("c", cut("text", "starts", "ends"))
    return joined.select(F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), F.col("c.kept").alias("text"),
                         "c.n_words", "c.n_removed", "c.kept_sha256", "starts", "ends")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w),
h AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS win FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS low FROM h) WHERE doc_id > low),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM r),
e AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM w),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS kept FROM e ANTI JOIN g USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""

r"""Suffix-array dedup: a multi-document BWT with common prefixes, built column by column.

Texts are UTF-8 bytes; a byte goes if some 400-byte string over it also starts anywhere else.

1. *Pieces*: in each 400-byte string the 32-byte gram of smallest hash (the leftmost of equal
   ones) is its anchor; it depends on the string alone. The strings of one anchor place with a part
   of the possible lefts (bytes before the anchor) lie in one piece of the text and have the bytes
   of its key in common: 216 or more around the anchor. Equal strings lie in pieces of equal keys.
   Pieces whose key a count-min sketch of all keys estimates as single can't hold a repeat.
2. *Collections*: the other pieces go to buckets by their key's hash, equal pieces of a chunk once
   with the number of copies. Pieces of a bucket of more than BUCKET_BYTES are cut in half by their
   lefts, with longer keys, as often as it takes: a passage in a million contexts thus ends as
   pieces that either differ in their keys, and spread, or are equal, and are one in each chunk.
   A bucket's pieces are a collection of documents.
3. *Construction*: each round inserts one symbol for each document, from its end on: the rows of
   the transform (the symbol before each suffix) move by the last-to-first mapping, and a row's
   common prefix with the one above is one more than the least between the two rows it comes
   from. A symbol is BLOCK bytes themselves (no hash), on a grid fixed by the anchor, one document
   for each phase of the grid; so 400 / BLOCK symbols in common are 400 equal bytes.
4. *Removal*: strings with such a neighbour, or of a piece with copies, go back to the chunk, and
   become runs of bytes for each document, joined to the texts.

A collection is a few MB, so a round hands its transform and prefixes to the next in memory, not in
external files. Hashes choose candidates and buckets alone; what is removed is compared by bytes.

Defined cases: a null text counts as empty; texts under 400 bytes lose nothing; equal texts
of 400 bytes or more lose everything, repeated rows too; very long texts are taken whole; of ties
none stays, since every copy of a string goes; null ids are allowed; other columns are
ignored. Cuts may fall inside a character, so what remains is given as bytes.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import short_batches, written
from .substring_dedup import NULL_ID, marked_texts, seen_twice, sketch

LENGTH, GRAM, BLOCK = 400, 32, 50
#: Bytes of pieces in a bucket beyond which they are cut.
BUCKET_BYTES = 4 << 20
MAX_CELLS = 1 << 28
#: Bytes of pieces that a chunk gathers before it is sent.
CHUNK_BYTES = 24 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of the `width` bytes at each place, put together from powers of two."""
    with np.errstate(over="ignore"):
        power, size = data.astype(np.uint64) + np.uint64(1), 1
        factor = _MULTIPLIER
        out, done = None, 0
        while True:
            if width & size:
                if out is None:
                    out = power.copy()
                else:
                    n = len(data) - done - size + 1
                    out = out[:n] * factor + power[done:done + n]
                done += size
            if done == width:
                break
            n = len(power) - size
            power = power[:n] * factor + power[size:size + n]
            factor, size = factor * factor, size * 2
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return out ^ (out >> np.uint64(29))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i:i + width] for each i: running minima of blocks, forward and backward."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n - width + 1], forward[width - 1:n])


def pieces(texts: list[str], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(all bytes, key's hash, start, strings, anchor's offset, text number, text start, least left, most
    left) of the pieces: `strings` places from `start` on share the anchor, with lefts in that range."""
    coded = [t.encode() for t in texts]
    sizes = np.array([len(c) for c in coded], np.int64)
    data = np.frombuffer(b"".join(coded), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return data, np.zeros(0, np.uint64), none, none, none, none, none, none, none
    h = rolling(data, gram)
    low = np.uint64((1 << 26) - 1)
    best = sliding_min((h & ~low) | (np.arange(len(h), dtype=np.uint64) & low), length - gram + 1)
    at = np.arange(len(best))
    anchor = (best & low).astype(np.int64)
    anchor += (at >> 26 << 26) + ((anchor < (at & int(low))).astype(np.int64) << 26)
    ends = np.cumsum(sizes)
    owner = np.searchsorted(ends, at, side="right")
    inside = at + length <= ends[owner]
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(new)
    count = np.diff(np.append(np.flatnonzero(new[inside]), inside.sum()))
    offset, middle = anchor[start] - start, (length - gram) // 2
    cut = np.clip(offset - middle, 0, count)  # the strings before it have more than `middle` bytes before the anchor
    hashes = {0: rolling(data, length - middle), 1: rolling(data, length - (length - gram) + middle + 1)}
    parts = []
    for side, low, high, first, n in ((0, 0, middle, cut, count - cut), (1, middle + 1, length - gram, np.zeros_like(cut), cut)):
        at = np.flatnonzero(n > 0)
        key = hashes[side][anchor[start[at]] - low] ^ np.uint64(side)
        o = owner[start[at]]
        parts.append((key, (start + first)[at], n[at], (offset - first)[at], o, (ends - sizes)[o], np.full(len(at), low), np.full(len(at), high)))
    return data, *(np.concatenate(x) for x in zip(*parts))


def block_ranks(data: np.ndarray, block: int) -> np.ndarray:
    """The rank of the block of bytes at each place among all blocks, by its bytes: from ranks of
    eight bytes on, those of twice the length are ranks of pairs, which may overlap in the end."""
    key, size = np.zeros(len(data) - 7, np.uint64), 8
    for k in range(8):
        key = key << np.uint64(8) | data[k:len(data) - 7 + k].astype(np.uint64)
    while True:
        order = np.argsort(key)
        new = np.zeros(len(key), np.int64)
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(new)
        if size == block:
            return rank.astype(np.int32)
        step = min(size, block - size)
        key = (rank[:-step].astype(np.uint64) << np.uint64(32)) | rank[step:].astype(np.uint64)
        size += step


def repeated_strings(collection: list[bytes], strings: np.ndarray, offset: np.ndarray,
                     length: int = LENGTH, block: int = BLOCK) -> list[np.ndarray]:
    """For each of the different pieces the places of strings that occur elsewhere in the collection.

    The collection's transform and common prefixes are built by inserting a symbol a round.
    """
    data = np.frombuffer(b"".join(collection), np.uint8)
    if len(data) < length:
        return [np.zeros(0, np.int64) for _ in collection]
    sizes = np.array([len(c) for c in collection])
    begin = np.cumsum(sizes) - sizes
    symbol = block_ranks(data, block)
    # One document for each piece and phase; it ends with the piece's last whole block.
    piece = np.repeat(np.arange(len(sizes)), block)
    first = (offset[piece] + np.tile(np.arange(block), len(sizes))) % block
    symbols = (sizes[piece] - first) // block
    fits = symbols >= length // block
    piece, first, symbols = piece[fits], first[fits], symbols[fits]
    docs = len(piece)
    if not docs:
        return [np.zeros(0, np.int64) for _ in collection]
    base = begin[piece] + first
    bwt = symbol[base + (symbols - 1) * block].astype(np.int32)
    common = np.zeros(docs, np.int8)
    left = symbols - 1  # the symbol of each document that its row holds
    suffix = np.full(docs, -1, np.int64)  # number of the suffix of each row: document * width + place
    width = int(symbols.max()) + 1
    row = np.arange(docs)
    active = np.arange(docs)
    while len(active):
        order = np.flatnonzero(bwt >= 0)
        for shift in (0, 16):  # numpy sorts 16 bits by radix
            order = order[np.argsort((bwt[order] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
        mapped = np.zeros(len(bwt), np.int64)
        mapped[order] = docs + np.arange(len(order))
        # Least common prefix between the rows that two neighbours come from, by a sparse table.
        above, below = order[:-1], order[1:]
        same = bwt[above] == bwt[below]
        level = np.frexp((below - above)[same].astype(np.float64))[1] - 1
        least, table = np.zeros(same.sum(), np.int8), common
        start, stop = above[same] + 1, below[same] + 1
        for k in range(int(level.max(initial=-1)) + 1):
            at = np.flatnonzero(level == k)
            least[at] = np.minimum(table[start[at]], table[stop[at] - (1 << k)])
            table = np.minimum(table[:-(1 << k)], table[1 << k:]) if len(table) > 1 << k else table
        fresh = np.zeros(docs + len(order), np.int8)
        fresh[docs + 1:][same] = np.minimum(least, 125) + 1
        row_of = mapped[row[active]]
        old = np.ones(len(fresh), bool)
        old[row_of] = False
        grown, names = np.empty(len(fresh), np.int32), np.empty(len(fresh), np.int64)
        grown[old], names[old] = bwt, suffix
        names[row_of] = active * width + left[active]
        left[active] -= 1
        more = left[active] >= 0
        grown[row_of] = np.where(more, symbol[base[active] + np.maximum(left[active], 0) * block], -1)
        row[active] = row_of
        bwt, common, suffix = grown, fresh, names
        active = active[more]
    enough = common >= length // block
    hit = enough.copy()
    hit[:-1] |= enough[1:]
    found = suffix[hit & (suffix >= 0)]
    doc, place = found // width, found % width
    where = first[doc] + place * block
    owner = piece[doc]
    good = where < strings[owner]
    owner, where = owner[good], where[good]
    order = np.lexsort((where, owner))
    return np.split(where[order], np.searchsorted(owner[order], np.arange(1, len(collection))))


_SENT = "bucket long, chunk long, size long, bytes binary, facts binary, owners binary"


def _rows(held: dict, chunk: int, buckets: int, level: int) -> pd.DataFrame:
    """The pieces of a chunk by bucket; held: the owners of each (key's hash, bytes, strings, offset, low, high)."""
    rows: dict[int, tuple[list, list, list]] = {}
    for (h, piece, strings, offset, low, high), owners in held.items():
        b, f, o = rows.setdefault(h % buckets + level * buckets, ([], [], []))
        b.append(piece)
        f.append((len(piece), strings, offset, len(owners), low, high))
        o += owners
    return pd.DataFrame([(k, chunk, sum(map(len, b)), b"".join(b), np.array(f, np.int32).tobytes(), np.array(o, np.int64).tobytes()) for k, (b, f, o) in rows.items()],
                        columns=[c.split()[0] for c in _SENT.split(", ")])


def _send(shared, bits: int, buckets: int):
    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        size, chunk = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            data, h, *facts = pieces(list(batch["text"]))
            doc, mark = batch["doc_id"].to_numpy(np.int64), batch["mark"].to_numpy(np.int64)
            raw = data.tobytes()
            at = np.flatnonzero(seen_twice(shared.value, h, bits))
            for x, s, c, o, t, b, low, high in zip(h[at].tolist(), *(f[at].tolist() for f in facts)):
                piece = raw[s:s + c + LENGTH - 1]
                owners = held.setdefault((x, piece, c, o, low, high), [])
                owners.append((doc[t], mark[t], s - b))
                size += len(piece) if len(owners) == 1 else 24
            if size > CHUNK_BYTES:
                yield _rows(held, chunk, buckets, 0)
                held, size, chunk = {}, 0, chunk + 1
        if held:
            yield _rows(held, chunk, buckets, 0)

    return send


def _read(r) -> Iterator[tuple[bytes, int, int, np.ndarray, int, int]]:
    """(bytes, strings, offset, owners, low, high) of each piece of a row."""
    at = done = 0
    owners = np.frombuffer(r.owners, np.int64).reshape(-1, 3)
    for n, strings, offset, k, low, high in np.frombuffer(r.facts, np.int32).reshape(-1, 6).tolist():
        yield r.bytes[at:at + n], strings, offset, owners[done:done + k], low, high
        at, done = at + n, done + k


def _halves(buckets: int, level: int):
    """Each piece as two, of the strings with the smaller and those with the larger lefts."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                held: dict[tuple, list] = {}
                for piece, strings, offset, owners, low, high in _read(r):
                    middle = (low + high) // 2
                    at = min(max(offset - middle, 0), strings)  # strings before it have larger lefts
                    for first, n, a, z in ((at, strings - at, low, middle), (0, at, middle + 1, high)):
                        if n > 0:
                            part, o = piece[first:first + n + LENGTH - 1], offset - first
                            key = hashlib.blake2b(part[o - a:o + LENGTH - z], digest_size=8, key=z.to_bytes(2, "big")).digest()
                            held.setdefault((int.from_bytes(key, "big"), part, n, o, a, z), []).extend(owners + np.array([0, 0, first]))
                if held:
                    yield _rows(held, r.chunk, buckets, level)

    return cut


def _decide(b: pd.DataFrame) -> pd.DataFrame:
    """In a bucket: the repeated strings' runs, for the chunk of each owner."""
    number: dict[tuple, int] = {}
    copies: list[int] = []
    keys: list[tuple[bytes, int]] = []
    asked = []
    for r in b.itertuples():
        mine, times = [], []
        for piece, strings, offset, owners, low, high in _read(r):
            k = number.setdefault((piece, strings, offset), len(number))
            if k == len(copies):
                copies.append(0)
                keys.append((piece[offset - low:offset + LENGTH - high], low))
            copies[k] += len(owners)
            mine.append(k)
            times.append(len(owners))
        asked.append((r.chunk, np.repeat(mine, times), np.frombuffer(r.owners, np.int64).reshape(-1, 3)))
    strings = np.array([k[1] for k in number])
    # A piece alone with its key has no string of another; strings of one piece differ in their lefts.
    times, every = Counter(keys), list(number)
    some = [k for k, key in enumerate(keys) if times[key] > 1]
    found = dict(zip(some, repeated_strings([every[k][0] for k in some], strings[some], np.array([every[k][2] for k in some], np.int64))))
    runs = []
    for k in range(len(every)):
        where = found.get(k, np.zeros(0, np.int64))
        if copies[k] > 1:
            runs.append(np.array([[0, strings[k] - 1]]))
        else:
            cut = np.flatnonzero(np.diff(where) > 1)
            runs.append(np.stack([where[np.append(0, cut + 1)], where[np.append(cut, len(where) - 1)]], 1) if len(where) else np.zeros((0, 2), np.int64))
    out = []
    for chunk, piece, owners in asked:
        parts = [np.column_stack([np.repeat(o[None, :2], len(runs[k]), 0), runs[k] + o[2]]) for k, o in zip(piece, owners) if len(runs[k])]
        if parts:
            out.append((chunk, np.concatenate(parts).astype(np.int64).tobytes()))
    return pd.DataFrame(out, columns=["chunk", "runs"])


def _spans(b: pd.DataFrame) -> pd.DataFrame:
    """For each document of the chunk the maximal spans of removed bytes."""
    doc, mark, start, end = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 4) for x in b["runs"]]).T
    end = end + LENGTH
    order = np.lexsort((start, mark, doc))
    doc, mark, start, end = doc[order], mark[order], start[order], end[order]
    head = np.ones(len(doc), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])
    # Strings are of one length, so runs in order of their starts that lie within another end before it.
    reach = np.maximum.accumulate(end + np.cumsum(head) * (1 << 40)) - np.cumsum(head) * (1 << 40)
    new = head.copy()
    new[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    rows = pd.DataFrame({"doc_id": doc[first], "mark": mark[first], "starts": start[first], "ends": reach[np.append(first[1:], len(doc)) - 1]})
    return rows.groupby(["doc_id", "mark"], sort=False).agg(list).reset_index()


def removed_spans(texts: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, mark, starts, ends): the removed bytes of documents that lose some."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = min(int(math.log2(MAX_CELLS)), max(16, math.ceil(math.log2(max(8, size) / 8))))
    buckets = max(48, size >> 22)
    shared = spark.sparkContext.broadcast(sketch(texts, bits, lambda t: pieces(t)[1]))
    now, decided = written(texts.mapInPandas(_send(shared, bits, buckets), _SENT), "pieces"), []
    for level in range(1, 10):
        full = written(now.groupBy("bucket").agg(F.sum("size").alias("held")).filter(F.col("held") > bucket_bytes).select("bucket"), "full")
        if full.isEmpty():
            break
        decided.append(now.join(full, "bucket", "left_anti"))
        now = written(now.join(full, "bucket", "left_semi").mapInPandas(_halves(buckets, level), _SENT), "pieces")
    sent = functools.reduce(DataFrame.unionByName, [*decided, now])
    decided = sent.groupBy("bucket").applyInPandas(_decide, "chunk long, runs binary")
    spans = decided.groupBy("chunk").applyInPandas(_spans, "doc_id long, mark long, starts array<long>, ends array<long>")
    return spans.groupBy("doc_id", "mark").agg(F.max("starts").alias("starts"), F.max("ends").alias("ends"))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: doc_id, kept (bytes), n_bytes, n_removed, n_spans, kept_sha256."""
    short_batches(docs.sparkSession)
    texts = marked_texts(docs, id_col, text_col)

    @F.pandas_udf("kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    def cut(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        rows = []
        for t, s, e in zip(text, starts, ends):
            data, kept, at = t.encode(), [], 0
            spans = list(zip(s, e)) if s is not None else []
            for x, y in spans:
                kept.append(data[at:x])
                at = y
            left = b"".join([*kept, data[at:]])
            rows.append((left, len(data), len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest()))
        return pd.DataFrame(rows, columns=["kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = texts.join(removed_spans(texts, bucket_bytes), ["doc_id", "mark"], "left").withColumn("c", cut("text", "starts", "ends"))
    return joined.select(F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "c.*")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")

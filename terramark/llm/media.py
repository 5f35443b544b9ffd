r"""Media columns: Netpbm and BMP images, area-resized by integral images, as NPY tiles.

`encode_*` and `decode` are small codecs between image bytes and numpy arrays: Netpbm P1 to P6
(bitmap, grey, colour; plain or raw, 8 or 16 bits) and uncompressed BMP of 1 to 8, 24 or 32 bits.
`area_resize` gives each output pixel the exact mean of its area from a summed-area table;
`dhash` compares neighbours of a 9 x 8 grid; `npy` writes a tile as an NPY file's bytes.

The query stores each text's UTF-8, padded by bytes 0 to a positive multiple of 64, losslessly as
a raw PGM of 64 columns, reads the payload back from the stored bytes and computes the features
from the decoded pixels.

Defined cases: a null text counts as empty (one row of zeros); equal texts give equal values;
repeated rows give equal rows; extra columns are ignored. Images of other forms, or without
pixels, raise ValueError in the codecs; `images_to_tiles` gives null columns for null or unreadable media.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import id_text, short_batches

WIDTH = 64
TILE = 32


def _header(data: bytes, fields: int) -> tuple[list[int], int]:
    """The decimal numbers behind the magic number, comments skipped, and where they end."""
    found: list[int] = []
    at = 2
    while len(found) < fields:
        while data[at:at + 1].isspace() or data[at:at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at:at + 1] == b"#" else at + 1
        end = at
        while data[end:end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("not a Netpbm header")
        found.append(int(data[at:end]))
        at = end
    return found, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as an array (height, width[, 3]); in bitmaps 1 is black."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    if kind in (b"P1", b"P4"):
        (w, h), at = _header(data, 2)
        top = 1
    else:
        (w, h, top), at = _header(data, 3)
    if not (h and w and top):
        raise ValueError("an image without pixels or levels")
    shape = (h, w, 3) if kind in (b"P3", b"P6") else (h, w)
    if kind == b"P1":
        bits = [c for c in data[at - 1:] if c in b"01"]
        return np.array(bits[:w * h], np.uint8).reshape(shape) - 48
    if kind in (b"P2", b"P3"):
        return np.array(data[at:].split()[:int(np.prod(shape))], np.int64).reshape(shape).astype(np.uint8 if top < 256 else np.uint16)
    if kind == b"P4":
        line = -(-w // 8)
        rows = np.frombuffer(data, np.uint8, line * h, at).reshape(h, line)
        return np.unpackbits(rows, axis=1)[:, :w]
    kind_of = np.dtype(np.uint8) if top < 256 else np.dtype(">u2")
    return np.frombuffer(data, kind_of, int(np.prod(shape)), at).reshape(shape)


def encode_netpbm(pixels: np.ndarray) -> bytes:
    """Raw PGM or PPM of 8-bit samples."""
    kind = b"P6" if pixels.ndim == 3 else b"P5"
    return kind + b"\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP: grey (palette of greys) as (h, w), else RGB as (h, w, 3)."""
    if data[:2] != b"BM":
        raise ValueError("not BMP")
    start, head, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed or bits not in (1, 4, 8, 24, 32) or w <= 0 or not h:
        raise ValueError("only uncompressed BMP of 1, 4, 8, 24 or 32 bits, with pixels")
    line = (w * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, line * abs(h), start).reshape(abs(h), line)
    rows = rows[::-1] if h > 0 else rows
    if bits > 8:
        return rows[:, :w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1]
    used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    colours = np.frombuffer(data, np.uint8, 4 * used, 14 + head).reshape(used, 4)
    if bits < 8:
        each = np.unpackbits(rows, axis=1).reshape(abs(h), -1, bits)
        rows = (each * (1 << np.arange(bits)[::-1]).astype(np.uint8)).sum(axis=2, dtype=np.uint8)
    index = rows[:, :w]
    if (colours[:, 0] == colours[:, 1]).all() and (colours[:, 1] == colours[:, 2]).all():
        return colours[:, 0][index]
    return colours[:, 2::-1][index]


def encode_bmp(pixels: np.ndarray) -> bytes:
    """8-bit grey or 24-bit RGB, bottom-up."""
    h, w = pixels.shape[:2]
    bits = 24 if pixels.ndim == 3 else 8
    line = (w * bits // 8 + 3) // 4 * 4
    rows = np.zeros((h, line), np.uint8)
    rows[:, :w * bits // 8] = (pixels[:, :, ::-1] if bits == 24 else pixels).reshape(h, -1)
    palette = b"" if bits == 24 else bytes(x for g in range(256) for x in (g, g, g, 0))
    start = 54 + len(palette)
    return (b"BM" + struct.pack("<IHHI", start + rows.size, 0, 0, start)
            + struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, 0, rows.size, 2835, 2835, 0 if bits == 24 else 256, 0)
            + palette + rows[::-1].tobytes())


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas, by a summed-area table read between its nodes."""
    h, w = grey.shape
    table = np.zeros((h + 1, w + 1))
    table[1:, 1:] = grey.cumsum(0, dtype=np.float64).cumsum(1)

    def at_edges(t: np.ndarray, n: int, parts: int) -> np.ndarray:
        edge = np.arange(parts + 1) * n / parts
        low = np.minimum(edge.astype(np.int64), n - 1)
        return t[low] + (edge - low)[:, None] * (t[low + 1] - t[low])

    corners = at_edges(at_edges(table, h, height).T, w, width).T
    sums = corners[1:, 1:] - corners[1:, :-1] - corners[:-1, 1:] + corners[:-1, :-1]
    return sums * (height * width / (h * w))


def dhash(grey: np.ndarray) -> str:
    """64 bits as 16 hex digits: does the brightness rise from one column to the next?"""
    small = np.round(area_resize(grey, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def grey_of(pixels: np.ndarray) -> np.ndarray:
    return pixels if pixels.ndim == 2 else pixels @ np.array([0.299, 0.587, 0.114])


def tile_of(pixels: np.ndarray, tile: int = TILE) -> bytes:
    """The image resized to tile x tile 8-bit grey samples, as an NPY file."""
    return npy(np.clip(np.rint(area_resize(grey_of(pixels), tile, tile)), 0, 255).astype(np.uint8))


def images_to_tiles(frame: DataFrame, media_col: str = "media", tile: int = TILE) -> DataFrame:
    """`frame` with height, width, tile (NPY bytes) and dhash of its images."""
    @F.pandas_udf("height int, width int, tile binary, dhash string")
    def read(media: pd.Series) -> pd.DataFrame:
        rows = []
        for m in media:
            try:
                pixels = decode(bytes(m))
                rows.append((*pixels.shape[:2], tile_of(pixels, tile), dhash(grey_of(pixels))))
            except (TypeError, ValueError, IndexError, ZeroDivisionError, OverflowError, struct.error):
                rows.append((None, None, None, None))
        return pd.DataFrame(rows, columns=["height", "width", "tile", "dhash"]).astype({"height": "Int32", "width": "Int32"})

    found = frame.withColumn("__read", read(frame[media_col]))
    names = ["height", "width", "tile", "dhash"]
    return found.select(*[found[c] for c in frame.columns if c not in names], *[F.col(f"__read.{c}") for c in names])


def store(data: bytes) -> bytes:
    """The bytes, padded, as a raw PGM of WIDTH columns."""
    payload = data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))
    return encode_netpbm(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH))


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and the stored image of each text."""
    short_batches(docs.sparkSession)

    @F.pandas_udf("binary")
    def stored(texts: pd.Series) -> pd.Series:
        return pd.Series([store(t.encode()) for t in texts], dtype=object)

    texts = id_text(docs, id_col, text_col)
    return texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), stored("text").alias("media"))


def media_features(frame: DataFrame, media_col: str = "media") -> DataFrame:
    """What is read back from the stored bytes, and the features of the pixels."""
    kinds = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string"
    names = [k.split()[0] for k in kinds.split(", ")]

    @F.pandas_udf(kinds)
    def features(media: pd.Series) -> pd.DataFrame:
        rows = []
        for m in media:
            m = bytes(m)
            pixels = decode(m)
            payload = pixels.tobytes()
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m),
                         hashlib.sha256(m).hexdigest(), dhash(pixels), hashlib.sha256(tile_of(pixels)).hexdigest()))
        return pd.DataFrame(rows, columns=names)

    found = frame.withColumn("__f", features(frame[media_col]))
    return found.select(*[found[c] for c in frame.columns], *[F.col(f"__f.{c}") for c in names])


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(text_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))).drop("media")

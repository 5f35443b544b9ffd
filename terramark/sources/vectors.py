"""Shapefiles as a data source of Spark, and features of GeoJSON, as rows of parts and attributes.

A row has feature_id, kind, parts (rings, lines or single points, each an array of [x, y]) and
attributes by name. A shapefile's records lie where its index (.shx) says, and its table's (.dbf)
records have a fixed length, so each partition reads a range of records by their bytes. With the
option box (x0,y0,x1,y1), records whose own box lies outside are passed over by their header: their
points are not decoded and their attributes not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .ascii_grid import store

SCHEMA = "feature_id long, kind string, parts array<array<array<double>>>, attributes map<string,string>"
#: The shape types of the format; those with heights or measures start with the same points.
KINDS = {1: "point", 3: "line", 5: "polygon", 8: "points", 11: "point", 13: "line", 15: "polygon", 18: "points", 21: "point", 23: "line", 25: "polygon", 28: "points"}
RECORDS = 10_000


def decode(shape: bytes) -> tuple[str, list[list[list[float]]]] | None:
    """(kind, parts) of a record's content; None for a null shape."""
    kind = KINDS.get(struct.unpack_from("<i", shape)[0])
    if kind is None:
        return None
    if kind == "point":
        return kind, [[list(struct.unpack_from("<2d", shape, 4))]]
    if kind == "points":
        n = struct.unpack_from("<i", shape, 36)[0]
        return kind, [[p] for p in np.frombuffer(shape, "<f8", 2 * n, 40).reshape(-1, 2).tolist()]
    n_parts, n = struct.unpack_from("<2i", shape, 36)
    starts = np.frombuffer(shape, "<i4", n_parts, 44)
    points = np.frombuffer(shape, "<f8", 2 * n, 44 + 4 * n_parts).reshape(-1, 2).tolist()
    return kind, [points[a:b] for a, b in zip(starts, [*starts[1:], n])]


def box_of(shape: bytes) -> tuple[float, ...] | None:
    """(x0, y0, x1, y1) by the head of a record alone."""
    kind = KINDS.get(struct.unpack_from("<i", shape)[0])
    if kind is None:
        return None
    if kind == "point":
        return struct.unpack_from("<2d", shape, 4) * 2
    return struct.unpack_from("<4d", shape, 4)


@dataclass
class Table:
    """The head of a .dbf: records, where they start, their length, and the fields by (name, offset, length)."""

    records: int
    start: int
    length: int
    fields: list[tuple[str, int, int]]

    @staticmethod
    def parse(data: bytes) -> Table:
        records, start, length = struct.unpack_from("<IHH", data, 4)
        fields, at = [], 1
        for k in range(32, start - 1, 32):
            if data[k] == 0x0D:
                break
            name, size = data[k:k + 11].split(b"\0")[0].decode("ascii", "replace"), data[k + 16]
            fields.append((name, at, size))
            at += size
        return Table(records, start, length, fields)

    def attributes(self, record: bytes, encoding: str) -> dict[str, str | None]:
        return {name: record[at:at + size].decode(encoding, "replace").strip("\0 ") or None for name, at, size in self.fields}


@dataclass
class Records(InputPartition):
    first: int
    last: int


class ShapeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.base = self.path.rsplit(".", 1)[0]
        self.box = tuple(float(x) for x in options["box"].split(",")) if options.get("box") else None
        self.records = int(options.get("records", RECORDS))
        self.encoding = options.get("encoding", "")
        at, name = store(self.base)
        if at.get_file_info(f"{name}.shp").type != fs.FileType.File:
            raise FileNotFoundError(self.path)
        if not self.encoding:
            self.encoding = "utf-8"
            if at.get_file_info(f"{name}.cpg").type == fs.FileType.File:
                with at.open_input_file(f"{name}.cpg") as f:
                    self.encoding = f.read().decode("ascii", "replace").strip() or "utf-8"

    def partitions(self) -> Sequence[InputPartition]:
        at, name = store(self.base)
        n = (at.get_file_info(f"{name}.shx").size - 100) // 8
        return [Records(k, min(n, k + self.records)) for k in range(0, n, self.records)] or [Records(0, 0)]

    def read(self, partition: Records) -> Iterator[tuple]:
        at, name = store(self.base)
        if partition.first >= partition.last:
            return
        with at.open_input_file(f"{name}.shx") as f:
            f.seek(100 + 8 * partition.first)
            places = np.frombuffer(f.read(8 * (partition.last - partition.first)), ">i4").reshape(-1, 2).astype(np.int64) * 2
        table = dbf = None
        if at.get_file_info(f"{name}.dbf").type == fs.FileType.File:
            dbf = at.open_input_file(f"{name}.dbf")
            table = Table.parse(dbf.read(struct.unpack_from("<H", dbf.read(10), 8)[0] + (dbf.seek(0) or 0)))
        with at.open_input_file(f"{name}.shp") as shp:
            for k, (byte, length) in enumerate(places.tolist(), partition.first):
                shp.seek(byte + 8)
                head = shp.read(min(length, 36))
                own = box_of(head)
                if own is None:
                    continue
                if self.box and not (own[0] <= self.box[2] and own[2] >= self.box[0] and own[1] <= self.box[3] and own[3] >= self.box[1]):
                    continue
                kind, parts = decode(head + shp.read(length - len(head)))
                attributes = {}
                if table and k < table.records:
                    dbf.seek(table.start + k * table.length)
                    attributes = table.attributes(dbf.read(table.length), self.encoding)
                yield k, kind, parts, attributes
        if dbf:
            dbf.close()


class Shapefile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ShapeReader:
        return ShapeReader(self.options)


def read_shapefile(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, records: int = RECORDS) -> DataFrame:
    """The features of a shapefile, those whose box meets `box` if there is one."""
    spark.dataSource.register(Shapefile)
    reader = spark.read.format("shapefile").option("records", records)
    return (reader.option("box", ",".join(map(repr, map(float, box)))) if box else reader).load(path)


def read_geojson(spark: SparkSession, path: str, one_document: bool = False) -> DataFrame:
    """The features of GeoJSON in the columns of a shapefile's: a feature a line, or one document.

    Lines may be those of a collection that has its features on lines of their own. All of it is Spark's
    own JSON, so lines are split over tasks; coordinates are parsed as the type of geometry says.
    """
    feature = "struct<type:string,id:string,properties:map<string,string>,geometry:string>"
    if one_document:
        text = spark.read.text(path, wholetext=True)
        rows = text.select(F.explode(F.from_json("value", f"struct<features:array<{feature}>>")["features"]).alias("f"))
    else:
        line = F.rtrim(F.regexp_replace("value", r",\s*$", ""))
        rows = spark.read.text(path).filter(F.col("value").rlike(r'^\s*\{.*"type"\s*:\s*"Feature"')).select(F.from_json(line, feature).alias("f"))
    kind = F.get_json_object("f.geometry", "$.type")
    read = lambda t: F.from_json(F.get_json_object("f.geometry", "$.coordinates"), t)
    point, line_, ring, many = "array<double>", "array<array<double>>", "array<array<array<double>>>", "array<array<array<array<double>>>>"
    flat = lambda parts: F.transform(parts, lambda p: F.transform(p, lambda q: F.slice(q, 1, 2)))
    parts = F.when(kind == "Point", flat(F.array(F.array(read(point))))).when(kind == "MultiPoint", flat(F.transform(read(line_), lambda p: F.array(p)))) \
        .when(kind == "LineString", flat(F.array(read(line_)))).when(kind.isin("MultiLineString", "Polygon"), flat(read(ring))).when(kind == "MultiPolygon", flat(F.flatten(read(many))))
    named = F.when(kind == "Point", "point").when(kind == "MultiPoint", "points").when(kind.isin("LineString", "MultiLineString"), "line").when(kind.isin("Polygon", "MultiPolygon"), "polygon")
    found = rows.filter("f.type = 'Feature'").select(F.coalesce(F.expr("try_cast(f.id AS long)"), F.monotonically_increasing_id()).alias("feature_id"), named.alias("kind"), parts.alias("parts"), F.col("f.properties").alias("attributes"))
    return found.filter("parts IS NOT NULL")


def attribute(name: str) -> Column:
    return F.element_at("attributes", F.lit(name))


def rings(features: DataFrame, to_cells: tuple[float, float, float, float, float, float] | None = None) -> DataFrame:
    """(feature_id, coords) of each part; with the transform of a grid, in units of its cells."""
    coords = F.col("coords")
    if to_cells:
        a, b, x, d, e, y = to_cells
        det = a * e - b * d
        coords = F.transform("coords", lambda p: F.array((e * (p[0] - x) - b * (p[1] - y)) / det, (a * (p[1] - y) - d * (p[0] - x)) / det))
    return features.select("feature_id", F.explode("parts").alias("coords")).select("feature_id", coords.alias("coords"))

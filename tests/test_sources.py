"""ASCII grids and vector files: round trips, what is read, and errors."""

import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terramark.functions import expressions as E
from terramark.operators import factors
from terramark.sources import ascii_grid, tables, vectors
from terramark.sources.grid import Profile

PROFILE = Profile(7, 50, "EPSG:32651", (30.0, 0.0, 600.0, 0.0, -30.0, 9000.0), 0)


@pytest.fixture
def cells(spark):
    rng = np.random.default_rng(4)
    rows = [(r * 7 + c, r, c, int(rng.integers(0, 9))) for r in range(50) for c in range(7)]
    return spark.createDataFrame(rows, "cell_id long, r long, c long, v int").repartition(5)


def plain(df):
    return sorted((r.r, r.c, r.value) for r in df.collect())


def test_ascii_round_trip(spark, cells, tmp_path):
    path = f"{tmp_path}/g"
    ascii_grid.write_ascii(cells, "v", PROFILE, path, block_rows=8)
    want = sorted((r.r, r.c, float(r.v) if r.v else None) for r in cells.collect())
    assert sorted(os.listdir(path)) == ["_grid.json", *[f"rows-{k:09d}.asc" for k in range(0, 50, 8)]]
    assert sorted(((r, c, v) for r, c, v in plain_null(ascii_grid.read_ascii(spark, path))), key=str) == sorted(want, key=str)
    assert ascii_grid.read_header(path).profile("EPSG:32651") == PROFILE
    # Each block is a grid of its own, at its own place.
    second = ascii_grid.read_header(f"{path}/rows-000000008.asc")
    assert (second.rows, second.columns, second.profile().transform[5]) == (8, 7, 9000.0 - 8 * 30)
    assert ascii_grid.read_ascii(spark, f"{path}/rows-000000008.asc").filter("r = 0").count() == 7
    with pytest.raises(Exception, match="(?i)exists"):
        ascii_grid.write_ascii(cells, "v", PROFILE, path)
    ascii_grid.write_ascii(cells.withColumn("v", F.lit(5)), "v", PROFILE, path, block_rows=20, overwrite=True)
    assert {r.value for r in ascii_grid.read_ascii(spark, path).collect()} == {5.0}


def plain_null(df):
    return [(r.r, r.c, r.value) for r in df.collect()]


def test_rows_choose_blocks(spark, cells, tmp_path):
    """Blocks without an asked row can be broken: they aren't opened."""
    path = f"{tmp_path}/g"
    ascii_grid.write_ascii(cells, "v", PROFILE, path, block_rows=10)
    for k in (0, 10, 40):
        with open(f"{path}/rows-{k:09d}.asc", "w") as f:
            f.write("not a grid")
    g = ascii_grid.read_ascii(spark, path, (22, 36))
    assert g.count() == 14 * 7 and g.filter("r = 30").count() == 7 and g.count() == 14 * 7 and g.filter("r = 21").count() == 0
    assert ascii_grid.read_ascii(spark, path, (20, 40)).count() == 20 * 7 and ascii_grid.read_ascii(spark, path, (90, 95)).count() == 0
    with pytest.raises(Exception, match="(?i)StopIteration|ends before|cells"):
        ascii_grid.read_ascii(spark, path).count()


def test_missing_cells_rows_and_values(spark, tmp_path):
    rows = [(0, 1, 1.5), (3, 0, None), (3, 2, -7.25), (5, 6, float("nan"))]
    g = spark.createDataFrame(rows, "r long, c long, v double")
    p = Profile(7, 9, "", (10.0, 0.0, 0.0, 0.0, -10.0, 90.0), None)
    ascii_grid.write_ascii(g, "v", p, f"{tmp_path}/g", block_rows=4)
    got = {(r, c): v for r, c, v in plain_null(ascii_grid.read_ascii(spark, f"{tmp_path}/g")) if v is not None}
    assert got == {(0, 1): 1.5, (3, 2): -7.25}
    assert ascii_grid.read_ascii(spark, f"{tmp_path}/g").count() == 8 * 7  # the block without a cell has no file
    with pytest.raises(Exception, match="outside"):
        ascii_grid.write_ascii(g.withColumn("c", F.lit(7).cast("long")), "v", p, f"{tmp_path}/h")
    assert not [x for x in os.listdir(f"{tmp_path}/h") if x.endswith(".asc")]


def test_a_single_file_and_its_index(spark, tmp_path):
    values = np.random.default_rng(1).integers(-5, 3000, (200, 11))
    text = "NCOLS 11\nNROWS 200\nXLLCENTER 15\nYLLCENTER 15\nCELLSIZE 30\nNODATA_value -5\n" + "".join(" ".join(map(str, r)) + "\n" for r in values)
    path = f"{tmp_path}/one.asc"
    with open(path, "w") as f:
        f.write(text)
    want = sorted(((r, c, float(v) if v != -5 else None) for (r, c), v in np.ndenumerate(values)), key=str)
    assert sorted(plain_null(ascii_grid.read_ascii(spark, path)), key=str) == want
    assert ascii_grid.read_header(path).profile().transform == (30.0, 0.0, 0.0, 0.0, -30.0, 6000.0)
    for size in (700, 64, 1 << 20):
        marks = ascii_grid.index_rows(spark, path, size)
        body = text.encode()
        starts = [n for n in range(len(body)) if n == 0 or body[n - 1:n] == b"\n"]
        assert all(body.index(b"\n", byte) > byte and starts.index(byte) - 6 == row for byte, row in marks[1:]) and marks[0] == [0, 0]
        g = ascii_grid.read_ascii(spark, path)
        assert g.rdd.getNumPartitions() >= (5 if size == 700 else 1)
        assert sorted(plain_null(g), key=str) == want
        assert g.filter("r >= 150 AND c = 3").count() == 50 and ascii_grid.read_ascii(spark, path, (150, 170)).count() == 20 * 11
    with pytest.raises(Exception, match="absent"):
        ascii_grid.read_ascii(spark, f"{tmp_path}/absent.asc").count()
    with open(path, "w") as f:
        f.write(text[:-40])
    os.remove(path + ".rows")
    with pytest.raises(Exception, match="cells, not 11|ends before"):
        ascii_grid.read_ascii(spark, path).count()


# Shapefiles, written here by the format's description.
def write_shapes(base, shapes, fields, rows, encoding="utf-8", broken=()):
    kind = {"point": 1, "line": 3, "polygon": 5}
    shp, shx, at = b"", b"", 50
    for k, (name, parts) in enumerate(shapes):
        if name is None:
            body = struct.pack("<i", 0)
        elif name == "point":
            body = struct.pack("<i2d", 1, *parts[0][0])
        else:
            points = np.array([p for part in parts for p in part], float)
            starts = np.cumsum([0, *[len(p) for p in parts]])[:-1]
            body = struct.pack("<i4d2i", kind[name], *points.min(0), *points.max(0), len(parts), len(points)) + starts.astype("<i4").tobytes() + points.astype("<f8").tobytes()
            if k in broken:
                body = body[:36] + b"\xff" * (len(body) - 36)
        shp += struct.pack(">2i", k + 1, len(body) // 2) + body
        shx += struct.pack(">2i", at, len(body) // 2)
        at += 4 + len(body) // 2
    head = struct.pack(">i20xi", 9994, at) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8)
    size = 1 + sum(n for _, n in fields)
    dbf = struct.pack("<4BIHH20x", 3, 100, 1, 1, len(rows), 33 + 32 * len(fields), size) + b"".join(struct.pack("<11sc4xB15x", name.encode(), b"C", n) for name, n in fields) + b"\r"
    for row in rows:
        dbf += b" " + b"".join((v or "").encode(encoding).ljust(n)[:n] for v, (_, n) in zip(row, fields))
    for end, data in (("shp", head + shp), ("shx", head + shx), ("dbf", dbf)):
        with open(f"{base}.{end}", "wb") as f:
            f.write(data)
    if encoding != "utf-8":
        with open(f"{base}.cpg", "w") as f:
            f.write(encoding)


SQUARE = [[0.0, 0.0], [0.0, 10.0], [10.0, 10.0], [10.0, 0.0], [0.0, 0.0]]
HOLE = [[2.0, 2.0], [4.0, 2.0], [4.0, 4.0], [2.0, 4.0], [2.0, 2.0]]


def test_shapefiles(spark, tmp_path):
    base = f"{tmp_path}/towns"
    shapes = [("polygon", [SQUARE, HOLE]), (None, None), ("line", [[[1.0, 1.0], [50.0, 60.0]], [[5.0, 5.0], [6.0, 6.0]]]), ("point", [[[3.5, 4.5]]]), ("polygon", [[[100.0, 100.0], [100.0, 120.0], [130.0, 100.0], [100.0, 100.0]]])]
    rows = [("Älpha", "1"), ("none", "2"), ("Road", None), ("Spot", "4"), ("Béta", "5")]
    write_shapes(base, shapes, [("NAME", 12), ("CODE", 4)], rows, "latin-1")
    for records in (2, 100):
        got = {r.feature_id: r for r in vectors.read_shapefile(spark, base + ".shp", records=records).collect()}
        assert sorted(got) == [0, 2, 3, 4]
        assert got[0].parts == [SQUARE, HOLE] and got[0].attributes == {"NAME": "Älpha", "CODE": "1"} and got[2].attributes == {"NAME": "Road", "CODE": None}
        assert got[3].kind == "point" and got[3].parts == [[[3.5, 4.5]]] and len(got[2].parts) == 2
    named = vectors.read_shapefile(spark, base + ".shp").withColumn("name", vectors.attribute("NAME")).withColumn("code", vectors.attribute("CODE"))
    assert [r.feature_id for r in tables.boundary(named, "béta", ("name",)).collect()] == [4]
    assert [r.feature_id for r in tables.boundary(named, "nowhere", ("name",), "1").collect()] == [0]
    with pytest.raises(Exception, match="absent"):
        vectors.read_shapefile(spark, f"{tmp_path}/absent.shp").count()


def test_shapes_outside_the_box_are_not_decoded(spark, tmp_path):
    """Points of records that the box leaves out are broken; reading all of them fails."""
    base = f"{tmp_path}/far"
    shapes = [("polygon", [SQUARE]), ("polygon", [[[x + 1000 for x in p] for p in SQUARE]]), ("line", [[[2000.0, 1.0], [2001.0, 1.0]]])]
    write_shapes(base, shapes, [("NAME", 3)], [("a",), ("b",), ("c",)], broken=(1, 2))
    assert [r.feature_id for r in vectors.read_shapefile(spark, base + ".shp", (-5.0, 5.0, 3.0, 6.0)).collect()] == [0]
    assert vectors.read_shapefile(spark, base + ".shp", (20.0, 20.0, 30.0, 30.0)).count() == 0
    with pytest.raises(Exception):
        vectors.read_shapefile(spark, base + ".shp").collect()


def test_boundary_from_a_file_to_clipped_cells(spark, tmp_path):
    base = f"{tmp_path}/city"
    at = lambda c, r: [600.0 + 30 * c, 9000.0 - 30 * r]
    write_shapes(base, [("polygon", [[at(1, 2), at(5, 2), at(5, 9), at(1, 9), at(1, 2)], [at(2, 4), at(3, 4), at(3, 6), at(2, 6), at(2, 4)]])], [("NAME", 8)], [("City",)])
    features = vectors.read_shapefile(spark, base + ".shp").withColumn("name", vectors.attribute("NAME"))
    rings = vectors.rings(tables.boundary(features, "CITY", ("name",)), PROFILE.transform)
    g = spark.createDataFrame([(r * 7 + c, r, c, 1) for r in range(50) for c in range(7)], "cell_id long, r long, c long, v int")
    got = {(r.r, r.c): r.v for r in factors.crop(g, factors.inside_polygons(g, factors.ring_edges(rings)), "v").collect()}
    assert got == {(r, c): int(not (c == 2 and 4 <= r < 6)) for r in range(2, 9) for c in range(1, 5)}
    assert {(r.r, r.c) for r in factors.burn_polygons(rings).collect()} == {k for k, v in got.items() if v}


def test_geojson(spark, tmp_path):
    features = [
        {"type": "Feature", "id": 7, "properties": {"name": "A", "n": 3}, "geometry": {"type": "Polygon", "coordinates": [SQUARE, HOLE]}},
        {"type": "Feature", "properties": {"name": None}, "geometry": {"type": "MultiPolygon", "coordinates": [[SQUARE], [HOLE]]}},
        {"type": "Feature", "properties": {}, "geometry": {"type": "LineString", "coordinates": [[1, 2, 99], [3, 4, 99]]}},
        {"type": "Feature", "properties": {"name": "P"}, "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}},
        {"type": "Feature", "properties": {"name": "M"}, "geometry": {"type": "MultiPoint", "coordinates": [[1.5, 2.5], [2, 3]]}},
        {"type": "Feature", "properties": {"name": "none"}, "geometry": None},
    ]
    for name, text in (("lines", "\n".join(map(json.dumps, features))), ("listed", '{"type": "FeatureCollection", "features": [\n' + ",\n".join(map(json.dumps, features)) + "\n]}\n"),
                       ("one", json.dumps({"type": "FeatureCollection", "features": features}, indent=1))):
        with open(f"{tmp_path}/{name}.json", "w") as f:
            f.write(text)
        got = vectors.read_geojson(spark, f"{tmp_path}/{name}.json", name == "one").collect()
        assert sorted((r.kind, len(r.parts)) for r in got) == [("line", 1), ("point", 1), ("points", 2), ("polygon", 2), ("polygon", 2)]
        first = next(r for r in got if r.feature_id == 7)
        assert first.parts == [SQUARE, HOLE] and first.attributes == {"name": "A", "n": "3"}
        assert next(r for r in got if r.kind == "line").parts == [[[1.0, 2.0], [3.0, 4.0]]]


def test_models_keep_their_facts(spark, tmp_path):
    from terramark.operators import models

    frame = spark.createDataFrame([(float(i % 7), 1.0 if i % 3 else 2.0) for i in range(60)], "x double, label double")
    model = models.train_forest(frame, ["x"], "label", trees=3, depth=3)
    tables.write_model(spark, model, {"features": ["x"], "trees": 3}, f"{tmp_path}/m")
    again, facts = tables.read_model(spark, f"{tmp_path}/m")
    assert facts == {"features": ["x"], "trees": 3}
    shown = lambda m: [tuple(r) for r in models.with_probabilities(frame, m).collect()]
    assert shown(again) == shown(model)
    with pytest.raises(ValueError, match="labels"):
        tables.read_model(spark, f"{tmp_path}/m", ("labels",))
    with pytest.raises(Exception, match="(?i)exist"):
        tables.write_model(spark, model, {}, f"{tmp_path}/m")
    tables.write_model(spark, model, {"features": []}, f"{tmp_path}/m", overwrite=True)


def test_first_known_and_colours(spark):
    rows = spark.createDataFrame([("x", "2.5", "9"), (None, None, "-1"), ("", "n/a", None)], "a string, b string, c string")
    assert [r.v for r in rows.select(E.first_known("a", "b", "c").alias("v")).collect()] == [2.5, -1.0, None]
    assert spark.range(1).select(E.hex_colour(F.lit(255), F.lit(0), F.lit(10)).alias("h")).first().h == "#ff000a"

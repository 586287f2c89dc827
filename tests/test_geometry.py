"""Geometries in three formats keep their parts and holes."""

from __future__ import annotations

import json
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from fathomline.operators import polygons
from fathomline.sources import geometry


def wkb(kind, body, order="<", extra=0):
    return struct.pack(order + "BI", order == "<", kind + extra) + body


def ring(pts, order="<", z=False):
    return struct.pack(order + "I", len(pts)) + b"".join(struct.pack(order + ("ddd" if z else "dd"), *p, *((9.0,) if z else ())) for p in pts)


SQUARE, HOLE = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]


def polygon(rings, order="<", z=False, extra=0):
    return wkb(3, struct.pack(order + "I", len(rings)) + b"".join(ring(r, order, z) for r in rings), order, extra)


def plain(parts):
    return [[[(p["x"], p["y"]) for p in r] for r in part] for part in parts]


def test_wkb():
    assert plain(geometry.decoded(polygon([SQUARE, HOLE]))[0]) == [[SQUARE, HOLE]]
    assert plain(geometry.decoded(polygon([SQUARE], ">"))[0]) == [[SQUARE]]
    assert plain(geometry.decoded(polygon([SQUARE], z=True, extra=1000))[0]) == plain(geometry.decoded(polygon([SQUARE], z=True, extra=0x80000000))[0]) == [[SQUARE]]
    many = wkb(6, struct.pack("<I", 2) + polygon([SQUARE]) + polygon([HOLE]))
    assert plain(geometry.decoded(wkb(7, struct.pack("<I", 2) + many + wkb(1, struct.pack("<dd", 5, 6))))[0]) == [[SQUARE], [HOLE], [[(5, 6)]]]
    assert geometry.decoded(wkb(1, struct.pack("<dd", float("nan"), float("nan"))))[0] == []
    for bad in (polygon([SQUARE])[:-1], wkb(99, struct.pack("<I", 1))):
        with pytest.raises((ValueError, struct.error)):
            geometry.decoded(bad)


def gpkg(path, tables):
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT)")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    for name, blobs in tables.items():
        db.execute("INSERT INTO gpkg_contents VALUES (?, 'features')", (name,))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom')", (name,))
        db.execute(f'CREATE TABLE "{name}" (fid INTEGER PRIMARY KEY, class TEXT, geom BLOB)')
        db.executemany(f'INSERT INTO "{name}" VALUES (?, ?, ?)', blobs)
    db.commit()
    db.close()


def test_geopackage_in_splits_gives_areas_with_holes(spark, tmp_path):
    head = lambda flags, envelope: b"GP\x00" + bytes([flags]) + struct.pack("<i", 4326) + bytes(envelope)
    blobs = [(k, "reef" if k % 2 else "grass", head(1 | (k % 2) << 1, 32 * (k % 2)) + polygon([[(x + 10 * k, y) for x, y in SQUARE], [(x + 10 * k, y) for x, y in HOLE]])) for k in range(1, 24)]
    gpkg(tmp_path / "a.gpkg", {"benthic": [*blobs, (50, "reef", None), (51, "reef", b"GPbroken")], "geomorphic zones": blobs[:2]})
    rows = geometry.geopackage(spark, str(tmp_path), split_rows=5, skip="geomorphic")
    assert rows.count() == 23 and {r["layer"] for r in rows.collect()} == {"a/benthic"}
    shapes = geometry.surfaces(rows.select(F.col("properties")["class"].alias("layer"), "fid", "parts"), ["layer", "fid"]).select("layer", F.concat_ws("/", "fid", "part").alias("polygon"), "rings")
    assert {tuple(r["layers"]): r["area"] for r in polygons.areas(shapes, [], 7.0).collect()} == {("grass",): pytest.approx(11 * 15), ("reef",): pytest.approx(12 * 15)}


def test_geojson_keeps_rings(spark, tmp_path):
    shapes = [("Polygon", [SQUARE, HOLE]), ("MultiPolygon", [[SQUARE], [HOLE]]), ("Point", [5, 6]), ("LineString", [[0, 0], [1, 2, 3]]), ("MultiLineString", [[[0, 0], [1, 1]]]), ("MultiPoint", [[1, 2]]), ("Odd", [1])]
    features = [{"type": "Feature", "properties": {"name": k}, "geometry": {"type": k, "coordinates": c}} for k, c in shapes] + [{"type": "Feature", "properties": {}, "geometry": None}]
    (tmp_path / "reef.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    got = {r["properties"]["name"]: plain(r["parts"]) for r in geometry.geojson(spark, str(tmp_path / "reef.geojson")).collect()}
    assert got == {"Polygon": [[SQUARE, HOLE]], "MultiPolygon": [[SQUARE], [HOLE]], "Point": [[[(5, 6)]]], "LineString": [[[(0, 0), (1, 2)]]], "MultiLineString": [[[(0, 0), (1, 1)]]], "MultiPoint": [[[(1, 2)]]]}
    where = geometry.surfaces(geometry.geojson(spark, str(tmp_path / "reef.geojson")), ["properties"]).filter("properties['name'] = 'Polygon'")
    inside = lambda x, y: where.select(polygons.contains(F.lit(x), F.lit(y), F.col("rings")).alias("i")).first()["i"]
    assert inside(3.0, 3.0) and not inside(1.5, 1.5)

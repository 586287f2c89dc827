"""Geometries with their parts and rings: WKB, GeoPackage and GeoJSON, as array<array<array<struct<x, y>>>> (parts, rings of a part, points of a ring).

A point is a part of one ring of one point, a line a part of one ring; a polygon's first ring is the outer one. Heights and measures are left out.
"""

from __future__ import annotations

import os
import sqlite3
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fathomline.sources.ranges import files_below

PARTS = T.ArrayType(T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))))
#: Fixed values of WKB: kinds of geometries, and flags of further coordinates in the older form.
POINT, LINE, POLYGON, MULTIPOINT, MULTILINE, MULTIPOLYGON, COLLECTION = range(1, 8)
HAS_Z, HAS_M, HAS_SRID = 0x80000000, 0x40000000, 0x20000000
#: Fixed values of GeoPackage: the marker of its blobs, the size of their header, and of the envelopes by their kind.
MARKER, HEADER, ENVELOPES = b"GP", 8, {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}


def decoded(data: bytes, at: int = 0) -> tuple[list, int]:
    """Parts of the geometry that begins at a place, and where it ends; struct.error for data cut short, ValueError for what is no WKB."""
    if data[at] not in (0, 1):
        raise ValueError("no byte order")
    order = "<" if data[at] else ">"
    kind = struct.unpack_from(order + "I", data, at + 1)[0]
    at += 5 + (4 if kind & HAS_SRID else 0)
    flags, kind = kind & 0xF0000000, kind & 0x0FFFFFFF
    width = 2 + bool(flags & HAS_Z) + bool(flags & HAS_M) + (kind // 1000 in (1, 3)) + (kind // 1000 in (2, 3))
    kind %= 1000

    def points(n: int, at: int) -> tuple[list, int]:
        v = struct.unpack_from(f"{order}{n * width}d", data, at)
        return [{"x": v[k], "y": v[k + 1]} for k in range(0, n * width, width)], at + 8 * n * width

    def count(at: int) -> tuple[int, int]:
        return struct.unpack_from(order + "I", data, at)[0], at + 4

    if kind == POINT:
        ring, at = points(1, at)
        return ([] if ring[0]["x"] != ring[0]["x"] else [[ring]]), at
    n, at = count(at)
    if kind == LINE:
        ring, at = points(n, at)
        return ([[ring]] if ring else []), at
    if kind == POLYGON:
        rings = []
        for _ in range(n):
            m, at = count(at)
            ring, at = points(m, at)
            rings.append(ring)
        return ([rings] if rings else []), at
    if kind in (MULTIPOINT, MULTILINE, MULTIPOLYGON, COLLECTION):
        out = []
        for _ in range(n):
            parts, at = decoded(data, at)
            out += parts
        return out, at
    raise ValueError(f"geometry kind {kind}")


def unwrapped(blob: bytes) -> bytes:
    """The WKB in a GeoPackage blob; other data as they are."""
    return blob[HEADER + ENVELOPES.get(blob[3] >> 1 & 7, 0) :] if blob[:2] == MARKER else blob


@F.pandas_udf(PARTS)
def wkb_parts(blobs: pd.Series) -> pd.Series:
    """Parts of WKB or GeoPackage blobs; null for nulls and for what cannot be read."""

    def one(blob: bytes | None) -> list | None:
        try:
            return None if blob is None else decoded(unwrapped(bytes(blob)))[0]
        except (struct.error, ValueError, IndexError):
            return None

    return blobs.map(one)


def geojson_parts(geometry: Column) -> Column:
    """Parts of a GeoJSON geometry in a string column, in the JVM; null for collections and for what cannot be read."""
    kind, c = F.get_json_object(geometry, "$.type"), F.get_json_object(geometry, "$.coordinates")
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    ring = lambda r: F.transform(r, point)
    part = lambda p: F.transform(p, ring)
    nested = {d: F.from_json(c, "array<" * d + "double" + ">" * d) for d in (1, 2, 3, 4)}
    return (
        F.when(kind == "Point", F.array(F.array(F.array(point(nested[1])))))
        .when(kind == "MultiPoint", F.transform(nested[2], lambda p: F.array(F.array(point(p)))))
        .when(kind == "LineString", F.array(F.array(ring(nested[2]))))
        .when(kind == "MultiLineString", F.transform(nested[3], lambda r: F.array(ring(r))))
        .when(kind == "Polygon", F.array(part(nested[3])))
        .when(kind == "MultiPolygon", F.transform(nested[4], part))
    )


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """layer, kind, properties (map) and parts of the features of GeoJSON collections; features without a geometry are left out."""
    shape = "features array<struct<properties: map<string,string>, geometry: string>>"
    docs = spark.read.schema(shape).json(path, multiLine=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"([^/]*)\.[A-Za-z]+$", 1).alias("layer"), F.inline("features"))
    rows = docs.filter("geometry IS NOT NULL").select("layer", F.coalesce(F.col("properties")["kind"], F.col("layer")).alias("kind"), "properties", geojson_parts(F.col("geometry")).alias("parts"))
    return rows.filter("parts IS NOT NULL")


def surfaces(rows: DataFrame, keep: list[str], parts: str = "parts") -> DataFrame:
    """``keep``, part (its number from 0) and rings of the parts that bound an area: what the operators over polygons take."""
    return rows.select(*keep, F.posexplode(parts).alias("part", "rings")).filter(F.size(F.get("rings", F.lit(0))) >= 3)


class GeoPackage(DataSource):
    """``spark.read.format("geopackage")``: layer, fid, properties (map of strings) and geometry (the blob) of all feature tables of the files below ``path``; a range of rows is a task.

    SQLite opens files of a local or shared folder only. Options: path, splitRows, skip (feature tables whose name holds this are left out).
    """

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def schema(self) -> str:
        return "layer string, fid long, properties map<string,string>, geometry binary"

    def reader(self, schema) -> GeoPackageReader:
        return GeoPackageReader(self.options)


class Rows(InputPartition):
    def __init__(self, path: str, table: str, column: str, low: int, high: int) -> None:
        super().__init__((path, table, low))
        self.path, self.table, self.column, self.low, self.high = path, table, column, low, high


def connected(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class GeoPackageReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.most, self.skip = options["path"], int(options.get("splitRows", 100_000)), options.get("skip", "")

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path, _ in files_below(self.root, (".gpkg",)):
            with connected(path) as db:
                for table, column in db.execute("SELECT c.table_name, g.column_name FROM gpkg_contents c JOIN gpkg_geometry_columns g ON g.table_name = c.table_name WHERE c.data_type = 'features' ORDER BY 1").fetchall():
                    if self.skip and self.skip.lower() in table.lower():
                        continue
                    low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(table)}").fetchone()
                    if low is not None:
                        out += [Rows(path, table, column, a, min(a + self.most - 1, high)) for a in range(low, high + 1, self.most)]
        return out or [Rows("", "", "", 0, -1)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        if not partition.path:
            return
        with connected(partition.path) as db:
            found = db.execute(f"SELECT rowid, * FROM {quoted(partition.table)} WHERE rowid BETWEEN ? AND ?", (partition.low, partition.high))
            names = [c[0] for c in found.description][1:]
            layer = f"{os.path.basename(partition.path).removesuffix('.gpkg')}/{partition.table}"
            for fid, *values in found:
                row = dict(zip(names, values, strict=True))
                blob = row.pop(partition.column, None)
                yield layer, fid, {k: None if v is None else str(v) for k, v in row.items() if not isinstance(v, bytes)}, blob


def geopackage(spark: SparkSession, path: str, split_rows: int = 100_000, skip: str = "") -> DataFrame:
    """layer, fid, properties and parts of the features below ``path``; those without a readable, non-empty geometry are left out."""
    spark.dataSource.register(GeoPackage)
    rows = spark.read.format("geopackage").option("splitRows", str(split_rows)).option("skip", skip).load(path)
    return rows.select("layer", "fid", "properties", wkb_parts("geometry").alias("parts")).filter("size(parts) > 0")

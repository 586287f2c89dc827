"""Readers and writers of the survey formats, as DataFrames with declared schemas."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "tile string, strip string, x int, y int, lat double, lon double, mean_intensity double, width int, height int, quality string"
SIDECAR = "format string, strip string, width int, height int, rows array<struct<row: int, time: timestamp, lat: double, lon: double, heading_deg: double, altitude_m: double, speed_mps: double, quality: string>>"
SURVEY = "survey_id string, detections array<struct<id: string, object_class: string, confidence: double, latitude: double, longitude: double, suppressed: boolean>>, hotspots array<struct<hotspot_id: string, risk_score: double>>"
PINGS = "path string, ping int, t double, lat double, lon double, samples array<float>"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Tiles from JSON (an array of records) or CSV; empty cells are nulls."""
    if path.endswith(".json"):
        return spark.read.schema(MANIFEST).json(path, multiLine=True)
    return spark.read.schema(MANIFEST).csv(path, header=True, nullValue="", enforceSchema=False)


def control_points(spark: SparkSession, path: str, aliases: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """strip, points: located pixels of each strip. Header names count whatever their case, and under their aliases; places off the globe are dropped."""
    aliases = aliases or {"strip": ("strip", "image"), "pixel_x": ("pixel_x", "px", "col"), "pixel_y": ("pixel_y", "py", "row"), "latitude": ("latitude", "lat"), "longitude": ("longitude", "lon", "lng")}
    rows = spark.read.csv(path, header=True, nullValue="")
    have = {c.strip().lower(): c for c in rows.columns}

    def column(name: str):
        found = [F.col(f"`{have[a]}`") for a in aliases[name] if a in have]
        return (F.coalesce(*found) if found else F.lit(None)).cast("string" if name == "strip" else "double").alias(name)

    rows = rows.select(*map(column, aliases)).filter(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180))
    return rows.groupBy("strip").agg(F.array_sort(F.collect_list(F.struct("pixel_y", "pixel_x", "latitude", "longitude"))).alias("points"))


def nav_sidecars(spark: SparkSession, path: str, kind: str = "nav-1") -> DataFrame:
    """One row for each navigation row of the sidecars whose format is ``kind``."""
    docs = spark.read.schema(SIDECAR).json(path, multiLine=True).filter(F.col("format") == kind)
    return docs.select("strip", "width", "height", F.inline("rows"))


def surveys(spark: SparkSession, path: str) -> DataFrame:
    """Survey documents below a folder; unreadable ones are skipped."""
    docs = spark.read.schema(SURVEY + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path, multiLine=True).withColumn("path", F.col("_metadata.file_path"))
    return docs.filter("_corrupt_record IS NULL").drop("_corrupt_record").withColumn("survey_id", F.coalesce("survey_id", F.element_at(F.split("path", "/"), -2)))


def features(spark: SparkSession, path: str) -> DataFrame:
    """layer, kind, name, geom_type, points of GeoJSON collections (points: the coordinates of points, lines and outer rings, flattened)."""
    shape = "features array<struct<properties: map<string,string>, geometry: string>>"
    docs = spark.read.schema(shape).json(path, multiLine=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"([^/]*)\.[A-Za-z]+$", 1).alias("layer"), F.inline("features"))
    numbers = F.regexp_extract_all(F.get_json_object("geometry", "$.coordinates"), F.lit(r"\[\s*(-?[0-9.eE+-]+)\s*,\s*(-?[0-9.eE+-]+)"), F.lit(0))
    pair = lambda s: F.struct(F.regexp_extract(s, r"\[\s*(-?[0-9.eE+-]+)", 1).cast("double").alias("lon"), F.regexp_extract(s, r",\s*(-?[0-9.eE+-]+)", 1).cast("double").alias("lat"))
    return docs.select("layer", F.coalesce(F.col("properties")["kind"], F.col("layer")).alias("kind"), F.col("properties")["name"].alias("name"), F.get_json_object("geometry", "$.type").alias("geom_type"), F.transform(numbers, pair).alias("points"))


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """path, meta, body of text files that begin with front matter between lines of three hyphens; others are left out."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("path"), F.regexp_replace("value", "\r\n", "\n").alias("value"))
    head = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---\n", 1)
    lines = F.filter(F.split(head, "\n"), lambda x: F.contains(x, F.lit(":")))
    meta = F.map_from_entries(F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, "^[^:]*:", "")))))
    return texts.filter(head != "").select("path", meta.alias("meta"), F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n", "").alias("body"))


def drifters(spark: SparkSession, path: str) -> DataFrame:
    """id, t, lat, lon, ve, vn of drifter CSVs with a row of units below the header; rows without a time or place are dropped."""
    rows = spark.read.csv(path, header=True, mode="DROPMALFORMED")
    number = lambda c: F.nullif(F.col(c).try_cast("double"), F.lit(float("nan")))
    rows = rows.select(F.col("ID").alias("id"), F.try_to_timestamp("time").alias("t"), number("latitude").alias("lat"), number("longitude").alias("lon"), number("ve").alias("ve"), number("vn").alias("vn"))
    return rows.dropna(subset=["t", "lat", "lon"])


def job_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """job_id, seq, ts, type, stage, message of JSON lines. Lines that are not whole are left out; a stream reads each file once, so its writers must add whole files."""
    shape = "job_id string, seq long, ts timestamp, type string, stage string, message string"
    reader = spark.readStream if streaming else spark.read
    lines = reader.schema("value string").text(path)
    return lines.select(F.from_json("value", shape).alias("e")).filter("e.seq IS NOT NULL").select("e.*")


def strip_images(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("png", "jpg", "jpeg", "tif", "tiff")) -> DataFrame:
    """path, name, bytes and content of the image files below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.filter(F.lower("path").rlike(r"\.(" + "|".join(suffixes) + ")$")).select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("length").alias("bytes"), "content")


#: Fixed values of the XTF format: packet magic, size of file and packet headers, type of a sonar packet, offsets in a ping header.
XTF_MAGIC, XTF_FILE_HEADER, XTF_PACKET_HEADER, XTF_SONAR, XTF_PING_HEADER, XTF_CHANNEL_HEADER = 0xFACE, 1024, 14, 0, 256, 64
XTF_TIME, XTF_LAT, XTF_LON, XTF_SAMPLES = 14, 160, 168, 42
#: The flag of the coordinates' units in the file header, and its value for projected metres.
XTF_UNITS, XTF_METRES = 164, 0


def xtf_pings(path: str, data: bytes) -> Iterator[tuple]:
    """Pings of an XTF file's bytes. Zero places are missing ones, and so are projected metres outside the range of degrees; a broken packet ends nothing, the
    next magic number is sought."""
    at, ping = XTF_FILE_HEADER, 0
    metres = len(data) > XTF_UNITS + 1 and struct.unpack_from("<H", data, XTF_UNITS)[0] == XTF_METRES
    while at + XTF_PACKET_HEADER <= len(data):
        magic, kind, _, channels = struct.unpack_from("<HBBH", data, at)
        size = struct.unpack_from("<I", data, at + 10)[0]
        if magic != XTF_MAGIC or size < XTF_PACKET_HEADER:
            at += 1
            continue
        if kind == XTF_SONAR and size >= XTF_PING_HEADER and at + size <= len(data):
            year, month, day, hour, minute, second, hundredth = struct.unpack_from("<H6B", data, at + XTF_TIME)
            try:
                t = pd.Timestamp(year, month, day, hour, minute, second, hundredth * 10000, tz="UTC").timestamp()
            except ValueError:
                t = None
            lat, lon = struct.unpack_from("<d", data, at + XTF_LAT)[0], struct.unpack_from("<d", data, at + XTF_LON)[0]
            samples: list[float] = []
            place = at + XTF_PING_HEADER
            for _ in range(channels):
                if place + XTF_CHANNEL_HEADER > at + size:
                    break
                n = struct.unpack_from("<I", data, place + XTF_SAMPLES)[0]
                body = data[place + XTF_CHANNEL_HEADER : min(place + XTF_CHANNEL_HEADER + 2 * n, at + size)]
                samples += np.frombuffer(body[: len(body) // 2 * 2], "<u2").astype(np.float32).tolist()
                place += XTF_CHANNEL_HEADER + 2 * n
            located = (lat, lon) != (0.0, 0.0) and not (metres and (abs(lat) > 90 or abs(lon) > 180))
            yield path, ping, t, lat if located else None, lon if located else None, samples
            ping += 1
        at += size


def xtf(spark: SparkSession, path: str) -> DataFrame:
    """Pings of side-scan logs: one file a task row, decoded where it lies."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame(list(xtf_pings(name, bytes(content))), columns=["path", "ping", "t", "lat", "lon", "samples"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, PINGS)


def write_geojson(rows: DataFrame, path: str, lat: str = "latitude", lon: str = "longitude") -> None:
    """One feature a line (GeoJSON text sequence) for located rows, and a summary of those that are not, below ``path``."""
    located = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    props = F.struct(*[c for c in rows.columns if c not in (lat, lon)])
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"), props.alias("properties"))
    rows.filter(located).select(F.to_json(feature).alias("value")).write.mode("overwrite").text(f"{path}/features")
    rows.agg(F.count_if(located).alias("located"), F.count_if(~located).alias("unlocated")).write.mode("overwrite").json(f"{path}/summary")


def write_report(rows: DataFrame, path: str, most: int = 0) -> None:
    """CSV by falling severity then id, all rows or the first ``most``; nulls are empty cells."""
    rows = rows.orderBy(F.desc("severity"), "id")
    (rows.limit(most) if most else rows).write.mode("overwrite").csv(path, header=True, nullValue="")


def evaluation_cases(spark: SparkSession, path: str) -> DataFrame:
    """id, question, answers of JSON lines; lines without a question are left out."""
    return spark.read.schema("id string, question string, answers array<string>").json(path).filter(F.col("question").isNotNull())


def hazards(spark: SparkSession, path: str) -> DataFrame:
    """id, class, confidence, x1, y1, x2, y2 of an array of records from another detector; a confidence above 1 is a percentage."""
    rows = spark.read.schema("id string, label string, score double, box array<double>").json(path, multiLine=True)
    score = F.when(F.col("score") > 1, F.col("score") / 100).otherwise(F.col("score"))
    return rows.select("id", F.coalesce("label", F.lit("unknown")).alias("class"), score.alias("confidence"), *[F.get("box", F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """id, name, embedding of a catalog (an array of records); raises if only some of them have an embedding, or if lengths differ."""
    rows = spark.read.schema("id string, name string, embedding array<double>").json(path, multiLine=True)
    n, embedded, lengths = rows.agg(F.count("*"), F.count("embedding"), F.countDistinct(F.size("embedding"))).first()
    if embedded not in (0, n) or (embedded and lengths > 1):
        raise ValueError(f"{embedded} of {n} entries have embeddings, of {lengths} lengths")
    return rows


def write_documents(rows: DataFrame, path: str, key: str) -> None:
    """One JSON document a key: the key and its rows, in the order of their columns. Spark's commit puts all files in place at once."""
    columns = [c for c in rows.columns if c != key]
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows"))
    grouped.select(F.to_json(F.struct(key, "rows")).alias("value")).write.mode("overwrite").text(path)


def write_manifest(rows: DataFrame, path: str) -> None:
    """The manifest as CSV (nulls are empty cells) and as JSON lines, below ``path``."""
    rows.write.mode("overwrite").csv(f"{path}/csv", header=True, nullValue="")
    rows.write.mode("overwrite").json(f"{path}/json")

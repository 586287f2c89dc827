"""Side-scan logs (JSF and XTF) as a batch source that plans its splits by byte ranges.

A log of any size is cut into ranges. A task reads the packets that begin in its range: it goes from packet to packet, and seeks the next marker at its start and after
anything broken. A marker counts where the packet's own fields fit together (or, for packets that are not decoded, where another one follows), so a log gives the same rows
however it is cut.
"""

from __future__ import annotations

import calendar
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fathomline.functions import geo
from fathomline.sources.ranges import Bytes, Span, files_below, spans

PING = (
    "path string, position long, subsystem int, channel int, ping long, t double, lat double, lon double, ship_lat double, ship_lon double, layback_m double, heading_deg double, ship_heading_deg double, "
    "pitch_deg double, roll_deg double, heave_m double, altitude_m double, aux_altitude_m double, depth_m double, speed_mps double, r0_m double, dr_m double, samples array<float>, synthetic boolean, problem string"
)
NAMES = [c.split()[0] for c in PING.split(", ")]
KNOT = 1852 / 3600

#: Fixed values of the JSF format: marker, type of a sonar message, sizes of the message header and of the sonar header.
JSF_MARKER, JSF_SONAR, JSF_HEADER, JSF_SONAR_HEADER = 0x1601, 80, 16, 240
#: Fixed places and kinds of the fields that are read from a sonar header.
JSF = {
    "seconds": (0, "i"), "start_depth": (4, "I"), "ping": (8, "I"), "data_format": (34, "h"), "x": (80, "i"), "y": (84, "i"), "units": (88, "h"), "annotation": (90, "24s"), "samples": (114, "H"),
    "interval_ns": (116, "I"), "depth_mm": (136, "i"), "altitude_mm": (144, "i"), "sound_speed": (148, "f"), "year": (156, "h"), "day": (158, "h"), "hour": (160, "h"), "minute": (162, "h"),
    "second": (164, "h"), "weight": (168, "h"), "heading": (172, "H"), "pitch": (174, "h"), "roll": (176, "h"), "speed": (194, "h"), "ms_today": (200, "I"),
}
#: Units of JSF coordinates that are degrees: ten-thousandths of a minute of arc.
JSF_ARC = 2

#: Fixed values of the XTF format: marker, sizes of the file, packet, ping and channel headers, type of a sonar packet, places of the units of coordinates and of
#: the channels' descriptions in the file header, size of such a description, and how it names port and starboard.
XTF_MARKER, XTF_FILE, XTF_HEADER, XTF_PING, XTF_CHANNEL, XTF_SONAR = 0xFACE, 1024, 14, 256, 64, 0
XTF_UNITS, XTF_DEGREES, XTF_DESCRIPTIONS, XTF_DESCRIPTION, XTF_PORT, XTF_STARBOARD = 164, 3, 256, 128, 1, 2
#: Fixed places and kinds of the fields of a ping header, and of a channel header.
XTF = {
    "year": (14, "H"), "month": (16, "B"), "day": (17, "B"), "hour": (18, "B"), "minute": (19, "B"), "second": (20, "B"), "hundredth": (21, "B"), "ping": (28, "I"), "ship_speed": (120, "f"), "ship_heading": (124, "f"),
    "ship_y": (128, "d"), "ship_x": (136, "d"), "speed": (152, "f"), "y": (160, "d"), "x": (168, "d"), "layback": (184, "f"), "depth": (192, "f"), "altitude": (196, "f"), "aux_altitude": (200, "f"),
    "pitch": (204, "f"), "roll": (208, "f"), "heading": (212, "f"), "heave": (216, "f"),
}
XTF_CHANNEL_FIELDS = {"number": (0, "H"), "slant_range": (4, "f"), "samples": (42, "I")}


def fields(table: dict[str, tuple[int, str]], data: bytes, base: int = 0) -> dict:
    return {name: struct.unpack_from("<" + kind, data, base + at)[0] for name, (at, kind) in table.items()}


def moment(year: int, month: int, day: int, hour: int, minute: int, second: float) -> float | None:
    """Seconds of UTC, or null for what is no date; days count on beyond a month's end."""
    if not (1900 < year < 2200 and 1 <= month <= 12 and 1 <= day <= 366 and 0 <= hour < 24 and 0 <= minute < 60 and 0 <= second < 61):
        return None
    return calendar.timegm((year, month, 1, hour, minute, 0)) + (day - 1) * 86400 + second


class Jsf:
    """One row for each sonar message."""

    marker, suffixes, first = struct.pack("<H", JSF_MARKER), (".jsf",), 0

    def __init__(self, file: Bytes) -> None:
        self.file = file

    def size(self, at: int) -> int:
        """Bytes of the packet that begins at a place; 0 if none does, or one that does not fit the file or its own fields."""
        head = self.file.at(at, JSF_HEADER)
        if len(head) < JSF_HEADER or head[:2] != self.marker:
            return 0
        size = struct.unpack_from("<i", head, 12)[0]
        if size < 0 or at + JSF_HEADER + size > self.file.size:
            return 0
        end = at + JSF_HEADER + size
        if head[4] == JSF_SONAR and size >= JSF_SONAR_HEADER:
            f = fields({k: JSF[k] for k in ("data_format", "samples")}, self.file.at(at + JSF_HEADER, JSF_SONAR_HEADER))
            if JSF_SONAR_HEADER + f["samples"] * (4 if f["data_format"] == 1 else 2) <= size <= JSF_SONAR_HEADER + 4 * 65536 + 4096:
                return JSF_HEADER + size
        follows = self.file.at(end, 2)
        return JSF_HEADER + size if follows in (self.marker, b"") else 0

    def rows(self, at: int, size: int) -> Iterator[dict]:
        data = self.file.at(at, size)
        if data[4] != JSF_SONAR:
            return
        where = {"position": at, "subsystem": data[7], "channel": data[8]}
        if size < JSF_HEADER + JSF_SONAR_HEADER:
            yield where | {"problem": "shorter than its header"}
            return
        f = fields(JSF, data, JSF_HEADER)
        t = f["seconds"] + f["ms_today"] % 1000 / 1000 if f["seconds"] > 0 else moment(f["year"], 1, f["day"], f["hour"], f["minute"], f["second"])
        located = f["units"] == JSF_ARC and (f["x"] or f["y"])
        sound = f["sound_speed"] if 1400 <= f["sound_speed"] <= 1600 else 1500.0
        dr = f["interval_ns"] * 1e-9 * sound / 2
        samples, problem = None, None
        wide = 4 if f["data_format"] == 1 else 2
        raw = data[JSF_HEADER + JSF_SONAR_HEADER :][: f["samples"] * wide]
        if not 0 <= f["data_format"] <= 4:
            problem = f"data format {f['data_format']}"
        elif len(raw) < f["samples"] * wide:
            problem = "samples do not fit"
        else:
            if f["data_format"] == 1:  # pairs of a real and an imaginary part
                pairs = np.frombuffer(raw, "<i2").astype(np.float32).reshape(-1, 2)
                samples = np.hypot(pairs[:, 0], pairs[:, 1])
            else:
                samples = np.frombuffer(raw, "<u2").astype(np.float32) if f["data_format"] in (0, 4) else np.abs(np.frombuffer(raw, "<i2").astype(np.float32))
            samples = samples * np.float32(2.0 ** -f["weight"])
        yield where | {
            "ping": f["ping"], "t": t, "lat": f["y"] / 600_000 if located else None, "lon": f["x"] / 600_000 if located else None, "heading_deg": f["heading"] / 100, "pitch_deg": f["pitch"] * 180 / 32768,
            "roll_deg": f["roll"] * 180 / 32768, "altitude_m": f["altitude_mm"] / 1000 if f["altitude_mm"] > 0 else None, "depth_m": f["depth_mm"] / 1000 if f["depth_mm"] > 0 else None,
            "speed_mps": f["speed"] / 10 * KNOT, "r0_m": f["start_depth"] * dr, "dr_m": dr if dr > 0 else None, "samples": samples, "synthetic": b"SYNTHETIC" in f["annotation"].upper(), "problem": problem,
        }


class Xtf:
    """One row for each channel of a sonar packet: 0 port, 1 starboard, others above."""

    marker, suffixes, first = struct.pack("<H", XTF_MARKER), (".xtf",), XTF_FILE

    def __init__(self, file: Bytes) -> None:
        self.file = file
        head = file.at(0, XTF_FILE)
        self.degrees = len(head) >= XTF_UNITS + 2 and struct.unpack_from("<H", head, XTF_UNITS)[0] == XTF_DEGREES  # others are projected metres
        kinds = [head[at] for at in range(XTF_DESCRIPTIONS, min(len(head), XTF_FILE) - XTF_DESCRIPTION + 1, XTF_DESCRIPTION)]
        self.sides = {k: kind - XTF_PORT for k, kind in enumerate(kinds) if kind in (XTF_PORT, XTF_STARBOARD)} or {0: 0, 1: 1}
        self.synthetic = b"SYNTHETIC" in head.upper()

    def size(self, at: int) -> int:
        head = self.file.at(at, XTF_HEADER)
        if len(head) < XTF_HEADER or head[:2] != self.marker:
            return 0
        size, channels = struct.unpack_from("<I", head, 10)[0], struct.unpack_from("<H", head, 4)[0]
        if size < XTF_HEADER or at + size > self.file.size:
            return 0
        if head[2] == XTF_SONAR and size >= XTF_PING:
            place = at + XTF_PING
            for _ in range(channels):
                c = self.file.at(place, XTF_CHANNEL)
                if len(c) < XTF_CHANNEL or place + XTF_CHANNEL > at + size:
                    break
                place += XTF_CHANNEL + 2 * struct.unpack_from("<I", c, XTF_CHANNEL_FIELDS["samples"][0])[0]
            else:
                if place <= at + size:
                    return size
        return size if self.file.at(at + size, 2) in (self.marker, b"") else 0

    def rows(self, at: int, size: int) -> Iterator[dict]:
        data = self.file.at(at, size)
        if data[2] != XTF_SONAR:
            return
        if size < XTF_PING:
            yield {"position": at, "subsystem": data[3], "problem": "shorter than its header"}
            return
        f = fields(XTF, data)
        t = moment(f["year"], f["month"], f["day"], f["hour"], f["minute"], f["second"] + f["hundredth"] / 100)

        def placed(x: float, y: float) -> tuple[float | None, float | None]:
            return (y, x) if (x or y) and self.degrees and abs(y) <= 90 and abs(x) <= 180 else (None, None)

        (lat, lon), (ship_lat, ship_lon) = placed(f["x"], f["y"]), placed(f["ship_x"], f["ship_y"])
        ping = {
            "position": at, "subsystem": data[3], "ping": f["ping"], "t": t, "lat": lat, "lon": lon, "ship_lat": ship_lat, "ship_lon": ship_lon, "layback_m": f["layback"], "heading_deg": f["heading"], "ship_heading_deg": f["ship_heading"],
            "pitch_deg": f["pitch"], "roll_deg": f["roll"], "heave_m": f["heave"], "altitude_m": f["altitude"] if f["altitude"] > 0 else None, "aux_altitude_m": f["aux_altitude"] if f["aux_altitude"] > 0 else None,
            "depth_m": f["depth"] if f["depth"] > 0 else None, "speed_mps": f["speed"] * KNOT, "r0_m": 0.0, "synthetic": self.synthetic,
        }
        place = XTF_PING
        for k in range(struct.unpack_from("<H", data, 4)[0]):
            if place + XTF_CHANNEL > size:
                yield ping | {"channel": self.sides.get(k, k + 2), "problem": "channel is missing"}
                break
            c = fields(XTF_CHANNEL_FIELDS, data, place)
            n, place = c["samples"], place + XTF_CHANNEL
            raw = data[place : place + 2 * n]
            fits = len(raw) == 2 * n
            yield ping | {
                "channel": self.sides.get(k, k + 2), "dr_m": c["slant_range"] / n if n and c["slant_range"] > 0 else None,
                "samples": np.frombuffer(raw, "<u2").astype(np.float32) if fits else None, "problem": None if fits else "samples do not fit",
            }
            place += 2 * n


FORMATS = {"jsf": Jsf, "xtf": Xtf}


def packets(log: Jsf | Xtf, start: int, end: int) -> Iterator[tuple[int, int]]:
    """(place, size) of the packets that begin in a range. Whether one begins at a place depends on the bytes from there on only, not on where reading began."""
    at = max(start, log.first)
    while 0 <= at < end:
        size = log.size(at)
        if size:
            yield at, size
            at += size
        else:
            at = log.file.find(log.marker, at + 1, end)


class SonarLog(DataSource):
    """``spark.read.format("sonar_log")``: the pings of one or of many logs. Options: path, kind (jsf, xtf), splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "sonar_log"

    def schema(self) -> str:
        return PING

    def reader(self, schema) -> SonarLogReader:
        return SonarLogReader(self.options)


class SonarLogReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.kind = options["path"], options.get("kind", "jsf")
        self.most = int(options.get("splitBytes", 64 << 20))
        if self.kind not in FORMATS:
            raise ValueError(f"kind {self.kind}: one of {', '.join(FORMATS)}")

    def partitions(self) -> list[InputPartition]:
        return [s for path, size in files_below(self.root, FORMATS[self.kind].suffixes) for s in spans(path, 0, size, size, self.most)] or [Span("", 0, 0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        file = Bytes(self.root, partition.path)
        log = FORMATS[self.kind](file)
        rows: list[dict] = []
        held = 0
        for at, size in packets(log, partition.start, partition.end):
            for row in log.rows(at, size):
                rows.append(row | {"path": partition.path})
                held += size
            if held > 4 << 20:
                yield batch(rows)
                rows, held = [], 0
        if rows:
            yield batch(rows)
        file.close()


def batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], type=f.type) for f in ARROW], schema=ARROW)


KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<float>": pa.list_(pa.float32())}
ARROW = pa.schema([(c.split(" ", 1)[0], KINDS[c.split(" ", 1)[1]]) for c in PING.split(", ")])


def messages(spark: SparkSession, path: str, kind: str, split_bytes: int = 64 << 20) -> DataFrame:
    """One row for each channel of each ping of the logs below ``path``, broken ones with their ``problem``."""
    spark.dataSource.register(SonarLog)
    return spark.read.format("sonar_log").option("kind", kind).option("splitBytes", str(split_bytes)).load(path)


def side_scan(rows: DataFrame, preferred: tuple[int, ...] = (20, 21)) -> DataFrame:
    """One row for each ping with its port and starboard samples: of each log the first of the preferred subsystems that has both channels, else the smallest (0 only in logs that have no other kind).

    What a whole log leaves at zero is not known: heading, attitude and speed become null there. A log without headings of the towfish takes the ship's; one without places of the
    towfish takes the ship's, moved back along the heading by the layback.
    """
    good = rows.filter("problem IS NULL AND channel IN (0, 1)")
    rank = F.coalesce(*(F.when(F.col("subsystem") == s, k) for k, s in enumerate(preferred)), F.col("subsystem") + len(preferred) + F.when(F.col("subsystem") == 0, 1 << 20).otherwise(0))
    both = good.groupBy("path", "subsystem").agg(F.count_distinct("channel").alias("sides")).filter("sides = 2")
    chosen = both.groupBy("path").agg(F.min_by("subsystem", rank).alias("subsystem"))
    zero = ("heading_deg", "ship_heading_deg", "pitch_deg", "roll_deg", "heave_m", "speed_mps")
    known = [F.max(F.coalesce(F.col(c) != 0, F.lit(False))).alias(f"has_{c}") for c in zero]
    chosen = chosen.join(good.groupBy("path").agg(*known, F.max(F.col("lat").isNotNull()).alias("has_place")), "path")

    def side(channel: int, name: str) -> list[Column]:
        return [F.max_by(c, F.when(F.col("channel") == channel, F.col("position"))).alias(f"{name}_{c}") for c in ("samples", "r0_m", "dr_m")]

    header = [c for c in NAMES if c not in ("path", "position", "subsystem", "channel", "ping", "r0_m", "dr_m", "samples", "problem")]
    first = F.min_by(F.struct(*header), F.struct("channel", "position")).alias("h")
    pings = good.join(chosen, ["path", "subsystem"]).groupBy("path", "subsystem", "ping").agg(
        first, *side(0, "port"), *side(1, "starboard"), *(F.max(f"has_{c}").alias(f"has_{c}") for c in (*zero, "place"))
    )
    h = {c: F.col(f"h.{c}") for c in header}

    def value(c: str) -> Column:
        return F.when(F.col(f"has_{c}"), h[c])

    heading = F.coalesce(value("heading_deg"), F.when(~F.col("has_heading_deg"), value("ship_heading_deg")))
    behind = F.radians(heading + 180)
    back = F.coalesce(F.when(h["layback_m"] > 0, h["layback_m"]), F.lit(0.0))
    lat, lon = geo.offset(h["ship_lat"], h["ship_lon"], F.coalesce(back * F.sin(behind), F.lit(0.0)), F.coalesce(back * F.cos(behind), F.lit(0.0)))
    return pings.select(
        "path", "subsystem", "ping", h["t"].alias("t"), F.when(F.col("has_place"), h["lat"]).otherwise(lat).alias("lat"), F.when(F.col("has_place"), h["lon"]).otherwise(lon).alias("lon"), heading.alias("heading_deg"),
        *(value(c).alias(c) for c in ("pitch_deg", "roll_deg", "heave_m", "speed_mps")), F.coalesce(h["altitude_m"], h["aux_altitude_m"]).alias("altitude_m"), h["depth_m"].alias("depth_m"), h["synthetic"].alias("synthetic"),
        *(f"{s}_{c}" for s in ("port", "starboard") for c in ("samples", "r0_m", "dr_m")),
    )

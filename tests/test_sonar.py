"""Side-scan logs: fields, splits, broken packets, and logs without a towfish's place."""

from __future__ import annotations

import math
import struct

import pytest

from fathomline.sources import sonar


def jsf_message(kind=80, subsystem=20, channel=0, samples=(1, 2, 3), data_format=0, count=None, **values):
    head = bytearray(240)
    given = {"data_format": data_format, "samples": len(samples) if count is None else count, "units": 2, "interval_ns": 100_000, "sound_speed": 1500.0, **values}
    for name, value in given.items():
        at, form = sonar.JSF[name]
        struct.pack_into("<" + form, head, at, value)
    flat = [x for s in samples for x in (s if isinstance(s, tuple) else (s,))]
    body = bytes(head) + struct.pack(f"<{len(flat)}{'H' if data_format in (0, 4) else 'h'}", *flat)
    return struct.pack("<HBBHBBBBHi", 0x1601, 1, 0, kind, 0, subsystem, channel, 0, 0, len(body)) + body


def log(n=60):
    """Pings with both channels, other messages between them, junk in the middle and a message cut off at the end."""
    out = [struct.pack("<HBBHBBBBHi", 0x1601, 1, 0, 426, 0, 0, 0, 0, 0, 5) + b"hello"]
    for p in range(n):
        for c in (0, 1):
            out.append(jsf_message(channel=c, ping=p, seconds=1_700_000_000 + p, ms_today=250, x=6_000_000 + p, y=-600_000, heading=9000, altitude_mm=12_500, samples=[(p * 7 + k) % 65_536 for k in range(200 + p)]))
        if p == 20:
            out.append(b"\x01\x16junk" * 9)
        if p == 30:
            out.append(jsf_message(subsystem=0, channel=0, ping=p))
    return b"".join(out) + jsf_message(ping=n)[:-3]


def rows_of(frame):
    return sorted(tuple(map(repr, r)) for r in frame.collect())


def test_splits_give_the_same_rows(spark, tmp_path):
    data = log()
    (tmp_path / "line.jsf").write_bytes(data)
    one = sonar.messages(spark, str(tmp_path), "jsf")
    many = sonar.messages(spark, str(tmp_path), "jsf", split_bytes=len(data) // 8 + 1)
    assert one.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() == 8
    assert rows_of(one) == rows_of(many) and one.count() == 121
    assert rows_of(sonar.messages(spark, str(tmp_path), "jsf", split_bytes=301)) == rows_of(one)


def test_jsf_fields(spark, tmp_path):
    parts = [
        jsf_message(ping=1, seconds=100, ms_today=1500, x=600_000, y=1_200_000, heading=12_345, pitch=16384, roll=-16384, altitude_mm=5000, depth_mm=0, speed=10, start_depth=4, weight=1, samples=[8, 16]),
        jsf_message(ping=1, channel=1, data_format=1, samples=[(3, 4), (-5, 12)], annotation=b"synthetic line"),
        jsf_message(ping=2, year=2024, day=32, hour=1, minute=2, second=3, units=1, x=5, y=5, data_format=2, samples=[-7, 7]),
        jsf_message(ping=2, channel=1, data_format=9),
        jsf_message(ping=3, samples=[1, 2], count=9),
    ]
    (tmp_path / "a.jsf").write_bytes(b"".join(parts))
    a, b, c, d, e = sonar.messages(spark, str(tmp_path / "a.jsf"), "jsf").orderBy("position").collect()
    assert (a["t"], a["lat"], a["lon"], a["heading_deg"], a["pitch_deg"], a["roll_deg"]) == (100.5, 2.0, 1.0, 123.45, 90.0, -90.0)
    assert (a["altitude_m"], a["depth_m"], a["speed_mps"], a["samples"], a["synthetic"]) == (5.0, None, pytest.approx(1852 / 3600), [4.0, 8.0], False)
    assert a["dr_m"] == pytest.approx(0.075) and a["r0_m"] == pytest.approx(0.3)
    assert b["samples"] == [5.0, 13.0] and b["synthetic"]
    assert (c["t"], c["lat"], c["samples"]) == (1706749323.0, None, [7.0, 7.0])
    assert (d["problem"], e["problem"], e["samples"]) == ("data format 9", "samples do not fit", None)


def test_side_scan_takes_one_subsystem_and_both_sides(spark, tmp_path):
    parts = [jsf_message(subsystem=s, channel=c, ping=p, samples=[s, c, p]) for p in (4, 5) for s in (0, 21, 22) for c in (0, 1)] + [jsf_message(subsystem=20, channel=0, ping=4)]
    (tmp_path / "a.jsf").write_bytes(b"".join(parts))
    (tmp_path / "empty.jsf").write_bytes(b"")
    got = sonar.side_scan(sonar.messages(spark, str(tmp_path), "jsf")).orderBy("ping").collect()
    assert [(r["subsystem"], r["ping"], r["port_samples"], r["starboard_samples"], r["heading_deg"], r["speed_mps"]) for r in got] == [(21, p, [21, 0, p], [21, 1, p], None, None) for p in (4, 5)]


def xtf_packet(ping, channels, kind=0, **values):
    head = bytearray(256)
    given = {"year": 2024, "month": 5, "day": 6, "hour": 7, "minute": 8, "second": 9, "hundredth": 50, "ping": ping, **values}
    for name, value in given.items():
        at, form = sonar.XTF[name]
        struct.pack_into("<" + form, head, at, value)
    body = b""
    for samples in channels:
        c = bytearray(64)
        struct.pack_into("<f", c, 4, 30.0)
        struct.pack_into("<I", c, 42, len(samples))
        body += bytes(c) + struct.pack(f"<{len(samples)}H", *samples)
    struct.pack_into("<HBBH", head, 0, 0xFACE, kind, 0, len(channels))
    struct.pack_into("<I", head, 10, 256 + len(body))
    return bytes(head) + body


def xtf_header(units=3, kinds=(1, 2)):
    head = bytearray(1024)
    struct.pack_into("<H", head, 164, units)
    for k, kind in enumerate(kinds):
        head[256 + 128 * k] = kind
    return bytes(head)


def test_xtf_splits_sides_and_fallbacks(spark, tmp_path):
    pings = b"".join(xtf_packet(p, [[p, 1], [p, 2], [9]], ship_y=10.0, ship_x=79.0, ship_heading=90.0, layback=100.0, aux_altitude=7.0) + (b"junk" if p == 3 else b"") for p in range(40))
    (tmp_path / "ship.xtf").write_bytes(xtf_header(kinds=(2, 1, 3)) + pings + xtf_packet(99, [[1]], kind=3))
    one = sonar.messages(spark, str(tmp_path), "xtf")
    assert rows_of(one) == rows_of(sonar.messages(spark, str(tmp_path), "xtf", split_bytes=3000)) and one.count() == 120
    got = sonar.side_scan(one).orderBy("ping").collect()
    assert len(got) == 40 and got[5]["starboard_samples"] == [5.0, 1.0] and got[5]["port_samples"] == [5.0, 2.0] and got[5]["port_dr_m"] == 15.0
    r = got[0]
    assert r["t"] == 1714979289.5 and r["heading_deg"] == 90.0 and r["altitude_m"] == 7.0 and r["lat"] == pytest.approx(10.0, abs=1e-9)
    assert (79.0 - r["lon"]) * math.radians(1) * 6378137 * math.cos(math.radians(10)) == pytest.approx(100.0, rel=0.002)


def test_projected_xtf_has_no_places(spark, tmp_path):
    (tmp_path / "m.xtf").write_bytes(xtf_header(units=0) + xtf_packet(1, [[1], [2]], y=50.0, x=60.0))
    assert [r["lat"] for r in sonar.messages(spark, str(tmp_path / "m.xtf"), "xtf").collect()] == [None, None]

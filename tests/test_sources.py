"""Readers and writers on small files of their own."""

from __future__ import annotations

import json
import struct

import particles
import pytest

from fathomline.operators import drift
from fathomline.sources import files


def test_manifest_csv_has_nulls_for_empty_cells(spark, tmp_path):
    (tmp_path / "m.csv").write_text("tile,strip,x,y,lat,lon,mean_intensity,width,height,quality\na_0_0,a,0,0,,,1.5,640,640,\n")
    r = files.manifest(spark, str(tmp_path / "m.csv")).first()
    assert (r["tile"], r["x"], r["lat"], r["quality"], r["mean_intensity"]) == ("a_0_0", 0, None, None, 1.5)


def test_control_points_by_alias(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Image,PX,Row,LAT,lng\ns1,1,2,10,79\ns1,3,1,11,80\ns2,1,1,95,80\n")
    got = files.control_points(spark, str(tmp_path / "c.csv")).collect()
    assert [(r["strip"], len(r["points"]), r["points"][0]["pixel_y"]) for r in got] == [("s1", 2, 1.0)]


def test_sidecars_of_one_format(spark, tmp_path):
    row = {"row": 0, "lat": 1.0, "lon": 2.0, "quality": "ok"}
    (tmp_path / "a.json").write_text(json.dumps({"format": "nav-1", "strip": "a", "width": 5, "height": 2, "rows": [row, {**row, "row": 1, "lat": None}]}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"format": "other", "strip": "b", "rows": [row]}))
    got = files.nav_sidecars(spark, str(tmp_path)).orderBy("row").collect()
    assert [(r["strip"], r["row"], r["lat"]) for r in got] == [("a", 0, 1.0), ("a", 1, None)]


def test_surveys_skip_what_cannot_be_read(spark, tmp_path):
    for name, text in (("one", json.dumps({"detections": [{"id": "d", "confidence": 0.5}]})), ("two", "{broken")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "export.json").write_text(text)
    got = files.surveys(spark, str(tmp_path / "*" / "export.json")).collect()
    assert [(r["survey_id"], len(r["detections"])) for r in got] == [("one", 1)]


def test_features(spark, tmp_path):
    shape = {"type": "Polygon", "coordinates": [[[1, 2], [3, 4], [1, 2]]]}
    (tmp_path / "reef.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "r"}, "geometry": shape}]}))
    r = files.features(spark, str(tmp_path / "reef.geojson")).first()
    assert (r["layer"], r["kind"], r["name"], r["geom_type"], [(p["lon"], p["lat"]) for p in r["points"]]) == ("reef", "reef", "r", "Polygon", [(1, 2), (3, 4), (1, 2)])


def test_corpus_needs_front_matter(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: One: two\nid: 7\n---\nBody here.\n")
    (tmp_path / "b.md").write_text("no front matter")
    got = files.corpus(spark, str(tmp_path)).collect()
    assert [(r["path"], r["meta"], r["body"]) for r in got] == [("a.md", {"title": "One: two", "id": "7"}, "Body here.\n")]


def test_job_log_leaves_a_partial_line(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"job_id":"j","seq":0,"type":"start"}\n{"job_id":"j","seq":1,"ty')
    assert [r["type"] for r in files.job_log(spark, str(tmp_path)).collect()] == ["start"]


def test_xtf_finds_its_way_after_a_broken_packet(spark, tmp_path):
    def packet(lat, lon, samples):
        body = bytearray(256 + 64 + 2 * len(samples))
        struct.pack_into("<HBBH", body, 0, 0xFACE, 0, 0, 1)
        struct.pack_into("<I", body, 10, len(body))
        struct.pack_into("<H6B", body, 14, 2024, 5, 6, 7, 8, 9, 50)
        struct.pack_into("<dd", body, 160, lat, lon)
        struct.pack_into("<I", body, 256 + 42, len(samples))
        struct.pack_into(f"<{len(samples)}H", body, 320, *samples)
        return bytes(body)

    (tmp_path / "x.xtf").write_bytes(bytes(1024) + packet(1.5, 2.5, [1, 2, 3]) + b"junk" + packet(0.0, 0.0, [9]))
    got = files.xtf(spark, str(tmp_path / "x.xtf")).orderBy("ping").collect()
    assert [(r["ping"], r["lat"], r["samples"]) for r in got] == [(0, 1.5, [1, 2, 3]), (1, None, [9])]
    assert got[0]["t"] == 1714979289.5


def test_reports_and_geojson(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.5, 1.0, 2.0), ("b", 0.9, None, None)], "id string, severity double, latitude double, longitude double")
    files.write_geojson(rows, str(tmp_path / "g"))
    files.write_report(rows, str(tmp_path / "r"), most=1)
    feature = json.loads(spark.read.text(str(tmp_path / "g" / "features")).first()["value"])
    assert feature["geometry"]["coordinates"] == [2.0, 1.0] and feature["properties"]["id"] == "a"
    assert spark.read.json(str(tmp_path / "g" / "summary")).first().asDict() == {"located": 1, "unlocated": 1}
    assert [r["id"] for r in spark.read.csv(str(tmp_path / "r"), header=True).collect()] == ["b"]


def test_drift_of_a_slack_field_is_the_random_walk_alone(spark):
    targets = spark.createDataFrame([(k, 10.0, 79.0, 0.0, 0.0) for k in range(6)], "target long, lat double, lon double, u double, v double")
    one, many = (particles.particles(targets.repartition(n), 6.0, 1.0, n=400, diffusion=2.0) for n in (1, 5))
    a, b = (sorted(map(tuple, f.collect())) for f in (one, many))
    assert a == b
    d = drift.displacement(one).filter("hours = 6 AND target = 0").first()
    # the distance of a plane random walk has the median sqrt(2 ln 2 * 2 K t)
    assert d["median_m"] == pytest.approx((2 * 0.693147 * 2 * 2.0 * 6 * 3600) ** 0.5, rel=0.12)
    assert drift.region(one.filter("hours = 0"), 0.9, 0.01).count() == 6

"""Cues of boxes on strips of known make."""

from __future__ import annotations

import numpy as np
import pytest

from fathomline.operators import cues
from fathomline.operators.cues import Levels

SHARP = Levels(smooth=1)


def strip(rng, rows=60, cols=120, level=100.0, speckle=0.1):
    return level * rng.uniform(1 - speckle, 1 + speckle, (rows, cols))


def frame(spark, images):
    return spark.createDataFrame([(s, k, row.tolist()) for s, x in images.items() for k, row in enumerate(x) if not np.isnan(row).all()], "strip string, place long, x array<double>")


def boxes(spark, rows):
    return spark.createDataFrame(rows, "strip string, id long, x1 long, y1 long, x2 long, y2 long, nadir double")


def cue(spark, images, rows, pad=20, block=16, **more):
    found = cues.patches(boxes(spark, rows), frame(spark, images), "strip", "id", "place", "x", pad, block)
    return {r["id"]: r for r in cues.measured(found, pad, "nadir", **more).collect()}


@pytest.mark.parametrize("side", [1, -1])
def test_shadow_behind_an_object_has_its_length(spark, side):
    x = strip(np.random.default_rng(1))
    x[25:35, 50:60] = 220
    x[25:35, slice(60, 74) if side > 0 else slice(36, 50)] = 5
    nadir = 10.0 if side > 0 else 110.0
    got = cue(spark, {"a": x}, [("a", 1, 50, 25, 60, 35, nadir), ("a", 2, 90, 5, 100, 15, nadir), ("a", 3, 50, 25, 60, 35, None)], levels=SHARP)
    assert got[1]["shadow_px"] == 14 and got[1]["edge_px"] == (60 if side > 0 else 50) and got[1]["side"] == side
    assert got[1]["shadow_score"] == 1 and abs(got[1]["seabed"] - 100) < 3 and got[1]["sharpness"] > 0.3
    assert got[2]["shadow_px"] == 0 and got[2]["shadow_score"] == 0 and got[2]["edge_px"] is None
    assert got[3]["side"] == side and got[3]["shadow_px"] == 14


def test_blocks_leave_no_trace(spark):
    x = strip(np.random.default_rng(2))
    x[25:35, 60:70] = 5
    rows = [("a", k, 20 + 5 * k, 2 + 6 * k, 28 + 5 * k, 9 + 6 * k, 3.0) for k in range(9)]
    assert cue(spark, {"a": x}, rows, block=7) == cue(spark, {"a": x}, rows, block=512)


def test_shadow_runs_by_steps():
    rng = np.random.default_rng(3)
    for _ in range(50):
        dark = rng.random((6, int(rng.integers(1, 20)))) < 0.6
        want = []
        for row in dark:
            run = light = at = 0
            for v in row:
                at += 1
                light = 0 if v else light + 1
                run = at if v else run
                if light == 3:
                    break
            want.append(run)
        assert cues.dark_runs(dark, 3).tolist() == want


def test_nets_are_told_from_ripples_and_speckle():
    y, x = np.mgrid[0:64, 0:64]
    rng = np.random.default_rng(4)
    net = 100 + 40 * (np.cos(x * 2 * np.pi / 8) + np.cos(y * 2 * np.pi / 8)) + rng.normal(0, 5, x.shape)
    ripples = 100 + 60 * np.cos(x * 2 * np.pi / 8) + rng.normal(0, 5, x.shape)
    of = lambda v: cues.mesh(v, 100.0, 4, 0.05)
    assert of(net) > 0.5 and of(ripples) < 0.2 and of(rng.normal(100, 20, x.shape)) < 0.2 and of(np.full((64, 64), 9.0)) == 0 and of(net[:12, :12]) == 0


def test_coherence_of_one_direction():
    y, x = np.mgrid[0:40, 0:40].astype(float)
    assert cues.coherence(np.sin((x + 2 * y) / 4)) == pytest.approx(1, abs=0.05)
    assert cues.coherence(np.random.default_rng(5).normal(size=(40, 40))) < 0.2
    assert np.isnan(cues.coherence(np.ones((5, 5)))) and np.isnan(cues.coherence(np.ones((1, 9))))


def test_blank_and_missing_rows_count_as_such_only(spark):
    x = strip(np.random.default_rng(6))
    want = cue(spark, {"a": x}, [("a", 1, 50, 20, 60, 40, 10.0)], levels=SHARP)[1]
    x[22:25] = 0
    x[30:32] = np.nan
    got = cue(spark, {"a": x}, [("a", 1, 50, 20, 60, 40, 10.0)], levels=SHARP)[1]
    assert got["missing_rows"] == 0.25 and want["missing_rows"] == 0 and got["shadow_excess"] == pytest.approx(0, abs=0.01) and abs(got["seabed"] - want["seabed"]) < 2


def test_borders_and_odd_boxes(spark):
    x = strip(np.random.default_rng(7), 30, 40)
    rows = [("a", 1, 0, 0, 5, 5, 20.0), ("a", 2, 35, 25, 60, 60, 20.0), ("a", 3, 5, 5, 5, 9, None), ("b", 4, 1, 1, 9, 9, None), ("a", 5, None, 1, 2, 3, None), ("a", 6, 500, 3, 510, 9, 1.0)]
    got = cue(spark, {"a": x}, rows, levels=SHARP)
    assert set(got) == {1, 2, 6} and got[1]["side"] == -1 and got[1]["seabed"] is not None and got[6]["seabed"] is None
    assert cue(spark, {"a": x[:0]}, rows) == {}

"""Altitude, slant-range correction, gain and speckle on pings of known make."""

from __future__ import annotations

import numpy as np
import pytest

from fathomline.operators import strips

PINGS = "strip string, place long, altitude_m double, port_samples array<double>, port_r0_m double, port_dr_m double, starboard_samples array<double>, starboard_r0_m double, starboard_dr_m double"


def ping(altitude, n=400, dr=0.1, level=100.0, noise=None):
    """Quiet water, then a bottom that answers from the altitude on."""
    r = np.arange(n) * dr
    x = np.where(r >= altitude, level, 2.0)
    return (x if noise is None else x * noise).tolist()


def frame(spark, rows):
    return spark.createDataFrame([(s, k, h, a, 0.0, 0.1, b, 0.0, 0.1) for s, k, h, a, b in rows], PINGS)


def test_flat_bottom_is_found_at_its_altitude(spark):
    rng = np.random.default_rng(1)
    rows = [("a", k, None, ping(8.0, noise=rng.uniform(0.8, 1.2, 400)), ping(8.0, noise=rng.uniform(0.8, 1.2, 400))) for k in range(40)]
    got = strips.bottom_returns(frame(spark, rows)).collect()
    assert all(abs(r["port_track_m"] - 8.0) < 0.15 and abs(r["starboard_track_m"] - 8.0) < 0.15 for r in got)


def test_no_return_without_rise_or_samples(spark):
    rows = [("a", 0, None, [5.0] * 50, []), ("a", 1, None, None, ping(0.2))]
    a, b = strips.bottom_returns(frame(spark, rows)).orderBy("place").collect()
    assert [a["port_track_m"], a["starboard_track_m"], b["port_track_m"], b["starboard_track_m"]] == [None] * 4


def test_altitude_sources(spark):
    good = ping(10.0)
    rows = [("a", k, 10.2, good, good) for k in range(12)]
    rows[3] = ("a", 3, 10.2, None, None)  # the header counts
    rows[5] = ("a", 5, None, None, None)  # the median counts
    rows[7] = ("a", 7, None, ping(4.0), good)  # a shoal over one side: the later return
    rows[9] = ("a", 9, 10.2, ping(3.0), ping(3.0))  # both sides off: the median
    rows += [("b", k, 20.0, ping(5.0), ping(5.0)) for k in range(5)] + [("c", 0, None, None, None)]
    got = {(r["strip"], r["place"]): (r["altitude"], r["altitude_source"]) for r in strips.altitudes(strips.bottom_returns(frame(spark, rows)), ["strip"], "place").collect()}
    assert len(got) == len(rows)
    assert got["a", 0] == (pytest.approx(10.0, abs=0.1), "bottom track") and got["a", 3] == (10.2, "header") and got["a", 5][1] == "bottom track, interpolated" and got["a", 5][0] == pytest.approx(10.0, abs=0.1)
    assert got["a", 7][0] == pytest.approx(10.0, abs=0.1) and got["a", 9] == (pytest.approx(10.0, abs=0.1), "bottom track")
    assert got["b", 2] == (20.0, "header, track rejected") and got["c", 0] == (None, "none")


def test_blocks_leave_no_trace_in_medians(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [("a", k, None, ping(a), ping(a)) for k, a in enumerate(10 + rng.normal(0, 1.5, 90))]
    tracked = strips.bottom_returns(frame(spark, rows)).persist()
    whole = {r["place"]: r["altitude"] for r in strips.altitudes(tracked, ["strip"], "place").collect()}
    halo = strips.with_halo
    monkeypatch.setattr(strips, "with_halo", lambda rows, place, reach, size=512: halo(rows, place, reach, 16))
    assert {r["place"]: r["altitude"] for r in strips.altitudes(tracked, ["strip"], "place").collect()} == whole
    tracked.unpersist()


def test_ground_ranges_of_a_ramp_are_exact(spark):
    ramp = [float(k) for k in range(500)]
    df = frame(spark, [("a", 0, None, ramp, ramp[:101])]).selectExpr("*", "6.0D AS altitude")
    r = strips.ground_ranged(df, 0.5, 120).first()
    ground = (np.arange(120) + 0.5) * 0.5
    want = np.sqrt(ground**2 + 36) / 0.1
    assert [v is None for v in r["port_ground"]] == (want > 499).tolist()
    assert [v for v in r["port_ground"] if v is not None] == pytest.approx(want[want <= 499].tolist())
    assert [v for v in r["starboard_ground"] if v is not None] == pytest.approx(want[want <= 100].tolist())
    nothing = strips.ground_ranged(df.selectExpr("* EXCEPT (altitude)", "CAST(NULL AS DOUBLE) AS altitude"), 0.5, 4).first()
    assert nothing["port_ground"] == [None] * 4


def test_gain_is_divided_out(spark):
    beam = np.exp(-np.arange(30) / 10) * 50
    rows = [("a", k, (8.0 if k % 2 else 12.0), (beam * (1 if k % 2 else 3)).tolist()) for k in range(80)] + [("b", 0, 5.0, [None] * 30), ("b", 1, None, [1.0] * 30)]
    df = spark.createDataFrame(rows, "strip string, place long, altitude double, port_ground array<double>").repartition(3)
    got = strips.levelled(df, ["strip"], "port_ground").collect()
    assert len(got) == len(rows)
    for r in got:
        want = [1.0] * 30 if r["strip"] == "a" else [None] * 30
        assert r["port_ground"] == (pytest.approx(want) if r["strip"] == "a" else want)


def brute_lee(x, size, noise=None):
    left, right = size // 2, size - 1 - size // 2
    wide = np.pad(x, ((left, right), (left, right)), mode="symmetric")
    mean, var = np.full(x.shape, np.nan), np.full(x.shape, np.nan)
    for i in range(x.shape[0]):
        for j in range(x.shape[1]):
            w = wide[i : i + size, j : j + size]
            w = w[np.isfinite(w)]
            if len(w):
                mean[i, j], var[i, j] = w.mean(), w.var()
    good = np.isfinite(x) & (mean > 1e-12)
    cu2 = np.median(var[good] / mean[good] ** 2) if noise is None else noise
    k = np.clip((var - cu2 * mean**2) / np.where(var > 0, var, np.inf), 0, 1)
    return np.where(good, mean + k * (x - mean), x)


@pytest.mark.parametrize("size", [2, 5])
def test_lee_equals_brute_force_across_blocks(spark, size):
    rng = np.random.default_rng(3)
    images = {s: rng.gamma(4, 10, (n, 23)) for s, n in (("a", 61), ("b", 1), ("c", 16), ("d", 17))}
    images["a"][20:24, 5:9] = np.nan
    rows = [(s, k, [None if v != v else float(v) for v in row], "x") for s, x in images.items() for k, row in enumerate(x)]
    df = spark.createDataFrame(rows, "strip string, place long, v array<double>, other string")
    for noise in (0.05, None):
        got = strips.lee(df, ["strip"], "place", "v", size, noise, block=16).collect()
        assert len(got) == len(rows)
        for s, x in images.items():
            mine = np.array([r["v"] for r in sorted((r for r in got if r["strip"] == s), key=lambda r: r["place"])], dtype=np.float64)
            np.testing.assert_allclose(mine, brute_lee(x, size, noise), rtol=1e-9 if noise else 2e-2)

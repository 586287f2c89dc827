"""Calibration fits against fine searches."""

from __future__ import annotations

import numpy as np
import pytest

from fathomline.operators import calibration


def loss(z, y):
    return np.mean(np.logaddexp(0, -z) * y + np.logaddexp(0, z) * (1 - y))


@pytest.fixture(scope="module")
def cases():
    rng = np.random.default_rng(6)
    out = {}
    for name, a, b, n in (("flat", 0.4, 0.0, 1500), ("steep", 2.5, -1.0, 800), ("shifted", 1.0, 2.0, 600)):
        p = rng.uniform(0.001, 0.999, n)
        z = np.log(p / (1 - p))
        out[name] = (p, (rng.uniform(size=n) < 1 / (1 + np.exp(-(a * z + b)))).astype(float), np.arange(n) % 5)
    out["one label"] = (np.full(30, 0.7), np.ones(30), np.arange(30) % 5)
    return out


@pytest.fixture(scope="module")
def rows(spark, cases):
    flat = [(k, float(p), int(y), int(f)) for k, (ps, ys, fs) in cases.items() for p, y, f in zip(ps, ys, fs, strict=True)] + [("flat", None, 1, 0), ("flat", 0.5, None, 0)]
    return spark.createDataFrame(flat, "model string, score double, label int, fold int")


def test_fits_are_as_good_as_a_fine_grid(rows, cases):
    got = {(r["model"], r["method"], r["held_out"]): r for r in calibration.fits(rows, ["model"], "score", "label", "fold").collect()}
    assert len(got) == 4 * 2 * 6
    for name, (p, y, f) in cases.items():
        for held in (-1, 3):
            use = f != held
            z, t = np.log(p[use] / (1 - p[use])), y[use]
            r = got[name, "temperature", held]
            assert r["n"] == use.sum()
            grid = min(loss(z * a, t) for a in np.geomspace(0.05, 20, 4000))
            assert loss(z * r["a"], t) <= grid + 1e-6 and r["b"] == 0 and r["loss"] == pytest.approx(loss(z * r["a"], t))
            r = got[name, "platt", held]
            if name == "one label":
                assert r["loss"] < 0.01
                continue
            grid = min(loss(z * (r["a"] + da) + r["b"] + db, t) for da in np.linspace(-0.5, 0.5, 41) for db in np.linspace(-0.5, 0.5, 41))
            assert loss(z * r["a"] + r["b"], t) <= grid + 1e-6


def test_the_method_is_chosen_by_held_out_loss(rows, cases):
    got = {r["model"]: r for r in calibration.chosen(rows, ["model"], "score", "label", "fold").collect()}
    assert got["flat"]["method"] == "temperature" and got["shifted"]["method"] == "platt" and got["steep"]["method"] == "platt"
    assert got["flat"]["n"] == 1500 and got["flat"]["positives"] == cases["flat"][1].sum() and got["flat"]["temperature"] == pytest.approx(2.5, rel=0.15)
    assert got["shifted"]["cv_platt"] < got["shifted"]["cv_temperature"] < got["shifted"]["cv_identity"] + 0.01
    assert calibration.chosen(rows.filter("false"), ["model"], "score", "label", "fold").count() == 0

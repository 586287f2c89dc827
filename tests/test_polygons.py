"""Areas in closed form, against a fine raster, and where slabs cut."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.operators import polygons as pg

SHAPE = f"g string, layer string, polygon string, rings {pg.RINGS}"


def rings(*rs):
    return [[{"x": float(x), "y": float(y)} for x, y in r] for r in rs]


def rect(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def found(frame, width):
    return {(r["g"], tuple(r["layers"])): r["area"] for r in pg.areas(frame, ["g"], width).collect()}


@pytest.mark.parametrize("width", [0.7, 3.0, 1000.0])
def test_union_difference_and_hole(spark, width):
    rows = [
        ("a", "swath", "1", rings(rect(0, 0, 10, 4))), ("a", "swath", "2", rings(rect(5, 2, 15, 6))), ("a", "swath", "2b", rings(rect(5, 2, 15, 6))), ("a", "nadir", "1", rings(rect(0, 1, 15, 3))),
        ("b", "reef", "1", rings(rect(-5, -5, 5, 5), rect(-1, -1, 1, 1))), ("b", "reef", "2", rings([(10, 0), (12, 0), (11, 1)])), ("b", "reef", "3", None), ("b", "reef", "4", rings([(0, 0), (1, 1)])), ("b", None, "5", rings(rect(0, 0, 9, 9))),
    ]
    got = found(spark.createDataFrame(rows, SHAPE), width)
    swath = 40 + 40 - 10
    both = 10 * 2 + 10 * 1 - 5 * 1
    assert got["a", ("swath",)] == pytest.approx(swath - both) and got["a", ("nadir", "swath")] == pytest.approx(both) and got["a", ("nadir",)] == pytest.approx(30 - both)
    assert got["b", ("reef",)] == pytest.approx(96 + 1) and len(got) == 4


def test_crossing_edges(spark):
    star = [(math.cos(k * 4 * math.pi / 5), math.sin(k * 4 * math.pi / 5)) for k in range(5)]  # crosses itself: the even-odd rule leaves its middle out
    diamond = [(0, -2), (2, 0), (0, 2), (-2, 0)]
    rows = [("s", "star", "1", rings(star)), ("d", "a", "1", rings(rect(-1.5, -1.5, 1.5, 1.5))), ("d", "b", "1", rings(diamond))]
    got = found(spark.createDataFrame(rows, SHAPE), 0.31)
    assert got["d", ("a", "b")] == pytest.approx(9 - 4 * 0.5) and got["d", ("b",)] == pytest.approx(8 - 7)
    n = 1500
    g = (np.arange(n) + 0.5) / n * 2.2 - 1.1
    x, y = np.meshgrid(g, g)
    inside = np.zeros(x.shape, dtype=bool)
    for (ax, ay), (bx, by) in zip(star, star[1:] + star[:1], strict=True):
        inside ^= ((ax <= x) != (bx <= x)) & (ay + (by - ay) * (x - ax) / (bx - ax) > y)
    assert got["s", ("star",)] == pytest.approx(inside.mean() * 2.2**2, rel=2e-3)


def test_random_polygons_against_a_raster(spark):
    rng = np.random.default_rng(4)
    rows, n = [], 1200
    g = (np.arange(n) + 0.5) / n * 10
    x, y = np.meshgrid(g, g)
    cover = {"p": np.zeros(x.shape, dtype=bool), "q": np.zeros(x.shape, dtype=bool)}
    for k in range(24):
        t = np.sort(rng.uniform(0, 2 * np.pi, 7))
        c, r = rng.uniform(2, 8, 2), rng.uniform(0.5, 1.9, 7)
        ring = [(c[0] + a * math.cos(b), c[1] + a * math.sin(b)) for a, b in zip(r, t, strict=True)]
        rows.append(("g", "pq"[k % 2], str(k), rings(ring)))
        inside = np.zeros(x.shape, dtype=bool)
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            inside ^= ((ax <= x) != (bx <= x)) & (ay + (by - ay) * (x - ax) / (bx - ax) > y)
        cover["pq"[k % 2]] |= inside
    frame = spark.createDataFrame(rows, SHAPE)
    one, many = found(frame, 100.0), found(frame, 0.37)
    want = {("p",): cover["p"] & ~cover["q"], ("q",): cover["q"] & ~cover["p"], ("p", "q"): cover["p"] & cover["q"]}
    for layers, mask in want.items():
        assert many["g", layers] == pytest.approx(one["g", layers], rel=1e-9) and one["g", layers] == pytest.approx(mask.mean() * 100, rel=5e-3)


def test_buffer_of_square_line_and_point(spark):
    round_ = 16 * math.sin(2 * math.pi / 32)  # a polygon of 32 corners on the unit circle
    square = spark.createDataFrame([("s", "l", "1", rings(rect(0, 0, 10, 10)))], SHAPE)
    line = spark.createDataFrame([("l", "l", "1", rings([(0, 0), (20, 0)])), ("p", "l", "1", rings([(3, 3)]))], SHAPE)
    assert found(pg.buffered(square, F.lit(2.0)), 3.0) == {("s", ("l",)): pytest.approx(100 + 80 + 4 * round_)}
    got = found(pg.buffered(line, F.lit(1.0), closed=False), 3.0)
    assert got == {("l", ("l",)): pytest.approx(40 + round_), ("p", ("l",)): pytest.approx(round_)}


def test_straight_survey_with_a_dropout(spark):
    """200 m of swath 2 x 45 m wide with a blind strip of 2 x 1.5 m; 10 m of it lost."""
    rows = []
    for k in range(20):
        a, b = 10 * k, 10 * k + 10
        if k == 9:
            rows.append(("s", "lost", str(k), rings(rect(a, -45, b, 45))))
            continue
        rows += [("s", "imaged", f"{k}p", rings(rect(a, -45, b, -1.5))), ("s", "imaged", f"{k}s", rings(rect(a, 1.5, b, 45))), ("s", "nadir", str(k), rings(rect(a, -1.5, b, 1.5)))]
    sets = pg.areas(spark.createDataFrame(rows, SHAPE), ["g"], 25.0)
    has = lambda name: F.array_contains("layers", name)
    r = sets.groupBy("g").agg(pg.area_where(has("imaged")).alias("imaged"), pg.area_where(has("nadir") & ~has("imaged")).alias("blind"), pg.area_where(has("lost") & ~has("imaged")).alias("gap")).first()
    assert (r["imaged"], r["blind"], r["gap"]) == (pytest.approx(190 * 87), pytest.approx(190 * 3), pytest.approx(900))


def test_points_in_polygons_with_holes(spark):
    shape = spark.createDataFrame([("a", "l", "1", rings(rect(0, 0, 10, 10), rect(4, 4, 6, 6)))], SHAPE)
    points = spark.createDataFrame([(1.0, 1.0), (5.0, 5.0), (11.0, 5.0), (3.0, 5.0)], "px double, py double")
    got = points.crossJoin(shape).select("px", pg.contains(F.col("px"), F.col("py"), F.col("rings")).alias("inside")).collect()
    assert {(r["px"], r["inside"]) for r in got} == {(1.0, True), (5.0, False), (11.0, False), (3.0, True)}


def test_nothing(spark):
    assert pg.areas(spark.createDataFrame([], SHAPE), ["g"], 1.0).count() == 0


@pytest.mark.parametrize("layers", [3, 12])
def test_dense_boxes_are_counted_in_cells(monkeypatch, layers):
    rng = np.random.default_rng(8)
    n, side = 3000, 48
    x0, y0 = rng.integers(0, side, n), rng.integers(0, side, n)
    x1, y1 = np.minimum(x0 + rng.integers(1, 9, n), side), y0 + rng.integers(0, 9, n)
    layer, both = rng.integers(0, layers, n), lambda a, b: np.concatenate([a, b]).astype(float)
    slab = (np.tile(layer, 2), layers, np.tile(np.arange(n), 2), both(x0, x0), both(y0, y1), both(x1, x1), both(y0, y1))
    raster = np.zeros((side + 1, side + 10), dtype=np.int64)
    for a, b, c, d, bit in zip(x0, x1, y0, y1, layer, strict=True):
        raster[a:b, c:d] |= 1 << int(bit)
    want = {c: float(k) for c, k in zip(*(v.tolist() for v in np.unique(raster, return_counts=True)), strict=True) if c}
    swept = {}
    for covers, xa, xb, low, _, high, _ in pg.sweep(*slab):
        pg.summed(covers, (xb - xa) * (high - low), swept)
    assert swept == want
    for pairs in (pg.PAIRS, 200):
        monkeypatch.setattr(pg, "PAIRS", pairs)
        monkeypatch.setattr(pg, "sweep", None)  # no pair of a box and an interval is made
        assert pg.covered(*slab) == want


def test_a_ring_of_boxes_beside_others_is_swept(spark):
    rows = [("a", "l", "1", rings(rect(0, 0, 10, 10), rect(4, 4, 6, 6))), ("a", "l", None, rings(rect(5, 0, 20, 1))), ("a", "m", "1", rings(rect(0, 0, 10, 10)))]
    got = found(spark.createDataFrame(rows, SHAPE), 100.0)
    assert got == {("a", ("l", "m")): 96.0, ("a", ("l",)): 10.0, ("a", ("m",)): 4.0}

"""Queries without SQL over whole tables, against brute force."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathomline.operators import sequential
from fathomline.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def test_matching_equals_greedy_over_all_pairs(spark):
    pairs = [(r["id_a"], r["id_b"], r["iou"]) for r in registry.QUERIES["j22_iou_pairs"](spark, SF).collect()]
    used_a, used_b, want = set(), set(), set()
    for a, b, iou in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            want.add((a, b, iou))
    got = [tuple(r) for r in registry.QUERIES["d05_j26_greedy_match"](spark, SF).select("a", "b", "iou").collect()]
    assert set(got) == want and len(got) == len(want) > 0


def routed_by_the_book(pdf):
    """Every target a point of its own, all distances in a matrix, moves tried one by one."""
    pdf = pdf.sort_values(["tier_rank", "id"], kind="stable").reset_index(drop=True)
    xy = pdf[["x", "y"]].to_numpy(float)
    d = np.hypot(xy[:, None, 0] - xy[None, :, 0], xy[:, None, 1] - xy[None, :, 1])
    path = []
    for tier in pdf["tier_rank"].unique():
        left = pdf.index[pdf["tier_rank"] == tier].tolist()
        part = [] if path else [left.pop(0)]
        while left:
            at = (part or path)[-1]
            left.sort(key=lambda k: (d[at, k], k))
            part.append(left.pop(0))
        better = True
        while better:
            better = False
            for i in range(len(part) - 1):
                for j in range(i + 1, len(part)):
                    before = part[i - 1] if i else (path[-1] if path else None)
                    after = part[j + 1] if j + 1 < len(part) else None
                    gain = (0 if before is None else d[before, part[i]] - d[before, part[j]]) + (0 if after is None else d[part[j], after] - d[part[i], after])
                    if gain > 1e-9:
                        part[i : j + 1] = part[i : j + 1][::-1]
                        better = True
        path += part
    return {pdf["id"][k]: n for n, k in enumerate(path, 1)}


def test_routes_equal_the_plain_algorithm(spark):
    rng = np.random.default_rng(22)
    pdf = pd.DataFrame({"survey": np.repeat([1, 2, 3, 4], (90, 60, 1, 40)), "id": rng.permutation(191), "tier_rank": rng.integers(0, 3, 191), "x": rng.integers(0, 12, 191), "y": rng.integers(0, 12, 191)})
    pdf.loc[pdf.survey == 2, ["x", "y"]] = rng.integers(0, 500, (60, 2))
    got = sequential.routes(spark.createDataFrame(pdf), ["survey"]).toPandas()
    for survey, rows in pdf.groupby("survey"):
        assert got[got.survey == survey].set_index("id")["step"].to_dict() == routed_by_the_book(rows)


def test_routes_visit_every_target(spark):
    got = registry.QUERIES["d07_routes"](spark, SF).toPandas()
    assert sorted(got["id"]) == sorted(r[0] for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey").collect())
    assert all(sorted(g["step"]) == list(range(1, len(g) + 1)) for _, g in got.groupby("survey"))


@pytest.mark.parametrize("name", ["d08_a28_displacement", "d10_likely_region"])
def test_drift_covers_every_supplier(spark, name):
    sf = SF.replace("0.001", "0.01")
    got = {r[0] for r in registry.QUERIES[name](spark, sf).select("target").distinct().collect()}
    assert got == {r[0] for r in spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey").collect()} and len(got) > 19


def crowded():
    rng = np.random.default_rng(23)
    pdf = pd.DataFrame({"strip": rng.integers(0, 3, 900), "id": rng.permutation(900), "model": rng.integers(0, 3, 900), "score": rng.integers(0, 40, 900) / 40, "x": rng.integers(0, 9, 900) * 10.0, "y": rng.integers(0, 9, 900) * 10.0})
    return pdf.assign(x1=pdf["x"], y1=pdf["y"], x2=pdf["x"] + 20 * (pdf["id"] % 7 > 0), y2=pdf["y"] + 20.0)


def in_order(pdf):
    for _, g in pdf.groupby("strip"):
        yield list(g.sort_values(["score", "id"], ascending=[False, True]).itertuples(index=False))


def by_streams(frame):
    """Groups stream through tasks in Spark's order; none is a frame of its own, which took most of the time where groups are small."""
    return "FlatMapGroupsInPandas" not in frame._jdf.queryExecution().executedPlan().toString()


def test_clusters_equal_the_plain_algorithm(spark):
    want = {}
    for rows in in_order(crowded()):
        reps = []
        for r in rows:
            near = min(((np.hypot(a.x - r.x, a.y - r.y), k) for k, a in enumerate(reps)), default=(np.inf, 0))
            want[r.id] = reps[near[1]].id if near[0] <= 25 else r.id
            if near[0] > 25:
                reps.append(r)
    found = sequential.clusters(spark.createDataFrame(crowded()), ["strip"], 25.0)
    assert by_streams(found) and dict(found.select("id", "rep").collect()) == want


@pytest.mark.parametrize("across", [True, False])
def test_merged_boxes_equal_the_plain_algorithm(spark, across):
    def iou(a, b):
        w, h = max(min(a.x2, b.x2) - max(a.x1, b.x1), 0), max(min(a.y2, b.y2) - max(a.y1, b.y1), 0)
        union = (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - w * h
        return w * h / union if union else 0

    want = {}
    for rows in in_order(crowded()):
        kept = []
        for r in rows:
            into = next((k for k in kept if iou(k, r) >= 0.3 and not (across and k.model == r.model)), None)
            want[r.id] = into.id if into else r.id
            if not into:
                kept.append(r)
    found = sequential.merged_boxes(spark.createDataFrame(crowded()), ["strip"], 0.3, across)
    assert by_streams(found) and dict(found.select("id", "kept_by").collect()) == want


def test_a_task_of_routes_holds_places_not_targets(spark):
    pdf = pd.DataFrame({"survey": 1, "id": range(3000), "tier_rank": 0, "x": [i % 3 for i in range(3000)], "y": 0})
    found = sequential.routes(spark.createDataFrame(pdf), ["survey"])
    # what goes to Python are sums by place
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("FlatMapGroupsInPandas") :]
    want = routed_by_the_book(pdf)
    assert {r["id"]: r["step"] for r in found.collect()} == want


def test_matching_of_boxes_equals_all_pairs_and_makes_few(spark, monkeypatch):
    rng = np.random.default_rng(26)
    n = 260
    x, y = rng.integers(0, 30, (2, n))
    boxes = pd.DataFrame({"g": rng.integers(0, 3, n), "id": rng.permutation(n), "model": rng.choice(["a", "b", "c"], n), "x1": x, "y1": y, "x2": x + rng.choice([10, 12, 20], n), "y2": y + rng.choice([10, 12, 20], n)})
    boxes.loc[:59, ["x1", "y1", "x2", "y2"]] = [3, 4, 13, 14]  # many equal ones
    pairs = boxes.merge(boxes, on="g").query("id_x < id_y and model_x != model_y")
    both = (np.minimum(pairs.x2_x, pairs.x2_y) - np.maximum(pairs.x1_x, pairs.x1_y)).clip(0) * (np.minimum(pairs.y2_x, pairs.y2_y) - np.maximum(pairs.y1_x, pairs.y1_y)).clip(0)
    pairs["exact"] = both / ((pairs.x2_x - pairs.x1_x) * (pairs.y2_x - pairs.y1_x) + (pairs.x2_y - pairs.x1_y) * (pairs.y2_y - pairs.y1_y) - both)
    pairs["iou"] = (pairs.exact * 1e4 + 0.5).astype(int) / 1e4
    used_a, used_b, want = set(), set(), set()
    for a, b, iou in pairs[pairs.exact >= 0.3].sort_values(["iou", "id_x", "id_y"], ascending=[False, True, True])[["id_x", "id_y", "iou"]].itertuples(index=False):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            want.add((a, b, iou))
    odd = [(0, None, "a", 3.0, 4.0, 13.0, 14.0), (0, 1000, None, 3.0, 4.0, 13.0, 14.0), (0, 1001, "b", None, 4.0, 13.0, 14.0)]
    boxes = boxes.astype({c: float for c in ("x1", "y1", "x2", "y2")})
    frame = spark.createDataFrame([*boxes.itertuples(index=False, name=None), *odd], "g long, id long, model string, x1 double, y1 double, x2 double, y2 double")
    got = [tuple(r) for r in sequential.matched_boxes(frame, ["g"], 0.3).select("a", "b", "iou").collect()]
    assert set(got) == want and len(got) == len(want) > 150
    assert sequential.matched_boxes(frame.filter("g > 9"), ["g"], 0.3).count() == 0

    seen, near = [], sequential.near_kinds
    monkeypatch.setattr(sequential, "near_kinds", lambda *v: (seen.append(len(p[0])) or p for p in near(*v)))
    n = 6000
    at = rng.integers(0, 40, (n, 2)).astype(float)
    found = sequential.greedy(np.arange(n), rng.integers(0, 3, n), np.concatenate([at, at + 40], axis=1), 0.3)
    assert len(found) > n / 2 and sum(seen) < n * n / 12, sum(seen)  # over an eighth of all pairs overlap enough, and are of different models


def test_assignment_by_places_is_optimal_and_makes_no_pairs(spark):
    rng = np.random.default_rng(29)
    n = 420
    pdf = pd.DataFrame({"site": rng.integers(0, 4, n), "side": rng.integers(0, 2, n), "id": rng.permutation(n), "x": rng.integers(0, 6, n) * 9, "y": rng.integers(0, 6, n) * 9.5})
    odd = pd.DataFrame({"site": [0, 0, None, 1], "side": [0, 1, 0, 1], "id": [None, 900, 901, 902], "x": [0, None, 0, 0], "y": [0, 0, 0, None]})
    frame = spark.createDataFrame([tuple(None if pd.isna(v) else float(v) for v in r) for r in pd.concat([pdf, odd]).itertuples(index=False)], "site double, side double, id double, x double, y double")
    frame = frame.withColumns({"site": F.col("site").cast("int"), "id": F.col("id").cast("long")}).repartition(5)
    found = sequential.reassigned(frame.filter("side = 0").drop("side"), frame.filter("side = 1").drop("side"), ["site"], 12.0)
    got = found.toPandas()
    pdf = pdf.set_index("id")
    for site, g in pdf.groupby("site"):
        p, q = g[g.side == 0], g[g.side == 1]
        d = np.hypot(p.x.to_numpy()[:, None] - q.x.to_numpy(), p.y.to_numpy()[:, None] - q.y.to_numpy())
        want = sequential.assignment(np.where(d <= 12, d, np.inf))
        mine = got[got.site == site]
        assert len(mine) == len(want) > 20 and mine.cost.sum() == pytest.approx(sum(d[i, j] for i, j in want), abs=1e-2)
    assert got.a.is_unique and got.b.is_unique
    assert np.allclose(got.cost, np.hypot(pdf.loc[got.a, "x"].to_numpy() - pdf.loc[got.b, "x"].to_numpy(), pdf.loc[got.a, "y"].to_numpy() - pdf.loc[got.b, "y"].to_numpy()), atol=1e-4)
    assert list(found.sort("site", "a").toPandas().b) == list(sequential.reassigned(*(frame.repartition(3).filter(f"side = {k}").drop("side") for k in (0, 1)), ["site"], 12.0).sort("site", "a").toPandas().b)
    assert sequential.reassigned(*(frame.filter(f"side = {k} AND site > 9").drop("side") for k in (0, 1)), ["site"], 12.0).count() == 0
    # rows of j13 are sorted and streamed; a join would make every pair of targets within reach a row
    plan = registry.QUERIES["j13_d06_assignment"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "FlatMapGroupsInPandas" not in plan

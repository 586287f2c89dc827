"""Operators against closed forms, brute force and their own batch twins."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathomline.functions import geo, score, text, vector
from fathomline.operators import joins, sequential, triage, windows
from fathomline.streaming import telemetry


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_quarter_of_a_meridian(spark):
    d = one(spark, geo.haversine(F.lit(0.0), F.lit(10.0), F.lit(90.0), F.lit(10.0)).alias("d"))["d"]
    assert d == pytest.approx(geo.EARTH_RADIUS * math.pi / 2)


def test_offset_and_delta_are_inverse(spark):
    lat, lon = geo.offset(F.lit(48.0), F.lit(7.0), F.lit(500.0), F.lit(-300.0))
    east, north = geo.delta(F.lit(48.0), F.lit(7.0), lat, lon)
    r = one(spark, east.alias("e"), north.alias("n"))
    assert (r["e"], r["n"]) == pytest.approx((500.0, -300.0))


def test_bearing_due_east_at_the_equator(spark):
    assert one(spark, geo.bearing(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("b"))["b"] == pytest.approx(90.0)


def test_point_in_ring_and_segment_distance(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))])
    r = one(spark, geo.in_ring(F.lit(1.0), F.lit(1.0), ring).alias("a"), geo.in_ring(F.lit(5.0), F.lit(1.0), ring).alias("b"), geo.segment_distance(F.lit(0.0), F.lit(3.0), F.lit(-1.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("d"))
    assert (r["a"], r["b"], r["d"]) == (True, False, 3.0)


def test_scores(spark):
    low, high = score.wilson(F.lit(0), F.lit(3))
    r = one(spark, low.alias("low"), high.alias("high"), score.sigmoid(score.logit(F.lit(0.3))).alias("p"), score.any_of(F.array(F.lit(0.5), F.lit(0.5))).alias("o"), score.rounded(F.lit(1.005), 2).alias("r"))
    assert r["low"] == pytest.approx(0, abs=1e-12) and r["high"] == pytest.approx(0.5615, abs=1e-4) and r["p"] == pytest.approx(0.3) and r["o"] == 0.75 and r["r"] == 1.01


def test_text(spark):
    r = one(spark, text.class_name(F.lit("  Ghost_Net / Rope ")).alias("c"), text.has_token_run(F.lit("ghost nets old"), F.lit("ghost-net")).alias("h"), text.citations(F.lit("a [2] b [1][2]")).alias("m"), text.numbers(F.lit("1,200 and 3.5")).alias("n"), text.longest_key(F.lit("old ghost net"), ("net", "ghost net")).alias("k"))
    assert (r["c"], r["h"], r["m"], r["n"], r["k"]) == ("ghost-net-rope", True, [1, 2], ["1200", "3.5"], "ghost net")


def test_unit_vectors(spark):
    r = one(spark, vector.unit(F.array(F.lit(3.0), F.lit(4.0))).alias("u"), vector.unit(F.array(F.lit(0.0), F.lit(0.0))).alias("z"), vector.total(vector.centred(F.array(F.lit(1.0), F.lit(2.0), F.lit(6.0)))).alias("s"))
    assert r["u"] == [0.6, 0.8] and r["z"] == [0.0, 0.0] and abs(r["s"]) < 1e-12


def test_near_is_all_pairs_within_the_radius(spark):
    rng = np.random.default_rng(1)
    a = pd.DataFrame({"id": range(60), "lat": rng.uniform(59, 61, 60), "lon": rng.uniform(5, 8, 60)})
    b = pd.DataFrame({"id": range(60), "lat": rng.uniform(59, 61, 60), "lon": rng.uniform(5, 8, 60)})
    got = {(r["id"], r["r_id"]) for r in joins.near(spark.createDataFrame(a), spark.createDataFrame(b), 30000.0).collect()}
    rows = spark.createDataFrame(a).crossJoin(spark.createDataFrame(b.add_prefix("r_"))).filter(geo.haversine(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon")) <= 30000)
    assert got == {(r["id"], r["r_id"]) for r in rows.collect()} and got


def test_asof_takes_the_last_value_and_its_ties(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("b", 10, 1)], "k string, t int, v int")
    back = {(r["k"], r["t"]): r["v"] for r in joins.asof(left, right, ["k"], "t", ["v"]).collect()}
    ahead = {(r["k"], r["t"]): r["v"] for r in joins.asof(left, right, ["k"], "t", ["v"], forward=True).collect()}
    assert back == {("a", 5): 50, ("a", 1): None, ("b", 9): None}
    assert ahead == {("a", 5): 50, ("a", 1): 20, ("b", 9): 1}


@pytest.mark.parametrize(("limit", "ends", "want"), [(1, False, [None, 1.0, 2.0, 3.0, None, None, 9.0, None]), (None, True, [1.0, 1.0, 2.0, 3.0, 5.0, 7.0, 9.0, 9.0])])
def test_gap_filling(spark, limit, ends, want):
    rows = spark.createDataFrame([("s", i, v) for i, v in enumerate([None, 1.0, None, 3.0, None, None, 9.0, None])], "s string, i int, v double")
    assert [r["f"] for r in windows.filled(rows, ["s"], "i", "v", "f", limit, ends).orderBy("i").collect()] == want


def test_speed_gate_starts_anew_after_refusals(spark):
    rows = spark.createDataFrame([("d", t, x) for t, x in [(0, 0.0), (1, 1.0), (2, 50.0), (3, 51.0), (4, 52.0), (5, 3.0)]], "d string, t int, x double")
    got = [r["accepted"] for r in windows.gated(rows, ["d"], ["x"], "t", lambda a, b: F.abs(a["x"] - b["x"]), 2.0, 2).orderBy("t").collect()]
    assert got == [True, True, False, False, True, False]


def test_soft_cap_fills_up_with_what_is_over(spark):
    rows = spark.createDataFrame([("q", g, s) for g, s in (("a", 9), ("a", 8), ("a", 7), ("b", 1))], "q string, g string, s int")
    got = windows.capped_top(rows, ["q"], "g", [F.desc("s")], 1, 3).orderBy("rank").collect()
    assert [(r["g"], r["s"]) for r in got] == [("a", 9), ("b", 1), ("a", 8)]


def test_assignment_is_optimal():
    rng = np.random.default_rng(2)
    for n, m in itertools.product((1, 3, 5), (2, 4, 6)):
        cost = rng.uniform(0, 9, (n, m))
        got = sum(cost[i, j] for i, j in sequential.assignment(cost))
        rows, cols = (range(n), range(m)) if n <= m else (range(m), range(n))
        c = cost if n <= m else cost.T
        assert got == pytest.approx(min(sum(c[i, j] for i, j in zip(rows, p, strict=True)) for p in itertools.permutations(cols, len(rows))))


def test_clusters_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": 1, "id": range(200), "x": rng.uniform(0, 50, 200), "y": rng.uniform(0, 50, 200), "score": rng.integers(0, 5, 200).astype(float)})
    a, b = (sorted(map(tuple, sequential.clusters(spark.createDataFrame(pdf).repartition(n), ["k"], 8.0).select("id", "rep").collect())) for n in (1, 7))
    reps = pdf.set_index("id").loc[sorted({r for _, r in a}), ["x", "y"]].to_numpy()
    assert a == b and min(np.hypot(*(p - q)) for p, q in itertools.combinations(reps, 2)) > 8.0


def test_hull_and_components():
    h = sequential.hull(np.array([(0, 0), (4, 0), (4, 4), (0, 4), (2, 2), (2, 0)], dtype=float))
    assert {tuple(p) for p in h} == {(0, 0), (4, 0), (4, 4), (0, 4)}


def test_plane_fit(spark):
    rows = spark.createDataFrame([("p", float(x), float(y), 2.0 * x - y + 5) for x in range(4) for y in range(3)] + [("line", float(x), 2.0 * x, 1.0) for x in range(5)], "k string, x double, y double, v double")
    got = {r["k"]: r for r in triage.plane_fit(rows, ["k"], "x", "y", "v").collect()}
    assert (got["p"]["a"], got["p"]["b"], got["p"]["c"]) == pytest.approx((2.0, -1.0, 5.0)) and got["line"]["collinear"] and got["line"]["a"] is None


def events(spark):
    kinds = ("signup", "purchase", "click")
    return spark.createDataFrame([(i, i % 5, 1_704_067_200 + (i * 7919) % 5000, kinds[(i * i) % 3 if i % 4 else 0]) for i in range(200)], "id long, device long, t_s long, event string")


def test_recovery_stream_ends_like_the_batch(spark, tmp_path):
    rows = events(spark)
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = telemetry.recovery_stream(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "signup", "purchase")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    seen = []
    q = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: seen.append((n, df.toPandas()))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = pd.concat([p.assign(n=n) for n, p in seen]).sort_values("n").groupby("device").last()
    want = telemetry.recoveries(rows, "signup", "purchase").toPandas().set_index("device").sort_index()
    assert last[["status", "t_s", "events"]].sort_index().equals(want[["status", "t_s", "events"]])


def test_links_are_closed_by_the_next_one(spark):
    rows = spark.createDataFrame([(1, 1, 10, "open"), (2, 1, 20, "open"), (3, 1, 25, "close"), (4, 1, 30, "open")], "id long, device long, t_s long, event string")
    got = [(r["link_id"], r["start"], r["end"]) for r in telemetry.link_intervals(rows, "open", "close").orderBy("link_id").collect()]
    assert got == [(1, 10, 20), (2, 20, 25), (4, 30, None)]


def test_validation_names_the_first_broken_rule(spark):
    rows = spark.createDataFrame([(1_704_067_200, 1.0, 1.0, 5.0, "view"), (5, 1.0, 1.0, 5.0, "view"), (1_704_067_200, 0.0, 0.0, 5.0, "view"), (1_704_067_200, 1.0, 999.0, 5.0, "view"), (None, 1.0, 1.0, 5.0, "view"), (1_704_067_200, 1.0, 1.0, 5.0, "jump")], "t_s long, lat double, lon double, value double, event string")
    got = [r["error"] for r in telemetry.validated(rows, F.lit(1_704_067_300)).collect()]
    assert got == [None, "time before 2000", "no fix", "lon out of range", "time missing", "unknown event"]

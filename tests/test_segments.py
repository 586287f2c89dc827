"""The segment cutter against a plain greedy walk."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from fathomline.operators import segments


def brute(rows, n, step, least, per_key, most):
    chosen = {}
    for key in sorted({r[0] for r in rows}):
        track = sorted((t, ok) for k, t, ok in rows if k == key)
        got, i = [], 0
        while i + n <= len(track):
            t0 = track[i][0]
            if all(track[i + k] == (t0 + k * step, True) for k in range(n)):
                got.append(t0)
                while i < len(track) and track[i][0] < t0 + least:
                    i += 1
            else:
                i += 1
        if len(got) > per_key:
            got = [got[k] for k in sorted({round(j * (len(got) - 1) / (per_key - 1)) for j in range(per_key)})]
        chosen[key] = got
    turns = [(d, k, v[d]) for k, v in chosen.items() for d in range(len(v))]
    return sorted((k, t, d) for d, k, t in sorted(turns)[:most])


def test_segments_equal_the_walk(spark):
    rng = random.Random(8)
    rows = []
    for key in range(12):
        t = 0
        for _ in range(rng.choice([0, 3, 40, 160])):
            t += rng.choice([6, 6, 6, 6, 6, 6, 3, 12])
            rows.append((key, t, rng.random() > 0.03))
    frame = spark.createDataFrame(rows, "id long, t long, ok boolean").repartition(3)
    for n, least, per_key, most in ((4, 30, 5, 1000), (1, 6, 3, 7), (13, 1, 100, 1000)):
        got = segments.segments(frame, ["id"], "t", n, 6, least, per_key, most, F.col("ok"))
        assert sorted(map(tuple, got.select("id", "t", "depth").collect())) == brute(rows, n, 6, least, per_key, most)


def test_a_long_walk(spark):
    points = spark.range(5000).selectExpr("1L AS id", "id * 2 AS t")
    assert sorted(r["t"] for r in segments.spaced(points, ["id"], "t", 3).collect()) == list(range(0, 10_000, 4))

"""Cases of findings on odd inputs and larger tables, made small."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from fathomline.functions import text
from fathomline.llm import jaccard, probing, tokens
from fathomline.operators import joins, projection, search, strips, triage, windows
from fathomline.plans import registry


def test_track_just_at_the_header_tolerance_stays(spark):
    rows = spark.createDataFrame([("a", 0, 14.0, 9.1, 9.1, [0.0] * 36, [0.0] * 36, 0.0, 0.0, 0.5, 0.5)], "strip string, place long, altitude_m double, port_track_m double, starboard_track_m double, port_samples array<double>, starboard_samples array<double>, port_r0_m double, starboard_r0_m double, port_dr_m double, starboard_dr_m double")
    got = strips.altitudes(rows, ["strip"], "place").select("altitude", "altitude_source").first()
    assert tuple(got) == (9.1, "bottom track")  # 14 - 9.1 is 0.35 * 14


def surveyed(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"id": range(400), "survey": rng.integers(1, 4, 400), "site": rng.integers(0, 2, 400), "class": rng.choice(["a", "b"], 400), "x": rng.integers(0, 12, 400) * 30, "y": rng.integers(0, 3, 400) * 30})
    return pdf, spark.createDataFrame(pdf)


def joined(frame):
    """Names of the joins of a plan."""
    return set(re.findall(r"\w+Join\b", frame._jdf.queryExecution().executedPlan().toString()))


def test_pairs_of_surveys_send_no_side_to_the_driver(spark):
    _, t = surveyed(spark)
    for frame in (triage.change_pairs(t, 60.0), triage.nearest_later(t, 60.0), triage.seen_before(t, 60.0)):
        assert joined(frame) == {"SortMergeJoin"}


def test_targets_found_again_equal_all_pairs(spark):
    pdf, t = surveyed(spark)
    both = pdf.merge(pdf.assign(survey=pdf["survey"] + 1), on=["survey", "site", "class"], suffixes=("", "_p"))
    both["d"] = np.hypot(both["x"] - both["x_p"], both["y"] - both["y_p"]).round(4)
    both = both[both["d"] <= 60]
    assert sorted(map(tuple, triage.change_pairs(t, 60.0).select("prior_id", "id").collect())) == sorted(zip(both["id_p"], both["id"], strict=True))
    best = both.sort_values(["d", "id"]).groupby("id_p").first()
    assert {r["prior_id"]: r["later"] for r in triage.nearest_later(t, 60.0).collect()} == best["id"].to_dict()
    assert {r["id"] for r in triage.seen_before(t, 60.0).filter("seen").collect()} == set(both["id"]) != set(pdf["id"])


def test_near_compares_places_and_gives_every_row(spark):
    rng = np.random.default_rng(5)
    a, b = (pd.DataFrame({"id": range(80), "lat": rng.integers(0, 4, 80) / 10, "lon": rng.integers(0, 4, 80) / 10}) for _ in range(2))
    near = joins.near(spark.createDataFrame(a), spark.createDataFrame(b), 12000.0)
    want = [(i, j) for i, y, x in a.itertuples(index=False) for j, v, u in b.itertuples(index=False) if abs(y - v) + abs(x - u) < 0.15]
    assert sorted(map(tuple, near.select("id", "r_id").collect())) == sorted(want)
    assert "SortMergeJoin" in joined(near)  # places on cells, however few they seem


def test_blocks_of_queries_are_not_sent_to_the_driver(spark, tmp_path):
    rng = np.random.default_rng(6)
    spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(300)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "v"))
    seen, joins_of = [], probing.staged

    def noted(frame, name):
        seen.append(joined(frame))
        return joins_of(frame, name)

    probing.staged = noted
    try:
        got = probing.nearest(spark.read.parquet(str(tmp_path / "v")), F.col("vec_id") % 50 == 0)
    finally:
        probing.staged = joins_of
    assert seen and not any("BroadcastHashJoin" in s for s in seen)
    assert got.count() == 30


def test_hits_shuffle_no_pairs_and_leading_rows_hold_the_first(spark, monkeypatch):
    monkeypatch.setattr(search, "LOOKED", 40)
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words, 12))) for i in range(120)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, " ".join(rng.choice(words, 4))) for i in range(5)], "item_id long, text string")
    found = search.hits(asked, "item_id", "text", search.index(docs, "doc_id", "text"), "doc_id").withColumn("source", F.pmod("doc_id", F.lit(3)))
    assert not re.search(r"hashpartitioning\(item_id#\d+L, doc_id", found._jdf.queryExecution().executedPlan().toString())
    rows = found.toPandas().sort_values(["item_id", "score", "doc_id"], ascending=[True, False, True])
    want = rows[rows["score"] > 0].groupby("item_id").head(8)
    assert sorted(map(tuple, search.top(found, "item_id", "doc_id", 8).select("item_id", "doc_id").collect())) == sorted(zip(want["item_id"], want["doc_id"], strict=True))
    order = [F.desc("score"), F.col("doc_id")]
    capped = lambda f: sorted(map(tuple, windows.capped_top(f, ["item_id"], "source", order, 2, 8).select("item_id", "doc_id", "rank").collect()))
    assert capped(search.leading(found, "item_id", "doc_id", 8, "source", 2)) == capped(found)


def test_dense_search_makes_no_row_of_a_pair_and_sends_nothing_to_the_driver(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 16))
    x[200:] = x[7]  # many equal vectors
    v = spark.createDataFrame(pd.DataFrame({"vec_id": range(300), "embedding": x.tolist()}))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for i in range(0, 300, 50):
        score = np.round(u @ u[i], 6)
        want[i] = sorted((j for j in range(300) if j != i), key=lambda j: (-score[j], j))[:10]
    for found in (search.nearest_exact(v, F.col("vec_id") % 50 == 0, 10), search.nearest_hashed(v, F.col("vec_id") % 50 == 0, 10)):
        assert joined(found) == set()
        rows = found.orderBy("query_id", "rank").toPandas()
        assert {i: g["vec_id"].tolist() for i, g in rows.groupby("query_id")} == want


def test_a_part_of_a_table_meets_its_queries_once(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 8)).round(1)
    x[900:1100] = x[0]
    pdf = pd.DataFrame({"vec_id": [*range(1490), *range(10)], "embedding": x.tolist()})  # ten ids twice
    v = spark.createDataFrame(pdf).repartition(40)  # many small blocks, each of which was compared with each of the queries'
    seen, staged = [], probing.staged
    probing.staged = lambda frame, name: (seen.append(joined(frame)), staged(frame, name))[1]
    try:
        got = probing.nearest(v, F.col("vec_id") % 50 == 0).toPandas()
    finally:
        probing.staged = staged
    assert seen[0] == set()  # neither side is copied for each block of the other
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for q, g in got.groupby("query_id"):
        score = pd.Series(np.max([u @ u[i] for i in np.flatnonzero(pdf["vec_id"] == q)], axis=0)).groupby(pdf["vec_id"]).max().drop(q)
        assert g.sort_values("rank")["score"].is_monotonic_decreasing and np.allclose(score[g["vec_id"]].to_numpy(), g["score"])
        kth = score.nlargest(5).iloc[-1]
        hits, total = hits + (g["score"] >= kth - 1e-9).sum(), total + 5
    assert hits >= 0.9 * total


def test_sets_are_small_only_where_two_subsets_are_fewer_rows(spark):
    # 40 shared keys are 780 2-subsets, but 39 rows of keys whose lists of two are scanned in a bin
    found = spark.createDataFrame([(260, 39, 780, 1000.0)] * 3 + [(13, 2, 1, 64.0)] * 5, "n int, ones int, subsets long, scan double")
    assert jaccard.boundary(found) == 13


def test_the_cache_of_a_packing_is_bounded_by_its_parameter(spark):
    words = [" ".join(f"w{i}x{j}" for j in range(500)) for i in range(60)]
    found = tokens.encoder(tokens.tokenizer_path(), 2000)
    plain = [found.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    for w, ids in zip(words, plain, strict=True):
        assert found.many([w])[0].tolist() == ids
        assert len(found.pieces) <= 2500 and len(found.units) <= 2000 // 6 + 1000


def test_an_index_shuffles_texts_and_no_rows_of_terms(spark, monkeypatch):
    texts = [(1, "red red blue of the"), (2, "Blue, green"), (2, "blue green green"), (3, None), (4, "a of -- x"), (None, "red"), (5, "")]
    rows = spark.createDataFrame(texts, "k long, text string")
    tf = {}
    for k, x in texts:
        for w in re.findall("[a-z0-9]+", (x or "").lower()):
            if len(w) > 1 and w not in text.STOP_WORDS:
                tf[k, w] = tf.get((k, w), 0) + 1
    df = Counter(w for _, w in tf)
    idf = {w: math.log(8 / (n + 1)) + 1 for w, n in df.items()}
    raw = {(k, w): (1 + math.log(n)) * idf[w] for (k, w), n in tf.items()}
    norm = {k: math.sqrt(sum(v * v for (j, _), v in raw.items() if j == k)) for k, _ in raw}
    for least in (search.LEAST, 4):  # one part, and many
        monkeypatch.setattr(search, "LEAST", least)
        weights, rarity = search.index(rows, "k", "text")
        assert {(r["k"], r["term"]): r["w"] for r in weights.collect()} == pytest.approx({p: v / norm[p[0]] for p, v in raw.items()})
        assert {r["term"]: (r["df"], r["idf"]) for r in rarity.collect()} == {w: (df[w], pytest.approx(idf[w])) for w in df}
        assert "Generate" not in weights._jdf.queryExecution().optimizedPlan().toString()
    none = search.index(rows.filter("k > 9"), "k", "text")
    assert none[0].count() == none[1].count() == 0
    key = search.index(rows.withColumn("k", F.concat(F.lit("k"), "k")), "k", "text")[0]
    assert {r["k"] for r in key.collect()} == {"k1", "k2", None}


def test_a_projection_adds_up_before_its_shuffle(spark):
    weights = spark.createDataFrame([(1, f"t{k}", (-1.0) ** k * 0.01 * k) for k in range(300)] + [(2, "t1", None), (None, "t2", 0.5)], "k long, term string, w double")
    want = {}
    for k, t, w in [tuple(r) for r in weights.collect() if r["w"] is not None]:
        for r in range(3):
            h = hashlib.md5(f"7:{r}:{t}".encode()).hexdigest()
            at = (k, int(h[:12], 16) % 8)
            want[at] = want.get(at, Decimal(0)) + round(Decimal(repr(w)), 12) * (-1) ** int(h[12:16], 16)
    norm = {k: math.sqrt(sum(float(v) ** 2 for (j, _), v in want.items() if j == k)) for k, _ in want}
    found = projection.projected(weights, "k", 8, 3, seed=7)
    assert {(r["k"], r["dim"]): r["v"] for r in found.collect()} == pytest.approx({p: float(v) / norm[p[0]] for p, v in want.items() if v})
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_the_counts_of_a_stored_index_cut_no_text_again(spark):
    found = registry.QUERIES["k11_stored_index"](spark, "/root/testdata/sf0.001")
    assert "ArrowEvalPython" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r["of"]: r["n"] for r in found.collect()}["passages"] == registry.QUERIES["f35_passages"](spark, "/root/testdata/sf0.001").count()


def widest_shuffle(frame):
    """Rows of the largest exchange of a frame that was run."""
    return max(int(n) for n in re.findall(r"\d+", ",".join(shuffled(frame._jdf.queryExecution().executedPlan()))))


def shuffled(plan):
    """Rows that each exchange of an executed plan wrote."""
    out = []
    if "Exchange" in plan.nodeName() and plan.metrics().contains("shuffleRecordsWritten"):
        out.append(str(plan.metrics().get("shuffleRecordsWritten").get().value()))
    inner = plan.plan() if plan.nodeName().endswith("QueryStage") else plan.executedPlan() if plan.nodeName().startswith("AdaptiveSparkPlan") else None
    for child in ([inner] if inner is not None else [plan.children().apply(k) for k in range(plan.children().size())]):
        out += shuffled(child)
    return out


@pytest.mark.parametrize("held", [joins.HELD, 7])
def test_pairs_of_rows_that_share_places_are_not_shuffled(spark, monkeypatch, held):
    """Places carry their rows through the join; every pair of rows is made behind it, those of null ids too."""
    monkeypatch.setattr(joins, "HELD", held)
    monkeypatch.setattr(joins, "PAIRS", 50)
    rng = np.random.default_rng(33)
    a, b = ([(None if i == 3 else i, f"n{i}", float(y) / 10, float(x) / 10) for i, y, x in zip(range(n), rng.integers(0, 2, n), rng.integers(0, 2, n), strict=True)] for n in (150, 130))
    left, right = (spark.createDataFrame([*rows, (900, "nowhere", None, 0.1)], "id long, name string, lat double, lon double").repartition(3) for rows in (a, b))
    want = sorted((str(i), n, str(k), m) for i, n, y, x in a for k, m, v, u in b if abs(y - v) + abs(x - u) < 0.15)
    near = joins.near(left, right, 12000.0)
    assert near.columns == ["id", "name", "lat", "lon", "r_id", "r_name", "r_lat", "r_lon", "distance_m"]
    assert sorted((str(r["id"]), r["name"], str(r["r_id"]), r["r_name"]) for r in near.collect()) == want and len(want) > 10_000
    assert widest_shuffle(near) < 1000
    ids = joins.near(left.select("id", "lat", "lon"), right.select("id", "lat", "lon"), 12000.0, digits=1)
    assert sorted((str(r["id"]), str(r["r_id"])) for r in ids.collect()) == sorted((i, k) for i, _, k, _ in want)
    places = joins.near(left.select("lat", "lon"), right.select("lat", "lon"), 12000.0)
    assert places.count() == len(want)

    t = spark.createDataFrame([(i, 1 + k % 2, 0, "c", int(x * 300), int(y * 300)) for k, (i, _, x, y) in enumerate([*a, *b])], "id long, survey long, site long, class string, x int, y int").repartition(3)
    rows = t.collect()
    both = sorted((str(p["id"]), str(q["id"])) for p in rows for q in rows if p["survey"] + 1 == q["survey"] and np.hypot(p["x"] - q["x"], p["y"] - q["y"]) <= 30)
    found = triage.change_pairs(t, 30.0)
    assert sorted((str(r["prior_id"]), str(r["id"])) for r in found.collect()) == both and len(both) > 9000
    assert widest_shuffle(found) < 1000

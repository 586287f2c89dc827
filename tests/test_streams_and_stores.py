"""Streams that end like their batch twins, stores that give back what they hold, and numbering without a single task."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from fathomline.operators import joins, search, windows
from fathomline.plans.coverage import packed_passages
from fathomline.sources import files
from fathomline.streaming import telemetry


def events(spark, n=400):
    return spark.range(n).select("id", (F.col("id") % 5).alias("device"), (F.col("id") * 7 % 97).alias("t_s"))


def test_rate_limit_stream_ends_like_the_batch(spark, tmp_path):
    rows = events(spark)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = telemetry.rate_limited(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 0.5, 4.0)
    seen = []
    stream.writeStream.outputMode("append").foreachBatch(lambda df, n: seen.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(seen) == sorted(map(tuple, telemetry.limited(rows, 0.5, 4.0).collect())) and 0 < sum(x[2] for x in seen) < 400


def test_job_log_stream_shows_the_last_stage(spark, tmp_path):
    lines = [{"job_id": j, "seq": k, "type": "done" if (j, k) == ("a", 3) else "stage", "stage": f"s{k}", "message": "m"} for j in "ab" for k in range(4)]
    for k, line in enumerate(lines):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps(line) + "\n" + '{"job_id": "a", "se')
    seen = []
    stream = telemetry.job_stages(files.job_log(spark, str(tmp_path / "in"), streaming=True))
    stream.writeStream.outputMode("complete").foreachBatch(lambda df, n: seen.append({r["job_id"]: (r["stage"], r["ended"]) for r in df.collect()})).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    assert seen[-1] == {"a": ("s3", True), "b": ("s3", False)}


def test_changes_go_on_after_the_last_id(spark):
    assert [r["id"] for r in telemetry.changes(events(spark), 10, 3).collect()] == [11, 12, 13]


def test_numbers_follow_the_order_over_all_rows(spark):
    rows = spark.range(5000).select(F.col("id"), (F.col("id") * 7919 % 13).alias("k")).repartition(7)
    got = windows.numbered(rows, [F.desc("k"), F.col("id")], F.col("k")).orderBy("place").collect()
    want = sorted(((-(i * 7919 % 13), i) for i in range(5000)))
    total = 0
    for n, (r, (k, i)) in enumerate(zip(got, want, strict=True), 1):
        assert (r["place"], r["id"], r["before"]) == (n, i, total)
        total -= k


def test_lines_go_on_beyond_the_ends(spark):
    control = spark.createDataFrame([("a", 2, 10.0), ("a", 4, 14.0), ("a", 6, 10.0), ("b", 1, 5.0)], "k string, x long, v double")
    points = spark.createDataFrame([("a", 0), ("a", 3), ("a", 8), ("b", 9), ("c", 1)], "k string, x long")
    got = {(r["k"], r["x"]): r["y"] for r in joins.interpolated(points, control, ["k"], "x", "v", "y").collect()}
    assert got == {("a", 0): 6.0, ("a", 3): 12.0, ("a", 8): 6.0, ("b", 9): 5.0, ("c", 1): None}


def test_missing_corners_drop_out(spark):
    grid = spark.createDataFrame([(0, 0, 1.0), (1, 0, 3.0), (0, 1, None)], "i long, j long, v double")
    points = spark.createDataFrame([(1, 0.5, 0.0), (2, 0.5, 0.5), (3, 7.0, 7.0)], "id long, x double, y double")
    got = {r["id"]: r["s"] for r in joins.bilinear(points, grid, "x", "y", "v", "s").collect()}
    assert got[1] == pytest.approx(2.0) and got[2] == pytest.approx(2.0) and got[3] is None


def test_passages_overlap_and_hold_all_paragraphs():
    paragraphs = [f"{k} " * (40 + 37 * k % 200) for k in range(30)]
    passages = packed_passages("\n\n".join(paragraphs))
    assert all(any(p in x for x in passages) for p in paragraphs) and packed_passages(None) == packed_passages(" \n ") == []
    assert all(b.startswith(a[-150:]) for a, b in zip(passages, passages[1:], strict=False))


def test_stored_index_answers_like_the_one_in_memory(spark, tmp_path):
    rows = spark.createDataFrame([(1, "blue water under ice"), (2, "green water"), (3, "red sand")], "id long, text string")
    found = search.index(rows, "id", "text")
    search.save(found, str(tmp_path / "index"))
    back = search.load(spark, str(tmp_path / "index"))
    assert all(sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect())) for a, b in zip(found, back, strict=True))


def test_records_of_others(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps([{"id": "a", "label": "wreck", "score": 87, "box": [1, 2, 3, 4]}, {"id": "b", "score": 0.5}]))
    got = [tuple(r) for r in files.hazards(spark, str(tmp_path / "h.json")).orderBy("id").collect()]
    assert got == [("a", "wreck", 0.87, 1.0, 2.0, 3.0, 4.0), ("b", "unknown", 0.5, None, None, None, None)]
    (tmp_path / "c.json").write_text(json.dumps([{"id": "a", "name": "x", "embedding": [1, 2]}, {"id": "b", "name": "y"}]))
    with pytest.raises(ValueError, match="1 of 2"):
        files.catalog(spark, str(tmp_path / "c.json"))
    (tmp_path / "e.jsonl").write_text('{"id": "1", "question": "q", "answers": ["x"]}\n{"id": "2"}\n')
    assert [r["id"] for r in files.evaluation_cases(spark, str(tmp_path / "e.jsonl")).collect()] == ["1"]


def test_documents_and_manifest(spark, tmp_path):
    rows = spark.createDataFrame([("s", 2, "x"), ("s", 1, None), ("t", 3, "z")], "survey string, id long, name string")
    files.write_documents(rows, str(tmp_path / "d"), "survey")
    docs = {json.loads(r["value"])["survey"]: json.loads(r["value"])["rows"] for r in spark.read.text(str(tmp_path / "d")).collect()}
    assert docs == {"s": [{"id": 1}, {"id": 2, "name": "x"}], "t": [{"id": 3, "name": "z"}]}
    files.write_manifest(rows, str(tmp_path / "m"))
    assert spark.read.csv(str(tmp_path / "m" / "csv"), header=True).count() == spark.read.json(str(tmp_path / "m" / "json")).count() == 3


def test_tools_bring_arguments_to_their_types(spark):
    from fathomline.plans import toolbox

    sf = "/root/testdata/sf0.001"
    assert toolbox.run_tool(spark, sf, "find_detections", {"kind": "error", "limit": "3", "x": 1}).count() == 3
    for name, arguments, text in (("find", {}, "no tool"), ("near", {"lat": 1}, "needs lon"), ("near", {"lat": "north", "lon": 1}, "no float")):
        with pytest.raises(ValueError, match=text):
            toolbox.run_tool(spark, sf, name, arguments)

"""A tail of growing files gives every line once."""

from __future__ import annotations

import json

from fathomline.sources import tail


def run(stream, out, checkpoint):
    query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None


def test_a_file_that_grows_in_the_middle_of_a_line(spark, tmp_path):
    logs, out, checkpoint = tmp_path / "logs", tmp_path / "out", tmp_path / "checkpoint"
    logs.mkdir()
    log = logs / "a.jsonl"
    event = lambda k: json.dumps({"job_id": "j", "seq": k, "type": "step", "message": "ü" * k}) + "\n"
    third = event(3)
    log.write_text(event(1) + "\n" + event(2) + third[:20])
    run(tail.job_events(spark, str(logs)), out, checkpoint)
    assert sorted(r["seq"] for r in spark.read.parquet(str(out)).collect()) == [1, 2]
    with log.open("a") as f:
        f.write(third[20:30])
    run(tail.job_events(spark, str(logs)), out, checkpoint)  # nothing whole is new
    with log.open("a") as f:
        f.write(third[30:] + "no json\n" + event(4))
    (logs / "b.jsonl").write_text(event(9))
    (logs / "c.txt").write_text(event(10))
    run(tail.job_events(spark, str(logs)), out, checkpoint)
    run(tail.job_events(spark, str(logs)), out, checkpoint)
    got = spark.read.parquet(str(out)).collect()
    assert sorted(r["seq"] for r in got) == [1, 2, 3, 4, 9] and {r["message"] for r in got if r["seq"] == 3} == {"üüü"}
    data = log.read_bytes()
    assert all(json.loads(data[r["position"] :].split(b"\n")[0])["seq"] == r["seq"] for r in got if r["path"].endswith("a.jsonl"))


def test_splits_share_the_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [f"{k} " + "x" * (k * 37 % 900) for k in range(700)]
    (tmp_path / "in" / "log").write_text("\n".join(lines) + "\nunfinished")
    run(tail.tailed(spark, str(tmp_path / "in"), split_bytes=1000), tmp_path / "out", tmp_path / "checkpoint")
    assert sorted(r["value"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(lines)


def test_a_shorter_file_is_read_anew_and_a_missing_folder_is_empty(spark, tmp_path):
    where, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "checkpoint"
    run(tail.tailed(spark, str(where)), out, checkpoint)
    where.mkdir()
    (where / "log").write_text("one\ntwo\nthree\n")
    run(tail.tailed(spark, str(where)), out, checkpoint)
    (where / "log").write_text("four\n")
    run(tail.tailed(spark, str(where)), out, checkpoint)
    assert sorted(r["value"] for r in spark.read.parquet(str(out)).collect()) == ["four", "one", "three", "two"]


def test_events_after_a_number(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("".join(json.dumps({"seq": k}) + "\n" for k in range(5)))
    run(tail.job_events(spark, str(tmp_path / "in"), after=2), tmp_path / "out", tmp_path / "checkpoint")
    assert sorted(r["seq"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [3, 4]

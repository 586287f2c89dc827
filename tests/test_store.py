"""Stores that change, their older versions, and documents replaced as a whole."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.sources import store

SCAN = T.StructType().add("scan", "long").add("name", "string")
DETECTION = T.StructType().add("id", "long").add("scan", "long").add("score", "double")


def rows(s, version=None):
    return sorted(map(tuple, s.read(version).collect()))


def test_versions_of_a_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "scans"), ["scan"], SCAN)
    frame = lambda *r: spark.createDataFrame(list(r), SCAN)
    assert rows(s) == [] and s.versions() == []
    assert s.insert(frame((1, "a"), (2, "b"), (3, "c"), (None, "lost"))) == 1
    assert s.upsert(frame((2, "B"), (4, "d"), (4, "D"))) == 2
    assert s.delete(frame((1, None), (9, None))) == 3
    assert s.upsert(frame((1, "again"))) == 4
    assert rows(s, 1) == [(1, "a"), (2, "b"), (3, "c")] and rows(s, 2) == [(1, "a"), (2, "B"), (3, "c"), (4, "d")] and rows(s, 3) == [(2, "B"), (3, "c"), (4, "d")]
    assert rows(s) == [(1, "again"), (2, "B"), (3, "c"), (4, "d")]
    with pytest.raises(ValueError):
        s.insert(frame((3, "x")))
    with pytest.raises(store.Conflict):
        s.upsert(frame((5, "late")), after=2)
    assert s.versions() == [1, 2, 3, 4]
    assert s.compacted() == 5 and rows(s) == [(1, "again"), (2, "B"), (3, "c"), (4, "d")] and len(s.segments(5)) == 1
    assert len(s.vacuumed()) == 5 and s.versions() == [5] and rows(s) == [(1, "again"), (2, "B"), (3, "c"), (4, "d")]


def test_cascade(spark, tmp_path):
    scans, found = store.Store(spark, str(tmp_path / "s"), ["scan"], SCAN), store.Store(spark, str(tmp_path / "d"), ["id"], DETECTION)
    scans.insert(spark.createDataFrame([(k, str(k)) for k in range(4)], SCAN))
    found.insert(spark.createDataFrame([(k, k % 4, 0.5) for k in range(12)], DETECTION))
    assert store.cascade(scans, found, spark.createDataFrame([(1,), (3,)], "scan long"), {"scan": "scan"}) == (2, 2)
    assert [r[0] for r in rows(scans)] == [0, 2] and {r[1] for r in rows(found)} == {0, 2} and len(rows(found)) == 6
    assert len(rows(found, 1)) == 12


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), ["scan"], SCAN)
    s.insert(spark.createDataFrame([(1, "a")], SCAN))
    broken = spark.range(100).repartition(4).select(F.col("id").alias("scan"), F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise("x").alias("name"))
    with pytest.raises(Exception, match="broken"):
        s.upsert(broken)
    assert s.versions() == [1] and rows(s) == [(1, "a")]


def test_documents_are_replaced_at_once(spark, tmp_path):
    path, shape = str(tmp_path / "docs"), "k long, v string"
    read = lambda: sorted(map(tuple, store.documents(spark, path, shape).collect()))
    assert read() == []
    store.replaced(spark.createDataFrame([(1, "ü"), (2, None)], shape).repartition(2), path)
    assert read() == [(1, "ü"), (2, None)]
    first = next(n for n in os.listdir(path) if n.startswith("write-"))
    fails = spark.range(50).repartition(5).select(F.col("id").alias("k"), F.when(F.col("id") == 33, F.raise_error(F.lit("half-way"))).otherwise("x").alias("v"))
    with pytest.raises(Exception, match="half-way"):
        store.replaced(fails, path)
    assert read() == [(1, "ü"), (2, None)]
    store.replaced(spark.createDataFrame([(3, "new")], shape), path)
    assert read() == [(3, "new")] and not os.path.isdir(os.path.join(path, first))  # what the pointer named before is gone
    spark.createDataFrame([(4, "more")], shape).write.format("documents").mode("append").save(path)
    assert read() == [(3, "new"), (4, "more")]
    store.replaced(spark.createDataFrame([], shape), path)
    assert read() == []

"""Sections, packing and the stored index."""

from __future__ import annotations

import os

import pytest
from hypothesis import given
from hypothesis import strategies as st

from fathomline.operators import passages


def test_sections_at_headings(spark):
    text = "before\n# One\nfirst\n\nsecond\n## Two ##\n\n# Three\nlast"
    got = passages.sections(spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "", "z"), (4, "# only", "w")], "id int, text string, heading_of string"), "text").orderBy("id", "section").collect()
    assert [(r["id"], r["section"], r["heading"], r["body"], r["heading_of"]) for r in got] == [(1, 0, "", "before", "x"), (1, 1, "One", "first\n\nsecond", "x"), (1, 3, "Three", "last", "x")]


def test_passages_never_straddle_headings(spark):
    body = "\n\n".join(f"{k} " + "w" * 300 for k in range(8))
    rows = spark.createDataFrame([(1, f"# A\n{body}\n# B\nshort")], "id int, text string")
    got = passages.passages(rows, "text").orderBy("section", "place").collect()
    assert [(r["heading"], r["place"]) for r in got] == [("A", 0), ("A", 1), ("A", 2), ("A", 3), ("B", 0)]
    assert all(len(r["passage"]) <= 900 for r in got) and got[-1]["passage"] == "short"
    assert got[1]["passage"].startswith("w" * 150 + "\n\n2 ")


def by_strings(paragraphs, target, overlap, glue):
    out, held = [], None
    for p in paragraphs:
        if held is None:
            held = p
        elif len(held) + len(glue) + len(p) > target:
            out.append(held)
            held = (held[-overlap:] + glue if overlap else "") + p
        else:
            held += glue + p
    return out + ([] if held is None else [held])


@given(st.lists(st.text("ab ", min_size=1, max_size=40), max_size=20), st.integers(1, 60), st.integers(0, 20))
def test_packing_by_strings(paragraphs, target, overlap):
    assert passages.packed(paragraphs, target, overlap, "\n") == by_strings(paragraphs, target, overlap, "\n")


def test_index_is_built_once_and_anew_for_other_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", "red fish"), ("b", "blue fish swims")], "passage_id string, passage string")
    built = []

    def index():
        source = spark.read.parquet(str(tmp_path / "docs"))
        return passages.stored(spark, "test-index", passages.fingerprint(spark, source, str(tmp_path)), lambda: built.append(1) or source)

    rows.write.parquet(str(tmp_path / "docs"))
    queries = spark.createDataFrame([(1, "blue")], "q int, text string")
    assert [r["passage_id"] for r in index().hits(queries, "q", "text").collect()] == ["b"]
    assert index().passages.count() == 2 and built == [1]
    rows.limit(1).unionByName(spark.createDataFrame([("c", "blue bird")], rows.schema)).write.mode("append").parquet(str(tmp_path / "docs"))
    assert {r["passage_id"] for r in index().hits(queries, "q", "text").collect()} == {"b", "c"} and built == [1, 1]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_searches_share_one_index(spark, monkeypatch):
    from fathomline.plans import passages as plans

    first = plans.index(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(plans, "cut", lambda *_: pytest.fail("built again"))
    assert plans.index(spark, "/root/testdata/sf0.001").passages.count() == first.passages.count()


def test_every_item_is_sought_in_every_document(spark):
    """Items of a word or two, of stop words or of signs only have no term between their first and last word."""
    from fathomline.plans import passages as plans

    texts = ["Red fish swims in the sea.", "a bird of the air", "redfish, blue fish", "...", None, ""]
    asked = ["fish", "of the", "blue fish", "fish swims in", "Red fish swims", "...", "", "no such words here", None, "Kelvin red", "in the sea."]
    docs = spark.createDataFrame(list(enumerate([*texts, "xKelvin red"])), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(asked)), "item_id long, text string")
    idf = spark.createDataFrame([("swims", 1, 1.0), ("fish", 2, 1.0)], "term string, df long, idf double")
    want = {(i, k) for i, item in enumerate(asked) for k, x in enumerate([*texts, "xKelvin red"]) if item is not None and x is not None and item in x}
    got = [tuple(r) for r in plans.holders(docs, items, idf).collect()]
    assert set(got) == want and len(got) == len(want) > 14


def test_searches_of_blocks_equal_the_join_on_terms(spark, tmp_path, monkeypatch):
    """Pairs of a query and a text are added up and ranked where a block is read; none that is not among the first is a row."""
    import numpy as np
    import pyarrow.compute as pc
    from pyspark.sql import functions as F

    from fathomline.operators import blocks, search, windows

    rng = np.random.default_rng(31)
    pool = np.array([f"w{k}" for k in range(25)] + ["the", "x", "Ñandú", "W3", "İs"])
    draw = lambda n: " ".join(rng.choice(pool, n)) + rng.choice([".", "\n", ""])
    rows = spark.createDataFrame([*((f"{k // 4}#0.{k % 4}", draw(rng.integers(1, 30))) for k in range(300)), ("90#0.0", ""), ("91#0.0", None), ("92#0.0", "the x")], "key string, text string").repartition(3)
    asked = spark.createDataFrame([*((k, draw(rng.integers(1, 6))) for k in range(20)), (90, "the"), (91, None), (92, "nowhere"), (93, "w1 w2")], "q int, text string")
    weights, idf = search.index(rows, "key", "text")
    want = search.hits(asked, "q", "text", (weights, idf), "key").cache()
    expected = sorted(map(tuple, want.collect()))
    first = sorted(map(tuple, search.top(want, "q", "key", 3).select("q", "key", "rank").collect()))
    capped = lambda found: sorted(map(tuple, windows.capped_top(found.withColumn("doc", F.substring_index("key", "#", 1)), ["q"], "doc", [F.desc("score"), F.col("key")], 2, 5).select("q", "key", "rank").collect()))
    soft = capped(want)
    assert len(expected) > 3000
    for size, weights_at_once in ((blocks.BLOCK, blocks.ASKED), (300, 10)):
        monkeypatch.setattr(blocks, "BLOCK", size)
        monkeypatch.setattr(blocks, "ASKED", weights_at_once)
        path = str(tmp_path / f"index{size}")
        blocks.build(rows, "key", "text", path)
        stored = spark.read.parquet(f"{path}/blocks")
        assert (stored.count() > 30) == (size == 300) and not (tmp_path / f"index{size}" / "counted").exists()
        found = spark.read.parquet(f"{path}/idf")
        assert {r["term"]: (r["df"], round(r["idf"], 9)) for r in found.collect()} == {r["term"]: (r["df"], round(r["idf"], 9)) for r in idf.collect()}
        heavy = {r["term"]: round(r["w"], 9) for r in weights.groupBy("term").agg(F.max("w").alias("w")).collect()}
        assert {r["term"]: round(r["w"], 9) for r in blocks.heaviest(stored).collect()} == heavy
        q = blocks.asked(asked, "q", "text", found)
        assert sorted(map(tuple, blocks.hits(stored, q, "q", "key").collect())) == expected
        few = blocks.hits(stored, q, "q", "key", 3, positive=True)
        assert sorted(map(tuple, search.top(few, "q", "key", 3).select("q", "key", "rank").collect())) == first
        some = blocks.hits(stored, q, "q", "key", 5, group=lambda keys: pc.list_element(pc.split_pattern(keys, "#"), 0))
        assert capped(some) == soft
        if size > 300:
            assert few.count() < len(expected) / 4 and some.count() < len(expected) / 2
    none = str(tmp_path / "none")
    blocks.build(rows.filter("key = 'none'"), "key", "text", none)
    assert blocks.hits(spark.read.parquet(f"{none}/blocks"), blocks.asked(asked, "q", "text", spark.read.parquet(f"{none}/idf")), "q", "key").count() == 0

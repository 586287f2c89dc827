"""The registered queries on the smallest tables, against SQL or brute force over every row."""

from __future__ import annotations

import os
import re
from collections import Counter

import oracle
import pytest

from fathomline.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    assert oracle.differences(queries.QUERIES[name](spark, SF), oracle.connect(SF), queries.ORACLE_SQL[name]) == []


def test_quality_rules_equal_brute_force(spark, documents):
    got = {r["doc_id"]: r for r in queries.op4_quality_rules(spark, SF).collect()}
    assert got.keys() == documents.keys()
    for i, d in documents.items():
        text = d["text"] or ""
        words = WORD.findall(text)
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        again = set()
        for p in range(len(words) - 2):
            if windows[tuple(words[p : p + 3])] > 1:
                again.update((p, p + 1, p + 2))
        lines = [x for x in text.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(again))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(again) > 50 * len(words)) and not (r["base_failed"] and r["kept"])


def test_mixing_equals_brute_force(spark, documents):
    got = queries.op7_source_mixing(spark, SF).collect()
    again = {r["doc_id"]: r["taken"] for r in queries.op7_source_mixing(spark, SF).collect()}
    sizes = {i: len(WORD.findall(d["text"] or "")) for i, d in documents.items()}
    of = Counter()
    for i, d in documents.items():
        of[d["source"]] += sizes[i]
    order = sorted(of, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(of.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > 3 * of[s]}
        if not full:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 3.0 * of[s] for s in full}
        left -= sum(3.0 * of[s] for s in full)
        free -= full
    taken = Counter()
    for r in got:
        source = documents[r["doc_id"]]["source"]
        taken[source] += r["taken"]
        assert (r["size"], r["source_size"]) == (sizes[r["doc_id"]], of[source]) and r["target"] == pytest.approx(target[source]) and r["taken"] <= 3 * r["size"]
        assert again[r["doc_id"]] == r["taken"]
    assert len(got) == len(documents) and all(abs(taken[s] - target[s]) <= 0.05 * target[s] + 50 for s in order)


def test_secrets_found_are_at_their_places(spark, documents):
    for r in queries.op5_secret_scan(spark, SF).collect():
        assert 0 <= r["start"] <= r["start"] + r["length"] <= len(documents[r["doc_id"]]["text"])
        assert 0 <= r["probability"] <= 1 and r["is_secret"] == (r["probability"] >= 0.5)

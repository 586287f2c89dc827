"""Substring deduplication by difference-cover anchors.

A window of ``n`` words that occurs twice shares a short anchor whose two positions both lie in a difference cover modulo the period, as
any two offsets meet in the cover at some shift below the period. So hashes of short windows at cover positions only are compared over the
corpus; around the anchors that occur twice or more, the full windows are extended and compared, and each learns where it starts first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import HASHES, windows
from fathomline.llm.dealing import dealt, parts_of, runs

#: A perfect difference set: every remainder modulo 13 is the difference of two of its members.
PERIOD, COVER = 13, (0, 1, 3, 9)
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class Block:
    """The documents of one block in the order of their ids, as one run of words."""

    def __init__(self, pdf: pd.DataFrame) -> None:
        pdf = pdf.assign(key=pdf["text"].fillna("")).sort_values(["doc_id", "key"], kind="stable", na_position="first")
        self.ids = pdf["doc_id"].tolist()
        self.words = [(t or "").encode("utf-8", "surrogatepass").split() for t in pdf["key"]]
        self.lens = np.array([len(w) for w in self.words], dtype=np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.hashes = [HASHES.of(w) for w in self.words]
        self.order = np.array([-1 << 62 if pd.isna(i) else int(i) for i in self.ids], dtype=np.int64)

    def anchors(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the anchors of each document, and their positions in the block."""
        size = n - PERIOD + 1
        hashes, places = [], []
        for start, h in zip(self.starts, self.hashes, strict=True):
            if len(h) < n:
                continue
            at = np.flatnonzero(np.isin(np.arange(len(h) - size + 1) % PERIOD, COVER))
            hashes.append(windows(h, size)[at])
            places.append(start + at)
        return (np.concatenate(hashes), np.concatenate(places)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def candidates(self, n: int, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and places of the full windows that hold an anchor out of ``shared`` (sorted hashes)."""
        size = n - PERIOD + 1
        h, places = self.anchors(n)
        hit = places[shared[np.minimum(np.searchsorted(shared, h), len(shared) - 1)] == h] if len(shared) else places[:0]
        edge = np.zeros(int(self.lens.sum()) + n + 1, dtype=np.int64)
        np.add.at(edge, np.maximum(hit - (n - size), 0), 1)
        np.add.at(edge, hit + 1, -1)
        near = np.cumsum(edge) > 0
        hashes, found = [], []
        for start, words in zip(self.starts, self.hashes, strict=True):
            if len(words) < n:
                continue
            at = np.flatnonzero(near[start : start + len(words) - n + 1])
            if len(at):
                hashes.append(windows(words, n)[at])
                found.append(start + at)
        return (np.concatenate(hashes), np.concatenate(found)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def owner(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts + self.lens, places, side="right")


def removed(docs: DataFrame, n: int = 20, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with ``texts``, kept_text: one row per document row.

    A word goes if a window of ``n`` words over it has a sequence that starts earlier: in a smaller doc_id, or earlier in the document.
    Words are ``[^\\x20\\x09-\\x0D]+``; a null text has none. A null doc_id comes before all ids. Rows that share an id count as separate documents
    in the order of their texts, equal ones in any order. Windows are compared by 64-bit hashes. Other columns are ignored.
    """
    blocks, n_blocks = dealt(docs)
    n_parts = max(1, n_blocks)

    def anchors(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.sort(Block(pdf).anchors(n)[0])
        at = runs(h)
        twice = np.diff(np.append(at, len(h))) > 1
        unique = h[at]
        rows = [(k, int(pdf["block"].iloc[0]), unique[p].tobytes(), np.packbits(twice[p]).tobytes()) for k, p in enumerate(parts_of(unique, n_parts)) if len(p)]
        return pd.DataFrame(rows, columns=["part", "block", "hashes", "twice"])

    def shared(pdf: pd.DataFrame) -> pd.DataFrame:
        each = [np.frombuffer(x, np.uint64) for x in pdf["hashes"]]
        twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=len(h)).astype(bool) for h, t in zip(each, pdf["twice"], strict=True)])
        every = np.concatenate(each)
        order = np.argsort(every, kind="stable")
        s = every[order]
        at = runs(s)
        many = np.repeat((np.diff(np.append(at, len(s))) > 1) | np.logical_or.reduceat(twice[order], at), np.diff(np.append(at, len(s))))
        good = np.zeros(len(s), dtype=bool)
        good[order] = many
        rows, start = [], 0
        for block, h in zip(pdf["block"], each, strict=True):
            mine = h[good[start : start + len(h)]]
            start += len(h)
            if len(mine):
                rows.append((block, mine.tobytes()))
        return pd.DataFrame(rows, columns=["of", "hashes"])

    def gathered(pdf: pd.DataFrame) -> np.ndarray:
        return np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["hashes"]])) if len(pdf) else np.zeros(0, np.uint64)

    def extended(pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        """The first start in this block of each candidate window."""
        columns = ["part", "block", "hashes", "ids", "places"]
        if not len(pdf) or not len(found):
            return pd.DataFrame([], columns=columns)
        block = Block(pdf)
        h, places = block.candidates(n, gathered(found))
        order = np.lexsort((places, h))
        first = order[runs(h[order])]
        ids, hashes = block.order[block.owner(places[first])], h[first]
        rows = [(k, int(pdf["block"].iloc[0]), hashes[p].tobytes(), ids[p].tobytes(), places[first][p].tobytes()) for k, p in enumerate(parts_of(hashes, n_parts)) if len(p)]
        return pd.DataFrame(rows, columns=columns)

    def firsts(pdf: pd.DataFrame) -> pd.DataFrame:
        """For each block the windows that start earlier in another one."""
        each = [np.frombuffer(x, np.uint64) for x in pdf["hashes"]]
        h, ids = np.concatenate(each), np.concatenate([np.frombuffer(x, np.int64) for x in pdf["ids"]])
        owner = np.repeat(pdf["block"].to_numpy(), [len(x) for x in each])
        order = np.lexsort((owner, ids, h))  # one id lies in one block, so the order of the places does not matter here
        later = np.ones(len(h), dtype=bool)
        later[order[runs(h[order])]] = False
        rows, start = [], 0
        for block, mine in zip(pdf["block"], each, strict=True):
            rows.append((block, mine[later[start : start + len(mine)]].tobytes()))
            start += len(mine)
        return pd.DataFrame(rows, columns=["of", "hashes"])

    def cut(pdf: pd.DataFrame, found: pd.DataFrame, later: pd.DataFrame) -> pd.DataFrame:
        block = Block(pdf)
        edge = np.zeros(int(block.lens.sum()) + n + 1, dtype=np.int64)
        if len(found):
            h, places = block.candidates(n, gathered(found))
            elsewhere = gathered(later)
            order = np.lexsort((places, h))
            gone = np.ones(len(h), dtype=bool)
            gone[order[runs(h[order])]] = False
            if len(elsewhere):
                gone |= elsewhere[np.minimum(np.searchsorted(elsewhere, h), len(elsewhere) - 1)] == h
            np.add.at(edge, places[gone], 1)
            np.add.at(edge, places[gone] + n, -1)
        covered = np.cumsum(edge) > 0
        rows = []
        for i, words, start in zip(block.ids, block.words, block.starts, strict=True):
            gone = covered[start : start + len(words)]
            kept = b" ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x]) if gone.any() else b" ".join(words)
            rows.append((None if pd.isna(i) else int(i), len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "surrogatepass")] * texts)))
        return pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * texts]).astype({"doc_id": "Int64"})

    found = (
        blocks.groupBy("block").applyInPandas(anchors, "part int, block int, hashes binary, twice binary")
        .groupBy("part").applyInPandas(shared, "of int, hashes binary")
    )
    later = (
        blocks.groupBy("block").cogroup(found.groupBy("of")).applyInPandas(extended, "part int, block int, hashes binary, ids binary, places binary")
        .groupBy("part").applyInPandas(firsts, "of int, hashes binary")
    )
    both = found.withColumn("later", F.lit(False)).unionByName(later.withColumn("later", F.lit(True)))

    def finish(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        return cut(pdf, answers[~answers["later"].astype(bool)], answers[answers["later"].astype(bool)])

    return blocks.groupBy("block").cogroup(both.groupBy("of")).applyInPandas(finish, SCHEMA + ", kept_text string" * texts)

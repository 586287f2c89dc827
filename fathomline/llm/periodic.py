"""Periodic runs of words, found with bit-parallel lags.

The ids of a text's words are written as bit planes, each one big integer with a bit a word. XOR of a plane with itself shifted by a lag, ORed over
the planes, leaves a zero where a word equals the one a lag further on; AND with copies shifted by 1, 2, 4 ... keeps the places where a long enough
stretch of zeros begins. Lags up to 15 are all tried. Of the longer ones those are tried at which some window repeats, as every run shows one:

* a run of period q, 2^j <= q < 2^(j+1), holds a window of 2^(j-1) words that starts at a multiple of 2^(j-1) and comes again q words on, inside the run;
* where that window and its copy lie in a run whose period divides q, the run of period q would have the smaller period too, so the lag can be left out.

So a text of n words tries few lags, and none that could hold a run is missed. All lags of a text of one repeated word fall to its period 1.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import arrow_schema, blocks, fresh, mixed, raw

#: A run is at least so many words long, and twice its period.
LEAST = 12
#: Lags below this one are all tried.
DENSE = 16
#: Planes between two looks whether a stretch can still be there.
LOOK = 4

RUNS = "array<struct<start: long, length: long, period: long>>"


class Runs(NamedTuple):
    """Runs by start, then period."""

    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def planes(ids: np.ndarray) -> list[int]:
    """One integer for each bit of the ids; its bit i belongs to word i."""
    bits = int(ids.max()).bit_length() if len(ids) else 0
    ids = ids.astype(np.uint32)
    return [int.from_bytes(np.packbits(ids & np.uint32(1 << b) > 0, bitorder="little").tobytes(), "little") for b in range(bits)]


def begins(same: int, need: int) -> int:
    """Bits at which ``need`` ones in a row begin, by AND with shifted copies of doubling reach."""
    have = 1
    while same and have < need:
        step = min(have, need - have)
        same &= same >> step
        have += step
    return same


def stretches(plane: list[int], n: int, lag: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest stretches of words that equal those ``lag`` words on, of at least ``need`` words each."""
    none = np.zeros(0, dtype=np.int64)
    need = max(least - lag, lag)
    if n - lag < need:
        return none, none
    inside = (1 << (n - lag)) - 1
    miss, found = 0, begins(inside, need)
    for k, p in enumerate(plane):
        miss |= p ^ (p >> lag)
        if k % LOOK == LOOK - 1 or k == len(plane) - 1:
            found = begins(~miss & inside, need)
            if not found:
                return none, none
    reach = 1  # bits at which stretches begin grow back to whole stretches
    while reach < need:
        step = min(reach, need - reach)
        found |= found << step
        reach += step
    edges = found ^ (found << 1)
    at = np.flatnonzero(np.unpackbits(np.frombuffer(edges.to_bytes((n + 8) // 8, "little"), dtype=np.uint8), bitorder="little"))
    return at[0::2], at[1::2]


class Windows:
    """Hashes of all windows of a width that doubles; only windows that come twice or more stay in view."""

    def __init__(self, ids: np.ndarray) -> None:
        self.n, self.width = len(ids), 1
        self.h = mixed(ids.astype(np.uint64) + np.uint64(1))

    def doubled(self) -> None:
        if len(self.h) > self.width:
            self.h = mixed(self.h[: -self.width] * np.uint64(0x9E3779B97F4A7C15) + self.h[self.width :])
        else:
            self.h = self.h[:0]
        self.width *= 2

    def repeats(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, bool]:
        """(place, lag) of windows at multiples of the width that come again at a lag of ``low`` to ``high`` - 1, and whether any window comes twice."""
        m = len(self.h)
        order = np.argsort(self.h, kind="stable")
        s = self.h[order]
        new = np.concatenate([[True], s[1:] != s[:-1]]) if m else np.zeros(0, dtype=bool)
        if new.all():
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), False
        group = np.empty(m, dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        keys = group[order] * (2 * self.n + 1) + order
        at = np.arange(0, m, self.width)
        first, last = (np.searchsorted(keys, group[at] * (2 * self.n + 1) + np.minimum(at + x, 2 * self.n)) for x in (low, high))
        size = last - first
        at = np.repeat(at, size)
        skip = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        return at, order[np.repeat(first, size) + skip] - at, True


#: Starts and ends of the runs of each period, in order.
Found = dict[int, tuple[np.ndarray, np.ndarray]]


def uncovered(at: np.ndarray, lag: np.ndarray, width: int, found: Found) -> list[int]:
    """The lags that some pair of windows shows which no run of a dividing period holds."""
    if found and len(at):
        start, end, period = (np.concatenate(x) for x in zip(*((s, e, np.full(len(s), p)) for p, (s, e) in found.items()), strict=True))
        order = np.argsort(start, kind="stable")
        start, end, period = start[order], end[order], period[order]
        farthest = np.maximum.accumulate(end * len(end) + np.arange(len(end))) % len(end)
        k = np.searchsorted(start, at, side="right") - 1
        run = farthest[np.maximum(k, 0)]
        lag = lag[~((k >= 0) & (end[run] >= at + lag + width) & (lag % period[run] == 0))]
    return np.unique(lag).tolist()


def runs_of(ids: np.ndarray, least: int = LEAST) -> Runs:
    """All runs of a sequence of word ids (0, 1, ...): longest stretches of a smallest period q, of ``least`` words and 2 * q words or more."""
    n = len(ids)
    plane = planes(ids)
    found: Found = {}

    def tried(lag: int) -> None:
        start, end = stretches(plane, n, lag, least)
        if len(start):
            end = end + lag
            smaller = np.zeros(len(start), dtype=bool)  # a stretch of 2 * lag words has a smaller period only if a run whose period divides the lag holds it
            for p, (s, e) in found.items():
                if lag % p == 0:
                    k = np.searchsorted(s, start, side="right") - 1
                    smaller |= (k >= 0) & (e[np.maximum(k, 0)] >= end)
            if not smaller.all():
                found[lag] = (start[~smaller], end[~smaller])

    for lag in range(1, min(DENSE, n // 2 + 1)):
        tried(lag)
    view, low = Windows(ids), DENSE
    while view.width < DENSE // 2:
        view.doubled()
    while 2 * low <= n:
        at, lag, any_left = view.repeats(low, 2 * low)
        if not any_left:
            break
        for x in uncovered(at, lag, view.width, found):
            if 2 * x <= n:
                tried(x)
        view.doubled()
        low *= 2
    rows = [np.stack([s, e - s, np.full(len(s), p)]) for p, (s, e) in found.items()]
    start, length, period = np.concatenate(rows, axis=1) if rows else np.zeros((3, 0), dtype=np.int64)
    order = np.lexsort((period, start))
    return Runs(start[order], length[order], period[order])


def repeated_words(runs: Runs, n: int) -> np.ndarray:
    """Which words lie in some run after its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, runs.start + runs.period, 1)
    np.add.at(edge, runs.start + runs.length, -1)
    return np.cumsum(edge[:-1]) > 0


def periodic(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with n_words, runs (start, length, period; by start, then period) and collapsed, the text in which each run keeps its first period.

    Words are separated by spaces, tabs and line ends and compared as they are; collapsed joins those kept by one space. A null text has no words, no
    runs and an empty collapsed text. Rows are worked on alone, without a shuffle: repeated rows give repeated results, other columns pass
    through (new ones get another sign where a name is taken), an empty table stays empty, texts are read whole.
    """
    words, runs, kept = fresh(docs, "n_words", "runs", "collapsed")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    schema = f"{ddl}, `{words}` long, `{runs}` {RUNS}, `{kept}` string"

    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text):
            counts, found, texts = [], [], []
            for value in raw(batch, text):
                w = (value or b"").split()
                ids = np.fromiter(map(defaultdict(count().__next__).__getitem__, w), dtype=np.int64, count=len(w))
                r = runs_of(ids, least)
                if len(r.start):
                    w = [x for x, gone in zip(w, repeated_words(r, len(w)).tolist(), strict=True) if not gone]
                counts.append(len(ids))
                found.append([{"start": s, "length": k, "period": p} for s, k, p in zip(*(x.tolist() for x in r), strict=True)])
                texts.append(b" ".join(w).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(batch.columns, out.types, strict=False)] + [pa.array(x, type=t) for x, t in zip((counts, found, texts), out.types[-3:], strict=True)], schema=out)

    return docs.mapInArrow(run, schema)


def looped(doc_id: Column, text: Column) -> Column:
    """The text of a document of which every tenth (by a checksum of its id) repeats a piece of itself to its end; others, and null ids, as they are.

    With h the checksum, g = h // 10, n words, a = g % n and p = 1 + (n - a) // (3 + g % 8), word i >= a becomes word a + (i - a) % p.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    w = F.regexp_extract_all(text, F.lit("([^\\x20\\x09-\\x0D]+)"), 1)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return F.concat_ws(" ", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))))

    once = F.transform(F.array(w), lambda x: F.when(F.size(x) > 0, repeated(x)))  # so that the words are taken once
    return F.when(F.pmod(h, F.lit(10)) == 0, F.coalesce(F.get(once, F.lit(0)), text)).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period) and checksums of all runs and of the collapsed text."""
    longest = F.aggregate("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda best, r: F.when(best.isNull() | (r["length"] > best["length"]), r).otherwise(best))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))))
    best = found.withColumn("_best", longest)
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

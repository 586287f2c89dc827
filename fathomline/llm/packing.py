"""Mixture-controlled packing: deficit round-robin over one queue a source.

A window is a fixed number of sequences. In every window each source is owed its quantum, its share of the window's tokens. A source whose quantum is large
sends it to the token and carries the rest of a token on; one whose quantum is small saves its deficit over windows until it can send a grain, a quarter of
a sequence, so its documents are not cut into crumbs. Served so, grain k of a source falls due at a time that depends on its own rate only, whatever the
other queues do, and the tokens that a source has sent by the end of any window follow from the queues' lengths and rates: deficits pass through
all windows and partitions without a task that sees more than its own documents. Documents are cut where a window ends, so each window holds its target
proportions to a few tokens, or to about a grain for sources that save up; when a queue is empty the others share its quantum.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.llm.common import blocks, staged
from fathomline.llm.tokens import encoder, tokenizer_path

#: Numbers in a matrix of windows by queues.
MATRIX = 1 << 20
#: Multiples of it, without their whole parts, are spread evenly.
GOLDEN = (5**0.5 - 1) / 2
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, window long"


def tokenized(docs: DataFrame, path: str, end: int, pieces: int) -> DataFrame:
    """uid, source, n, doc_ids, lengths and ids (16-bit numbers where they fit, else 32-bit): a row for each source in each block of documents, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            ids, lengths = encoder(path, pieces).ended(batch.column("text"), end)
            ids = np.split(ids, np.cumsum(lengths)[:-1])
            doc_ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
            members: dict[str | None, list[int]] = {}
            for i, source in enumerate(batch.column("source").cast(pa.string()).to_pylist()):
                members.setdefault(source, []).append(i)
            joined = [np.concatenate([ids[i] for i in own]) for own in members.values()]
            narrow = [x.astype(np.uint16).tobytes() if x.max() < 65536 else b"\xff" + x.tobytes() for x in joined]
            lists = [[[of[i] for i in own] for own in members.values()] for of in (doc_ids, lengths.tolist())]
            columns = [pa.array(list(members), pa.string()), pa.array([len(x) for x in joined], pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in lists), pa.array(narrow, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["source", "n", "doc_ids", "lengths", "ids"])

    rows = docs.select("doc_id", "source", "text").mapInArrow(run, "source string, n long, doc_ids array<long>, lengths array<long>, ids binary")
    return staged(rows.withColumn("uid", F.monotonically_increasing_id()), "pack-tokens")


def widened(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint32, offset=1) if len(x) % 2 else np.frombuffer(x, np.uint16).astype(np.uint32)


def running(rows: DataFrame, by: list[str], order: str, value: str, out: str, fan: int = 12) -> DataFrame:
    """``rows`` with ``out``, the sum of ``value`` over earlier rows (by ``order``, unique in the group) of its group ``by``.

    Sums go up from blocks of 2**fan consecutive orders to blocks of blocks, and offsets come down again; no task sees more than one
    block's rows, or the totals of the top level.
    """
    block, top = F.shiftright(F.col(order), fan), F.shiftright(F.col(order), 2 * fan)
    per_block = rows.groupBy(*by, block.alias("rs_block"), top.alias("rs_top")).agg(F.sum(value).alias("rs_sum"))
    per_top = per_block.groupBy(*by, "rs_top").agg(F.sum("rs_sum").alias("rs_sum"))
    earlier = lambda of, keys, by_order: F.coalesce(F.sum(of).over(Window.partitionBy(*keys).orderBy(by_order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = per_top.select(*by, "rs_top", earlier("rs_sum", by, "rs_top").alias("rs_before"))
    offsets = per_block.withColumn("rs_in_top", earlier("rs_sum", [*by, "rs_top"], "rs_block")).join(tops, [*by, "rs_top"])
    offsets = offsets.select(*by, "rs_block", (F.col("rs_in_top") + F.col("rs_before")).alias("rs_offset"))
    rows = rows.withColumn("rs_block", block).withColumn("rs_in", earlier(value, [*by, "rs_block"], order))
    return rows.join(offsets, [*by, "rs_block"]).withColumn(out, F.col("rs_in") + F.col("rs_offset")).drop("rs_block", "rs_in", "rs_offset")


@dataclass(frozen=True)
class Rounds:
    """Queues of ``tokens``, served at ``rates`` (their sum is 1), in windows of ``size`` tokens; each window holds its sources one after the other.

    A source whose quantum is below ``least`` saves its deficit until it can send a grain of that many tokens (its last grain takes the rest);
    the others send what they are owed to the token. Sources begin at different parts of a grain, so small ones do not all fall due together.
    """

    tokens: np.ndarray
    rates: np.ndarray
    size: int
    least: int = 1
    known: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self) -> None:
        grain = np.where(self.rates * self.size >= self.least, 1, self.least)
        grains = np.maximum(1, self.tokens // grain)
        phase = np.where(grain == 1, 0.5, (np.arange(1, len(grain) + 1) * GOLDEN) % 1.0)
        for name, value in (("grain", grain), ("grains", grains), ("phase", phase), ("speed", np.where(grain == 1, self.rates, self.rates * grains / self.tokens))):
            object.__setattr__(self, name, value)

    def due(self, time: np.ndarray) -> np.ndarray:
        """Tokens of each queue (second axis) that are due by each time."""
        sent = np.floor(time[:, None] * self.speed + (1.0 - self.phase)).astype(np.int64)
        return np.where(sent >= self.grains, self.tokens, sent * self.grain)

    def few(self, items: np.ndarray) -> list[np.ndarray]:
        """``items`` in parts, of each of which a matrix by queues is small."""
        return np.array_split(items, max(1, -(-len(items) * len(self.tokens) // MATRIX)))

    def sent(self, window: np.ndarray) -> np.ndarray:
        """Tokens of each queue sent before each window. Of those due at the same moment the first queues' go first."""
        total = np.minimum(window * self.size, self.tokens.sum())
        low, high = np.zeros(len(window)), np.full(len(window), (self.tokens / self.rates).max() * 1.01 + 1.0)
        while True:
            middle = (low + high) / 2
            if not ((low < middle) & (middle < high)).any():
                break
            over = self.due(middle).sum(1) > total
            low, high = np.where(over, low, middle), np.where(over, middle, high)
        before = self.due(low)
        tied = self.due(high) - before
        return before + np.clip((total - before.sum(1))[:, None] - (np.cumsum(tied, axis=1) - tied), 0, tied)

    def edges(self, queue: int, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens that a queue, and that all queues before it, have sent before each window. Windows that other rows of a task asked for are at hand."""
        out = np.empty((2, len(windows)), dtype=np.int64)
        for part in self.few(np.arange(len(windows))):
            missing = [w for w in windows[part].tolist() if w not in self.known]
            if len(missing) + len(self.known) > 4 * MATRIX // len(self.tokens):
                self.known.clear()
                missing = windows[part].tolist()
            if missing:
                found = self.sent(np.array(missing))
                self.known.update(zip(missing, zip(found, np.cumsum(found, axis=1) - found, strict=True), strict=True))
            for at, w in zip(part.tolist(), windows[part].tolist(), strict=True):
                own, ahead = self.known[w]
                out[:, at] = own[queue], ahead[queue]
        return out[0], out[1]

    def windows(self, queue: int, before: int, n: int) -> np.ndarray:
        """Windows that may hold tokens ``before`` to ``before + n`` of a queue, rising; all that do are among them."""
        last = int(self.grains[queue]) - 1
        first, end = (min(t // int(self.grain[queue]), last) for t in (before, before + n - 1))
        if self.grain[queue] == 1:
            low, high = (int(self.due(np.array([(k + 0.5) / self.rates[queue]])).sum()) // self.size for k in (first, end))
            return np.arange(max(0, low - 2), high + 3)
        found = []
        for grains in self.few(np.arange(first, end + 1)):
            time = (grains + self.phase[queue]) / self.speed[queue]
            low, high = (self.due(time * (1 + d)).sum(1) // self.size for d in (-1e-12, 1e-12))
            found += [np.arange(max(0, a - 1), b + 2) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
        return np.unique(np.concatenate(found))

    def pieces(self, queue: int, before: int, lengths: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
        """Document (by its place in ``lengths``), start in it, length, place in the stream, and window of each piece of consecutive documents, of which
        the first begins at token ``before`` of its queue; no piece crosses a window or a multiple of ``length``."""
        n = int(lengths.sum())
        windows = self.windows(queue, before, n)
        windows = np.unique(np.concatenate([windows, windows + 1]))
        own, earlier = self.edges(queue, windows)
        ends = before + np.cumsum(lengths)
        inside = own[(own > before) & (own < before + n)]
        start = np.unique(np.concatenate([ends - lengths, inside]))
        size = np.diff(np.append(start, before + n))
        w = np.searchsorted(own, start, side="right") - 1
        ahead = earlier[w + 1] - earlier[w]
        place = windows[w] * self.size + ahead + start - own[w]
        times = (place + size - 1) // length - place // length + 1
        which = np.repeat(np.arange(len(start)), times)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        low = np.maximum(place[which], (place[which] // length + nth) * length)
        high = np.minimum(place[which] + size[which], (place[which] // length + nth + 1) * length)
        at = start[which] + low - place[which]
        doc = np.searchsorted(ends, at, side="right")
        return doc, at - (ends - lengths)[doc], high - low, low, windows[w][which]


def packed(docs: DataFrame, length: int = 1024, windows_of: int = 64, proportions: dict[str | None, float] | None = None, end: int = 0, path: str | None = None, most_sources: int = 100_000, pieces: int = 900_000) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, window: one row for each piece of a document in a sequence.

    A window is ``windows_of`` sequences of ``length`` tokens; sources of which a window would hold less than a quarter of a sequence send that much at a time. They share a window by ``proportions``, by default by their tokens, so that all queues end
    together; sources not named wait until the others are used up. Only the last sequence can be shorter. A null text is packed as an empty one (its end id
    alone), a null source is a source of its own, a null doc_id stays null, and repeated rows are documents of their own. Other columns are
    ignored; an empty table has no pieces. The driver reads one row a source; more than ``most_sources`` are refused. A worker caches the ids of ``pieces`` pieces of text (about 40 bytes each).
    """
    tokens = tokenized(docs, path or tokenizer_path(), end, pieces)
    totals = tokens.groupBy("source").agg(F.sum("n").alias("n")).limit(most_sources + 1).collect()
    if len(totals) > most_sources:
        raise ValueError(f"more than {most_sources} sources: group them before packing")
    totals = sorted(totals, key=lambda r: (r["source"] is None, r["source"] or ""))
    queues = {r["source"]: i for i, r in enumerate(totals)}
    amounts = np.array([r["n"] for r in totals], dtype=np.int64)
    rates = amounts.astype(np.float64)
    if proportions is not None:
        whole = sum(proportions.values())
        rates = np.array([max(proportions.get(s, 0.0) / whole, 1e-9) for s in queues])
    rounds = Rounds(amounts, rates / max(rates.sum(), 1e-300), length * windows_of, max(1, length // 4))
    queue = F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("0"))
    # a row of three numbers for each source of each block: small enough to be broadcast by its file size, or joined by a shuffle
    starts = staged(running(tokens.select("uid", queue.alias("queue"), "n"), ["queue"], "uid", "n", "before").select("uid", "before"), "pack-starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.strip().split(" ")[0] for x in SCHEMA.split(",")]
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                lengths = np.array(r["lengths"], dtype=np.int64)
                doc, start, size, place, window = rounds.pieces(queues[r["source"]], r["before"], lengths, length)
                ids = widened(r["ids"])
                low = (np.cumsum(lengths) - lengths)[doc] + start
                crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(low.tolist(), size.tolist(), strict=True)]
                columns = [pa.array(r["doc_ids"], pa.int64()).take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, size, crc, lengths[doc], place // length, place % length)), pa.array([r["source"]] * len(doc), pa.string()), pa.array(window, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return tokens.drop("n").join(starts, "uid").select("source", "doc_ids", "lengths", "ids", "before").mapInArrow(run, SCHEMA)

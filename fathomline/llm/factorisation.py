"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score is linear in the number of features of a text: the sum over all pairs of <v_i, v_j> x_i x_j is half of the square of the sum
of v_i x_i less the sum of their squares. The machine is trained in numpy on a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.llm.common import blocks, fresh, kept, only, raw
from fathomline.llm.labelled import labelled_sample, remainder

WORD_SPACE = 1 << 15
BUCKETS = 8
#: Upper edges of the buckets of each structure statistic, the first two from the length (metadata), the others shares of it.
EDGES = {
    "bytes": (64, 256, 512, 1024, 2048, 8192, 32768),
    "words": (5, 20, 50, 100, 300, 1000, 5000),
    "word_length": (2, 3.5, 4.5, 5.5, 6.5, 8, 12),
    "long_words": (0.001, 0.01, 0.05, 0.1, 0.2, 0.4, 0.7),
    "upper": (0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7),
    "digits": (0.001, 0.005, 0.01, 0.03, 0.08, 0.2, 0.5),
    "symbols": (0.0005, 0.002, 0.01, 0.03, 0.06, 0.12, 0.3),
    "bars": (0.0005, 0.002, 0.01, 0.03, 0.06, 0.12, 0.3),
    "exclaims": (0.0005, 0.002, 0.01, 0.03, 0.06, 0.12, 0.3),
    "stops": (0.002, 0.006, 0.012, 0.02, 0.04, 0.08, 0.2),
    "repeated_words": (0.1, 0.3, 0.45, 0.6, 0.7, 0.8, 0.9),
    "top_word": (0.01, 0.03, 0.05, 0.08, 0.12, 0.2, 0.5),
    "repeated_lines": (0.001, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8),
    "repeated_pairs": (0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8),
    "line_words": (2, 5, 10, 20, 40, 80, 200),
}
SPACE = WORD_SPACE + len(EDGES) * BUCKETS


def structure(text: bytes, words: list[bytes], counts: Counter) -> list[float]:
    size, n = max(len(text), 1), max(len(words), 1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    drop = lambda chars: (len(text) - len(text.translate(None, chars))) / size
    pairs = set(zip(words, words[1:], strict=False))
    return [
        len(text), len(words), sum(map(len, words)) / n, sum(len(w) > 14 for w in words) / n,
        drop(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), drop(b"0123456789"), drop(b"#*$%&<>@^~=+_\\/{}[]"), drop(b"|"), drop(b"!"), drop(b".,;:?"),
        1 - len(counts) / n, max(counts.values(), default=0) / n, 1 - len(set(lines)) / max(len(lines), 1), 1 - len(pairs) / max(n - 1, 1), len(words) / max(len(lines), 1),
    ]


EDGE_TABLE = np.array(list(EDGES.values()))
SLOTS: dict[bytes, int] = kept({})


def slot(word: bytes) -> int:
    """Place of a word among the hashed features."""
    if len(SLOTS) > 200_000:
        SLOTS.clear()
    found = SLOTS.get(word)
    if found is None:
        found = SLOTS[word] = xxhash.xxh3_64_intdigest(word) % WORD_SPACE
    return found


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's features. The words have length 1 together, and each statistic has 1 in its bucket."""
    text = text or b""
    words = text.split()
    counts = Counter(words)
    stats = np.array(structure(text, words, counts))
    at = WORD_SPACE + np.arange(len(stats)) * BUCKETS + (stats[:, None] > EDGE_TABLE).sum(1)
    ids = np.fromiter(map(slot, counts), dtype=np.int32, count=len(counts))
    x = np.sqrt(np.fromiter(counts.values(), dtype=np.float32, count=len(counts)))
    if len(x):
        x /= np.linalg.norm(x)
    return np.concatenate([ids, at.astype(np.int32)]), np.concatenate([x, np.full(len(at), 0.5, np.float32)])


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray

    def margins(self, ids: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log odds of each text; its features begin at ``starts``. Every text has features, as it has statistics."""
        xv = self.v[ids] * x[:, None]
        pairs = np.add.reduceat(xv, starts, axis=0) ** 2 - np.add.reduceat(xv * xv, starts, axis=0)
        return self.bias + np.add.reduceat(self.w[ids] * x, starts) + 0.5 * pairs.sum(1)


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, share: float = 0.5, rank: int = 6, epochs: int = 12, batch: int = 128, rate: float = 0.08, penalty: float = 2e-4, seed: int = 5) -> Machine:
    """Logistic loss by AdaGrad over small batches; label 1 has ``share`` of the weight."""
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(SPACE, np.float32), rng.normal(0, 0.02, (SPACE, rank)).astype(np.float32))
    gw, gv, gb = np.full(SPACE, 1e-2, np.float32), np.full((SPACE, rank), 1e-2, np.float32), 1e-2
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for part in np.array_split(order, max(1, len(rows) // batch)):
            lens = np.array([len(rows[i][0]) for i in part])
            starts = np.cumsum(lens) - lens
            ids, x = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
            owner = np.repeat(np.arange(len(part)), lens)
            g = weight[part] * (1 / (1 + np.exp(-np.clip(m.margins(ids, x, starts), -30, 30))) - y[part]) / len(part)
            xv = m.v[ids] * x[:, None]
            sums = np.add.reduceat(xv, starts, axis=0)
            slope = (g[owner] * x)[:, None]
            used, back = np.unique(ids, return_inverse=True)
            dw = np.bincount(back, g[owner] * x, len(used)).astype(np.float32) + penalty * m.w[used]
            each = slope * (sums[owner] - xv)
            dv = np.stack([np.bincount(back, each[:, f], len(used)) for f in range(rank)], 1).astype(np.float32) + penalty * m.v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += g.sum() ** 2
            m.w[used] -= rate * dw / np.sqrt(gw[used])
            m.v[used] -= rate * dv / np.sqrt(gv[used])
            m.bias -= rate * g.sum() / np.sqrt(gb)
    return m


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = 2000, label: str = "quality", modulus: int = 4, held_out: int = 2) -> Machine | float:
    """A machine trained on at most ``per_class`` documents of each class, or the share of label 1 if only one class has labels."""
    sample, counts = labelled_sample(docs, labels, label, modulus, held_out, {0: per_class, 1: per_class})
    if set(counts) != {0, 1}:
        return float(next(iter(counts), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(SLOTS)
        for batch in blocks(batches):
            found = [features(text) for text in raw(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("label"), pa.array([i.tobytes() for i, _ in found]), pa.array([x.tobytes() for _, x in found])], names=["doc_id", "label", "ids", "x"])

    rows = sorted(sample.mapInArrow(run, "doc_id long, label int, ids binary, x binary").collect())  # bounded by the sample
    return train([(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["x"], np.float32)) for r in rows], np.array([r["label"] for r in rows], dtype=float), counts[1] / (counts[0] + counts[1]))


def scored(docs: DataFrame, machine: Machine | float, name: str = "fm_score") -> DataFrame:
    """All columns of ``docs``, and the score as a last column ``name``, which must not be among them; no shuffle. An empty table stays empty."""
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {name} already")
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # SPACE * (rank + 1) floats at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(SLOTS)
        m = sent.value
        for batch in blocks(batches):
            if isinstance(m, float):
                score = np.full(batch.num_rows, m)
            else:
                found = [features(text) for text in raw(batch)]
                lens = np.array([len(i) for i, _ in found])
                margins = m.margins(np.concatenate([i for i, _ in found]), np.concatenate([x for _, x in found]), np.cumsum(lens) - lens)
                score = 1 / (1 + np.exp(-np.clip(margins.astype(np.float64), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def accepted(docs: DataFrame, machine: Machine | float, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the machine scores at ``threshold`` or more, with their columns, whatever these are named."""
    (name,) = fresh(docs, "fm_score")
    return scored(docs, machine, name).filter(F.col(name) >= threshold).drop(name)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document row.

    Null and empty texts are scored by their (zero) statistics; other columns are ignored, an empty table has no rows; a null doc_id is in no fold (held_out null counts as false). Repeated rows
    score alike. Labels of one class only, or none, give all documents that class's score (1 without labels).
    """
    rows = scored(docs.select("doc_id", "text"), fitted(docs, labels, **options))
    held = F.coalesce(remainder(F.col("doc_id"), options.get("modulus", 4)) == options.get("held_out", 2), F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), F.col("fm_score").alias("score"), (F.col("fm_score") >= threshold).cast("int").alias("predicted"))

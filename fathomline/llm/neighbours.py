"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found with a block-max inverted index.

Terms are all words of the labelled sample and their beginnings; their document frequencies are counted over all documents. How strongly a term marks
label 1 in the sample is a factor on its weight. Examples lie in blocks; the index keeps, for each term and block, the largest weight and the examples
that hold the term. A search scores the blocks of the highest upper bounds first, then those whose bound reaches the k-th cosine found; the others
cannot hold a nearer example, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import blocks, raw
from fathomline.llm.labelled import labelled_sample, remainder

#: ASCII capitals to small letters, ASCII punctuation to blanks.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
#: Bytes of the beginnings of words that are terms.
BEGINNINGS = (5, 7)
#: Parts in which document frequencies are added up.
PARTS = 16
#: Texts that are searched together.
TOGETHER = 64


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def forms(word: bytes) -> tuple[int, ...]:
    """64-bit hashes of a word's terms: itself, and its beginnings (marked by a star), which stand for its inflected forms."""
    return tuple(map(xxhash.xxh3_64_intdigest, [word, *(word[:n] + b"*" for n in BEGINNINGS if len(word) > n)]))


class Terms(dict):
    """word -> numbers of its terms in the vocabulary (sorted hashes), or the hashes without one; holds about ``most`` words (270 bytes a word), then gives up the newer half."""

    def __init__(self, vocabulary: np.ndarray | None = None, most: int = 300_000) -> None:
        super().__init__()
        self.vocabulary, self.most = vocabulary, most

    def learn(self, words: set[bytes]) -> None:
        """Looks up the terms of all new words together."""
        for batch in np.array_split(np.array(list(words), dtype=object), -(-len(words) // 20_000)):
            found = [forms(w) for w in batch]
            if self.vocabulary is not None and len(self.vocabulary):
                h = np.fromiter(chain.from_iterable(found), dtype=np.uint64)
                at = np.searchsorted(self.vocabulary, h)
                number = iter(np.where(self.vocabulary.take(at, mode="clip") == h, at, -1).tolist())
                found = [tuple([i for i in islice(number, len(f)) if i >= 0]) for f in found]
            elif self.vocabulary is not None:
                found = [()] * len(found)
            self.update(zip(batch.tolist(), found, strict=True))

    def split(self, texts: list[bytes | None]) -> list[list[bytes]]:
        """The words of each text, whose terms are then known."""
        if len(self) >= self.most:
            for word in list(islice(self, self.most // 2, None)):
                del self[word]
        out = [words_of(text) for text in texts]
        if new := set().union(*out).difference(self):
            self.learn(new)
        return out

    def of(self, texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The terms of each text, rising, and how often each occurs."""
        kind = np.uint64 if self.vocabulary is None else np.int64
        for words in self.split(texts):
            yield np.unique(np.fromiter(chain.from_iterable(map(self.__getitem__, words)), dtype=kind), return_counts=True)

    def sets(self, texts: list[bytes | None]) -> Iterator[list[int]]:
        """The terms of each text, each once."""
        for words in self.split(texts):
            yield list(set(chain.from_iterable(map(self.__getitem__, set(words)))))


def ranges(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """low, low + 1, ... (n of them) for each pair, one after the other."""
    ends = np.cumsum(n)
    return np.repeat(low - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


class BlockMaxIndex:
    """Unit vectors of examples over ``n_terms`` terms, cut into blocks of ``block`` examples.

    Terms that more than a ``frequent`` share of the examples hold are a dense matrix, whose part of the cosines is one product for many searches; the
    others have lists. A block's bound is its largest part from the matrix and, for each other term, the largest weight in the block.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = 32, frequent: float = 0.04) -> None:
        n = self.n = len(vectors)
        heaviest = [ids[np.argmax(w)] if len(ids) else n_terms for ids, w in vectors]
        self.order = np.lexsort((np.arange(n), heaviest))  # like examples share a block, which keeps the bounds low elsewhere
        self.block, self.n_blocks = block, max(1, -(-n // block))
        sizes = np.array([len(vectors[i][0]) for i in self.order], dtype=np.int64)
        term = np.concatenate([vectors[i][0] for i in self.order]) if n else np.zeros(0, np.int64)
        weight = np.concatenate([vectors[i][1] for i in self.order]) if n else np.zeros(0)
        place = np.repeat(np.arange(n), sizes)
        dense = np.bincount(term, minlength=n_terms) > max(8, frequent * n)
        self.row = np.where(dense, np.cumsum(dense) - 1, -1)
        self.matrix = np.zeros((int(dense.sum()), self.n_blocks * block), np.float32)
        mine = dense[term]
        self.matrix[self.row[term[mine]], place[mine]] = weight[mine]
        term, place, weight = term[~mine], place[~mine], weight[~mine]
        by = np.argsort(term, kind="stable")
        term, self.place, self.weight = term[by], place[by].astype(np.int32), weight[by].astype(np.float32)
        # an entry is a term in a block: its largest weight, and where its examples begin in the lists
        key = term * self.n_blocks + self.place // block
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.start = np.append(first, len(key)).astype(np.int64)
        self.of_block = (key[first] % self.n_blocks).astype(np.int32)
        self.top = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0, np.float32)
        self.entries = np.searchsorted(term[first], np.arange(n_terms + 1))

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """For each query the numbers and cosines of its ``k`` nearest examples with a cosine above 0, ties to the smaller number, and how many blocks' lists were read."""
        q = np.zeros((len(queries), len(self.matrix)), np.float32)
        rest = []
        for i, (ids, w) in enumerate(queries):
            row = self.row[ids]
            q[i, row[row >= 0]] = w[row >= 0]
            rest.append((ids[row < 0], w[row < 0]))
        for score, (ids, w) in zip(q @ self.matrix, rest, strict=True):
            yield self.completed(score.astype(np.float64), ids, w, k)

    def completed(self, score: np.ndarray, ids: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        low = self.entries[ids]
        n = self.entries[ids + 1] - low
        e, q = ranges(low, n), np.repeat(w, n)
        block = self.of_block[e]
        bounds = score.reshape(-1, self.block).max(axis=1) + np.bincount(block, q * self.top[e], minlength=self.n_blocks)
        first = min(self.n_blocks, max(-(-2 * k // self.block), self.n_blocks // 12))
        todo = np.argpartition(-bounds, first - 1)
        scored = 0
        done = np.zeros(self.n_blocks, dtype=bool)
        for part in (todo[:first], todo[first:]):
            if scored:
                whole = score.reshape(-1, self.block)[done].ravel()
                part = part[bounds[part] >= np.partition(whole, -k)[-k] - 1e-6]
            scored += len(part)
            chosen = np.zeros(self.n_blocks, dtype=bool)
            chosen[part] = True
            done |= chosen
            mine = chosen[block]
            own = e[mine]
            size = self.start[own + 1] - self.start[own]
            at = ranges(self.start[own], size)
            score += np.bincount(self.place[at], self.weight[at] * np.repeat(q[mine], size), minlength=len(score))
        score = np.where(np.repeat(done, self.block), score, 0.0)
        found = np.flatnonzero(score > 0)
        if len(found) > k:
            found = found[score[found] >= np.partition(score[found], -k)[-k]]
        number = self.order[found]
        best = np.lexsort((number, -score[found]))[:k]
        return number[best], score[found][best], scored


@dataclass
class Voter:
    """The index with its terms, weights, labels and calibration."""

    vocabulary: np.ndarray
    factor: np.ndarray
    index: BlockMaxIndex
    labels: np.ndarray
    ids: np.ndarray
    k: int
    slope: float = 1.0
    shift: float = 0.0

    def vector(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(n)) * self.factor[ids]
        return ids, w / np.linalg.norm(w) if len(w) else w

    def votes(self, queries: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """For each query the sum of the neighbours' cosines, those of label 0 below zero, over ``k``; and the neighbours. ``without``: an example for each that is no neighbour."""
        for i, (near, cosine, _) in enumerate(self.index.search(queries, self.k + (without is not None))):
            if without is not None:
                keep = near != without[i]
                near, cosine = near[keep][: self.k], cosine[keep][: self.k]
            yield float((cosine * (2 * self.labels[near] - 1)).sum() / self.k), near, cosine

    def score(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-(self.slope * margin + self.shift))))


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton's steps, with a small ridge on the slope and a prior on the labels."""
    target = np.where(y == 1, 1 - 1e-3, 1e-3)
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([(weight * (p - target) * margin).sum() + 1e-3 * a, (weight * (p - target)).sum()])
        d = weight * p * (1 - p)
        h = np.array([[(d * margin * margin).sum() + 1e-3, (d * margin).sum()], [(d * margin).sum(), d.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 4.0 / max(1e-9, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
    return float(a), float(b)


def frequencies(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Number of documents, over all, that hold each term. A task sends its counts as a few packed rows."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by the sample
    edges = [len(vocabulary) * p // PARTS for p in range(PARTS + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, total = Terms(sent.value), np.zeros(len(sent.value), dtype=np.int64)
        for batch in blocks(batches):
            total += np.bincount(np.fromiter(chain.from_iterable(terms.sets(raw(batch))), dtype=np.int64), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([total[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary())], names=["part", "counts"])

    def added(pdf):
        pdf = pdf.groupby("part", as_index=False).agg({"counts": lambda c: sum(np.frombuffer(x, np.int64) for x in c).tobytes()})
        return pdf

    counted = docs.select("text").mapInArrow(run, "part int, counts binary").groupBy("part").applyInPandas(added, "part int, counts binary")
    df = np.zeros(len(vocabulary), dtype=np.int64)
    for r in counted.collect():  # PARTS rows, a number a term together
        df[edges[r["part"]] : edges[r["part"] + 1]] = np.frombuffer(r["counts"], np.int64)
    return df


def strength(a: np.ndarray, b: np.ndarray, n1: int, n0: int, min_lift: float = 6.0) -> np.ndarray:
    """Factor of each term: 1, and for terms ``min_lift`` times as frequent under label 1 up to about 10 + z more, as far as z, their distance from chance, is sure."""
    share = (a + b) / (n1 + n0)
    z = np.maximum(0.0, (a / n1 - b / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n1 + 1 / n0)))
    lift = ((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1))
    return 1 + np.where(lift > min_lift, (10 + z) * z**3 / (z**3 + 64), 0.0)


def fitted(docs: DataFrame, labels: DataFrame, per_class: dict[int, int] | None = None, k: int = 12, label: str = "toxic", modulus: int = 3, held_out: int = 1, calibrated: int = 1500) -> Voter | float:
    """A voter over at most ``per_class`` examples of each label, or 0.0 / 1.0 if only one label occurs. ``calibrated`` examples, each without itself, fit the scores' curve."""
    sample, counts = labelled_sample(docs, labels, label, modulus, held_out, per_class or {0: 1500, 1: 900})
    if set(counts) != {0, 1}:
        return float(next(iter(counts), 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("label"), pa.array([b" ".join(sorted(words_of(x))) for x in raw(batch)], pa.binary())], names=["doc_id", "label", "words"])

    rows = sample.mapInArrow(run, "doc_id long, label int, words binary").groupBy("words", "label").agg(F.min("doc_id").alias("doc_id")).collect()  # bounded by the sample
    rows = sorted(((r["doc_id"], r["label"], bytes(r["words"])) for r in rows))
    y = np.array([r[1] for r in rows])
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    held = list(Terms().of([r[2] for r in rows]))
    vocabulary = np.unique(np.concatenate([h for h, _ in held])) if held else np.zeros(0, np.uint64)
    held = [(np.searchsorted(vocabulary, h), n) for h, n in held]
    marked = [np.bincount(np.concatenate([h for (h, _), own in zip(held, y, strict=True) if own == v] or [np.zeros(0, np.int64)]), minlength=len(vocabulary)) for v in (0, 1)]
    idf = np.log((docs.count() + 1) / (frequencies(docs, vocabulary) + 1)) + 1
    voter = Voter(vocabulary, idf * strength(marked[1], marked[0], n1, n0), BlockMaxIndex([], 1), y, np.array([r[0] for r in rows]), k)
    vectors = [voter.vector(*v) for v in held]
    voter.index = BlockMaxIndex(vectors, len(vocabulary))
    every = [np.flatnonzero(y == v)[:: max(1, -(-int((y == v).sum()) * 2 // calibrated))] for v in (0, 1)]
    tried = np.concatenate(every)
    margin = np.array([m for part in np.array_split(tried, -(-len(tried) // TOGETHER)) for m, _, _ in voter.votes([vectors[i] for i in part], part.tolist())])
    share = counts[1] / (counts[0] + counts[1])
    weight = np.where(y[tried] == 1, share / max(1, len(every[1])), (1 - share) / max(1, len(every[0]))) * len(tried)
    voter.slope, voter.shift = platt(margin, y[tried], weight)
    return voter


def scored(docs: DataFrame, voter: Voter | float) -> DataFrame:
    """doc_id, score, margin and evidence (labelled examples with their cosines, nearest first) of each document row; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(voter)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        terms = None if isinstance(v, float) else Terms(v.vocabulary)
        memo: dict[bytes, tuple] = {}  # equal texts are searched once
        shape = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))
        for batch in blocks(batches):
            texts = raw(batch)
            keys = [xxhash.xxh3_128_digest(text or b"") for text in texts]
            if len(memo) > 20_000:
                memo.clear()
            new = list({key: text for key, text in zip(keys, texts, strict=True) if key not in memo}.items())
            for start in range(0, len(new), TOGETHER):
                part = new[start : start + TOGETHER]
                votes = ((0.0, [], []) for _ in part) if terms is None else v.votes([v.vector(*x) for x in terms.of([text for _, text in part])])
                for (key, _), (margin, near, cosine) in zip(part, votes, strict=True):
                    memo[key] = v if terms is None else v.score(margin), margin, [{"doc_id": int(v.ids[i]), "label": int(v.labels[i]), "cosine": float(c)} for i, c in zip(near, cosine, strict=True)]
            scores, margins, evidence = zip(*map(memo.__getitem__, keys), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64()), pa.array(evidence, shape)], names=["doc_id", "score", "margin", "evidence"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, margin double, evidence array<struct<doc_id: long, label: int, cosine: double>>")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence: one row per document row.

    A text without any of the sample's terms (null and empty ones too) has no neighbours and gets the calibrated score of that. A null doc_id is in
    no fold (held_out false). Repeated rows score alike; equal examples of one label count once. Labels of one class only, or none,
    give every document that class's score (0 without labels). Other columns are ignored, whatever their names; an empty table has no rows.
    """
    held = F.coalesce(remainder(F.col("doc_id"), options.get("modulus", 3)) == options.get("held_out", 1), F.lit(False))
    rows = scored(docs, fitted(docs, labels, **options))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")

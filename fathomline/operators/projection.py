"""Vectors of fixed length from sparse ones, and matching of records with a catalogue in one of two spaces."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from fathomline.operators import search

#: In a search that compares all with all: items looked at together, and queries; queries of a group and items of a part, at most; parts that are made where there are items enough.
ROWS, ASKED, GROUP, PART, TASKS = 1024, 2048, 8192, 65536, 64
#: Terms whose places a task keeps at most.
KNOWN = 200_000
#: Scores that differ by less may be equal when rounded to 6 places.
ROUNDED = 1.5e-6


def projected(weights: DataFrame, key: str, dim: int, spread: int = 16, seed: int = 0) -> DataFrame:
    """key, dim, v: the weights (key, term, w) as vectors of ``dim`` places, of length 1, zeros left out.

    Inner products are kept in the mean (Johnson and Lindenstrauss); the error falls with the square root of ``dim``.
    """
    def places(term: str) -> tuple[int, ...]:
        """Twice each of a term's places, and one more where its sign is negative: from digests of the term, so no matrix is stored and new terms need none."""
        digests = (hashlib.md5(f"{seed}:{r}:{term}".encode()).hexdigest() for r in range(spread))
        return tuple(int(h[:12], 16) % dim * 2 + int(h[12:16], 16) % 2 for h in digests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            if len(known) > KNOWN:
                known.clear()
            terms, keys = batch.column("term").dictionary_encode(), batch.column(key).dictionary_encode(null_encoding="encode")
            at = np.array([known.get(t) or known.setdefault(t, places(t)) for t in terms.dictionary.to_pylist()], dtype=np.int64).reshape(-1, spread)[terms.indices.to_numpy()]
            w = batch.column("w").to_numpy()
            units = (np.sign(w) * np.floor(np.abs(w) * 1e12 + 0.5)).astype(np.int64)[:, None]
            cell = keys.indices.to_numpy().astype(np.int64)[:, None] * dim + (at >> 1)
            cells, number = np.unique(cell, return_inverse=True)
            sums = np.zeros(len(cells), dtype=np.int64)
            np.add.at(sums, number.ravel(), np.where(at & 1, -units, units).ravel())
            yield pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(cells // dim)), pa.array(cells % dim), pa.array(sums)], schema=arrow)

    shape = T.StructType([T.StructField(key, weights.schema[key].dataType), T.StructField("dim", T.LongType()), T.StructField("units", T.LongType())])
    arrow = to_arrow_schema(shape)
    # a batch's weights are added up before they are shuffled, in whole units of the twelfth place, so that their order does not matter
    parts = weights.select(key, "term", "w").dropna(subset=["term", "w"]).mapInArrow(run, shape).repartition(key)
    sums = parts.groupBy(key, "dim").agg((F.sum("units") / 1e12).alias("v")).filter("v != 0")
    return sums.withColumn("v", F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key))))


def dense(vectors: DataFrame, key: str, dim: int) -> DataFrame:
    """key, e: the places of :func:`projected` as arrays."""
    found = vectors.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("dim", "v"))).alias("m"))
    return found.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.coalesce(F.try_element_at("m", k.cast("long")), F.lit(0.0))).alias("e"))


def nearest(queries: DataFrame, items: DataFrame, query: str, item: str, vector: str, k: int, others: bool = False, buckets: str | None = None, least: float | None = None) -> DataFrame:
    """query, item, score (inner product), rank: the ``k`` best items of each query, ties to the smaller item; with ``others`` never the query itself.

    Queries are cut into groups and items into parts, and every group meets every part: a task holds one group and reads the part's items past it, so no pair of blocks is a row, nothing
    goes through the driver, and a task passes on what can be among the ``k`` best of a query. Rows are copied once a part or group, of which there are few. With ``buckets`` (array<int> of
    both) a pair is looked at only where some place of the two is equal; ``least`` is a score that it must exceed. Vectors must be of one length; null vectors take no part. With ``others`` query and item keys are of one type.
    """
    kind = items.schema[item].dataType.simpleString()
    shared = [F.col(buckets).alias("h")] if buckets else []
    own = queries.schema[query].dataType.simpleString()
    q = queries.filter(F.col(vector).isNotNull()).select(F.lit(0).alias("side"), F.col(query).alias("own"), F.lit(None).cast(kind).alias("key"), F.col(vector).cast("array<double>").alias("e"), *shared)
    b = items.filter(F.col(vector).isNotNull()).select(F.lit(1).alias("side"), F.lit(None).cast(own).alias("own"), F.col(item).alias("key"), F.col(vector).cast("array<double>").alias("e"), *shared)
    n_queries, n_items = q.count(), b.count()
    groups, parts = max(1, -(-n_queries // GROUP)), max(1, -(-n_items // PART), min(TASKS, -(-n_items // ROWS)))
    one_of = lambda n: F.pmod(F.xxhash64("own", "key", "e"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("group", one_of(groups)).withColumn("part", every(parts))
    b = b.withColumn("part", one_of(parts)).withColumn("group", every(groups))
    met = q.unionByName(b).repartition(groups * parts, "group", "part").sortWithinPartitions("group", "part", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best = None, None
        for batch in batches:
            cells = np.stack([batch.column(c).to_numpy() for c in ("group", "part", "side")], axis=1)
            cuts = np.flatnonzero((cells[1:] != cells[:-1]).any(axis=1)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(cells)], strict=True):
                if start == end:
                    continue
                if at != (cell := tuple(cells[start, :2].tolist())):
                    if best is not None:
                        yield best.rows(shape)
                    at, best = cell, Best(k, others, least)
                for low in range(start, end, ROWS):
                    rows = batch.slice(low, min(low + ROWS, end) - low)
                    best.ask(rows) if cells[start, 2] == 0 else best.look(rows)
        if best is not None:
            yield best.rows(shape)

    out = T.StructType([T.StructField(query, queries.schema[query].dataType), T.StructField(item, items.schema[item].dataType), T.StructField("score", T.DoubleType())])
    shape = to_arrow_schema(out)
    found = met.mapInArrow(run, out).withColumn("score", search.rounded(F.col("score"), 6))
    w = Window.partitionBy(query).orderBy(F.desc("score"), item)
    return found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


class Best:
    """The items that can be among the ``k`` best of each of a group's queries, of the items looked at so far."""

    def __init__(self, k: int, others: bool, least: float | None) -> None:
        self.k, self.others, self.least = k, others, least
        self.asked: list[tuple] = []
        self.queries: tuple | None = None
        self.found: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        self.waiting = 0

    def read(self, rows: pa.RecordBatch, key: str) -> tuple:
        """Keys, vectors and buckets."""
        lengths = np.unique(pc.list_value_length(rows.column("e")).to_numpy(zero_copy_only=False))
        if len(lengths) > 1:
            raise ValueError(f"vectors of {lengths[0]} and of {lengths[1]} dimensions")
        flat = [rows.column(c).flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1) for c in ("e", "h") if c in rows.schema.names]
        return rows.column(key), flat[0].astype(np.float64, copy=False), flat[1] if len(flat) > 1 else None

    def ask(self, rows: pa.RecordBatch) -> None:
        self.asked.append(self.read(rows, "own"))

    def look(self, rows: pa.RecordBatch) -> None:
        if not self.asked:
            return
        if self.queries is None:
            keys, e, h = zip(*self.asked, strict=True)
            if len(sizes := sorted({x.shape[1] for x in e})) > 1:
                raise ValueError(f"vectors of {sizes[0]} and of {sizes[1]} dimensions")
            self.queries = pa.concat_arrays(keys), np.concatenate(e), np.concatenate(h) if h[0] is not None else None
            self.edge = np.full(len(self.queries[0]), -np.inf)
        own, x, own_h = self.queries
        keys, y, h = self.read(rows, "key")
        if x.shape[1] != y.shape[1]:
            raise ValueError(f"vectors of {x.shape[1]} and of {y.shape[1]} dimensions")
        for low in range(0, len(x), ASKED):
            mine = slice(low, low + ASKED)
            score = x[mine] @ y.T
            score[~np.isfinite(score)] = -np.inf
            if self.others:
                score[own[mine].to_numpy(zero_copy_only=False)[:, None] == keys.to_numpy(zero_copy_only=False)[None, :]] = -np.inf
            if self.least is not None:
                score[score <= self.least] = -np.inf
            if h is not None:
                meets = np.zeros(score.shape, dtype=bool)
                for t in range(h.shape[1]):
                    meets |= own_h[mine, t][:, None] == h[:, t][None, :]
                score[~meets] = -np.inf
            near = (score >= self.edge[mine][:, None] - ROUNDED) & (score > -np.inf)
            if score.shape[1] > self.k and near.sum() > 4 * self.k * len(score):
                self.edge[mine] = np.maximum(self.edge[mine], np.partition(score, -self.k, axis=1)[:, -self.k])
                near = (score >= self.edge[mine][:, None] - ROUNDED) & (score > -np.inf)
            row, column = np.nonzero(near)
            self.found.append((row + low, keys.take(pa.array(column)), score[row, column]))
            self.waiting += len(row)
        if self.waiting > 16 * self.k * len(x):
            self.settle()

    def settle(self) -> None:
        """Drops what ``k`` better items of its query leave no place for; scores that are rounded later may tie. Of equal scores the ``k`` smallest keys are enough."""
        row, key, score = np.concatenate([f[0] for f in self.found]), pa.concat_arrays([f[1] for f in self.found]), np.concatenate([f[2] for f in self.found])
        order = np.lexsort((pc.rank(key, tiebreaker="dense").to_numpy(), -score, row))
        row, score = row[order], score[order]
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, dtype=np.int64)
        size = np.diff(np.append(first, len(row)))
        full = size >= self.k
        self.edge[row[first[full]]] = np.maximum(self.edge[row[first[full]]], score[first[full] + self.k - 1])
        run = np.concatenate([[True], (row[1:] != row[:-1]) | (score[1:] != score[:-1])]) if len(row) else np.zeros(0, dtype=bool)
        place = np.arange(len(row)) - np.maximum.accumulate(np.where(run, np.arange(len(row)), 0))
        keep = (score >= self.edge[row] - ROUNDED) & (place < self.k)
        self.found = [(row[keep], key.take(pa.array(order[keep])), score[keep])]
        self.waiting = len(self.found[0][0])

    def rows(self, shape: pa.Schema) -> pa.RecordBatch:
        if not self.found:
            return pa.RecordBatch.from_pylist([], schema=shape)
        self.settle()
        row, key, score = self.found[0]
        return pa.RecordBatch.from_arrays([self.queries[0].take(pa.array(row)).cast(shape.field(0).type), key.cast(shape.field(1).type), pa.array(score)], schema=shape)


def catalogue_matches(records: DataFrame, catalogue: DataFrame, key: str, entry: str, described: str, k: int = 3) -> DataFrame:
    """key, entry, score, rank: the best catalogue entries of each record, scores above 0 only, in one of two spaces that are never mixed.

    Where the catalogue has embeddings (all entries or none), records are matched by theirs: records without one have no match, another length is an error. Where it has none, they are
    matched by the terms of ``described`` (a text column of both); a record with an embedding is an error then. ``embedding`` is a column of both.
    """
    n, embedded, lengths = catalogue.agg(F.count("*"), F.count("embedding"), F.count_distinct(F.size("embedding"))).first()
    if embedded not in (0, n) or embedded and lengths > 1:
        raise ValueError(f"{embedded} of {n} entries have embeddings, of {lengths} lengths")
    if embedded:
        e = F.transform("embedding", lambda v: v.cast("double"))
        length = F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, v: a + v * v))
        unit = lambda rows, name: rows.filter("size(embedding) > 0").select(name, F.transform(e, lambda v: v / F.when(length > 0, length).otherwise(1.0)).alias("e"))
        return nearest(unit(records, key), unit(catalogue, entry), key, entry, "e", k).filter("score > 0")
    if records.filter("size(embedding) > 0").limit(1).count():
        raise ValueError("a record carries an embedding, the catalogue does not")
    weights, idf = search.index(catalogue, entry, described)
    return search.top(search.scores(search.weighted(search.terms(records, key, described), idf, key), weights, key, entry), key, entry, k).select(key, entry, "score", "rank")

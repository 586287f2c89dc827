"""Approximate nearest neighbours: multiprobe p-stable hashing with exact reranking.

A table hashes a unit vector x to the cells floor((a.x + b) / w) of several Gaussian directions a. A query visits, in each table, its own bucket and
those it gets by moving to neighbouring cells, in the order of their estimated chance to hold a near vector: the expected squared
distances to the nearest cell borders (their order statistics) rank the sets of moves once for all queries. How many buckets to visit follows from the distance of
true neighbours, measured for a bounded sample of queries against all vectors. Only pairs that share a bucket are scored: one by one where they are few,
by a masked product where they are many. Queries and vectors of one part of a table meet in a task, where vectors stream past the queries, so neither is copied for each block of the other.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.llm.common import MIX_1, mixed, staged

#: Vectors in a block of one part of one table, at most; queries in one; queries of a group, which a task holds at once; best candidates that a task holds before it passes them on.
BLOCK, ASKED, GROUP, HELD = 4096, 128, 16384, 1_000_000
#: Pairs of a query and a vector that are looked at together.
PAIRS = 1 << 22
#: Pairs of a query and a vector are scored one by one below this share of those looked at, and by one product masked to them above it, which is as cheap as a fiftieth of the pairs one by one.
PRODUCT = 0.02
#: Tasks that compare, at most.
MOST = 512
#: How far cosines in single precision may be off.
ROUGH = 1e-5


@dataclass(frozen=True)
class Tables:
    tables: int = 8
    directions: int = 8
    width: float = 1.4
    #: Share of true neighbours that the visits are planned to find.
    target: float = 0.94
    #: Buckets that a query may visit in a table.
    most: int = 8192
    sample: int = 64
    seed: int = 3

    def projections(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        return rng.normal(size=(dim, self.tables * self.directions)), rng.uniform(0, self.width, self.tables * self.directions)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Places of unit vectors along all directions, in cells: (rows, tables, directions)."""
        a, b = self.projections(x.shape[1])
        return ((x @ a + b) / self.width).reshape(len(x), self.tables, self.directions)


def move_sets(k: int, most: int) -> list[tuple[int, ...]]:
    """Sets of moves, by rank of their border's distance among the 2k, in the order of the expected sum of squared distances."""
    j = np.arange(1, 2 * k + 1)
    z = np.where(j <= k, j * (j + 1) / (4.0 * (k + 1) * (k + 2)), 1 - (2 * k + 1 - j) / (k + 1) + (2 * k + 1 - j) * (2 * k + 2 - j) / (4.0 * (k + 1) * (k + 2)))
    out: list[tuple[int, ...]] = [()]
    heap = [(z[0], (0,))]
    while heap and len(out) < most:
        cost, moves = heapq.heappop(heap)
        if not any(2 * k - 1 - m in moves for m in moves):  # both borders of one direction
            out.append(moves)
        last = moves[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (cost - z[last] + z[last + 1], (*moves[:-1], last + 1)))
            heapq.heappush(heap, (cost + z[last + 1], (*moves, last + 1)))
    return out


def bucket(cells: np.ndarray) -> np.ndarray:
    """64-bit keys of integer cells along the last axis."""
    key = np.zeros(cells.shape[:-1], dtype=np.uint64)
    for i in range(cells.shape[-1]):
        key = mixed(key * MIX_1 + cells[..., i].astype(np.int64).astype(np.uint64))
    return key


def visits(places: np.ndarray, sets: list[tuple[int, ...]]) -> np.ndarray:
    """Cells of the buckets that queries visit: (rows, sets, directions) of places (rows, directions)."""
    own = np.floor(places)
    f = places - own
    k = places.shape[1]
    order = np.argsort(np.concatenate([f, 1 - f], axis=1), axis=1, kind="stable")
    out = np.repeat(own[:, None, :], len(sets), axis=1)
    rows = np.arange(len(places))
    for s, moves in enumerate(sets):
        for m in moves:
            at = order[:, m]
            out[rows, s, at % k] += np.where(at < k, -1, 1)
    return out


def needed_moves(places: np.ndarray, goal: np.ndarray) -> list[tuple[int, ...] | None]:
    """For each row of ``places`` the one set of moves (see :func:`move_sets`) that leads to the cell of ``goal``; None where a cell is further than one off."""
    f, k = places - np.floor(places), places.shape[1]
    off = (np.floor(goal) - np.floor(places)).astype(int)
    rank = np.argsort(np.argsort(np.concatenate([f, 1 - f], axis=1), axis=1, kind="stable"), axis=1)
    moved = np.concatenate([off == -1, off == 1], axis=1)
    near = (np.abs(off) <= 1).all(axis=1)
    return [tuple(sorted(r[m].tolist())) if ok else None for r, m, ok in zip(rank, moved, near, strict=True)]


def planned(tables: Tables, distance: float, trials: int = 800) -> int:
    """Number of visits a table with which ``target`` of the vectors at ``distance`` are found by one table or another; ``most`` at most.

    A neighbour's cell fixes the moves that lead to it, so a trial is one look at the place of that set in the order of visits.
    """
    rng = np.random.default_rng(tables.seed + 1)
    k = tables.directions
    sets = move_sets(k, min(3**k, tables.most))
    f = rng.uniform(size=(trials, k))
    goal = f + rng.normal(size=(trials, k)) * distance / tables.width
    turn = {moves: i for i, moves in enumerate(sets)}
    turns = [turn[m] for m in needed_moves(f, goal) if m in turn]
    found = np.cumsum(np.bincount(turns, minlength=len(sets)) / trials)
    enough = np.flatnonzero(1 - (1 - np.minimum(found, 1)) ** tables.tables >= tables.target)
    return int(enough[0]) + 1 if len(enough) else len(sets)


def candidate_share(x: np.ndarray, q: np.ndarray, tables: Tables, visited: int) -> np.ndarray:
    """For each query, the share of the vectors that lie in a bucket it visits in some table; what hashing saves."""
    sets = move_sets(tables.directions, visited)
    at, asked = tables.cells(unit(x)), tables.cells(unit(q))
    seen = np.zeros((len(q), len(x)), dtype=bool)
    for t in range(tables.tables):
        key, visit = bucket(np.floor(at[:, t])), bucket(visits(asked[:, t], sets))
        for i in range(len(q)):
            seen[i] |= np.isin(key, visit[i])
    return seen.mean(axis=1)


def usable(column: Column) -> Column:
    """Arrays without null, NaN or infinite parts that are not all zero."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return column.isNotNull() & (F.size(column) > 0) & finite & F.exists(column, lambda x: x != 0)


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    values = batch.column("embedding")
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return unit(q) @ unit(x).T


def neighbour_distance(vectors: DataFrame, queries: DataFrame, k: int, sample: int, seed: int) -> float:
    """The distance within which nine tenths of a bounded sample of queries have their k-th neighbour, over all vectors."""
    rows = queries.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample).collect()  # at most ``sample``
    if not rows:
        return 1.0
    ids, q = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(q), k), -1.0)
        for batch in batches:
            if batch.num_rows:
                c = cosines(q, matrix(batch))
                c[ids[:, None] == batch.column("vec_id").to_numpy()[None, :]] = -1.0
                best = -np.sort(-np.concatenate([best, c], axis=1), axis=1)[:, :k]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q)), k)), pa.array(best.ravel())], names=["query", "cosine"])

    found = vectors.mapInArrow(run, "query long, cosine double")
    kth = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine")))).filter(F.col("r") == k)
    at = kth.agg(F.percentile(F.sqrt(F.greatest(2 - 2 * F.col("cosine"), F.lit(0.0))), 0.9)).first()[0]
    return float(at) if at else 1.0


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, tables: Tables | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest vectors found for each query by cosine, nearest first, ties to the smaller vec_id.

    A query that finds fewer than ``k`` in its buckets is compared with all vectors.

    Columns vec_id and embedding. Null, empty or zero vectors, null or non-finite parts, and null ids take no part; of vectors of another
    length than the most frequent one too. Rows that share a vec_id are one candidate, by its best score; a query's own id is no candidate. Other columns are ignored.
    """
    tables = tables or Tables()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    schema = "query_id long, vec_id long, score double"
    dims = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("embedding") == dims["d"])
    queries = rows.filter(is_query)
    n_rows, n_queries = rows.count(), queries.count()
    sets = move_sets(tables.directions, planned(tables, neighbour_distance(rows, queries, k, tables.sample, tables.seed)))
    parts = max(1, -(-n_rows // (4 * BLOCK)))

    def dealt(batches: Iterator[pa.RecordBatch], probing: bool, hashed: bool = True) -> Iterator[pa.RecordBatch]:
        """One row for each table and part: the keys, ids and unit vectors of a block. Without hashing a vector lies in one part and a query goes to all."""
        size = ASKED if probing else BLOCK
        for whole in batches:
            for start in range(0, whole.num_rows, size):
                batch = whole.slice(start, size)
                x, ids = unit(matrix(batch)), batch.column("vec_id").to_numpy()
                places = tables.cells(x) if hashed else None
                out = []
                for t in range(tables.tables if hashed else 1):
                    if not hashed:
                        row = np.repeat(np.arange(len(x)), parts) if probing else np.arange(len(x))
                        key = np.tile(np.arange(parts), len(x)).astype(np.uint64) if probing else ids.astype(np.uint64) % np.uint64(parts)
                    elif probing:
                        keys = bucket(visits(places[:, t], sets))
                        row, key = np.repeat(np.arange(len(x)), keys.shape[1]), keys.ravel()
                    else:
                        row, key = np.arange(len(x)), bucket(np.floor(places[:, t]))
                    part = (key % np.uint64(parts)).astype(np.int64)
                    for p in np.unique(part):
                        mine = np.flatnonzero(part == p)
                        if probing:  # in the order of the keys, in which vectors look them up
                            mine = mine[np.argsort(key[mine], kind="stable")]
                        used, local = np.unique(row[mine], return_inverse=True)
                        out.append((t, int(p), key[mine].tobytes(), local.astype(np.int32).tobytes(), ids[used].tobytes(), x[used].tobytes()))
                if out:
                    columns = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)], names=["table", "part", "keys", "rows", "ids", "vectors"])

    def best_of(q_ids: np.ndarray, ids: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best candidates of each query, each candidate once by its best score."""
        order = np.lexsort((-score, ids, q_ids))
        q_ids, ids, score = q_ids[order], ids[order], score[order]
        first = np.ones(len(ids), dtype=bool)
        first[1:] = (q_ids[1:] != q_ids[:-1]) | (ids[1:] != ids[:-1])
        q_ids, ids, score = q_ids[first], ids[first], score[first]
        order = np.lexsort((ids, -score, q_ids))
        q_ids, ids, score = q_ids[order], ids[order], score[order]
        start = np.flatnonzero(np.concatenate([[True], q_ids[1:] != q_ids[:-1]])) if len(q_ids) else np.zeros(0, dtype=np.int64)
        place = np.arange(len(q_ids)) - np.repeat(start, np.diff(np.append(start, len(q_ids))))
        return q_ids[place < k], ids[place < k], score[place < k]

    class Asked:
        """The queries of one group in one part of one table, with the nearest candidates found so far."""

        def __init__(self, rows: list[dict], best: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
            read = lambda name, kind: [np.frombuffer(r[name], kind) for r in rows]
            self.ids = np.concatenate(read("ids", np.int64))
            self.x = np.concatenate(read("vectors", np.float64)).reshape(-1, dims["d"])
            sizes = np.cumsum([0, *(len(v) for v in read("ids", np.int64))])
            key, row = np.concatenate(read("keys", np.uint64)), np.concatenate([v + start for v, start in zip(read("rows", np.int32), sizes, strict=False)])
            order = np.argsort(key, kind="stable")
            self.key, self.row = key[order], row[order]
            self.rough = self.x.astype(np.float32)
            self.told(best)

        def told(self, best: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
            """What a candidate must reach: the k-th best that is held of each query."""
            q_ids, _, score = best
            last = np.flatnonzero(np.append(q_ids[1:] != q_ids[:-1], True)) if len(q_ids) else np.zeros(0, dtype=np.int64)
            first = np.append(0, last[:-1] + 1)[: len(last)]
            full = last - first + 1 >= k
            known, kth = q_ids[last[full]], score[last[full]]
            at = np.minimum(np.searchsorted(known, self.ids), max(0, len(known) - 1))
            self.edge = np.where(known[at] == self.ids, kth[at], -np.inf) if len(known) else np.full(len(self.ids), -np.inf)

        def look(self, key: np.ndarray, member: np.ndarray, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Query, vector and cosine of the pairs that share a bucket and can be among the nearest."""
            low, high = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
            seen = np.zeros((len(self.x), len(x)), dtype=bool)
            n = high - low
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            seen[self.row[np.repeat(low, n) + within], np.repeat(member, n)] = True
            seen &= self.ids[:, None] != ids[None, :]
            if np.count_nonzero(seen) > PRODUCT * seen.size:
                rough = np.where(seen, self.rough @ x.astype(np.float32).T, np.float32(-np.inf))
                edge = self.edge
                if rough.shape[1] > k and np.isinf(edge).any() and len(np.unique(ids)) == len(ids):
                    edge = np.maximum(edge, np.partition(rough, -k, axis=1)[:, -k] - ROUGH)
                seen &= rough >= (edge - ROUGH).astype(np.float32)[:, None]
            row, column = np.nonzero(seen)
            # sums in one order, so that equal vectors score alike wherever they lie
            score = np.concatenate([(self.x[row[i : i + 65536]] * x[column[i : i + 65536]]).sum(axis=1) for i in range(0, len(row), 65536)] or [np.zeros(0)])
            return self.ids[row], ids[column], score

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nearest vectors to each query among those that share a bucket. Rows of one part of a table and one group come together, the queries first."""

        def passed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held[0], pa.int64()), pa.array(held[1], pa.int64()), pa.array(held[2], pa.float64())], names=["query_id", "vec_id", "score"])

        def met() -> None:
            """Looks at the vectors that wait, some at a time."""
            nonlocal held, waiting, asking
            if asking and waiting:
                group = asking = Asked(asking, held) if isinstance(asking, list) else asking
                start = np.cumsum([0, *(len(r["ids"]) // 8 for r in waiting)])
                key, member = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in waiting]), np.concatenate([np.frombuffer(r["rows"], np.int32) + a for r, a in zip(waiting, start, strict=False)])
                ids, x = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in waiting]), np.concatenate([np.frombuffer(r["vectors"]) for r in waiting]).reshape(-1, dims["d"])
                order = np.argsort(member, kind="stable")
                key, member = key[order], member[order]
                step = max(1, PAIRS // len(group.ids))
                for low in range(0, len(ids), step):
                    a, b = np.searchsorted(member, [low, low + step])
                    found = group.look(key[a:b], member[a:b] - low, ids[low : low + step], x[low : low + step])
                    if len(found[0]):
                        held = best_of(*(np.concatenate([p, q]) for p, q in zip(held, found, strict=True)))
                        group.told(held)
            waiting = []

        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        held, at, asking, waiting, size = empty, None, [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if at != (cell := (r["table"], r["part"], r["group"])):
                    met()
                    at, asking, size = cell, [], 0
                    if len(held[0]) > HELD:
                        yield passed()
                        held = empty
                if r["side"] == 0:
                    asking.append(r)
                elif asking:
                    waiting.append(r)
                    size += len(r["ids"]) // 8
                    if size >= BLOCK:
                        met()
                        size = 0
        met()
        yield passed()

    shape = "table int, part int, keys binary, rows binary, ids binary, vectors binary"

    def searched(queries: DataFrame, hashed: bool) -> DataFrame:
        groups = max(1, -(-n_queries // GROUP))
        asked = queries.repartition(max(1, -(-n_queries // ASKED)), "vec_id").mapInArrow(lambda it: dealt(it, True, hashed), shape)
        asked = asked.select("*", F.lit(0).alias("side"), F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int").alias("group"))
        held = rows.mapInArrow(lambda it: dealt(it, False, hashed), shape).select("*", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
        by = ["table", "part", "group"]
        cells = (tables.tables if hashed else 1) * parts * groups
        found = asked.unionByName(held).repartition(min(cells, MOST), *by).sortWithinPartitions(*by, "side").mapInArrow(compared, schema)
        best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
        return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = staged(searched(queries, True), "nearest-found")
    # queries whose buckets held too few vectors are compared with all
    whole = found.groupBy("query_id").count().filter(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    short = staged(queries.hint("merge").join(whole, "vec_id", "left_anti").select("vec_id", "embedding"), "nearest-short")
    if short.isEmpty():
        return found
    return found.hint("merge").join(whole, found["query_id"] == whole["vec_id"], "left_semi").unionByName(searched(short, False))

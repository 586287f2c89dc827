"""Order-dependent operators: one pass over each group's rows in a fixed order, grouped by Spark."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window


def widened(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(name, kind)])


def changes(rows: pa.RecordBatch | pa.Table, by: list[str]) -> np.ndarray:
    """Places where another group begins, the first row left out."""
    new = np.zeros(max(0, rows.num_rows - 1), dtype=bool)
    for c in by:
        a, b = rows.column(c).slice(1), rows.column(c).slice(0, max(0, rows.num_rows - 1))
        other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        new |= other.to_numpy(zero_copy_only=False) if isinstance(other, pa.Array) else other.to_numpy()
    return np.flatnonzero(new) + 1


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[list[pa.RecordBatch]]:
    """Rows sorted by group, in lists of batches that hold whole groups only."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and held[-1].slice(held[-1].num_rows - 1).select(by).to_pylist() != batch.slice(0, 1).select(by).to_pylist():
            yield held
            held = []
        cuts = changes(batch, by)
        if len(cuts):
            yield [*held, batch.slice(0, int(cuts[-1]))]
            held = [batch.slice(int(cuts[-1]))]
        else:
            held.append(batch)
    if held:
        yield held


def pointed(rows: DataFrame, by: list[str], name: str, columns: list[str], point: Callable[..., np.ndarray]) -> DataFrame:
    """``rows`` with ``name``, the id of the row of their group at the place that ``point`` gives for each.

    A group's rows come by falling score, then id, sorted by Spark; ``point`` gets arrays of ``columns``. Groups stream through a task one after the other, so a task holds one of them, and small ones cost little.
    """
    score = F.col("score")
    if isinstance(rows.schema["score"].dataType, T.FloatType | T.DoubleType):
        score = F.when(~F.isnan(score), score)
    sorted_rows = rows.repartition(*by).sortWithinPartitions(*by, score.desc_nulls_last(), F.col("id").asc_nulls_last())

    def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        values = [pc.fill_null(table.column(c).combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False) if c == "model" else table.column(c).cast(pa.float64()).to_numpy() for c in columns]
        cuts = changes(table, by)
        ends = zip([0, *cuts], [*cuts, table.num_rows], strict=True)
        at = np.concatenate([start + point(*(v[start:end] for v in values)) for start, end in ends])
        batch = table.to_batches(max_chunksize=table.num_rows)[0]
        return pa.RecordBatch.from_arrays([*batch.columns, batch.column("id").take(pa.array(at))], schema=batch.schema.append(pa.field(name, batch.schema.field("id").type)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(done, whole_groups(batches, by))

    return sorted_rows.mapInArrow(run, widened(rows.schema, name, rows.schema["id"].dataType))


def clusters(rows: DataFrame, by: list[str], within: float) -> DataFrame:
    """``rows`` (id, x, y, score) with rep, the id of their representative: the nearest one within reach, else themselves.

    Rows come by falling score, then id; only representatives attract, so chains do not grow. Only the first row at a place can become one, as what attracted it attracts the later
    ones too: places are gone through one by one, and rows look up what was nearest to their place when they came.
    """
    around = [(di, dj) for di in (-1, 0, 1) for dj in (-1, 0, 1)]

    def point(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        first, place = distinct(x, y)
        places = list(zip(x[first].tolist(), y[first].tolist(), strict=True))
        cells = [(math.floor(a / within), math.floor(b / within)) for a, b in places]
        reps: dict[tuple[int, int], list[tuple[float, float, int]]] = {}  # by cells as wide as the reach: the nearest lies in one of nine
        near = lambda i, j, x, y: [(n, d) for di, dj in around for a, b, n in reps.get((i + di, j + dj), ()) if (d := math.hypot(a - x, b - y)) <= within]
        for k in np.argsort(first, kind="stable").tolist():
            if not near(*cells[k], *places[k]):
                reps.setdefault(cells[k], []).append((*places[k], int(first[k])))
        # a place's nearest representative changes where a nearer one came: place, row from which it holds
        held = []
        for k in range(len(places)):
            best = math.inf
            for n, d in sorted(near(*cells[k], *places[k])):
                if d < best:
                    best = d
                    held.append((k, n))
        at, since = np.array(held, dtype=np.int64).reshape(-1, 2).T
        found = np.searchsorted(at * (len(x) + 1) + since, place * (len(x) + 1) + np.arange(len(x)), side="right") - 1
        return since[found]

    return pointed(rows, by, "rep", ["x", "y"], point)


def distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct row of the columns, and the number of each row's."""
    order = np.lexsort(columns)
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number  # lexsort is stable, so the first of equal rows comes first


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of one box with many."""
    w = np.clip(np.minimum(a[2], b[:, 2]) - np.maximum(a[0], b[:, 0]), 0, None)
    h = np.clip(np.minimum(a[3], b[:, 3]) - np.maximum(a[1], b[:, 1]), 0, None)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1]) - w * h
    return np.divide(w * h, union, out=np.zeros(len(b)), where=union > 0)


def merged_boxes(rows: DataFrame, by: list[str], least: float, across_models: bool = True) -> DataFrame:
    """``rows`` (id, model, x1, y1, x2, y2, score) with kept_by: the id of the first kept box they overlap enough, else their own.

    With ``across_models`` boxes of one model never absorb each other; without it this is plain suppression of overlapping boxes. Equal boxes (of one model, where models count) have
    one fate, so each is compared once: what absorbs the first absorbs all, and where the first is kept, no box that would absorb a later one can have been kept since. Then the later ones are
    kept too where models count, and else absorbed by the first.
    """

    def point(model: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
        first, number = distinct(x1, y1, x2, y2, *([model] if across_models else []))
        boxes, models = np.stack([x1, y1, x2, y2], axis=1)[first], model[first]
        kept, kept_models, at = np.empty_like(boxes), np.empty_like(models), np.empty(len(first), dtype=np.int64)
        into, n = np.full(len(first), -1), 0
        for u in np.argsort(first, kind="stable").tolist():
            if n:
                near = overlap(boxes[u], kept[:n]) >= least
                if across_models:
                    near &= kept_models[:n] != models[u]
                k = int(near.argmax())
                if near[k]:
                    into[u] = at[k]
                    continue
            kept[n], kept_models[n], at[n] = boxes[u], models[u], first[u]
            n += 1
            if not across_models and overlap(boxes[u], boxes[u : u + 1])[0] >= least:
                into[u] = first[u]
        return np.where(into[number] < 0, np.arange(len(number)), into[number])

    return pointed(rows, by, "kept_by", ["model", "x1", "y1", "x2", "y2"], point)


#: Least overlaps that are looked at one after the other, falling.
OVERLAPS = (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)


def near_kinds(boxes: np.ndarray, models: np.ndarray, least: float, chunk: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Kinds of other models whose overlap is ``least`` or more, and the overlap, each pair once.

    The common width of two boxes is then at least that share of the wider one's, so by rising left sides only those are met that begin within the rest of the width.
    """
    order = np.argsort(boxes[:, 0], kind="stable")
    b, m = boxes[order], models[order]
    slack = 1e-9 * (1 + np.abs(b[:, 2]))
    reach = np.searchsorted(b[:, 0], b[:, 2] - least * (b[:, 2] - b[:, 0]) + slack, side="right")
    count = np.maximum(reach - np.arange(len(b)) - 1, 0)
    part = np.cumsum(count) // chunk
    for p in np.unique(part):
        span = np.flatnonzero(part == p)
        c = count[span]
        i = np.repeat(span, c)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        tall = np.minimum(b[i, 3], b[j, 3]) - np.maximum(b[i, 1], b[j, 1])
        some = (tall > 0) & (m[i] != m[j])
        i, j, tall = i[some], j[some], tall[some]
        both = np.maximum(np.minimum(b[i, 2], b[j, 2]) - np.maximum(b[i, 0], b[j, 0]), 0) * tall
        iou = both / ((b[i, 2] - b[i, 0]) * (b[i, 3] - b[i, 1]) + (b[j, 2] - b[j, 0]) * (b[j, 3] - b[j, 1]) - both)
        some = iou >= least
        yield order[i[some]], order[j[some]], iou[some]


def four_places(v: np.ndarray) -> np.ndarray:
    """As :func:`functions.score.rounded`: half up, after eight places."""
    return np.floor((np.floor(v * 1e8 + 0.5 + 1e-7) + 5000) / 10000) / 1e4


def greedy(ids: np.ndarray, model: np.ndarray, boxes: np.ndarray, least: float) -> list[tuple[int, int, float]]:
    """Places of a, places of b and overlap (to four places): by falling overlap each box, the smallest id first, takes the smallest later id of another model that no box took.

    ``ids`` rise. Equal boxes of a model are a kind. The overlaps are gone through from the greatest down, among kinds with boxes left to take and to be taken, so where boxes lie densely few pairs
    of kinds are looked at before all are taken. At one overlap, sources come by id and take from queues of targets, so no pair of boxes is made.
    """
    first, number = distinct(*boxes.T, model)
    order = np.lexsort((np.arange(len(number)), number))
    queues = np.split(order, np.cumsum(np.bincount(number))[:-1])
    sources, targets = [q.tolist() for q in queues], [q.tolist() for q in queues]
    kinds, models, out, above = boxes[first], model[first], [], math.inf
    for least_now in [*(t for t in OVERLAPS if t > least), least]:
        live = np.array([k for k in range(len(first)) if sources[k] or targets[k]], dtype=np.int64)
        parts = []
        for i, j, iou in near_kinds(kinds[live], models[live], max(least, least_now - 1e-3)):
            score = four_places(iou)
            here = (score < above) & ((score >= least_now) | (least_now == least))
            parts.append((live[i[here]], live[j[here]], score[here]))
        if not parts:
            above = least_now
            continue
        i, j, score = (np.concatenate(v) for v in zip(*parts, strict=True))
        by = np.argsort(-score, kind="stable")
        i, j, score = i[by], j[by], score[by]
        cuts = np.flatnonzero(np.diff(score)) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(score)], strict=True):
            if start == end:
                continue
            beside: dict[int, list[int]] = {}
            for u, v in zip(i[start:end].tolist(), j[start:end].tolist(), strict=True):
                if sources[u] and targets[v] and sources[u][0] < targets[v][-1]:
                    beside.setdefault(u, []).append(v)
                if sources[v] and targets[u] and sources[v][0] < targets[u][-1]:
                    beside.setdefault(v, []).append(u)
            out += taken(sources, targets, beside, float(score[start]))
        above = least_now
    return out


def taken(sources: list[list[int]], targets: list[list[int]], beside: dict[int, list[int]], score: float) -> list[tuple[int, int, float]]:
    """The pairs of one overlap: sources of the kinds in ``beside``, by rising id, take the first later target of the kinds beside theirs. Both are taken off their queues."""
    out = []
    at = {v: 0 for vs in beside.values() for v in vs}
    gone: dict[int, set[int]] = {}
    waiting = [(sources[u][0], u, 0) for u in beside]
    heapq.heapify(waiting)
    while waiting:
        a, u, k = heapq.heappop(waiting)
        best, owner, left = -1, -1, False
        for v in beside[u]:
            queue, n = targets[v], at[v]
            while n < len(queue) and queue[n] <= a:
                n += 1
            at[v] = n
            if n < len(queue):
                left = True
                if best < 0 or queue[n] < best:
                    best, owner = queue[n], v
        if left:
            out.append((a, best, score))
            gone.setdefault(u, set()).add(a)
            targets[owner].pop(at[owner])
            if k + 1 < len(sources[u]):
                heapq.heappush(waiting, (sources[u][k + 1], u, k + 1))
    for u, ids in gone.items():
        sources[u] = [x for x in sources[u] if x not in ids]
    return out


def matched_boxes(rows: DataFrame, by: list[str], least: float) -> DataFrame:
    """by, a, b, iou: of the boxes (id, model, x1, y1, x2, y2) of a group, a one-to-one choice of pairs of different models with a < b that overlap enough (:func:`greedy`).

    Boxes without an id, a model or a place, and rows of an id that is there already, take no part. A task holds one group's boxes and no pairs of them.
    """
    sides = ["x1", "y1", "x2", "y2"]
    kept = rows.select(*by, "id", "model", *(F.col(c).cast("double").alias(c) for c in sides)).dropna(subset=["id", "model", *sides])
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = kept.repartition(tasks, *by).sortWithinPartitions(*by, "id", "model", *sides)
    shape = T.StructType([*(rows.schema[c] for c in by), *(T.StructField(n, rows.schema["id"].dataType) for n in "ab"), T.StructField("iou", T.DoubleType())])
    arrow = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in whole_groups(batches, by):
            table = pa.Table.from_batches(parts).combine_chunks()
            ids, model = table.column("id").to_numpy(), pc.dictionary_encode(table.column("model").combine_chunks()).indices.to_numpy()
            boxes = np.stack([table.column(c).to_numpy() for c in sides], axis=1)
            cuts = changes(table, by)
            rows, found = [], []
            for start, end in zip([0, *cuts], [*cuts, table.num_rows], strict=True):
                new = start + np.concatenate([[0], np.flatnonzero(ids[start + 1 : end] != ids[start : end - 1]) + 1])
                pairs = greedy(ids[new], model[new], boxes[new], least)
                rows += [start] * len(pairs)
                found += [(new[a], new[b], iou) for a, b, iou in pairs]
            a, b = (np.array([p[k] for p in found], dtype=np.int64) for k in (0, 1))
            at = pa.array(rows, pa.int64())
            key = table.column("id").combine_chunks()
            yield pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks().take(at) for c in by), key.take(pa.array(a)), key.take(pa.array(b)), pa.array([p[2] for p in found], pa.float64())], schema=arrow)

    return kept.mapInArrow(run, shape)


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of least total cost, each row and column once at most; infinite cost forbids a pair. Shortest augmenting paths with potentials."""
    n, m = cost.shape
    if n > m:
        return [(i, j) for j, i in assignment(cost.T)]
    finite = cost[np.isfinite(cost)]
    barred = (np.abs(finite).sum() + 1.0) * 2 if len(finite) else 1.0
    c = np.where(np.isfinite(cost), cost, barred)
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        slack, way, seen = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while owner[j0]:
            seen[j0] = True
            free = np.flatnonzero(~seen[1:]) + 1
            reduced = c[owner[j0] - 1, free - 1] - u[owner[j0]] - v[free]
            better = reduced < slack[free]
            slack[free[better]], way[free[better]] = reduced[better], j0
            j1 = free[np.argmin(slack[free])]
            step = slack[j1]
            u[owner[seen]] += step
            v[seen] -= step
            slack[~seen] -= step
            j0 = int(j1)
        while j0:
            owner[j0], j0 = owner[way[j0]], int(way[j0])
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j] and np.isfinite(cost[owner[j] - 1, j - 1]))


def transport(supply: np.ndarray, demand: np.ndarray, a: np.ndarray, b: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """How much each edge (a, b) carries where as much as possible is carried from the ``supply`` of sources to the ``demand`` of sinks, and then at least total cost.

    Each round finds the shortest ways from all sources with supply left to the nearest sinks with demand left, by potentials, and carries what ways of that length let through. Costs are not negative.
    """
    carried = np.zeros(len(a), dtype=np.int64)
    if not len(a):
        return carried
    left, free = supply.astype(np.int64), demand.astype(np.int64)
    order = np.argsort(b, kind="stable")
    into, starts = np.unique(b[order], return_index=True)
    sources = a[order]
    before, after = np.zeros(len(left)), np.zeros(len(free))
    fine = 1e-10 * max(1.0, float(cost.max()))
    while True:
        reduced = cost + before[a] - after[b]
        reduced[reduced < fine] = 0.0
        rest, waiting = reduced[order], free > 0
        used = np.flatnonzero(carried)
        back, ahead = a[used], b[used]
        near, far = np.where(left > 0, 0.0, np.inf), np.full(len(free), np.inf)
        while True:
            far[into] = np.minimum.reduceat(near[sources] + rest, starts)
            reach = far[waiting].min(initial=np.inf)
            nearer = near.copy()
            np.minimum.at(nearer, back, far[ahead])
            new = nearer[nearer < near]
            near = nearer
            # what lies no nearer than the nearest demand changes nothing
            if not (new < reach).any():
                break
        if not np.isfinite(reach):
            return carried
        before += np.minimum(near, reach)
        after += np.minimum(far, reach)
        tight = np.flatnonzero((cost + before[a] - after[b] < 2 * fine) & (near[a] <= reach) & (far[b] <= reach))
        onward: dict[int, list[tuple[int, int]]] = {}
        for e, i, j in zip(tight.tolist(), a[tight].tolist(), b[tight].tolist(), strict=True):
            onward.setdefault(i, []).append((e, j))
        held: dict[int, list[tuple[int, int]]] = {}
        for e, i, j in zip(used.tolist(), back.tolist(), ahead.tolist(), strict=True):
            held.setdefault(j, []).append((e, i))
        let_through(left, free, carried, onward, held)


def let_through(left: np.ndarray, free: np.ndarray, carried: np.ndarray, onward: dict[int, list[tuple[int, int]]], held: dict[int, list[tuple[int, int]]]) -> None:
    """Carries more from each source with supply left along edges of ``onward`` (source -> edge, sink), and back along carrying edges of ``held`` (sink -> edge, source), until no way is left."""
    dead: set[int] = set()
    for start in [i for i in onward if left[i] > 0]:
        while left[start] > 0:
            came: dict[int, tuple[int, int]] = {}
            behind: dict[int, tuple[int, int]] = {start: (-1, -1)}
            stack, end = [start], -1
            while stack and end < 0:
                i = stack.pop()
                for e, j in onward.get(i, ()):
                    if j in came or j in dead:
                        continue
                    came[j] = (e, i)
                    if free[j] > 0:
                        end = j
                        break
                    for k, n in held.get(j, ()):
                        if n not in behind and carried[k] > 0:
                            behind[n] = (k, j)
                            stack.append(n)
            if end < 0:
                # what a search in vain has met leads nowhere in this round
                dead.update(came)
                break
            way, j = [], end
            while j >= 0:
                e, i = came[j]
                k, j = behind[i]
                way.append((e, k))
            n = min(left[start], free[end], *(carried[k] for _, k in way if k >= 0))
            for e, k in way:
                carried[e] += n
                if k >= 0:
                    carried[k] -= n
            left[start] -= n
            free[end] -= n


def within_reach(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b, d: places a of (x, y), which are sorted by x, and b of (px, py) that lie within ``reach``. Looked at are those in its band of x."""
    low, high = np.searchsorted(x, px - reach, "left"), np.searchsorted(x, px + reach, "right")
    ends = np.cumsum(high - low)
    out, start = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0
    while start < len(px):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + 2_000_000, "right")))
        n = (high - low)[start:stop]
        b = np.repeat(np.arange(start, stop), n)
        a = np.arange(len(b)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[start:stop], n)
        d = np.sqrt((x[a] - px[b]) * (x[a] - px[b]) + (y[a] - py[b]) * (y[a] - py[b]))
        keep = d <= reach
        out.append((a[keep], b[keep], d[keep]))
        start = stop
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def reassigned(prior: DataFrame, later: DataFrame, by: list[str], reach: float) -> DataFrame:
    """by, a, b, cost: of the pairs of a prior and a later row (id, x, y) of a group within ``reach``, the one-to-one choice of most pairs, and then of least total distance (to 4 digits).

    Rows of a group at one place can stand in for each other, so places are assigned with their numbers of rows, and rows meet only where they are chosen: no pair is a row. Of equally good choices one is
    taken that depends on the rows alone. A task holds one group's rows and the pairs of its places. Rows with a null take no part, and of rows that repeat an id one does.
    """
    columns = [*by, "side", "x", "y", "id"]
    sides = [df.select(*by, F.lit(k).alias("side"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "id") for k, df in enumerate((prior, later))]
    rows = sides[0].unionByName(sides[1]).dropna()
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, *by).sortWithinPartitions(*columns)
    shape = T.StructType([*(rows.schema[c] for c in by), *(T.StructField(n, rows.schema["id"].dataType) for n in "ab"), T.StructField("cost", T.DoubleType())])
    arrow = to_arrow_schema(shape)

    def chosen(x: np.ndarray, y: np.ndarray, ids: np.ndarray, at: np.ndarray, sides: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of rows, in pairs, and their costs."""
        kinds = []
        for side in sides:
            k = side[np.sort(np.unique(ids[side], return_index=True)[1])]
            new = np.flatnonzero(np.concatenate([[True], (x[k][1:] != x[k][:-1]) | (y[k][1:] != y[k][:-1])])) if len(k) else np.zeros(0, np.int64)
            kinds.append((k, new, np.diff([*new, len(k)])))
        (p, p_new, supply), (q, q_new, demand) = kinds
        a, b, d = within_reach(x[p[p_new]], y[p[p_new]], x[q[q_new]], y[q[q_new]], reach)
        cost = np.floor(np.floor(d * 1e8 + 0.5) / 1e4 + 0.5) / 1e4
        n = transport(supply, demand, a, b, cost)
        out = []
        for kind, new, rows_of in ((a, p_new, p), (b, q_new, q)):
            order = np.argsort(kind, kind="stable")
            taken, held = n[order], kind[order]
            first = np.cumsum(taken) - taken
            base = first[np.searchsorted(held, held, "left")] if len(held) else first
            start = np.empty_like(n)
            start[order] = new[held] + first - base
            out.append(rows_of[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)])
        return at[out[0]], at[out[1]], np.repeat(cost, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in whole_groups(batches, by):
            table = pa.Table.from_batches(parts).combine_chunks()
            x, y, side = (table.column(c).to_numpy() for c in ("x", "y", "side"))
            ids = pc.dictionary_encode(table.column("id").combine_chunks()).indices.to_numpy()
            cuts = changes(table, by)
            for start, end in zip([0, *cuts], [*cuts, table.num_rows], strict=True):
                here = side[start:end]
                a, b, cost = chosen(x[start:end], y[start:end], ids[start:end], np.arange(start, end), (np.flatnonzero(here == 0), np.flatnonzero(here == 1)))
                if len(cost):
                    key = table.column("id").combine_chunks()
                    yield pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks().take(pa.array(a)) for c in by), key.take(pa.array(a)), key.take(pa.array(b)), pa.array(cost)], schema=arrow)

    return rows.mapInArrow(run, shape)


def away(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of points, row by row."""
    return np.hypot(p[..., 0] - q[..., 0], p[..., 1] - q[..., 1])


def nearest_next(xy: np.ndarray, start: np.ndarray | None) -> np.ndarray:
    """Order of distinct places, the nearest next and of equally near ones the first; without a start from the first place."""
    left, out, at = np.arange(len(xy)), [], start
    while len(left):
        k = 0 if at is None else int(np.argmin(away(xy[left], at)))
        out.append(left[k])
        at, left = xy[left[k]], np.delete(left, k)
    return np.array(out)


def uncrossed(xy: np.ndarray, tour: np.ndarray, start: np.ndarray | None, chunk: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """The tour after 2-opt on an open path, and which places were turned round an odd number of times."""
    tour, turned, n, better = tour.copy(), np.zeros(len(tour), bool), len(tour), True
    while better:
        better = False
        for i in range(n - 1):
            before, j = (xy[tour[i - 1]] if i else start), i + 1
            while j < n:
                here, last = xy[tour[i]], xy[tour[j : j + chunk]]
                after = xy[tour[j + 1 : j + 1 + chunk]]
                gain = np.zeros(len(last)) if before is None else away(before, here) - away(before, last)
                gain[: len(after)] += away(last[: len(after)], after) - away(here, after)
                hits = np.flatnonzero(gain > 1e-9)
                if len(hits):
                    j += int(hits[0])
                    tour[i : j + 1], turned[i : j + 1] = tour[i : j + 1][::-1].copy(), ~turned[i : j + 1][::-1]
                    better = True
                j += 1 if len(hits) else len(last)
    return tour, turned


def routes(rows: DataFrame, by: list[str]) -> DataFrame:
    """Visiting order of targets (id, tier_rank, x, y) as step: tier by tier the nearest next, then each tier's part uncrossed by 2-opt.

    The start is the first target of the gravest tier by id; the path is open. Targets of a tier at one place follow each other, and no 2-opt move parts
    them, so places are ordered instead of targets: a task holds a group's places, and Spark numbers the targets of each. Distances are worked out as needed, a row at a time. Targets without a place have no step.
    """
    keys = [*by, "tier_rank", "x", "y"]
    places = rows.dropna(subset=["x", "y"]).groupBy(*keys).agg(F.min("id").alias("_first"), F.count("*").alias("_n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tier_rank", "_first"], kind="stable").reset_index(drop=True)
        order, turned, end = [], [], None
        for _, tier in pdf.groupby("tier_rank", sort=True):
            xy = tier[["x", "y"]].to_numpy(float)
            tour, back = uncrossed(xy, nearest_next(xy, end), end)
            order.append(tier.index.to_numpy()[tour])
            turned.append(back)
            end = xy[tour[-1]]
        pdf = pdf.iloc[np.concatenate(order)]
        return pdf.assign(_turned=np.concatenate(turned), _before=pdf["_n"].cumsum() - pdf["_n"]).drop(columns="_first")

    shape = T.StructType([*(places.schema[c] for c in (*keys, "_n")), T.StructField("_turned", T.BooleanType()), T.StructField("_before", T.LongType())])
    toured = places.groupBy(*by).applyInPandas(run, shape)
    # estimates of what tasks in Python make are those of what they read
    found = rows.hint("merge").join(toured, keys, "left").withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy("id")))
    step = F.col("_before") + F.when(F.col("_turned"), F.col("_n") - F.col("_nth") + 1).otherwise(F.col("_nth"))
    return found.select(*rows.columns, step.cast("int").alias("step"))


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise, from the lowest left one."""
    p = sorted(map(tuple, np.unique(points, axis=0)))
    if len(p) < 3:
        return np.array(p)
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    sides = []
    for order in (p, p[::-1]):
        side: list[tuple[float, float]] = []
        for q in order:
            while len(side) > 1 and turn(side[-2], side[-1], q) <= 0:
                side.pop()
            side.append(q)
        sides += side[:-1]
    return np.array(sides)


def hulls(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, corner, x, y, area: the convex hull of each group's points."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h = hull(pdf[["x", "y"]].to_numpy(float))
        x, y = h[:, 0], h[:, 1]
        area = 0.5 * abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1)))
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in by}, "corner": np.arange(len(h), dtype=np.int32), "x": x, "y": y, "area": area})

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    return rows.groupBy(*by).applyInPandas(run, f"{kinds}, corner int, x double, y double, area double")


def connected_cells(rows: DataFrame, by: list[str], least: int = 1) -> DataFrame:
    """by, label, n, mean_row: 8-connected components of marked cells (r, c), of ``least`` cells or more, labelled by their first cell."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left = set(zip(pdf["r"].astype(int), pdf["c"].astype(int), strict=True))
        out = []
        for cell in sorted(left):
            if cell not in left:
                continue
            left.discard(cell)
            stack, found = [cell], []
            while stack:
                r, c = stack.pop()
                found.append(r)
                for k in ((r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                    if k in left:
                        left.discard(k)
                        stack.append(k)
            if len(found) >= least:
                out.append((len(out), len(found), float(np.mean(found))))
        return pd.DataFrame([(*(pdf[c].iloc[0] for c in by), *o) for o in out], columns=[*by, "label", "n", "mean_row"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    return rows.groupBy(*by).applyInPandas(run, f"{kinds}, label int, n int, mean_row double")

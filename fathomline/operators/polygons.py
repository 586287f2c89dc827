"""Exact areas of unions, differences and intersections of many polygons, as a sweep over slabs.

Polygons are rings of points: array<array<struct<x, y>>>, the first ring the outer one, the others holes; parts of a multipolygon are rows of one polygon id. Their edges are cut at the
borders of slabs of equal width, and each slab is swept in a task of its own: between neighbouring ends and crossings of edges nothing changes its order, so what the layers cover there is a stack of
trapezoids. Areas add up over slabs; no task sees the whole of a polygon, let alone of a layer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fathomline.operators.sequential import changes, whole_groups

RINGS = "array<array<struct<x: double, y: double>>>"
#: (edge, interval) pairs that a sweep holds at a time.
PAIRS = 1 << 21
#: Boxes are counted in cells where these are at most so many for each pair that a sweep would hold.
CELLS = 128


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The rings of an upright rectangle."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1)))


def contains(x: Column, y: Column, rings: Column) -> Column:
    """Whether a point is inside: an odd number of edges of all rings lies above it, so holes count as outside. Null for null rings."""

    def crossings(ring: Column) -> Column:
        def above(p: Column, i: Column) -> Column:
            q = F.get(ring, F.when(i + 1 < F.size(ring), i + 1).otherwise(0))
            spans = (p["x"] <= x) != (q["x"] <= x)
            return F.when(spans, (p["y"] + (q["y"] - p["y"]) * (x - p["x"]) / (q["x"] - p["x"]) > y).cast("int")).otherwise(0)

        return F.aggregate(F.transform(ring, above), F.lit(0), lambda a, b: a + b)

    return F.aggregate(F.transform(rings, crossings), F.lit(0), lambda a, b: a + b) % 2 == 1


def edges(polygons: DataFrame, by: list[str], width: float) -> DataFrame:
    """by, slab, layer, polygon, xa, ya, xb, yb: the edges from left to right, cut at multiples of ``width``. Upright edges bound no area and are left out."""
    rings = polygons.select(*by, "layer", "polygon", F.explode("rings").alias("ring")).filter(F.size("ring") >= 3)
    ends = F.transform("ring", lambda p, i: F.struct(p.alias("p"), F.get(F.col("ring"), F.when(i + 1 < F.size("ring"), i + 1).otherwise(0)).alias("q")))
    e = rings.select(*by, "layer", "polygon", F.inline(ends)).filter(F.col("p.x") != F.col("q.x"))
    left = F.col("p.x") < F.col("q.x")
    a, b = F.when(left, F.col("p")).otherwise(F.col("q")), F.when(left, F.col("q")).otherwise(F.col("p"))
    e = e.select(*by, "layer", "polygon", a.alias("a"), b.alias("b"))
    first, last = F.floor(F.col("a.x") / width), F.ceil(F.col("b.x") / width) - 1
    e = e.withColumn("slab", F.explode(F.sequence(first, F.greatest(first, last))))
    x0, x1 = F.greatest(F.col("a.x"), F.col("slab") * width), F.least(F.col("b.x"), (F.col("slab") + 1) * width)
    slope = (F.col("b.y") - F.col("a.y")) / (F.col("b.x") - F.col("a.x"))

    def y(x: Column) -> Column:
        return F.when(x == F.col("a.x"), F.col("a.y")).when(x == F.col("b.x"), F.col("b.y")).otherwise(F.col("a.y") + slope * (x - F.col("a.x")))

    return e.select(*by, "slab", "layer", "polygon", x0.alias("xa"), y(x0).alias("ya"), x1.alias("xb"), y(x1).alias("yb")).filter("xa < xb")


def crossings(xa: np.ndarray, ya: np.ndarray, xb: np.ndarray, yb: np.ndarray) -> np.ndarray:
    """Where edges cross inside both."""
    slope = (yb - ya) / (xb - xa)
    at = ya - slope * xa
    low, high = np.minimum(ya, yb), np.maximum(ya, yb)
    order = np.argsort(low, kind="stable")
    xa, xb, slope, at, low, high = (v[order] for v in (xa, xb, slope, at, low, high))
    out = []
    reach = np.searchsorted(low, high, side="right")  # later edges that begin below this one's top
    for start in range(0, len(xa), 256):
        end = min(start + 256, len(xa))
        count = reach[start:end] - np.arange(start, end) - 1
        i = np.repeat(np.arange(start, end), count)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        left, right = np.maximum(xa[i], xa[j]), np.minimum(xb[i], xb[j])
        some = (left < right) & (slope[i] != slope[j])
        i, j, left, right = i[some], j[some], left[some], right[some]
        x = (at[j] - at[i]) / (slope[i] - slope[j])
        out.append(x[(x > left) & (x < right)])
    return np.concatenate(out) if out else np.zeros(0)


def named(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, list]:
    """The number of each value in sorted order, and the values."""
    found = pc.dictionary_encode(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, null_encoding="encode")
    names = found.dictionary.to_pylist()
    order = sorted(range(len(names)), key=lambda k: (names[k] is None, names[k]))
    place = np.empty(len(names), dtype=np.int64)
    place[order] = np.arange(len(names))
    return place[found.indices.to_numpy(zero_copy_only=False)], [names[k] for k in order]


def sweep(layer: np.ndarray, n_layers: int, polygon: np.ndarray, xa: np.ndarray, ya: np.ndarray, xb: np.ndarray, yb: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """The number of the set of layers (a bit for each), xa, xb, and the lower and upper y at both of the trapezoids that a slab's edges bound."""
    xs = np.unique(np.concatenate([xa, xb, crossings(xa, ya, xb, yb)]))
    slope = (yb - ya) / (xb - xa)
    first, last = np.searchsorted(xs, xa), np.searchsorted(xs, xb)  # an edge is there in the intervals first to last - 1
    load = np.cumsum(np.bincount(first, minlength=len(xs)) - np.bincount(last, minlength=len(xs)))
    part = np.cumsum(load) // PAIRS
    for p in np.unique(part[:-1]):
        span = np.flatnonzero(part[:-1] == p)
        lo, hi = span[0], span[-1] + 1
        a, b = np.maximum(first, lo), np.minimum(last, hi)
        count = np.maximum(b - a, 0)
        e = np.repeat(np.arange(len(xa)), count)
        k = np.repeat(a, count) + np.arange(len(e)) - np.repeat(np.cumsum(count) - count, count)
        middle = (xs[k] + xs[k + 1]) / 2
        y = ya[e] + slope[e] * (middle - xa[e])
        order = np.lexsort((y, polygon[e], k))  # a polygon's edges are by turns its lower and its upper ones
        run = np.concatenate([[True], (k[order][1:] != k[order][:-1]) | (polygon[e][order][1:] != polygon[e][order][:-1])]) if len(e) else np.zeros(0, dtype=bool)
        place = np.arange(len(e)) - np.maximum.accumulate(np.where(run, np.arange(len(e)), 0))
        delta = np.empty(len(e), dtype=np.int64)
        delta[order] = 1 - 2 * (place % 2)
        order = np.lexsort((-delta, y, k))
        e, k, y, delta = e[order], k[order], y[order], delta[order]
        covers = np.zeros(len(e), dtype=np.int64)
        for bit in range(n_layers):
            covers |= (np.cumsum(np.where(layer[e] == bit, delta, 0)) > 0).astype(np.int64) << bit
        keep = np.flatnonzero((covers[:-1] > 0) & (k[:-1] == k[1:]) & (y[:-1] < y[1:])) if len(e) > 1 else np.zeros(0, dtype=np.int64)
        lower, upper, x0, x1 = e[keep], e[keep + 1], xs[k[keep]], xs[k[keep] + 1]
        at = lambda edge, x: ya[edge] + slope[edge] * (x - xa[edge])
        yield covers[keep], x0, x1, at(lower, x0), at(lower, x1), at(upper, x0), at(upper, x1)


def summed(covers: np.ndarray, area: np.ndarray, into: dict[int, float]) -> None:
    sets, number = np.unique(covers, return_inverse=True)
    for c, v in zip(sets.tolist(), np.bincount(number.ravel(), weights=area.ravel(), minlength=len(sets)).tolist(), strict=True):
        if c:
            into[c] = into.get(c, 0.0) + v


def boxes_of(layer: np.ndarray, polygon: np.ndarray, xa: np.ndarray, ya: np.ndarray, xb: np.ndarray, yb: np.ndarray) -> np.ndarray | None:
    """layer, x0, x1, y0, y1 of the distinct upright boxes, if a slab's polygons are nothing else."""
    if len(xa) % 2 or (ya != yb).any():
        return None
    order = np.lexsort((ya, polygon))
    low, high = order[::2], order[1::2]
    if (polygon[low] != polygon[high]).any() or (polygon[low][1:] == polygon[low][:-1]).any() or (xa[low] != xa[high]).any() or (xb[low] != xb[high]).any():
        return None
    return np.unique(np.stack([layer[low], xa[low], xb[low], ya[low], ya[high]]), axis=1)


def covered(layer: np.ndarray, n_layers: int, polygon: np.ndarray, *ends: np.ndarray) -> dict[int, float]:
    """The area of each set of layers (a bit for each) in a slab.

    Boxes that lie densely are counted in the cells between their sides, of which there are no more than places on their grid however many boxes there are; a sweep meets every box in every interval.
    """
    out: dict[int, float] = {}
    boxes = boxes_of(layer, polygon, *ends)
    if boxes is not None:
        kind, (x0, x1, y0, y1) = boxes[0].astype(np.int64), boxes[1:]
        xs, ys = np.unique(np.concatenate([x0, x1])), np.unique(np.concatenate([y0, y1]))
        i0, i1, j0, j1 = np.searchsorted(xs, x0), np.searchsorted(xs, x1), np.searchsorted(ys, y0), np.searchsorted(ys, y1)
        if (len(xs) - 1) * len(ys) * n_layers <= CELLS * int((i1 - i0).sum()):
            step = max(1, PAIRS // len(ys))
            bits = np.min_scalar_type((1 << n_layers) - 1)
            count = np.int16 if len(kind) < 1 << 14 else np.int32
            for lo in range(0, len(xs) - 1, step):
                hi = min(lo + step, len(xs) - 1)
                covers = np.zeros((hi - lo, len(ys)), dtype=bits)
                here = (i0 < hi) & (i1 > lo)
                for bit in range(n_layers):
                    b = here & (kind == bit)
                    a, z = np.maximum(i0[b], lo) - lo, np.minimum(i1[b], hi) - lo
                    begin = np.zeros((hi - lo + 1, len(ys)), dtype=count)
                    for at, j, v in ((a, j0[b], 1), (a, j1[b], -1), (z, j0[b], -1), (z, j1[b], 1)):
                        np.add.at(begin, (at, j), count(v))
                    np.cumsum(begin, axis=0, dtype=count, out=begin)
                    np.cumsum(begin, axis=1, dtype=count, out=begin)
                    covers |= (begin[:-1] > 0).astype(bits) << bits.type(bit)
                wide, tall = np.diff(xs[lo : hi + 1]), np.append(np.diff(ys), 0.0)
                if n_layers <= 10:
                    # a row's cells of one set are added up before they are multiplied with its width
                    row = np.arange(hi - lo)[:, None] << n_layers
                    tops = np.bincount((row + covers).ravel(), weights=np.broadcast_to(tall, covers.shape).ravel(), minlength=(hi - lo) << n_layers)
                    totals = wide @ tops.reshape(hi - lo, 1 << n_layers)
                    for c in np.flatnonzero(totals[1:] > 0) + 1:
                        out[int(c)] = out.get(int(c), 0.0) + float(totals[c])
                else:
                    area = wide[:, None] * tall[None, :]
                    summed(covers[area > 0].astype(np.int64), area[area > 0], out)
            return out
    for covers, x0, x1, low_a, low_b, high_a, high_b in sweep(layer, n_layers, polygon, *ends):
        summed(covers, (x1 - x0) * (high_a - low_a + high_b - low_b) / 2, out)
    return out


def slabs(polygons: DataFrame, by: list[str], width: float, run: Callable[..., Iterator[tuple[np.ndarray, ...]]], names: list[str]) -> DataFrame:
    """by, layers and ``names``: what ``run`` gives for each slab's layers, polygons and edges, as numbers of sets of layers and columns beside them."""
    cut = edges(polygons.filter("layer IS NOT NULL"), by, width)
    # many tasks, as the work of a slab grows faster than its bytes
    tasks = int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = cut.repartition(tasks, *by, "slab").sortWithinPartitions(*by, "slab")
    shape = T.StructType([*(polygons.schema[c] for c in by), T.StructField("layers", T.ArrayType(T.StringType())), *(T.StructField(n, T.DoubleType()) for n in names)])
    arrow = to_arrow_schema(shape)

    def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        cuts = changes(table, [*by, "slab"])
        for start, end in zip([0, *cuts], [*cuts, table.num_rows], strict=True):
            rows = table.slice(start, end - start)
            layer, layers = named(rows.column("layer"))
            polygon, kinds = named(rows.column("polygon"))
            polygon = layer * len(kinds) + polygon
            for covers, *columns in run(layer, len(layers), polygon, *(rows.column(c).to_numpy() for c in ("xa", "ya", "xb", "yb"))):
                sets, number = np.unique(covers, return_inverse=True)
                shown = pa.array([[x for bit, x in enumerate(layers) if c >> bit & 1] for c in sets.tolist()], arrow.field("layers").type)
                keys = [pa.repeat(rows.column(c)[0], len(covers)) for c in by]
                yield pa.RecordBatch.from_arrays([*keys, shown.take(pa.array(number.ravel())), *(pa.array(c, pa.float64()) for c in columns)], schema=arrow)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in whole_groups(batches, [*by, "slab"]):
            yield from done(parts)

    return met.mapInArrow(each, shape)


def trapezoids(polygons: DataFrame, by: list[str], width: float) -> DataFrame:
    """by, layers, xa, xb, low_a, low_b, high_a, high_b: what the layers cover, cut into trapezoids that do not overlap, each with the sorted names of all layers that cover it.

    ``polygons``: by, layer (string, up to 62 of them in one slab), polygon (an id inside the layer) and rings. Rings may cross themselves (the even-odd rule holds inside a polygon id), touch or repeat; rings of fewer than three
    points, null rings and null layers count nowhere. ``width`` is that of the slabs: a slab's work grows with the square of the edges in it that overlap in y, so it should hold some thousands.
    """
    return slabs(polygons, by, width, sweep, ["xa", "xb", "low_a", "low_b", "high_a", "high_b"])


def areas(polygons: DataFrame, by: list[str], width: float) -> DataFrame:
    """by, layers, area: how much exactly these layers cover together. Unions, differences and intersections of layers are sums of such rows.

    A slab gives a row for each set of layers, and where its polygons are dense upright boxes its work is bounded by their grid (:func:`covered`).
    """

    def run(*slab: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        found = covered(*slab)
        yield np.array(list(found), dtype=np.int64), np.array(list(found.values()))

    return slabs(polygons, by, width, run, ["area"]).groupBy(*by, "layers").agg(F.sum("area").alias("area"))


def area_where(condition: Column) -> Column:
    """Aggregate over rows of :func:`areas`: the area of the sets of layers for which ``condition`` on ``layers`` holds."""
    return F.coalesce(F.sum(F.when(condition, F.col("area"))), F.lit(0.0))


def buffered(shapes: DataFrame, distance: Column, arcs: int = 8, closed: bool = True) -> DataFrame:
    """``shapes`` (rings; lines or points where not ``closed``) as the pieces whose union is everything within ``distance``: the shape itself, a rectangle along each edge, a polygon of 4 * ``arcs`` corners around each point.

    Every piece is a polygon id of its own (``polygon`` becomes a string), so :func:`areas` gives the buffer's area.
    """
    d = F.col("_d")
    rows = shapes.withColumn("_d", distance.cast("double"))
    others = [c for c in shapes.columns if c not in ("polygon", "rings")]
    pts = rows.select(*others, "_d", F.col("polygon").cast("string").alias("polygon"), F.posexplode("rings").alias("_r", "ring"))
    xy = lambda x, y: F.struct(x.alias("x"), y.alias("y"))

    def disc(p: Column) -> Column:
        angles = F.sequence(F.lit(0), F.lit(4 * arcs - 1))
        return F.array(F.transform(angles, lambda k: xy(p["x"] + d * F.cos(k * (np.pi / 2 / arcs)), p["y"] + d * F.sin(k * (np.pi / 2 / arcs)))))

    def along(p: Column, q: Column) -> Column:
        length = F.sqrt((q["x"] - p["x"]) ** 2 + (q["y"] - p["y"]) ** 2)
        nx, ny = -(q["y"] - p["y"]) / length * d, (q["x"] - p["x"]) / length * d
        return F.when(length > 0, F.array(F.array(xy(p["x"] + nx, p["y"] + ny), xy(q["x"] + nx, q["y"] + ny), xy(q["x"] - nx, q["y"] - ny), xy(p["x"] - nx, p["y"] - ny))))

    last = F.size("ring") - (0 if closed else 1)
    following = lambda i: F.get(F.col("ring"), F.when(i + 1 < F.size("ring"), i + 1).otherwise(0))
    discs = F.transform("ring", lambda p, i: F.struct(F.lit("c").alias("k"), i.alias("i"), disc(p).alias("rings")))
    sides = F.transform("ring", lambda p, i: F.struct(F.lit("e").alias("k"), i.alias("i"), F.when(i < last, along(p, following(i))).alias("rings")))
    pieces = pts.select(*others, "polygon", "_r", F.inline(F.concat(discs, sides))).filter("rings IS NOT NULL")
    pieces = pieces.select(*others, F.concat_ws(":", "polygon", "_r", "k", "i").alias("polygon"), "rings")
    return pieces.unionByName(rows.select(*others, F.col("polygon").cast("string").alias("polygon"), "rings")) if closed else pieces

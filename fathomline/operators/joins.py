"""Joins that Spark has no single word for, as compositions of equi joins and windows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from fathomline.functions import geo
from fathomline.functions.score import rounded


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], forward: bool = False) -> DataFrame:
    """``left`` with the values of the last right row at or before ``on`` (the first at or after it, with ``forward``), per ``by``.

    One union and one window: the cost is a sort by key, whatever the number of matches, and no pair is ever formed.
    """
    tagged = left.withColumn("_right", F.lit(None).cast(right.select(F.struct(*values, F.col(on).alias("_at")).alias("s")).schema["s"].dataType)).withColumn("_side", F.lit(1))
    events = right.select(*by, on, F.struct(*values, F.col(on).alias("_at")).alias("_right")).withColumn("_side", F.lit(0))
    both = tagged.unionByName(events, allowMissingColumns=True)
    order = [F.desc(on), "_side"] if forward else [on, "_side"]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_right", F.last("_right", ignorenulls=True).over(w)).filter("_side = 1")
    return both.select(*left.columns, *[F.col("_right")[v].alias(v) for v in values], F.col("_right")["_at"].alias(f"{on}_matched"))


def within_intervals(points: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, end: str) -> DataFrame:
    """Inner join of points with the intervals [start, end] of their key that hold them; a null end is open."""
    i = intervals.select(*[F.col(c).alias(f"i_{c}") for c in intervals.columns])
    keys = [F.col(c) == F.col(f"i_{c}") for c in by]
    inside = (F.col(at) >= F.col(f"i_{start}")) & (F.col(f"i_{end}").isNull() | (F.col(at) <= F.col(f"i_{end}")))
    on = keys[0]
    for k in [*keys[1:], inside]:
        on = on & k
    return points.join(i, on)


#: Rows of one place that go through a join together at most, and pairs of such rows that a task makes at once, about.
HELD, PAIRS = 4096, 500_000


def gathered(rows: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """by, ``name``: the rows' values, nulls too, in arrays of HELD at most, so that a join on ``by`` shuffles and pairs arrays where rows share a place."""
    number = F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*by)) - 1) / HELD)
    found = rows.select(*by, value.alias("_value")).withColumn("_number", number).groupBy(*by, "_number")
    nulls = F.array_repeat(F.lit(None), F.count_if(F.col("_value").isNull()).cast("int"))
    return found.agg(F.concat(F.collect_list("_value"), nulls).alias(name)).drop("_number")


def unfolded(rows: DataFrame, left: str, right: str) -> DataFrame:
    """A row for every pair of an element of the array ``left`` and one of ``right``; other columns pass through. Pairs are made as they are read, so what a task holds does not grow with them."""
    shape = T.StructType([T.StructField(f.name, f.dataType.elementType if f.name in (left, right) else f.dataType) for f in rows.schema])
    arrow = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = {c: batch.column(c) for c in (left, right)}
            n, m = (pc.fill_null(pc.list_value_length(lists[c]), 0).to_numpy().astype(np.int64) for c in (left, right))
            values = {c: pc.list_flatten(lists[c]) for c in (left, right)}
            # every left element, its row, and where its row's right elements begin
            row = np.repeat(np.arange(batch.num_rows), n)
            size, first = m[row], (np.cumsum(m) - m)[row]
            ends = np.cumsum(size)
            low = 0
            while low < len(row):
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS, "right")))
                each = size[low:high]
                mine = np.repeat(np.arange(low, high), each)
                theirs = np.arange(len(mine)) + np.repeat(first[low:high] - (np.cumsum(each) - each), each)
                at = {left: pa.array(mine), right: pa.array(theirs)}
                other = pa.array(row[mine])
                yield pa.RecordBatch.from_arrays([values[f.name].take(at[f.name]) if f.name in at else batch.column(f.name).take(other) for f in arrow], schema=arrow)
                low = high

    return rows.mapInArrow(run, shape)


def near(left: DataFrame, right: DataFrame, radius: float, lat: str = "lat", lon: str = "lon", digits: int | None = None) -> DataFrame:
    """Pairs within ``radius`` metres, with distance_m (rounded to ``digits``); the right side's columns are prefixed by r_.

    The plane is cut into rows of latitude and, within each, cells of longitude wide enough for the radius there; a left place looks into its
    own cell and the eight around it, so the join is an equi join on cells with the exact distance as its residual. Rows at one place share its neighbours: places
    are compared, with their rows in arrays, and rows meet behind the join only, so no pair is shuffled.
    """
    size = radius * 1.02 / (geo.EARTH_RADIUS * 3.141592653589793 / 180)
    row = lambda y: F.floor(F.col(y) / size)
    # cells of a row are as wide as its edge farther from the equator needs
    wide = lambda r: F.lit(size) / F.greatest(F.cos(F.radians(F.least(F.greatest(F.abs(r * size), F.abs((r + 1) * size)), F.lit(89.9)))), F.lit(1e-3))
    rows = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    others, r_others = [c for c in left.columns if c not in (lat, lon)], [c for c in rows.columns if c not in (f"r_{lat}", f"r_{lon}")]
    whole = lambda cs: F.lit(0) if not cs else F.col(cs[0]) if len(cs) == 1 else F.struct(*cs)
    r = gathered(rows, [f"r_{lat}", f"r_{lon}"], whole(r_others), "_r").withColumn("_row", row(f"r_{lat}")).withColumn("_cell", F.floor(F.col(f"r_{lon}") / wide(F.col("_row"))))
    spread = gathered(left, [lat, lon], whole(others), "_l").withColumn("_row", F.explode(F.array(*[row(lat) + k for k in (-1, 0, 1)])))
    spread = spread.withColumn("_cell", F.explode(F.array(*[F.floor(F.col(lon) / wide(F.col("_row"))) + k for k in (-1, 0, 1)])))
    # no estimate knows how far places are spread, nor how many rows they hold: no side of this join is broadcast, and its tasks are not put together
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = spread.repartition(tasks, "_row", "_cell").hint("merge").join(r.repartition(tasks, "_row", "_cell"), ["_row", "_cell"])
    met = met.withColumn("distance_m", geo.haversine(F.col(lat), F.col(lon), F.col(f"r_{lat}"), F.col(f"r_{lon}"))).filter(F.col("distance_m") <= radius)
    if digits is not None:
        met = met.withColumn("distance_m", rounded(F.col("distance_m"), digits))
    pairs = unfolded(met.drop("_row", "_cell"), "_l", "_r")
    of = lambda held, cs: lambda c: F.col(c) if c not in cs else F.col(held).alias(c) if len(cs) == 1 else F.col(f"{held}.{c}").alias(c)
    return pairs.select(*map(of("_l", others), left.columns), *map(of("_r", r_others), rows.columns), "distance_m")


def first_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def latest(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Each key's row with the largest ``at``, ties to the largest ``tie``, by one aggregation."""
    columns = [c for c in rows.columns if c not in (key, at, tie)]
    best = rows.groupBy(key).agg(F.max(F.struct(F.col(at), F.col(tie), *columns)).alias("_best"))
    return best.select(key, F.col(f"_best.{at}").alias(at), F.col(f"_best.{tie}").alias(tie), *[F.col(f"_best.{c}").alias(c) for c in columns])


def by_longest_key(rows: DataFrame, column: str, policy: DataFrame, key: str, values: list[str]) -> DataFrame:
    """``rows`` with the policy of the class: the exact key, else the longest key contained in it, else nulls. ``policy`` is a small table of settings."""
    classes = rows.select(column).distinct()
    fits = classes.join(policy, F.contains(F.col(column), F.col(key)), "left")
    best = fits.groupBy(column).agg(F.max_by(F.struct(*values), F.struct((F.col(column) == F.col(key)).cast("int"), F.length(key), F.col(key))).alias("_p"))
    best = best.select(F.col(column).alias("_class"), *[F.col(f"_p.{v}").alias(v) for v in values])
    return rows.join(best, rows[column].eqNullSafe(F.col("_class")), "left").drop("_class")


def interpolated(points: DataFrame, control: DataFrame, by: list[str], on: str, value: str, out: str) -> DataFrame:
    """``points`` with ``out``, the control points' ``value`` at ``on`` on straight lines between them; outside, the first and the last line go on.

    A single control point gives its value everywhere, no control point null. Two as-of joins, no pairs.
    """
    w = Window.partitionBy(*by).orderBy(on)
    lines = control.select(*by, on, F.struct(F.col(on).alias("x0"), F.col(value).alias("y0"), F.lead(on).over(w).alias("x1"), F.lead(value).over(w).alias("y1"), F.lag(on).over(w).alias("xp"), F.lag(value).over(w).alias("yp")).alias("_line"))
    back = asof(points, lines, by, on, ["_line"]).drop(f"{on}_matched").withColumnRenamed("_line", "_back")
    both = asof(back, lines, by, on, ["_line"], forward=True).drop(f"{on}_matched")
    a = F.coalesce("_back", "_line")
    x = F.col(on)
    ahead = a["y0"] + (a["y1"] - a["y0"]) * (x - a["x0"]) / (a["x1"] - a["x0"])
    beyond = a["yp"] + (a["y0"] - a["yp"]) * (x - a["xp"]) / (a["x0"] - a["xp"])
    return both.withColumn(out, F.coalesce(F.when(a["x1"].isNotNull(), ahead), F.when(a["xp"].isNotNull(), beyond), a["y0"])).select(*points.columns, out)


def bilinear(points: DataFrame, grid: DataFrame, x: str, y: str, value: str, out: str) -> DataFrame:
    """``points`` (unique by all their columns) with ``out``: the grid's ``value`` (at whole i, j) between the four corners around x, y.

    Corners that are missing or null drop out and the others' weights are scaled up; without any, the result is null.
    """
    i, j = F.floor(F.col(x)).cast("long"), F.floor(F.col(y)).cast("long")
    fx, fy = F.col(x) - i, F.col(y) - j
    corner = lambda di, dj, w: F.struct((i + di).alias("i"), (j + dj).alias("j"), w.alias("w"))
    corners = F.explode(F.array(corner(0, 0, (1 - fx) * (1 - fy)), corner(1, 0, fx * (1 - fy)), corner(0, 1, (1 - fx) * fy), corner(1, 1, fx * fy)))
    spread = points.withColumn("_c", corners).withColumn("_i", F.col("_c.i")).withColumn("_j", F.col("_c.j"))
    g = grid.select(F.col("i").alias("_i"), F.col("j").alias("_j"), F.col(value).alias("_v"))
    met = spread.join(g, ["_i", "_j"], "left").withColumn("_w", F.when(F.col("_v").isNotNull(), F.col("_c.w")).otherwise(0.0))
    sums = met.groupBy(*points.columns).agg(F.sum(F.col("_w") * F.coalesce("_v", F.lit(0.0))).alias("_s"), F.sum("_w").alias("_n"))
    return sums.withColumn(out, F.when(F.col("_n") > 1e-9, F.col("_s") / F.col("_n"))).select(*points.columns, out)


def nearest(points: DataFrame, samples: DataFrame, by: str, x: str, y: str, point: str, sample: str) -> DataFrame:
    """point, sample: for each point the nearest sample of its key ``by`` in the plane, ties to the smaller sample; a point is no sample of its own number.

    Each key's plane is cut into cells about as wide as its samples lie apart. A point looks into its cell and the eight around it: a sample no farther
    than a cell's width is the nearest. Points without one look again in cells four times as wide, until one block holds the whole key, so a point meets the
    samples around it and not all of its key. The number of rounds follows from the largest key, which is counted first.
    """
    extent = F.greatest(F.max(x) - F.min(x), F.max(y) - F.min(y), F.lit(1e-9))
    scale = samples.groupBy(by).agg((extent / F.sqrt(F.count("*"))).alias("_width"), F.count("*").alias("_n"))
    most = scale.agg(F.max("_n")).first()[0] or 1
    rounds = 2 + max(0, math.ceil(math.log(math.sqrt(most), 4)))
    s = samples.select(F.col(by).alias("_by"), F.col(x).alias("_x"), F.col(y).alias("_y"), F.col(sample).alias("_sample")).join(scale.withColumnRenamed(by, "_by"), "_by")
    rest = points.select(F.col(by).alias("_by"), F.col(x).alias("_px"), F.col(y).alias("_py"), F.col(point).alias("_point")).join(scale.withColumnRenamed(by, "_by"), "_by")
    out = None
    for k in range(rounds):
        width = F.col("_width") * 4.0**k
        around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        cells = rest.withColumn("_o", around).withColumn("_i", F.floor(F.col("_px") / width) + F.col("_o.i")).withColumn("_j", F.floor(F.col("_py") / width) + F.col("_o.j"))
        held = s.select("_by", F.floor(F.col("_x") / width).alias("_i"), F.floor(F.col("_y") / width).alias("_j"), "_x", "_y", "_sample")
        d2 = (F.col("_y") - F.col("_py")) * (F.col("_y") - F.col("_py")) + (F.col("_x") - F.col("_px")) * (F.col("_x") - F.col("_px"))
        met = cells.join(held, ["_by", "_i", "_j"]).filter("_sample <> _point").groupBy("_point", "_width").agg(F.min(F.struct(d2.alias("d2"), F.col("_sample").alias("sample"))).alias("_best"))
        sure = met if k == rounds - 1 else met.filter(F.sqrt(F.col("_best.d2")) <= width)
        # two uses: the result, and what is left for the next round
        found = sure.select(F.col("_point").alias(point), F.col("_best.sample").alias(sample)).persist()
        out = found if out is None else out.unionByName(found)
        rest = rest.join(found.select(F.col(point).alias("_point")), "_point", "left_anti")
    return out

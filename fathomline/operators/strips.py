"""Side-scan strips: altitude by bottom tracking, slant-range correction, gain and speckle.

A ping is a row with array columns, so a strip of any length is many rows. What needs the pings around one is done in blocks of a strip's rows; each block
also holds the rows within reach on both sides (:func:`with_halo`), so no task sees a whole strip and borders of blocks leave no trace.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window


#: Rows of a strip in a block.
BLOCK = 512


def with_halo(rows: DataFrame, place: str, reach: int, size: int = BLOCK) -> DataFrame:
    """``rows`` with ``block`` and ``own``: each row in the block of its place (own), and in those whose own places are within ``reach``."""
    low, high = F.floor((F.col(place) - reach) / size), F.floor((F.col(place) + reach) / size)
    return rows.withColumn("block", F.explode(F.sequence(F.greatest(low, F.lit(0)), high))).withColumn("own", F.col("block") == F.floor(F.col(place) / size))


def padded(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """An array column as a matrix, zeros after each row's end, and the rows' lengths."""
    lists = batch.column(column)
    n = np.array([0 if x is None else x for x in pc.list_value_length(lists).to_pylist()], dtype=np.int64)
    flat = np.nan_to_num(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(n), max(int(n.max(initial=0)), 1)))
    out[np.arange(out.shape[1])[None, :] < n[:, None]] = flat
    return out, n


def number(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)


def moving_mean(x: np.ndarray, size: int) -> np.ndarray:
    """Means over ``size`` neighbours along the rows; the outermost values go on beyond the ends."""
    left = size // 2
    wide = np.pad(x, ((0, 0), (left, size - 1 - left)), mode="edge")
    total = np.cumsum(np.pad(wide, ((0, 0), (1, 0))), axis=1)
    return (total[:, size:] - total[:, :-size]) / size


def first_return(x: np.ndarray, n: np.ndarray, persist: int, smooth: int, fraction: float, held: float) -> np.ndarray:
    """Place of each row's first return that lasts, to parts of a sample; NaN if there is none.

    Between the 5th and the 95th percentile of a smoothed row, the return begins where ``fraction`` of the way is passed and, over the next ``persist`` samples, half of that
    is for a share of ``held``. The edge is where a smooth over 3 samples crosses half the height of the peak that follows.
    """
    rows, width = x.shape
    valid = np.arange(width)[None, :] < n[:, None]
    s = moving_mean(x, smooth)
    some = n > 0
    quiet, bright = np.full(rows, np.nan), np.full(rows, np.nan)
    if some.any():
        quiet[some], bright[some] = np.nanpercentile(np.where(valid, s, np.nan)[some], (5, 95), axis=1)
    rise = np.nan_to_num(bright - quiet)[:, None]
    quiet = np.nan_to_num(quiet)[:, None]
    lifted = np.cumsum(np.pad(valid & (s > quiet + fraction / 2 * rise), ((0, 0), (1, 0))), axis=1)
    end = np.minimum(np.arange(width) + persist, width)
    share = (lifted[:, end] - lifted[:, :-1]) / (end - np.arange(width))
    start = valid & (s > quiet + fraction * rise) & (share >= held) & (rise > 0)
    found, first = start.any(axis=1), np.argmax(start, axis=1)

    fine = moving_mean(x, 3)
    near = np.clip(first[:, None] + np.arange(-3, 6), 0, width - 1)
    v = np.take_along_axis(fine, near, axis=1)
    level = quiet[:, 0] + (v[:, 3:].max(axis=1) - quiet[:, 0]) / 2
    over = v >= level[:, None]
    over[:, 0] = False
    k = np.where(over.any(axis=1), np.argmax(over, axis=1), 3)
    below, above = v[np.arange(rows), k - 1], v[np.arange(rows), k]
    part = np.where(above > below, np.clip((level - below) / np.where(above > below, above - below, 1), 0, 1), 1.0)
    return np.where(found, np.clip(first + k - 4 + part, 0, width - 1), np.nan)


def bottom_returns(pings: DataFrame, smooth: int = 5, fraction: float = 0.35, persist_m: float = 0.75, held: float = 0.7, least_m: float = 0.5) -> DataFrame:
    """``pings`` (port_ and starboard_ samples, r0_m, dr_m) with port_track_m and starboard_track_m: slant range of each side's first lasting return.

    Row by row. Null or empty samples, flat rows, unknown sample spacings and ranges below ``least_m`` give null.
    """
    schema = T.StructType([*pings.schema.fields, *(T.StructField(f"{side}_track_m", T.DoubleType()) for side in ("port", "starboard"))])
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tracks = []
            for side in ("port", "starboard"):
                x, n = padded(batch, f"{side}_samples")
                r0, dr = number(batch, f"{side}_r0_m"), number(batch, f"{side}_dr_m")
                track = np.full(len(n), np.nan)
                steps = np.round(persist_m / np.where(dr > 0, dr, np.inf)).astype(np.int64)
                for persist in np.unique(steps[dr > 0]):
                    k = np.flatnonzero((steps == persist) & (dr > 0))
                    track[k] = r0[k] + first_return(x[k], n[k], max(3, int(persist)), smooth, fraction, held) * dr[k]
                tracks.append(pa.array(np.where(track >= least_m, track, np.nan), from_pandas=True))
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip([*batch.columns, *tracks], out.types, strict=True)], schema=out)

    return pings.mapInArrow(run, schema)


def median_around(by: list[str], place: str, value: str, size: int) -> Column:
    """Median of the known values of ``size`` rows centred on a row; within one block."""
    w = Window.partitionBy(*by, "block").orderBy(place).rowsBetween(-(size // 2), size - 1 - size // 2)
    return F.percentile(F.col(value), 0.5).over(w)


def altitudes(pings: DataFrame, by: list[str], place: str, header: str = "altitude_m", window: int = 9, outlier_m: float = 1.0, tolerance: float = 0.35, least_m: float = 0.5) -> DataFrame:
    """``pings`` with altitude and altitude_source, from the sides' tracks (:func:`bottom_returns`) and the header's altitude.

    The sides' mean is the track; where they differ by more than 15 % of it, the one nearer to the header counts, or the farther one where the header is silent, as
    what floats in the water answers first. A track far from the running median takes that ("bottom track"). A track that is far from a plausible header gives way to it
    ("header, track rejected"). Without a track the header counts ("header") where it does not contradict the median, then the median ("bottom track, interpolated"), else
    nothing ("none"). ``place`` numbers the rows of each strip from 0 without gaps.
    """
    p, s, h = F.col("port_track_m"), F.col("starboard_track_m"), F.col(header)
    far = F.greatest(*(F.col(f"{side}_r0_m") + F.size(f"{side}_samples") * F.col(f"{side}_dr_m") for side in ("port", "starboard")))
    rows = with_halo(pings, place, 2 * window).withColumn("_prelim", F.when(p.isNotNull() & s.isNotNull(), (p + s) / 2).otherwise(F.coalesce(p, s)))
    rows = rows.withColumn("_ref", median_around(by, place, "_prelim", window))
    pick = F.when(h.isNull(), F.greatest(p, s)).when(F.abs(p - h) <= F.abs(s - h), p).otherwise(s)
    split = p.isNotNull() & s.isNotNull() & (F.abs(p - s) > 0.15 * F.greatest(F.col("_ref"), F.lit(1e-6)))
    rows = rows.withColumn("_track", F.when(split, pick).otherwise(F.col("_prelim"))).withColumn("_near", median_around(by, place, "_track", window))
    t, m = F.col("_track"), F.col("_near")
    fits = h.isNotNull() & (h > least_m) & (F.coalesce(far, F.lit(float("inf"))) > h)
    taken = F.when(F.abs(t - m) > outlier_m, m).otherwise(t)
    share = F.round(tolerance * F.greatest(h, F.lit(1e-6)), 9)  # 0.35 * 14 is 4.9, not a bit less: headers are decimals, and a track just at the limit stays
    rejected = fits & (F.abs(taken - h) > share)
    agrees = fits & (m.isNull() | (F.abs(h - m) <= tolerance * F.greatest(m, F.lit(1e-6))))
    rows = rows.filter("own").withColumn("altitude", F.when(t.isNotNull(), F.when(rejected, h).otherwise(taken)).when(agrees, h).otherwise(m))
    source = F.when(t.isNotNull(), F.when(rejected, "header, track rejected").otherwise("bottom track")).when(agrees, "header").when(m.isNotNull(), "bottom track, interpolated").otherwise("none")
    return rows.withColumn("altitude_source", source).drop("block", "own", "_prelim", "_ref", "_track", "_near")


def ground_ranged(pings: DataFrame, dx: float, columns: int, altitude: str = "altitude") -> DataFrame:
    """``pings`` with port_ground and starboard_ground: the samples at ground ranges (k + 1/2) * dx, k < columns, on a flat bottom.

    The slant range of a ground range g is sqrt(g^2 + altitude^2); samples are interpolated linearly there. Beyond the samples, and where the altitude or the
    spacing is not known, values are null.
    """
    schema = T.StructType([*pings.schema.fields, *(T.StructField(f"{side}_ground", T.ArrayType(T.DoubleType())) for side in ("port", "starboard"))])
    out = to_arrow_schema(schema)
    ground = (np.arange(columns) + 0.5) * dx

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = number(batch, altitude)
            slant = np.sqrt(ground[None, :] ** 2 + a[:, None] ** 2)
            sides = []
            for side in ("port", "starboard"):
                x, n = padded(batch, f"{side}_samples")
                at = (slant - number(batch, f"{side}_r0_m")[:, None]) / number(batch, f"{side}_dr_m")[:, None]
                with np.errstate(invalid="ignore"):
                    inside = (at >= 0) & (at <= (n - 1)[:, None])
                at = np.where(inside, at, 0.0)
                low = np.floor(at).astype(np.int64)
                high = np.minimum(low + 1, x.shape[1] - 1)
                part = at - low
                v = np.take_along_axis(x, low, axis=1) * (1 - part) + np.take_along_axis(x, high, axis=1) * part
                values = pa.array(np.where(inside, v, np.nan).ravel(), from_pandas=True)
                sides.append(pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, columns, dtype=np.int32)), values))
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip([*batch.columns, *sides], out.types, strict=True)], schema=out)

    return pings.mapInArrow(run, schema)


def levelled(pings: DataFrame, by: list[str], side: str, band_m: float = 1.0, least: int = 20, altitude: str = "altitude") -> DataFrame:
    """``pings`` with ``side`` divided by its gain: the mean of the strip's values at the same range bin and altitude band, or at the bin alone where fewer than ``least`` pings are known.

    Means are summed up inside tasks before they are shuffled, so what meets is one row a band and task. The gain table holds bands x bins and is joined by band, not broadcast.
    """
    band = F.floor(F.col(altitude) / band_m).cast("long")
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pings.schema.fields if f.name in by)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, list] = {}
        for pdf in batches:
            for *key, values in pdf[[*by, "_band", side]].itertuples(index=False, name=None):
                if values is None:
                    continue
                v = np.asarray(values, dtype=np.float64)
                known = np.isfinite(v)
                key = tuple(key)
                if key not in sums:
                    sums[key] = [np.zeros(len(v)), np.zeros(len(v), dtype=np.int64)]
                sums[key][0][known] += v[known]
                sums[key][1] += known
        for (*key, b), (total, count) in sums.items():
            yield pd.DataFrame({**{c: [k] for c, k in zip(by, key, strict=True)}, "_band": [b], "total": [total.tolist()], "count": [count.tolist()]})

    rows = pings.withColumn("_band", band)
    cells = rows.filter("_band IS NOT NULL").select(*by, "_band", side).mapInPandas(partial, f"{keys}, _band long, total array<double>, count array<long>")
    cells = cells.select(*by, "_band", F.posexplode(F.arrays_zip("total", "count")).alias("bin", "z")).groupBy(*by, "_band", "bin").agg(F.sum("z.total").alias("total"), F.sum("z.count").alias("count"))
    line = cells.groupBy(*by, "bin").agg(F.sum("total").alias("line_total"), F.sum("count").alias("line_count"))
    gain = F.when(F.col("count") >= least, F.col("total") / F.col("count")).otherwise(F.try_divide(F.col("line_total"), F.col("line_count")))
    surface = cells.join(line, [*by, "bin"]).groupBy(*by, "_band").agg(F.array_sort(F.collect_list(F.struct("bin", gain.alias("gain")))).alias("_gain"))
    out = rows.join(surface, [*by, "_band"], "left")
    value = F.transform(F.col(side), lambda v, k: F.when(F.get(F.col("_gain"), k)["gain"] > 0, v / F.get(F.col("_gain"), k)["gain"]))
    return out.withColumn(side, value).drop("_band", "_gain")


def local_sums(x: np.ndarray, size: int) -> np.ndarray:
    """Sums over size x size windows inside the rows and columns of ``x`` that are whole, by a summed-area table."""
    table = np.pad(np.cumsum(np.cumsum(x, axis=0), axis=1), ((1, 0), (1, 0)))
    return table[size:, size:] - table[:-size, size:] - table[size:, :-size] + table[:-size, :-size]


def lee(rows: DataFrame, by: list[str], place: str, values: str, size: int = 5, noise: float | None = None, block: int = BLOCK) -> DataFrame:
    """``rows`` with ``values`` (an image row; nulls are not valid) freed of speckle: mean + k * (value - mean), k = max(0, (var - noise * mean^2) / var).

    Mean and variance are those of the valid pixels of a ``size`` x ``size`` window, the image mirrored at its borders; ``noise`` is the speckle's squared coefficient of variation, by
    default the median of var / mean^2 over a strip (approximate, to a hundredth of a percent of the ranks). Invalid pixels stay so and count nowhere. Rows of a strip
    are numbered from 0 without gaps by ``place`` and equally long.
    """
    left, right = size // 2, size - 1 - size // 2
    last = rows.groupBy(*by).agg(F.max(place).alias("_last"))
    cut = with_halo(rows.select(*by, place, values), place, max(left, right), block).join(last, by).filter(F.col("block") <= F.floor(F.col("_last") / block))
    keys = [f for f in rows.schema.fields if f.name in by]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys) + f", `{place}` {rows.schema[place].dataType.simpleString()}"

    def moments(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
        """own places, x, mean and variance of the own rows (NaN where a pixel is not valid or its window is empty)."""
        pdf = pdf.sort_values(place)
        x = np.array([np.asarray(v, dtype=np.float64) for v in pdf[values]])
        own = pdf["own"].to_numpy()
        at = pdf[place].to_numpy()
        top = left if at[0] == 0 else 0
        bottom = right if at[-1] == pdf["_last"].iloc[0] else 0
        wide = np.pad(x, ((top, bottom), (left, right)), mode="symmetric")
        valid = np.isfinite(wide)
        n = local_sums(valid.astype(np.float64), size)
        filled_in = np.where(valid, wide, 0.0)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = local_sums(filled_in, size) / n
            var = np.maximum(local_sums(filled_in * filled_in, size) / n - mean * mean, 0.0)
        first = np.flatnonzero(own)[0] - (left - top)  # the windows' first row is that of the row ``left`` below the first one held
        return at[own], x[own], mean[first : first + own.sum()], var[first : first + own.sum()]

    def ratios(pdf: pd.DataFrame) -> pd.DataFrame:
        at, x, mean, var = moments(pdf)
        good = np.isfinite(x) & (mean > 1e-12)
        return pd.DataFrame({**{k.name: [pdf[k.name].iloc[0]] for k in keys}, "r": [(var[good] / mean[good] ** 2).tolist()]})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at, x, mean, var = moments(pdf)
        cu2 = pdf["_noise"].iloc[0]
        with np.errstate(invalid="ignore", divide="ignore"):
            k = np.where(var > 0, np.clip((var - cu2 * mean * mean) / var, 0.0, 1.0), 0.0)
            out = np.where(np.isfinite(x) & (mean > 1e-12), mean + k * (x - mean), x)
        lists = [[None if v != v else v for v in row] for row in out.tolist()]
        return pd.DataFrame({**{f.name: [pdf[f.name].iloc[0]] * len(at) for f in keys}, place: at, values: lists})

    grouped = [*by, "block"]
    if noise is None:
        found = cut.groupBy(*grouped).applyInPandas(ratios, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys) + ", r array<double>")
        estimate = found.select(*by, F.explode("r").alias("r")).groupBy(*by).agg(F.percentile_approx("r", 0.5, 10_000).alias("_noise"))
        cut = cut.join(estimate, by, "left").fillna(0.0, ["_noise"])
    else:
        cut = cut.withColumn("_noise", F.lit(float(noise)))
    clean = cut.groupBy(*grouped).applyInPandas(run, f"{ddl}, `{values}` array<double>")
    return rows.drop(values).join(clean, [*by, place])

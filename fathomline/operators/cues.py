"""Cues by which a box on a strip is verified: seabed level, acoustic shadow, edges, coherence, mesh and missing rows.

A strip is rows with an array of samples. :func:`patches` cuts a box and its surroundings out of the blocks of rows it lies in, so a task sees boxes, never a
whole strip; :func:`measured` works on one patch at a time in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.operators.strips import BLOCK, moving_mean

#: What :func:`measured` adds.
CUES = "seabed double, side int, shadow_excess double, shadow_score double, shadow_px double, edge_px double, sharpness double, coherence double, mesh double, missing_rows double"


@dataclass(frozen=True)
class Levels:
    """Settings of the cues; levels are shares of the seabed level around the box."""

    dark: float = 0.5
    bright: float = 1.4
    full_excess: float = 0.35
    blank: float = 2.0
    least_ring: int = 16
    least_rows: float = 0.3
    gap: int = 3
    repeats: int = 4
    texture: float = 0.05
    smooth: int = 3


def patches(boxes: DataFrame, rows: DataFrame, strip: str, key: str, place: str, column: str, pad: int, block: int = BLOCK) -> DataFrame:
    """``boxes`` (``strip``, ``key``, x1, y1, x2, y2, ends exclusive) with patch: array of (place, samples) within ``pad`` of the box, and col0, the column it begins at.

    An equi join on strip and block of rows; what is shuffled are the samples cut to each box's columns. Boxes without rows, without width or height or with a
    null corner are left out; ``key`` must be unique. Rows may be missing.
    """
    low, high = F.floor((F.greatest(F.col("y1") - pad, F.lit(0))) / block), F.floor((F.col("y2") - 1 + pad) / block)
    sought = boxes.filter("x2 > x1 AND y2 > y1 AND y2 > 0").withColumn("col0", F.greatest(F.col("x1") - pad, F.lit(0)))
    parts = sought.select(strip, key, "col0", F.col("x2").alias("_x2"), F.col("y1").alias("_y1"), F.col("y2").alias("_y2"), F.explode(F.sequence(low, high)).alias("_block"))
    cut = rows.select(strip, F.col(place).alias("_place"), F.col(column).alias("_samples"), F.floor(F.col(place) / block).alias("_block"))
    met = parts.join(cut, [strip, "_block"]).filter((F.col("_place") >= F.col("_y1") - pad) & (F.col("_place") < F.col("_y2") + pad))
    samples = F.slice("_samples", (F.col("col0") + 1).cast("int"), (F.col("_x2") + pad - F.col("col0")).cast("int"))
    # one row for each box holds its own surroundings only: their size is the box's and the pad's
    found = met.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("_place").cast("long").alias("place"), samples.cast("array<double>").alias("x")))).alias("patch"))
    return sought.join(found, key)


def smoothed(x: np.ndarray, size: int) -> np.ndarray:
    return x if size < 2 else moving_mean(moving_mean(x, size).T, size).T


def dark_runs(dark: np.ndarray, gap: int) -> np.ndarray:
    """Length of each row's dark run from its first column on: it begins within ``gap`` and ends where ``gap`` columns in turn are light; 0 if there is none."""
    if not dark.shape[1]:
        return np.zeros(len(dark))
    wide = np.pad(dark, ((0, 0), (0, gap)))
    light = ~np.lib.stride_tricks.sliding_window_view(wide, gap, axis=1).any(axis=2)
    return np.argmax(light, axis=1).astype(float)


def coherence(x: np.ndarray) -> float:
    """How much the gradients have one direction, from 0 (none) to 1, by the structure tensor of the whole patch; NaN if it is flat."""
    if min(x.shape) < 2:
        return np.nan
    gy, gx = np.gradient(x)
    xx, yy, xy = (gx * gx).sum(), (gy * gy).sum(), (gx * gy).sum()
    return float(np.hypot(xx - yy, 2 * xy) / (xx + yy)) if xx + yy > 1e-9 else np.nan


def mesh(x: np.ndarray, level: float, repeats: int, least: float) -> float:
    """How far the texture repeats in two directions.

    Prominence of a shift: the correlation there less that at half the shift, which is low between the cells of a net and high for what only fades. The most prominent
    shift is sought among those of 4 samples up to a ``repeats``-th of the shorter side, and so is one at 45 degrees or more to it; the lesser of both counts. One set of
    parallel lines is no net.
    """
    h, w = x.shape
    if min(h, w) < 4 * repeats:
        return 0.0
    wave = x - smoothed(x, max(3, min(h, w) // 3 | 1))
    wave = wave - wave.mean()
    variance = float((wave * wave).mean())
    if variance**0.5 < least * max(level, 1e-9):
        return 0.0
    power = np.abs(np.fft.rfft2(wave, (2 * h, 2 * w))) ** 2
    most = min(h, w) // repeats
    down, across = np.mgrid[0 : most + 1, -most : most + 1]
    shared = (h - down) * (w - abs(across))
    correlation = np.fft.irfft2(power, (2 * h, 2 * w))[down, across] / shared / variance
    # a shift and its opposite correlate alike; what lies beyond the longest shift is not used
    at = lambda d, a: correlation[np.minimum(np.rint(np.abs(d)).astype(int), most), np.clip(np.rint(np.where(d < 0, -a, a)).astype(int), -most, most) + most]
    reach = np.hypot(down, across)
    usable = (reach >= 4) & (reach <= most) & ((down > 0) | (across > 0))
    if not usable.any():
        return 0.0
    prominence = np.where(usable, correlation - at(down / 2, across / 2), -np.inf)
    # of shifts that stand out nearly as much the shortest: across parallel lines, not slanting over them
    first = np.unravel_index(np.argmin(np.where(prominence >= 0.9 * prominence.max(), reach, np.inf)), prominence.shape)
    if prominence[first] <= 0:
        return 0.0
    along = np.array([down[first], across[first]]) / reach[first]
    turn = np.abs(np.degrees(np.arctan2(down, across)) - np.degrees(np.arctan2(along[0], along[1])))
    # parallel lines repeat at every shift that crosses them alike, so only the part of the second shift that runs along the lines is halved
    aside = across * along[0] - down * along[1]
    second = np.where(usable & (np.minimum(turn, 180 - turn) >= 45), correlation - at(down + aside * along[1] / 2, across - aside * along[0] / 2), -np.inf).max()
    return float(np.clip(min(prominence[first], second), 0, 1))


def sharpness(x: np.ndarray, dark: np.ndarray, level: float) -> float:
    """Upper quartile of the gradient where a dark region ends, as a share of the seabed level: cast shadows end within a few samples. NaN without such an edge."""
    if min(x.shape) < 2:
        return np.nan
    steep = np.hypot(*np.gradient(x)) / level
    edge = np.zeros(dark.shape, dtype=bool)
    edge[:, 1:] |= dark[:, 1:] != dark[:, :-1]
    edge[1:] |= dark[1:] != dark[:-1]
    return float(np.percentile(steep[edge], 75)) if edge.sum() >= 8 else np.nan


def cues_of(x: np.ndarray, box: tuple[int, int, int, int], side: int, window: int, levels: Levels) -> tuple:
    """The cues of one patch. ``box`` is x1, y1, x2, y2 in it; rows that are missing hold NaN. ``side`` is where the shadow falls: 1 to larger columns, -1, or 0 (the darker one)."""
    x1, y1, x2, y2 = box
    blank = np.nan_to_num(np.nanpercentile(np.where(np.isnan(x).all(axis=1, keepdims=True), 0.0, x), 99, axis=1)) <= levels.blank
    seen = ~np.isnan(x) & ~blank[:, None]
    own = np.zeros(x.shape, dtype=bool)
    own[y1:y2, x1:x2] = True
    missing = float(blank[y1:y2].mean())
    soft = smoothed(np.where(seen, x, 0.0), levels.smooth)

    def beyond(s: int, inner: bool) -> np.ndarray:
        out = np.zeros(x.shape, dtype=bool)
        middle = (x1 + x2) // 2
        cols = slice(middle if inner else x2, x2 + window) if s > 0 else slice(max(0, x1 - window), middle if inner else x1)
        out[y1:y2, cols] = True
        return out & seen

    ring = seen & ~own
    if side:
        ring &= ~beyond(side, False)
    nothing = (None, side, None, None, None, None, None, None, None, missing)
    if ring.sum() < levels.least_ring:
        return nothing
    level = float(np.median(soft[ring]))
    if level <= 0:
        return nothing
    dark = soft < levels.dark * level
    usual = float(dark[ring].mean())
    excess = {s: float(dark[region].mean()) - usual for s in ((side,) if side else (1, -1)) if (region := beyond(s, True)).sum() >= levels.least_ring}
    chosen = max(excess, key=lambda s: (excess[s], s)) if excess else side
    shadow = edge = None
    if chosen:
        turned, d, a = (soft[y1:y2], dark[y1:y2], (x1, x2)) if chosen > 0 else (soft[y1:y2, ::-1], dark[y1:y2, ::-1], (x.shape[1] - x2, x.shape[1] - x1))
        bright = turned[:, a[0] : a[1]] > levels.bright * level
        start = np.where(bright.any(axis=1), a[1] - np.argmax(bright[:, ::-1], axis=1), a[1])
        stop = np.minimum(start + window + (x2 - x1), x.shape[1])
        at = start[:, None] + np.arange(window + x2 - x1)
        run = dark_runs(np.where(at < stop[:, None], np.take_along_axis(d, np.minimum(at, x.shape[1] - 1), axis=1), False), levels.gap)
        some = run > 0
        shadow = 0.0
        if some.sum() >= levels.least_rows * (y2 - y1):
            shadow = float(np.median(run[some]))
            far = float(np.median(start[some]))
            edge = far if chosen > 0 else x.shape[1] - far
    inside = soft[y1:y2, x1:x2]
    best = excess.get(chosen)
    share = None if best is None else float(np.clip(best / levels.full_excess, 0, 1))
    tidy = lambda v: None if v is None or np.isnan(v) else v
    return level, chosen, best, share, shadow, edge, tidy(sharpness(soft, dark & seen, level)), tidy(coherence(inside)), mesh(inside, level, levels.repeats, levels.texture), missing


def measured(found: DataFrame, pad: int, nadir: str | None = None, window: int | None = None, levels: Levels = Levels()) -> DataFrame:
    """``found`` (of :func:`patches` with the same ``pad``) without patch and col0, with the columns of :data:`CUES`.

    The shadow is sought over ``window`` columns (by default ``pad``) beyond the box on the side away from the column ``nadir``; where that is null, on the darker side.
    shadow_excess is the share of dark samples there less that of the surroundings, shadow_px the median run of dark samples behind the object, edge_px the column where it begins
    (of the strip). Missing or blank rows count in missing_rows and nowhere else. Boxes with too few samples around have null cues.
    """
    names = [c for c in found.columns if c not in ("patch", "col0")]
    reach = pad if window is None else window
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema if f.name in names), CUES])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                top = max(int(r["y1"]) - pad, 0)
                width = max((0 if p["x"] is None else len(p["x"]) for p in r["patch"]), default=0)
                x = np.full((int(r["y2"]) + pad - top, max(width, 1)), np.nan)
                for p in r["patch"]:
                    if p["x"] is not None:
                        x[int(p["place"]) - top, : len(p["x"])] = np.asarray(p["x"], dtype=float)
                # rows beyond the strip's end are no missing rows
                x = x[: max(int(r["y2"]), r["patch"][-1]["place"] + 1) - top]
                box = (int(r["x1"]) - int(r["col0"]) if r["x1"] > 0 else 0, max(int(r["y1"]), 0) - top, min(int(r["x2"]) - int(r["col0"]), x.shape[1]), int(r["y2"]) - top)
                if box[2] - box[0] < 1:
                    out.append((None, 0, *[None] * 8))
                    continue
                middle = (r["x1"] + r["x2"]) / 2
                side = 0 if nadir is None or pd.isna(r[nadir]) else 1 if middle >= r[nadir] else -1
                cues = list(cues_of(x, box, side, reach, levels))
                cues[5] = None if cues[5] is None else cues[5] + r["col0"]
                out.append(tuple(cues))
            more = pd.DataFrame(out, columns=[c.strip().split(" ")[0] for c in CUES.split(",")], index=batch.index)
            more["side"] = more["side"].astype("Int32")
            yield pd.concat([batch[names], more], axis=1)

    return found.mapInPandas(run, schema)

"""Makes tracks of particles for tests of the tables made from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from fathomline.functions.geo import EARTH_RADIUS

PARTICLES = "target long, particle int, hours double, lat double, lon double, state string"


def particles(targets: DataFrame, hours: float, step_h: float, n: int = 200, diffusion: float = 1.0, every: int = 1, lon_shore: float | None = None, seed: int = 1) -> DataFrame:
    """target, particle, hours, lat, lon, state: ensembles from targets (target, lat, lon, u, v), by the midpoint rule and a random walk.

    The field (u, v in metres a second) turns with the tide once in 12.42 hours. A particle east of ``lon_shore`` is stranded and stays. Each target has its own generator,
    seeded by its id, so the result does not depend on partitions.
    """
    steps = round(hours / step_h)
    dt = step_h * 3600.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                rng = np.random.default_rng([seed, int(r.target)])
                lat, lon, ashore = np.full(n, r.lat), np.full(n, r.lon), np.zeros(n, bool)
                out = []
                for k in range(steps + 1):
                    if k % every == 0 or k == steps:
                        out.append(pd.DataFrame({"target": r.target, "particle": np.arange(n, dtype=np.int32), "hours": k * step_h, "lat": lat, "lon": lon, "state": np.where(ashore, "stranded", "active")}))
                    phase = 2 * np.pi * (k + 0.5) * step_h / 12.42
                    u, v = r.u * np.cos(phase) - r.v * np.sin(phase), r.u * np.sin(phase) + r.v * np.cos(phase)
                    noise = rng.normal(size=(2, n)) * np.sqrt(2 * diffusion * dt)
                    lat = np.where(ashore, lat, lat + np.degrees((v * dt + noise[1]) / EARTH_RADIUS))
                    lon = np.where(ashore, lon, lon + np.degrees((u * dt + noise[0]) / (EARTH_RADIUS * np.cos(np.radians(lat)))))
                    if lon_shore is not None:
                        ashore |= lon > lon_shore
                yield pd.concat(out)

    return targets.select("target", "lat", "lon", "u", "v").mapInPandas(run, PARTICLES)

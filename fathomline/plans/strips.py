"""Queries over strips of sonar pings: embeddings as pings, a label as a strip, and fixes as altitude series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.functions.score import rounded
from fathomline.operators import strips
from fathomline.plans.registry import query
from fathomline.plans.views import table

DX, COLUMNS, DR = 0.5, 40, 0.5
PING_SQL = f"""ping AS (SELECT vec_id, label AS strip, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS place, 1.0 + vec_id % 5 AS altitude,
    list_transform(embedding, lambda v: abs(v::DOUBLE) * 100) AS x FROM embeddings)"""
GROUND_SQL = f"""{PING_SQL}, side AS (SELECT vec_id, strip, altitude, 'port' AS side, x[1:32] AS s FROM ping UNION ALL SELECT vec_id, strip, altitude, 'starboard', x[33:64] FROM ping),
  far AS (SELECT *, sqrt(((bin + 0.5) * {DX}) ** 2 + altitude ** 2) / {DR} AS k FROM side, range({COLUMNS}) r(bin)),
  ground AS (SELECT vec_id, strip, altitude, side, bin, CASE WHEN k <= len(s) - 1 THEN s[floor(k)::BIGINT + 1] * (1 - (k - floor(k))) + coalesce(s[floor(k)::BIGINT + 2], 0) * (k - floor(k)) END AS v FROM far)"""


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a ping: its first half the port side, its second half the starboard side."""
    w = Window.partitionBy("label").orderBy("vec_id")
    x = F.transform("embedding", lambda v: F.abs(v.cast("double")) * 100)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("strip"), (F.row_number().over(w) - 1).cast("long").alias("place"), (F.lit(1.0) + F.pmod("vec_id", F.lit(5))).alias("altitude"), x.alias("x"))
    for k, side in enumerate(("port", "starboard")):
        rows = rows.withColumns({f"{side}_samples": F.slice("x", 32 * k + 1, 32), f"{side}_r0_m": F.lit(0.0), f"{side}_dr_m": F.lit(DR)})
    return rows


def by_bin(rows: DataFrame) -> DataFrame:
    sides = [F.struct(F.lit(s).alias("side"), F.col(f"{s}_ground").alias("g")) for s in ("port", "starboard")]
    rows = rows.select("vec_id", F.explode(F.array(*sides)).alias("s")).select("vec_id", "s.side", F.posexplode("s.g").alias("bin", "v"))
    return rows.select("vec_id", "side", F.col("bin").cast("long").alias("bin"), rounded(F.col("v"), 4).alias("v"))


@query("d15_ground_ranges", f"WITH {GROUND_SQL} SELECT vec_id, side, bin, CAST(round(CAST(v AS DECIMAL(18,8)), 4) AS DOUBLE) AS v FROM ground")
def d15_ground(spark, d):
    return by_bin(strips.ground_ranged(pings(spark, d).drop("x"), DX, COLUMNS))


@query("d15_levelled", f"""WITH {GROUND_SQL}, cell AS (SELECT strip, side, altitude, bin, count(v) AS n, sum(v) AS s FROM ground GROUP BY 1, 2, 3, 4), line AS (SELECT strip, side, bin, sum(s) / nullif(sum(n), 0) AS g FROM cell GROUP BY 1, 2, 3)
  SELECT vec_id, side, bin, CAST(round(CAST(CASE WHEN gain > 0 THEN v / gain END AS DECIMAL(18,8)), 4) AS DOUBLE) AS v FROM (SELECT g.*, CASE WHEN c.n >= 20 THEN c.s / c.n ELSE l.g END AS gain FROM ground g JOIN cell c USING (strip, side, altitude, bin) JOIN line l USING (strip, side, bin))""")
def d15_levelled(spark, d):
    rows = strips.ground_ranged(pings(spark, d).drop("x"), DX, COLUMNS)
    for side in ("port", "starboard"):
        rows = strips.levelled(rows, ["strip"], f"{side}_ground")
    return by_bin(rows)


@query("d13_lee_filter", f"""WITH {PING_SQL}, cell AS (SELECT vec_id, strip, place, c, x[c + 1] AS v FROM ping, range(64) r(c)), n AS (SELECT strip, max(place) + 1 AS n FROM ping GROUP BY 1),
  tall AS (SELECT strip, place, c, v FROM cell UNION ALL SELECT strip, -1 - place, c, v FROM cell WHERE place < 2 UNION ALL SELECT strip, 2 * n - 1 - place, c, v FROM cell JOIN n USING (strip) WHERE place >= n - 2),
  wide AS (SELECT strip, place, c, v FROM tall UNION ALL SELECT strip, place, -1 - c, v FROM tall WHERE c < 2 UNION ALL SELECT strip, place, 127 - c, v FROM tall WHERE c >= 62),
  across AS (SELECT strip, place, c, sum(v) OVER w AS s, sum(v * v) OVER w AS q FROM wide WINDOW w AS (PARTITION BY strip, place ORDER BY c ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
  along AS (SELECT strip, place, c, sum(s) OVER w / 25 AS mean, sum(q) OVER w / 25 AS square FROM across WINDOW w AS (PARTITION BY strip, c ORDER BY place ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
  m AS (SELECT vec_id, c, v, mean, greatest(square - mean * mean, 0) AS var FROM cell JOIN along USING (strip, place, c))
  SELECT vec_id, c AS col, CAST(round(CAST(mean + CASE WHEN var > 0 THEN greatest((var - 0.3 * mean * mean) / var, 0) ELSE 0 END * (v - mean) AS DECIMAL(18,8)), 4) AS DOUBLE) AS v FROM m""")
def d13_lee(spark, d):
    clean = strips.lee(pings(spark, d).select("vec_id", "strip", "place", "x"), ["strip"], "place", "x", 5, 0.3)
    return clean.select("vec_id", F.posexplode("x").alias("col", "v")).select("vec_id", F.col("col").cast("long").alias("col"), rounded(F.col("v"), 4).alias("v"))


TRACK_SQL = """t AS (SELECT user_id AS strip, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place, CASE WHEN event_id % 5 > 0 THEN 8 + value / 100 END AS p, CASE WHEN event_id % 6 > 0 THEN 8 + value / 100 + event_id % 7 / 2.0 END AS s,
    CASE WHEN event_id % 3 > 0 THEN 9.0 + event_id % 11 END AS h FROM events),
  a AS (SELECT *, CASE WHEN p IS NOT NULL AND s IS NOT NULL THEN (p + s) / 2 ELSE coalesce(p, s) END AS prelim FROM t), b AS (SELECT *, quantile_cont(prelim, 0.5) OVER w AS ref FROM a WINDOW w AS (PARTITION BY strip ORDER BY place ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
  c AS (SELECT *, CASE WHEN p IS NOT NULL AND s IS NOT NULL AND abs(p - s) > 0.15 * ref THEN CASE WHEN h IS NULL THEN greatest(p, s) WHEN abs(p - h) <= abs(s - h) THEN p ELSE s END ELSE prelim END AS t FROM b),
  e AS (SELECT *, quantile_cont(t, 0.5) OVER w AS m FROM c WINDOW w AS (PARTITION BY strip ORDER BY place ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)), f AS (SELECT *, CASE WHEN abs(t - m) > 1 THEN m ELSE t END AS taken, coalesce(h > 0.5 AND h < 18, false) AS fits FROM e),
  g AS (SELECT *, fits AND abs(taken - h) > 0.35 * h AS rejected, fits AND (m IS NULL OR abs(h - m) <= 0.35 * m) AS agrees FROM f)"""


@query("d14_bottom_track", f"""WITH {TRACK_SQL} SELECT strip, place, CAST(round(CAST(CASE WHEN t IS NOT NULL THEN CASE WHEN rejected THEN h ELSE taken END WHEN agrees THEN h ELSE m END AS DECIMAL(18,8)), 4) AS DOUBLE) AS altitude,
  CASE WHEN t IS NOT NULL THEN CASE WHEN rejected THEN 'header, track rejected' ELSE 'bottom track' END WHEN agrees THEN 'header' WHEN m IS NOT NULL THEN 'bottom track, interpolated' ELSE 'none' END AS source FROM g""")
def d14_bottom(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k, at = F.col("event_id"), 8 + F.col("value") / 100
    rows = table(spark, d, "events").select(
        F.col("user_id").alias("strip"), (F.row_number().over(w) - 1).cast("long").alias("place"), F.when(k % 5 > 0, at).alias("port_track_m"), F.when(k % 6 > 0, at + k % 7 / 2.0).alias("starboard_track_m"),
        F.when(k % 3 > 0, 9.0 + k % 11).alias("altitude_m"), *(F.array_repeat(F.lit(0.0), 36).alias(f"{s}_samples") for s in ("port", "starboard")), *(F.lit(0.0).alias(f"{s}_r0_m") for s in ("port", "starboard")), *(F.lit(0.5).alias(f"{s}_dr_m") for s in ("port", "starboard")),
    )
    return strips.altitudes(rows, ["strip"], "place").select("strip", "place", rounded(F.col("altitude"), 4).alias("altitude"), F.col("altitude_source").alias("source"))

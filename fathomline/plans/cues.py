"""Queries over boxes on strips: what surrounds a box, its shadow and the rows it lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import geo
from fathomline.functions.score import rounded
from fathomline.operators import cues
from fathomline.operators.cues import Levels
from fathomline.plans.registry import query
from fathomline.plans.strips import PING_SQL, pings

#: Vectors as pings of a strip; a box of 10 columns and 6 rows stands at every 25th ping, and the nadir at column 20.
PAD, WIDE, TALL, NADIR, COLUMNS, EVERY = 8, 10, 6, 20, 64, 25
PLAIN = Levels(smooth=1, dark=0.5, blank=-1.0)
BOX_SQL = f"""{PING_SQL}, n AS (SELECT strip, max(place) AS top FROM ping GROUP BY 1), box AS (SELECT vec_id AS id, strip, altitude, place AS y1, place + {TALL} AS y2, 8 + vec_id % 40 AS x1, 8 + vec_id % 40 + {WIDE} AS x2 FROM ping JOIN n USING (strip) WHERE place % {EVERY} = 0 AND place + {TALL} <= top),
  near AS (SELECT b.*, p.place, x1 + {WIDE // 2} >= {NADIR} AS far, c, p.x[c + 1] AS v FROM box b JOIN ping p ON p.strip = b.strip AND p.place BETWEEN b.y1 - {PAD} AND b.y2 + {PAD} - 1, range({COLUMNS}) r(c) WHERE c >= x1 - {PAD} AND c < x2 + {PAD}),
  zoned AS (SELECT *, place >= y1 AND place < y2 AS row_in, c >= x1 AND c < x2 AS col_in, place >= y1 AND place < y2 AND CASE WHEN far THEN c >= x2 ELSE c < x1 END AS beyond,
    place >= y1 AND place < y2 AND CASE WHEN far THEN c >= (x1 + x2) // 2 ELSE c < (x1 + x2) // 2 END AS shade FROM near),
  lit AS (SELECT id, median(v) FILTER (NOT (row_in AND col_in) AND NOT beyond) AS level FROM zoned GROUP BY 1),
  cue AS (SELECT id, any_value(strip) AS strip, any_value(far) AS far, any_value(level) AS level, avg((v < 0.5 * level)::INT) FILTER (shade) - avg((v < 0.5 * level)::INT) FILTER (NOT (row_in AND col_in) AND NOT beyond) AS excess FROM zoned JOIN lit USING (id) GROUP BY 1)"""
R5 = "CAST(round(CAST({} AS DECIMAL(18,8)), 5) AS DOUBLE)"


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pings(spark, sf_dir).select("vec_id", "strip", "place", "altitude", "x")
    top = rows.groupBy("strip").agg(F.max("place").alias("top"))
    left = (8 + F.pmod("vec_id", F.lit(40))).cast("long")
    boxes = rows.filter(F.col("place") % EVERY == 0).join(top, "strip").filter(F.col("place") + TALL <= F.col("top"))
    boxes = boxes.select(F.col("vec_id").alias("id"), "strip", "altitude", left.alias("x1"), F.col("place").alias("y1"), (left + WIDE).alias("x2"), (F.col("place") + TALL).alias("y2"), F.lit(float(NADIR)).alias("nadir"))
    return cues.measured(cues.patches(boxes, rows, "strip", "id", "place", "x", PAD), PAD, "nadir", levels=PLAIN)


@query("d17_shadow_cues", f"WITH {BOX_SQL} SELECT id, strip, CASE WHEN far THEN 1 ELSE -1 END AS side, {R5.format('level')} AS seabed, {R5.format('excess')} AS excess, {R5.format('least(greatest(excess / 0.35, 0), 1)')} AS score FROM cue")
def d17_shadow(spark, d):
    return found(spark, d).select("id", "strip", "side", rounded(F.col("seabed"), 5).alias("seabed"), rounded(F.col("shadow_excess"), 5).alias("excess"), rounded(F.col("shadow_score"), 5).alias("score"))


@query("d23_shadow_heights")
def d23_heights(spark, d):
    """Object heights from shadow lengths, and the texture cues, of every box; tested on strips of known make."""
    rows = found(spark, d)
    out = F.abs(F.col("edge_px") - F.col("nadir")) * 0.5
    return rows.select("id", "strip", "shadow_px", "edge_px", rounded(geo.shadow_height(F.col("altitude"), F.col("shadow_px") * 0.5, out), 4).alias("height_m"), rounded(F.col("sharpness"), 5).alias("sharpness"), rounded(F.col("coherence"), 5).alias("coherence"), rounded(F.col("mesh"), 5).alias("mesh"), "missing_rows")

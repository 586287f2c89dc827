"""Queries that choose among rows: segments of tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.operators import segments
from fathomline.plans.registry import query
from fathomline.plans.views import FIX_SQL, fixes


@query("w23_segments", f"""WITH RECURSIVE {FIX_SQL}, b AS (SELECT DISTINCT device, t_s // 21600 AS b FROM fix), s AS (SELECT device, b FROM (SELECT device, b, lead(b, 2) OVER (PARTITION BY device ORDER BY b) AS e FROM b) WHERE e = b + 2),
  walk AS (SELECT device, min(b) AS b FROM s GROUP BY 1 UNION ALL SELECT walk.device, (SELECT min(s.b) FROM s WHERE s.device = walk.device AND s.b >= walk.b + 8) AS b FROM walk WHERE walk.b IS NOT NULL),
  n AS (SELECT device, b, row_number() OVER (PARTITION BY device ORDER BY b) - 1 AS i, count(*) OVER (PARTITION BY device) AS m FROM walk WHERE b IS NOT NULL),
  p AS (SELECT DISTINCT device, b, i FROM n, range(4) r(j) WHERE m <= 4 OR i = round_even(j * (m - 1) / 3.0, 0)), d AS (SELECT device, b, row_number() OVER (PARTITION BY device ORDER BY b) - 1 AS depth FROM p)
  SELECT device, b, depth FROM d ORDER BY depth, device, b LIMIT 1000""")
def w23(spark, d):
    b = fixes(spark, d).select("device", F.floor(F.col("t_s") / 21600).alias("b")).distinct()
    return segments.segments(b, ["device"], "b", 3, 1, 8, 4, 1000)

"""Queries over areas: boxes of detections as polygons, their classes as layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.score import rounded
from fathomline.operators import polygons
from fathomline.plans.registry import query
from fathomline.plans.views import DET_SQL, detections

SLAB = 512.0
BOX_SQL = f"{DET_SQL}, b AS (SELECT strip, class, x AS x0, x + 64 + id % 128 AS x1, y AS y0, y + 64 + id % 96 AS y1 FROM det)"
#: Cells between neighbouring x of one strip's boxes, then between neighbouring y of the boxes there.
CELL_SQL = """xs AS (SELECT {k}, x, lead(x) OVER (PARTITION BY {k} ORDER BY x) AS nx FROM (SELECT {k}, x0 AS x FROM b UNION SELECT {k}, x1 FROM b)), cb AS (SELECT {k}, x, nx, {more} y0, y1 FROM xs JOIN b USING ({k}) WHERE x0 <= x AND x1 >= nx),
  ys AS (SELECT {k}, x, nx, y, lead(y) OVER (PARTITION BY {k}, x, nx ORDER BY y) AS ny FROM (SELECT {k}, x, nx, y0 AS y FROM cb UNION SELECT {k}, x, nx, y1 FROM cb))"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    x, y, k = F.col("x"), F.col("y"), F.col("id")
    return d.select("strip", F.col("class").alias("layer"), k.cast("string").alias("polygon"), polygons.box(x, y, x + 64 + k % 128, y + 64 + k % 96).alias("rings"))


@query("a17_union_areas", f"""WITH {BOX_SQL}, {CELL_SQL.format(k="strip", more="class,")}, cell AS (SELECT strip, x, nx, y, ny, array_to_string(list_sort(list_distinct(list(class))), '+') AS layers FROM ys JOIN cb USING (strip, x, nx) WHERE y0 <= y AND y1 >= ny GROUP BY ALL)
  SELECT strip, layers, CAST(sum((nx - x) * (ny - y)) AS DOUBLE) AS area FROM cell GROUP BY 1, 2""")
def a17(spark, d):
    return polygons.areas(boxes(spark, d), ["strip"], SLAB).select("strip", F.array_join("layers", "+").alias("layers"), rounded(F.col("area"), 2).alias("area"))


@query("x28_dissolved", f"""WITH {BOX_SQL.replace("b AS (", "whole AS (")}, b AS (SELECT strip || '/' || class AS k, strip, class, greatest(x0, 1000) AS x0, least(x1, 3000) AS x1, greatest(y0, 1000) AS y0, least(y1, 3000) AS y1 FROM whole WHERE x0 < 3000 AND x1 > 1000 AND y0 < 3000 AND y1 > 1000),
  {CELL_SQL.format(k="k", more="")}, cell AS (SELECT DISTINCT k, x, nx, y, ny FROM ys JOIN cb USING (k, x, nx) WHERE y0 <= y AND y1 >= ny) SELECT strip, class, CAST(sum((nx - x) * (ny - y)) AS DOUBLE) AS area FROM cell JOIN (SELECT DISTINCT k, strip, class FROM b) USING (k) GROUP BY 1, 2""")
def x28_dissolved(spark, d):
    """Each class's boxes, clipped to a region and dissolved: the region is a layer beside them."""
    corner = lambda k, c: F.col("rings")[0][k][c]
    found = boxes(spark, d).filter((corner(0, "x") < 3000) & (corner(2, "x") > 1000) & (corner(0, "y") < 3000) & (corner(2, "y") > 1000))
    region = found.select("strip").distinct().select("strip", F.lit("region").alias("layer"), F.lit("region").alias("polygon"), polygons.box(*(F.lit(v) for v in (1000, 1000, 3000, 3000))).alias("rings"))
    sets = polygons.areas(found.unionByName(region), ["strip"], SLAB).filter(F.array_contains("layers", "region"))
    parts = sets.select("strip", "area", F.explode(F.array_remove("layers", "region")).alias("class"))
    return parts.groupBy("strip", "class").agg(rounded(F.sum("area"), 2).alias("area"))

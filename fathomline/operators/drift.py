"""Tables made from the tracks of drifting particles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions.score import rounded


def displacement(rows: DataFrame) -> DataFrame:
    """target, hours and the median, ninth decile and largest of the particles' distance from their common start."""
    from fathomline.functions.geo import haversine

    start = rows.filter("hours = 0").groupBy("target").agg(F.avg("lat").alias("lat0"), F.avg("lon").alias("lon0"))
    d = rows.join(start, "target").withColumn("d", haversine(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")))
    q = d.groupBy("target", "hours").agg(F.percentile("d", F.array(F.lit(0.5), F.lit(0.9))).alias("q"), F.max("d").alias("most"))
    return q.select("target", "hours", F.col("q")[0].alias("median_m"), F.col("q")[1].alias("p90_m"), F.col("most").alias("max_m"))


def impacts(rows: DataFrame, areas: DataFrame) -> DataFrame:
    """target, area, probability, first_h, median_h: share of particles that reach each box (area, south, west, north, east), and when."""
    total = rows.groupBy("target").agg(F.countDistinct("particle").alias("total"))
    a = F.broadcast(areas)  # a table of settings
    inside = F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east"))
    first = rows.join(a, inside).groupBy("target", "area", "particle").agg(F.min("hours").alias("h"))
    hit = first.groupBy("target", "area").agg(F.count("*").alias("n"), F.min("h").alias("first_h"), F.percentile("h", 0.5).alias("median_h"))
    return hit.join(total, "target").select("target", "area", rounded(F.col("n") / F.col("total"), 4).alias("probability"), "first_h", "median_h")


def stranding(rows: DataFrame, cell: float) -> DataFrame:
    """target, cell_lat, cell_lon, n of stranded particles at the end."""
    last = rows.groupBy("target", "particle").agg(F.max(F.struct("hours", "lat", "lon", "state")).alias("e")).filter("e.state = 'stranded'")
    return last.groupBy("target", F.floor(F.col("e.lat") / cell).alias("cell_lat"), F.floor(F.col("e.lon") / cell).alias("cell_lon")).agg(F.count("*").alias("n"))


def region(rows: DataFrame, share: float, cell: float) -> DataFrame:
    """target, hours, cell_lat, cell_lon: the fewest cells that hold ``share`` of the particles, the fullest first."""
    from pyspark.sql.window import Window

    c = rows.groupBy("target", "hours", F.floor(F.col("lat") / cell).alias("cell_lat"), F.floor(F.col("lon") / cell).alias("cell_lon")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("target", "hours")
    before = F.coalesce(F.sum("n").over(w.orderBy(F.desc("n"), "cell_lat", "cell_lon").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return c.withColumn("before", before).withColumn("total", F.sum("n").over(w)).filter(F.col("before") < share * F.col("total")).select("target", "hours", "cell_lat", "cell_lon", "n")

"""Drift, track-skill and forecast queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.functions import geo
from fathomline.functions.score import rounded
from fathomline.operators import drift
from fathomline.plans.registry import query
from fathomline.plans.telemetry import hav_sql
from fathomline.plans.views import FIX_SQL, fixes, table

R4 = "CAST(round(CAST({} AS DECIMAL(18,8)), 4) AS DOUBLE)"


#: Tracks of particles, as a forecast's table holds them: of each target (a supplier) its particles' (orders') places hour by hour.
TRACK_SQL = """tr AS (SELECT l_suppkey AS target, l_orderkey AS particle, l_linenumber - 1 AS hours, 10 + (l_orderkey * 53 + l_linenumber * 11) % 1000 / 1000.0 AS lat, 79 + (l_orderkey * 59 + l_linenumber * 7) % 1000 / 1000.0 AS lon, CASE WHEN l_returnflag = 'R' THEN 'stranded' ELSE 'active' END AS state FROM lineitem)"""
AREAS = (("reef", 10.2, 79.2, 10.5, 79.5), ("port", 10.6, 79.6, 10.9, 79.95))


def tracks(spark, d):
    line, order = F.col("l_linenumber"), F.col("l_orderkey")
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("target"), order.alias("particle"), (line - 1).alias("hours"), (10 + F.pmod(order * 53 + line * 11, F.lit(1000)) / 1000.0).alias("lat"),
        (79 + F.pmod(order * 59 + line * 7, F.lit(1000)) / 1000.0).alias("lon"), F.when(F.col("l_returnflag") == "R", "stranded").otherwise("active").alias("state"),
    )


R2 = "CAST(round(CAST({} AS DECIMAL(18,8)), 2) AS DOUBLE)"


@query("d08_a28_displacement", f"""WITH {TRACK_SQL}, s AS (SELECT target, avg(lat) AS lat0, avg(lon) AS lon0 FROM tr WHERE hours = 0 GROUP BY 1), e AS (SELECT target, hours, {hav_sql('lat0', 'lon0', 'lat', 'lon')} AS d FROM tr JOIN s USING (target))
  SELECT target, hours, {R2.format('quantile_cont(d, 0.5)')} AS median_m, {R2.format('quantile_cont(d, 0.9)')} AS p90_m, {R2.format('max(d)')} AS max_m FROM e GROUP BY 1, 2""")
def d08(spark, d):
    return drift.displacement(tracks(spark, d)).select("target", "hours", *[rounded(F.col(c), 2).alias(c) for c in ("median_m", "p90_m", "max_m")])


@query("a26_impacts", f"""WITH {TRACK_SQL}, a(area, south, west, north, east) AS (VALUES {', '.join(map(str, AREAS))}), f AS (SELECT target, area, particle, min(hours) AS h FROM tr JOIN a ON lat BETWEEN south AND north AND lon BETWEEN west AND east GROUP BY 1, 2, 3), n AS (SELECT target, count(DISTINCT particle) AS n FROM tr GROUP BY 1)
  SELECT target, area, {R4.format('count(*) * 1.0 / any_value(n.n)')} AS probability, min(h) AS first_h, quantile_cont(h, 0.5) AS median_h FROM f JOIN n USING (target) GROUP BY 1, 2""")
def a26(spark, d):
    areas = spark.createDataFrame(AREAS, "area string, south double, west double, north double, east double")
    return drift.impacts(tracks(spark, d), areas)


@query("a27_stranding_grid", f"WITH {TRACK_SQL}, e AS (SELECT target, particle, max(row(hours, lat, lon, state)) AS e FROM tr GROUP BY 1, 2) SELECT target, CAST(floor(e[2] / 0.25) AS BIGINT) AS cell_lat, CAST(floor(e[3] / 0.25) AS BIGINT) AS cell_lon, count(*) AS n FROM e WHERE e[4] = 'stranded' GROUP BY 1, 2, 3")
def a27(spark, d):
    return drift.stranding(tracks(spark, d), 0.25)


@query("d10_likely_region", f"""WITH {TRACK_SQL}, c AS (SELECT target, hours, CAST(floor(lat / 0.25) AS BIGINT) AS cell_lat, CAST(floor(lon / 0.25) AS BIGINT) AS cell_lon, count(*) AS n FROM tr GROUP BY 1, 2, 3, 4), w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY target, hours ORDER BY n DESC, cell_lat, cell_lon ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY target, hours) AS total FROM c)
  SELECT target, hours, cell_lat, cell_lon, n FROM w WHERE before < 0.9 * total""")
def d10(spark, d):
    return drift.region(tracks(spark, d), 0.9, 0.25)


@query("a15_track_skill", f"""WITH {FIX_SQL}, s AS (SELECT device, t_s, id, {hav_sql('lat', 'lon', 'lat + value / 1e5', 'lon + value / 2e5')} AS d, coalesce({hav_sql('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')}, 0) AS l FROM fix WINDOW w AS (PARTITION BY device ORDER BY t_s, id)),
  c AS (SELECT device, d, sum(CAST(l AS DECIMAL(18,6))) OVER (PARTITION BY device ORDER BY t_s, id ROWS UNBOUNDED PRECEDING) AS cum FROM s) SELECT device, {R4.format('greatest(0, 1 - sum(d) / sum(CAST(cum AS DOUBLE)))')} AS skill FROM c GROUP BY device HAVING sum(CAST(cum AS DOUBLE)) > 0""")
def a15(spark, d):
    w = Window.partitionBy("device").orderBy("t_s", "id")
    off = geo.haversine(F.col("lat"), F.col("lon"), F.col("lat") + F.col("value") / 1e5, F.col("lon") + F.col("value") / 2e5)
    step = F.coalesce(geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")), F.lit(0.0)).cast("decimal(18,6)")
    rows = fixes(spark, d).withColumns({"d": off, "l": step})
    rows = rows.withColumn("cum", F.sum("l").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double"))
    g = rows.groupBy("device").agg(F.sum("d").alias("d"), F.sum("cum").alias("c")).filter("c > 0")
    return g.select("device", rounded(F.greatest(F.lit(0.0), 1 - F.col("d") / F.col("c")), 4).alias("skill"))


@query("f22_constant_velocity", "SELECT s_suppkey, k AS hour, CAST(round(CAST(s_acctbal + k * 0.25 * 3.6 AS DECIMAL(18,8)), 4) AS DOUBLE) AS along_km FROM supplier, range(0, 25, 6) r(k)")
def f22(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long"), F.lit(6).cast("long"))).alias("hour")).select("s_suppkey", "hour", rounded(F.col("s_acctbal") + F.col("hour") * 0.25 * 3.6, 4).alias("along_km"))


@query("f54_clipped_window", "SELECT o_orderkey, greatest(o_orderdate, TIMESTAMP '1995-01-01') AS start, least(o_orderdate + INTERVAL 90 DAY, TIMESTAMP '1998-01-01') AS stop, o_orderdate < TIMESTAMP '1995-01-01' AS shifted FROM orders WHERE o_orderdate + INTERVAL 90 DAY > TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
def f54(spark, d):
    t = F.col("o_orderdate")
    low, high = F.lit("1995-01-01").cast(table(spark, d, "orders").schema["o_orderdate"].dataType), F.lit("1998-01-01").cast(table(spark, d, "orders").schema["o_orderdate"].dataType)
    stop = t + F.expr("INTERVAL 90 DAY")
    return table(spark, d, "orders").filter((stop > low) & (t < high)).select("o_orderkey", F.greatest(t, low).alias("start"), F.least(stop, high).alias("stop"), (t < low).alias("shifted"))


@query("x24_snapshot_means", f"WITH {FIX_SQL} SELECT t_s // 86400 AS day, {R4.format('avg(lat)')} AS mean_lat, {R4.format('avg(lon)')} AS mean_lon, count(*) AS n FROM fix GROUP BY 1")
def x24(spark, d):
    return fixes(spark, d).groupBy(F.floor(F.col("t_s") / 86400).alias("day")).agg(rounded(F.avg("lat"), 4).alias("mean_lat"), rounded(F.avg("lon"), 4).alias("mean_lon"), F.count("*").alias("n"))

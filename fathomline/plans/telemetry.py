"""Telemetry and navigation queries: fixes, links, tracks, ordered sequences."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.functions import geo
from fathomline.functions.score import rounded
from fathomline.operators import joins, windows
from fathomline.plans.registry import query
from fathomline.plans.views import FIX_SQL, NAV_SQL, fixes, nav_rows, table
from fathomline.streaming import telemetry as stream

R4 = "CAST(round(CAST({} AS DECIMAL(18,8)), 4) AS DOUBLE)"
NOW = 1704326400


def hav_sql(a, b, c, e):
    return f"2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({e} - {b}) / 2), 2))))"


LINK_SQL = f"{FIX_SQL}, link AS (SELECT device, id AS link_id, t_s AS start, lead(t_s) OVER (PARTITION BY device ORDER BY t_s, id) AS end_ FROM fix WHERE event = 'signup')"


def links(spark, d):
    return stream.link_intervals(fixes(spark, d), "signup")


@query("p11_validate_fixes", f"""WITH {FIX_SQL} SELECT id, CASE WHEN t_s IS NULL THEN 'time missing' WHEN t_s < 946684800 THEN 'time before 2000' WHEN t_s > {NOW} + 300 THEN 'time in the future' WHEN lat = 0 AND lon = 0 THEN 'no fix'
  WHEN lat NOT BETWEEN -90 AND 90 THEN 'lat out of range' WHEN lon NOT BETWEEN -180 AND 180 THEN 'lon out of range' WHEN value NOT BETWEEN 0 AND 450 THEN 'value out of range' END AS error FROM fix""")
def p11(spark, d):
    return stream.validated(fixes(spark, d), F.lit(NOW)).select("id", "error")


@query("st01_accept_reject", f"WITH {FIX_SQL} SELECT device, count(*) FILTER (t_s <= {NOW} + 300 AND value <= 450) AS accepted, count(*) FILTER (NOT (t_s <= {NOW} + 300 AND value <= 450)) AS rejected FROM fix GROUP BY device")
def st01(spark, d):
    rows = stream.validated(fixes(spark, d), F.lit(NOW))
    return rows.groupBy("device").agg(F.count_if(F.col("error").isNull()).alias("accepted"), F.count_if(F.col("error").isNotNull()).alias("rejected"))


@query("j04_latest_fix", f"WITH {FIX_SQL} SELECT device, t_s, id, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY device ORDER BY t_s DESC, id DESC) AS n FROM fix) WHERE n = 1")
def j04(spark, d):
    return joins.latest(fixes(spark, d).select("device", "t_s", "id", "lat", "lon"), "device", "t_s", "id")


@query("j05_fixes_for_link", f"WITH {LINK_SQL} SELECT link_id, count(*) AS fixes, min(f.t_s) AS first_t, max(f.t_s) AS last_t FROM fix f JOIN link l ON f.device = l.device AND f.t_s >= l.start AND (l.end_ IS NULL OR f.t_s <= l.end_) GROUP BY link_id")
def j05(spark, d):
    rows = joins.within_intervals(fixes(spark, d), links(spark, d), ["device"], "t_s", "start", "end")
    return rows.groupBy(F.col("i_link_id").alias("link_id")).agg(F.count("*").alias("fixes"), F.min("t_s").alias("first_t"), F.max("t_s").alias("last_t"))


SNAP_SQL = f"{LINK_SQL}, snap AS (SELECT link_id, device, start + k * 43200 AS t_s, 10 + (link_id * 31 % 1000) / 1000.0 + k * 0.01 AS mean_lat FROM link, range(20) r(k)), paired AS (SELECT f.id, f.t_s, f.lat, l.link_id FROM fix f JOIN link l ON f.device = l.device AND f.t_s >= l.start AND (l.end_ IS NULL OR f.t_s < l.end_))"


def snapshots(spark, d):
    steps = spark.range(20).select(F.col("id").alias("k"))
    lat = 10 + F.pmod(F.col("link_id") * 31, F.lit(1000)) / 1000.0 + F.col("k") * 0.01
    return links(spark, d).crossJoin(F.broadcast(steps)).select("link_id", (F.col("start") + F.col("k") * 43200).cast("long").alias("t_s"), lat.alias("mean_lat"))


def paired(spark, d):
    rows = joins.within_intervals(fixes(spark, d), links(spark, d), ["device"], "t_s", "start", "end").filter(F.col("i_end").isNull() | (F.col("t_s") < F.col("i_end")))
    return rows.select("id", "t_s", "lat", F.col("i_link_id").alias("link_id"))


@query("j06_forecast_bracket", f"""WITH {SNAP_SQL}, lo AS (SELECT p.id, p.lat, p.t_s, max(row(s.t_s, s.mean_lat)) AS a FROM paired p JOIN snap s ON p.link_id = s.link_id AND s.t_s <= p.t_s GROUP BY 1, 2, 3),
  hi AS (SELECT p.id, min(row(s.t_s, s.mean_lat)) AS b FROM paired p JOIN snap s ON p.link_id = s.link_id AND s.t_s >= p.t_s GROUP BY 1)
  SELECT lo.id, CAST(round(CAST(CASE WHEN a[1] = b[1] THEN a[2] ELSE a[2] + (b[2] - a[2]) * (t_s - a[1]) / (b[1] - a[1]) END AS DECIMAL(18,8)), 6) AS DOUBLE) AS forecast_lat FROM lo JOIN hi USING (id)""")
def j06(spark, d):
    snap = snapshots(spark, d)
    before = joins.asof(paired(spark, d), snap, ["link_id"], "t_s", ["mean_lat"]).withColumnsRenamed({"mean_lat": "lat_a", "t_s_matched": "t_a"})
    both = joins.asof(before, snap, ["link_id"], "t_s", ["mean_lat"], forward=True).filter("lat_a IS NOT NULL AND mean_lat IS NOT NULL")
    line = F.col("lat_a") + (F.col("mean_lat") - F.col("lat_a")) * (F.col("t_s") - F.col("t_a")) / F.nullif(F.col("t_s_matched") - F.col("t_a"), F.lit(0))
    return both.select("id", rounded(F.coalesce(line, F.col("lat_a")), 6).alias("forecast_lat"))


@query("j09_asof_backward", f"WITH {FIX_SQL}, p AS (SELECT device, t_s, max(id) AS pid FROM fix WHERE event = 'purchase' GROUP BY 1, 2) SELECT f.id, max(row(p.t_s, p.pid))[2] AS purchase_id FROM (SELECT * FROM fix WHERE event = 'error') f LEFT JOIN p ON p.device = f.device AND p.t_s <= f.t_s GROUP BY f.id")
def j09(spark, d):
    f = fixes(spark, d)
    p = f.filter("event = 'purchase'").groupBy("device", "t_s").agg(F.max("id").alias("purchase_id"))
    return joins.asof(f.filter("event = 'error'").select("id", "device", "t_s"), p, ["device"], "t_s", ["purchase_id"]).select("id", "purchase_id")


@query("j10_within_radius", f"WITH {FIX_SQL} SELECT a.id AS id, b.id AS near_id, CAST(round(CAST({hav_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS DECIMAL(18,8)), 2) AS DOUBLE) AS distance_m FROM (SELECT * FROM fix WHERE event = 'error') a JOIN (SELECT * FROM fix WHERE event = 'signup') b ON {hav_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 3000")
def j10(spark, d):
    f = fixes(spark, d)
    pairs = joins.near(f.filter("event = 'error'").select("id", "lat", "lon"), f.filter("event = 'signup'").select("id", "lat", "lon"), 3000.0, digits=2)
    return pairs.select("id", F.col("r_id").alias("near_id"), "distance_m")


@query("j07_nearest_nav_row", f"WITH {NAV_SQL}, n AS (SELECT strip, count(*) AS n FROM nav GROUP BY strip), q AS (SELECT event_id, user_id AS strip, value AS y FROM events) SELECT q.event_id, nav.r, nav.depth FROM q JOIN n USING (strip) JOIN nav ON nav.strip = q.strip AND nav.r = greatest(0, least(n.n - 1, CAST(floor(q.y) AS BIGINT)))")
def j07(spark, d):
    nav = nav_rows(spark, d)
    n = nav.groupBy("strip").agg(F.count("*").alias("n"))
    q = table(spark, d, "events").select("event_id", F.col("user_id").alias("strip"), F.col("value").alias("y")).join(n, "strip")
    q = q.withColumn("r", F.greatest(F.lit(0), F.least(F.col("n") - 1, F.floor("y"))).cast("long"))
    return q.join(nav, ["strip", "r"]).select("event_id", "r", "depth")


@query("j08_row_bracket", f"""WITH {NAV_SQL}, q AS (SELECT event_id, user_id AS strip, (event_id % 37) + 0.25 AS y FROM events)
  SELECT event_id, {R4.format('a.depth + (b.depth - a.depth) * (y - floor(y))')} AS depth, {R4.format("((degrees(atan2(sin(radians(a.heading)) * 0.75 + sin(radians(b.heading)) * 0.25, cos(radians(a.heading)) * 0.75 + cos(radians(b.heading)) * 0.25)) + 360) % 360)")} AS heading FROM q JOIN nav a ON a.strip = q.strip AND a.r = floor(y) JOIN nav b ON b.strip = q.strip AND b.r = floor(y) + 1 WHERE abs(a.heading - b.heading) <> 180""")
def j08(spark, d):
    nav = nav_rows(spark, d).select("strip", "r", "depth", "heading")
    q = table(spark, d, "events").select("event_id", F.col("user_id").alias("strip"), (F.pmod(F.col("event_id"), F.lit(37)) + 0.25).alias("y"))
    a = nav.select("strip", F.col("r").alias("ra"), F.col("depth").alias("da"), F.col("heading").alias("ha"))
    b = nav.select("strip", (F.col("r") - 1).alias("ra"), F.col("depth").alias("db"), F.col("heading").alias("hb"))
    rows = q.withColumn("ra", F.floor("y").cast("long")).join(a, ["strip", "ra"]).join(b, ["strip", "ra"]).filter("abs(ha - hb) <> 180")
    mix = lambda f: f(F.radians("ha")) * 0.75 + f(F.radians("hb")) * 0.25
    turn = F.pmod(F.degrees(F.atan2(mix(F.sin), mix(F.cos))) + 360, F.lit(360))
    return rows.select("event_id", rounded(F.col("da") + (F.col("db") - F.col("da")) * (F.col("y") - F.floor("y")), 4).alias("depth"), rounded(turn, 4).alias("heading"))


@query("x20_nearest_sample", f"WITH {FIX_SQL} SELECT q.id AS qid, min(row((fix.value > 100), (fix.lat - q.lat) * (fix.lat - q.lat) + (fix.lon - q.lon) * (fix.lon - q.lon), fix.id))[3] AS sample_id FROM fix q JOIN fix USING (device) WHERE fix.id <> q.id GROUP BY q.id")
def x20(spark, d):
    """The nearest other fix of the device, of those with a value up to 100 if there is one."""
    f = fixes(spark, d).select("device", "lat", "lon", "id", "value")
    q = f.withColumnRenamed("id", "qid")
    near = joins.nearest(q, f.filter("value <= 100"), "device", "lon", "lat", "qid", "id")
    far = joins.nearest(q.join(near, "qid", "left_anti"), f.filter("value > 100"), "device", "lon", "lat", "qid", "id")
    return near.unionByName(far).select("qid", F.col("id").alias("sample_id"))


@query("a10_device_totals", f"WITH {FIX_SQL} SELECT device, count(*) AS n, min(t_s) AS first_t, max(t_s) AS last_t, bool_or(event = 'error') AS simulated FROM fix GROUP BY device")
def a10(spark, d):
    return fixes(spark, d).groupBy("device").agg(F.count("*").alias("n"), F.min("t_s").alias("first_t"), F.max("t_s").alias("last_t"), F.bool_or(F.col("event") == "error").alias("simulated"))


@query("a11_tracks", f"WITH {FIX_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY t_s DESC, id DESC) AS n, count(*) OVER (PARTITION BY device) AS total FROM fix) SELECT device, total, count(*) AS kept, string_agg(CAST(id AS VARCHAR), ',' ORDER BY t_s, id) AS points FROM o WHERE n <= 20 GROUP BY device, total")
def a11(spark, d):
    w = Window.partitionBy("device")
    rows = fixes(spark, d).withColumn("n", F.row_number().over(w.orderBy(F.desc("t_s"), F.desc("id")))).withColumn("total", F.count("*").over(w)).filter("n <= 20")
    points = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t_s", "id"))), lambda p: p["id"].cast("string")), ",")
    return rows.groupBy("device", "total").agg(F.count("*").alias("kept"), points.alias("points"))


@query("a16_track_length", f"WITH {FIX_SQL}, s AS (SELECT device, {hav_sql('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS step FROM fix WINDOW w AS (PARTITION BY device ORDER BY t_s, id)) SELECT device, {R4.format('sum(CAST(step AS DECIMAL(18,6)))')} AS length_m, {R4.format('median(step)')} AS median_step FROM s GROUP BY device")
def a16(spark, d):
    w = Window.partitionBy("device").orderBy("t_s", "id")
    step = geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    rows = fixes(spark, d).select("device", step.alias("step"))
    return rows.groupBy("device").agg(rounded(F.sum(F.col("step").cast("decimal(18,6)")), 4).alias("length_m"), rounded(F.median("step"), 4).alias("median_step"))


@query("a36_footprint", f"WITH {FIX_SQL} SELECT device, min(lat) AS south, min(lon) AS west, max(lat) AS north, max(lon) AS east FROM fix GROUP BY device")
def a36(spark, d):
    return fixes(spark, d).groupBy("device").agg(F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east"))


@query("w05_w06_cumulative_distance", f"WITH {FIX_SQL}, s AS (SELECT device, id, t_s, CAST(coalesce({hav_sql('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')}, 0) AS DECIMAL(18,6)) AS step FROM fix WINDOW w AS (PARTITION BY device ORDER BY t_s, id)) SELECT id, CAST(round(sum(step) OVER (PARTITION BY device ORDER BY t_s, id ROWS UNBOUNDED PRECEDING), 2) AS DOUBLE) AS run_m FROM s")
def w06(spark, d):
    w = Window.partitionBy("device").orderBy("t_s", "id")
    step = F.coalesce(geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")), F.lit(0.0)).cast("decimal(18,6)")
    rows = fixes(spark, d).withColumn("step", step)
    return rows.select("id", F.round(F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).cast("double").alias("run_m"))


@query("w07_sessions", f"WITH {FIX_SQL}, f AS (SELECT *, CASE WHEN t_s - lag(t_s) OVER w > 36000 OR abs(value - lag(value) OVER w) > 200 THEN 1 ELSE 0 END AS b FROM fix WINDOW w AS (PARTITION BY device ORDER BY t_s, id)), g AS (SELECT *, 1 + sum(b) OVER (PARTITION BY device ORDER BY t_s, id ROWS UNBOUNDED PRECEDING) AS line FROM f) SELECT device, CAST(line AS BIGINT) AS line, count(*) AS n, min(t_s) AS start_t FROM g GROUP BY 1, 2")
def w07(spark, d):
    w = Window.partitionBy("device").orderBy("t_s", "id")
    gap = (F.col("t_s") - F.lag("t_s").over(w) > 36000) | (F.abs(F.col("value") - F.lag("value").over(w)) > 200)
    rows = windows.sessions(fixes(spark, d).withColumn("gap", gap), ["device"], ["t_s", "id"], F.col("gap"), "line")
    return rows.groupBy("device", "line").agg(F.count("*").alias("n"), F.min("t_s").alias("start_t"))


@query("w08_quality_runs", f"WITH {NAV_SQL}, i AS (SELECT *, r - row_number() OVER (PARTITION BY strip, quality ORDER BY r) AS k FROM nav) SELECT strip, quality AS flag, min(r) AS start, max(r) AS \"end\", count(*) AS n FROM i GROUP BY strip, quality, k")
def w08(spark, d):
    return windows.islands(nav_rows(spark, d), ["strip"], "r", F.col("quality")).select("strip", "flag", "start", "end", "n")


FILL = "coalesce(altitude, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND b[1] - a[1] - 1 <= 2 THEN a[2] + (b[2] - a[2]) * (r - a[1]) / (b[1] - a[1]) END)"
AB_SQL = "ab AS (SELECT *, last_value(CASE WHEN altitude IS NOT NULL THEN row(r, altitude) END IGNORE NULLS) OVER (PARTITION BY strip ORDER BY r ROWS UNBOUNDED PRECEDING) AS a, first_value(CASE WHEN altitude IS NOT NULL THEN row(r, altitude) END IGNORE NULLS) OVER (PARTITION BY strip ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM nav)"


@query("w09_short_gap_fill", f"WITH {NAV_SQL}, {AB_SQL} SELECT strip, r, {R4.format(FILL)} AS altitude FROM ab")
def w09(spark, d):
    return windows.filled(nav_rows(spark, d), ["strip"], "r", "altitude", "f", limit=2).select("strip", "r", rounded(F.col("f"), 4).alias("altitude"))


@query("w10_full_fill", f"WITH {NAV_SQL}, {AB_SQL} SELECT strip, r, {R4.format('coalesce(altitude, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a[2] + (b[2] - a[2]) * (r - a[1]) / (b[1] - a[1]) ELSE coalesce(a[2], b[2]) END)')} AS altitude FROM ab")
def w10(spark, d):
    return windows.filled(nav_rows(spark, d), ["strip"], "r", "altitude", "f", ends=True).select("strip", "r", rounded(F.col("f"), 4).alias("altitude"))


@query("w11_moving_average", f"WITH {NAV_SQL}, h AS (SELECT strip, r, least(2, r, count(*) OVER (PARTITION BY strip) - 1 - r) AS h FROM nav) SELECT h.strip, h.r, {R4.format('avg(n.altitude)')} AS smooth FROM h JOIN nav n ON n.strip = h.strip AND n.r BETWEEN h.r - h.h AND h.r + h.h GROUP BY 1, 2")
def w11(spark, d):
    return windows.smoothed(nav_rows(spark, d), ["strip"], "r", "altitude", "s", 2).select("strip", "r", rounded(F.col("s"), 4).alias("smooth"))


@query("w12_median_filter", f"WITH {NAV_SQL} SELECT strip, r, median(depth) OVER (PARTITION BY strip ORDER BY r ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS depth FROM nav")
def w12(spark, d):
    near = F.array_sort(F.collect_list("depth").over(Window.partitionBy("strip").orderBy("r").rowsBetween(-2, 2)))
    rows = nav_rows(spark, d).withColumn("v", near).withColumn("n", F.size("v"))
    middle = (F.col("v")[F.floor((F.col("n") - 1) / 2).cast("int")] + F.col("v")[F.floor(F.col("n") / 2).cast("int")]) / 2
    return rows.select("strip", "r", middle.alias("depth"))


@query("w16_dropouts", f"WITH {FIX_SQL}, g AS (SELECT id, device, t_s - lag(t_s) OVER (PARTITION BY device ORDER BY t_s, id) AS dt FROM fix), m AS (SELECT device, median(dt) AS m FROM g GROUP BY device) SELECT id, dt, dt > 3 * m AS dropout FROM g JOIN m USING (device) WHERE dt IS NOT NULL")
def w16(spark, d):
    rows = fixes(spark, d).withColumn("dt", F.col("t_s") - F.lag("t_s").over(Window.partitionBy("device").orderBy("t_s", "id")))
    m = rows.groupBy("device").agg(F.median("dt").alias("m"))
    return rows.join(m, "device").filter("dt IS NOT NULL").select("id", "dt", (F.col("dt") > 3 * F.col("m")).alias("dropout"))


@query("w17_hold_window", f"WITH {FIX_SQL} SELECT id, max(CASE WHEN event = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY t_s RANGE BETWEEN 3600 PRECEDING AND 3600 FOLLOWING) = 1 AS held FROM fix")
def w17(spark, d):
    w = Window.partitionBy("device").orderBy("t_s").rangeBetween(-3600, 3600)
    return fixes(spark, d).select("id", (F.max((F.col("event") == "error").cast("int")).over(w) == 1).alias("held"))


@query("w18_rate", f"WITH {NAV_SQL} SELECT strip, r, {R4.format('(lead(depth) OVER w - lag(depth) OVER w) / nullif(lead(t_s) OVER w - lag(t_s) OVER w, 0)')} AS rate FROM nav WINDOW w AS (PARTITION BY strip ORDER BY r)")
def w18(spark, d):
    w = Window.partitionBy("strip").orderBy("r")
    rate = (F.lead("depth").over(w) - F.lag("depth").over(w)) / F.nullif(F.lead("t_s").over(w) - F.lag("t_s").over(w), F.lit(0))
    return nav_rows(spark, d).select("strip", "r", rounded(rate, 4).alias("rate"))


@query("w19_resample", f"""WITH {FIX_SQL}, b AS (SELECT device, min(t_s) AS t0, max(t_s) AS t1 FROM fix GROUP BY device), g AS (SELECT device, unnest(range(t0, t1 + 1, 86400)) AS t_s FROM b), v AS (SELECT device, t_s, max(value) AS value FROM fix GROUP BY 1, 2),
  j AS (SELECT g.device, g.t_s, (SELECT max(row(v.t_s, v.value)) FROM v WHERE v.device = g.device AND v.t_s <= g.t_s) AS a, (SELECT min(row(v.t_s, v.value)) FROM v WHERE v.device = g.device AND v.t_s >= g.t_s) AS z FROM g)
  SELECT device, t_s, {R4.format('CASE WHEN a[1] = z[1] THEN a[2] ELSE a[2] + (z[2] - a[2]) * (t_s - a[1]) / (z[1] - a[1]) END')} AS value FROM j""")
def w19(spark, d):
    f = fixes(spark, d)
    v = f.groupBy("device", "t_s").agg(F.max("value").alias("value"))
    grid = f.groupBy("device").agg(F.min("t_s").alias("t0"), F.max("t_s").alias("t1")).select("device", F.explode(F.sequence("t0", "t1", F.lit(86400).cast("long"))).alias("t_s"))
    a = joins.asof(grid, v, ["device"], "t_s", ["value"]).withColumnsRenamed({"value": "va", "t_s_matched": "ta"})
    z = joins.asof(a, v, ["device"], "t_s", ["value"], forward=True)
    line = F.col("va") + (F.col("value") - F.col("va")) * (F.col("t_s") - F.col("ta")) / F.nullif(F.col("t_s_matched") - F.col("ta"), F.lit(0))
    return z.select("device", "t_s", rounded(F.coalesce(line, F.col("va")), 4).alias("value"))


@query("w21_thinned_track", f"WITH {FIX_SQL}, o AS (SELECT id, row_number() OVER (PARTITION BY device ORDER BY t_s, id) - 1 AS i, count(*) OVER (PARTITION BY device) AS n FROM fix) SELECT id FROM o WHERE i % 10 = 0 OR i = n - 1")
def w21(spark, d):
    rows = fixes(spark, d).withColumn("o", F.struct("t_s", "id"))
    return windows.thinned(rows, ["device"], "o", 10).select("id")


@query("w26_every_nth", f"WITH {FIX_SQL}, o AS (SELECT id, row_number() OVER (PARTITION BY device ORDER BY t_s, id) AS i FROM fix) SELECT id FROM o WHERE i % 7 = 0")
def w26(spark, d):
    w = Window.partitionBy("device").orderBy("t_s", "id")
    return fixes(spark, d).withColumn("i", F.row_number().over(w)).filter("i % 7 = 0").select("id")


@query("st03_links", f"WITH {LINK_SQL} SELECT device, link_id, start, end_ AS \"end\" FROM link")
def st03(spark, d):
    return links(spark, d)


@query("st04_recoveries", f"WITH {FIX_SQL}, m AS (SELECT device, max(row(CASE WHEN event = 'purchase' THEN 2 ELSE 1 END, t_s, id)) AS b, count(*) AS events FROM fix WHERE event IN ('signup', 'purchase') GROUP BY device) SELECT device, CASE WHEN b[1] = 2 THEN 'recovered' ELSE 'arrived' END AS status, b[2] AS t_s, events FROM m")
def st04(spark, d):
    return stream.recoveries(fixes(spark, d), "signup", "purchase")


@query("s17_incremental_scan", f"WITH {FIX_SQL} SELECT id, device, t_s FROM fix WHERE id > 500 ORDER BY id LIMIT 100")
def s17(spark, d):
    return fixes(spark, d).filter("id > 500").orderBy("id").limit(100).select("id", "device", "t_s")


@query("f50_f51_clock", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, epoch_us(ts) // 1000000 AS t_s, CASE WHEN ts < TIMESTAMP '2024-01-05' THEN 'before' WHEN ts < TIMESTAMP '2024-01-15' THEN 'inside' ELSE 'after' END AS status FROM events")
def f50(spark, d):
    e = table(spark, d, "events")
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    back = F.try_to_timestamp(F.lit("2024-01-05")), F.try_to_timestamp(F.lit("2024-01-15"))
    ts = F.col("ts").cast("timestamp")
    return e.select("event_id", iso.alias("iso"), F.unix_seconds(ts).alias("t_s"), F.when(ts < back[0], "before").when(ts < back[1], "inside").otherwise("after").alias("status"))


@query("f07_bearing", f"WITH {FIX_SQL} SELECT id, {R4.format('((degrees(atan2(sin(radians(80 - lon)) * cos(radians(11)), cos(radians(lat)) * sin(radians(11)) - sin(radians(lat)) * cos(radians(11)) * cos(radians(80 - lon)))) + 360) % 360)')} AS bearing FROM fix")
def f07(spark, d):
    return fixes(spark, d).select("id", rounded(geo.bearing(F.col("lat"), F.col("lon"), F.lit(11.0), F.lit(80.0)), 4).alias("bearing"))


@query("f03_offset_round_trip", f"WITH {FIX_SQL} SELECT id, CAST(250.0 AS DOUBLE) AS east, CAST(-40.0 AS DOUBLE) AS north FROM fix")
def f03(spark, d):
    lat, lon = geo.offset(F.col("lat"), F.col("lon"), F.lit(250.0), F.lit(-40.0))
    east, north = geo.delta(F.col("lat"), F.col("lon"), lat, lon)
    return fixes(spark, d).select("id", rounded(east, 4).alias("east"), rounded(north, 4).alias("north"))


@query("w14_speed_gate")
def w14(spark, d):
    far = lambda a, b: geo.haversine(a["lat"], a["lon"], b["lat"], b["lon"])
    return windows.gated(fixes(spark, d).select("device", "t_s", "lat", "lon"), ["device"], ["lat", "lon"], "t_s", far, 5.0, 4)

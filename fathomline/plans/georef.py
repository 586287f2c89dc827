"""Georeferencing: from pixels and rows to positions, and the order-dependent helpers it needs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.functions import geo
from fathomline.functions.score import rounded
from fathomline.operators import joins, windows
from fathomline.plans.registry import query
from fathomline.plans.telemetry import R4, hav_sql
from fathomline.plans.views import DET_SQL, FIX_SQL, NAV_SQL, detections, fixes, nav_rows, table

R7 = "CAST(round(CAST({} AS DECIMAL(18,8)), 7) AS DOUBLE)"
E2 = "(1 / 298.257223563) * (2 - 1 / 298.257223563)"
MERIDIAN = f"6378137.0 * (1 - {E2}) / pow(1 - {E2} * pow(sin(radians({{0}})), 2), 1.5)"
PRIME = f"6378137.0 / sqrt(1 - {E2} * pow(sin(radians({{0}})), 2))"

#: A reference for every second strip: the positions of its image's four corners, and its metres a pixel.
REF_SQL = """ref AS (SELECT strip, 10 + strip * 0.001 AS lat_tl, 79 + strip * 0.002 AS lon_tl, 10.01 + strip * 0.001 AS lat_tr, 79.04 + strip * 0.002 AS lon_tr,
    9.96 + strip * 0.001 AS lat_bl, 79.01 + strip * 0.002 AS lon_bl, 9.97 + strip * 0.001 AS lat_br, 79.05 + strip * 0.002 AS lon_br FROM (SELECT DISTINCT user_id AS strip FROM events) WHERE strip % 2 = 0)"""
CORNERS = {"tl": (10.0, 79.0), "tr": (10.01, 79.04), "bl": (9.96, 79.01), "br": (9.97, 79.05)}
SIZE = 4095.0


def references(spark, d):
    strips = table(spark, d, "events").select(F.col("user_id").alias("strip")).distinct().filter("strip % 2 = 0")
    return strips.select("strip", *[(F.lit(v) + F.col("strip") * k).alias(f"{n}_{c}") for c, at in CORNERS.items() for n, v, k in (("lat", at[0], 0.001), ("lon", at[1], 0.002))])


def between_corners(name, u, v):
    """Bilinear position between the corners of an image, u across and v down, 0 to 1."""
    c = lambda k: F.col(f"{name}_{k}")
    return (1 - u) * (1 - v) * c("tl") + u * (1 - v) * c("tr") + (1 - u) * v * c("bl") + u * v * c("br")


def corners_sql(name, u, v):
    return f"(1 - {u}) * (1 - {v}) * {name}_tl + {u} * (1 - {v}) * {name}_tr + (1 - {u}) * {v} * {name}_bl + {u} * {v} * {name}_br"


@query("f02_radii", f"WITH {FIX_SQL} SELECT id, {R4.format(MERIDIAN.format('lat'))} AS meridional, {R4.format(PRIME.format('lat'))} AS prime_vertical FROM fix")
def f02(spark, d):
    m, n = geo.radii(F.col("lat"))
    return fixes(spark, d).select("id", rounded(m, 4).alias("meridional"), rounded(n, 4).alias("prime_vertical"))


@query("f03_offset", f"WITH {FIX_SQL} SELECT id, {R7.format('lat + degrees(-40.0 / (' + MERIDIAN.format('lat') + '))')} AS lat2, {R7.format('lon + degrees(250.0 / (' + PRIME.format('lat') + ' * cos(radians(lat))))')} AS lon2 FROM fix")
def f03(spark, d):
    lat, lon = geo.offset(F.col("lat"), F.col("lon"), F.lit(250.0), F.lit(-40.0))
    return fixes(spark, d).select("id", rounded(lat, 7).alias("lat2"), rounded(lon, 7).alias("lon2"))


@query("f04_plane", f"WITH {FIX_SQL} SELECT id, {R4.format('radians(lon - 79.5) * 6371008.8 * cos(radians(10.5))')} AS east, {R4.format('radians(lat - 10.5) * 6371008.8')} AS north FROM fix")
def f04(spark, d):
    east, north = geo.plane(F.lit(10.5), F.lit(79.5), F.col("lat"), F.col("lon"))
    return fixes(spark, d).select("id", rounded(east, 4).alias("east"), rounded(north, 4).alias("north"))


@query("f05_f06_padding", f"WITH {FIX_SQL} SELECT id, {R4.format('6371008.8 * pi() / 180')} AS per_lat, {R4.format('6371008.8 * pi() / 180 * cos(radians(lat))')} AS per_lon, {R7.format('1500 * 1.02 / (6371008.8 * pi() / 180)')} AS pad_lat, {R7.format('1500 * 1.02 / (6371008.8 * pi() / 180 * cos(radians(lat)))')} AS pad_lon FROM fix")
def f05(spark, d):
    per, pad = geo.metres_per_degree(F.col("lat")), geo.padding(F.col("lat"), F.lit(1500.0))
    return fixes(spark, d).select("id", rounded(per[0], 4).alias("per_lat"), rounded(per[1], 4).alias("per_lon"), rounded(pad[0], 7).alias("pad_lat"), rounded(pad[1], 7).alias("pad_lon"))


EDGE = {s: (R7.format(f"lat + degrees({n} / ({MERIDIAN.format('lat')}))"), R7.format(f"lon + degrees({e} / ({PRIME.format('lat')} * cos(radians(lat))))")) for s, e, n in (("port", "-50 * cos(radians(id % 360))", "50 * sin(radians(id % 360))"), ("starboard", "60 * cos(radians(id % 360))", "-60 * sin(radians(id % 360))"))}


@query("f08_swath_edges", f"WITH {FIX_SQL} SELECT id, {EDGE['port'][0]} AS port_lat, {EDGE['port'][1]} AS port_lon, {EDGE['starboard'][0]} AS starboard_lat, {EDGE['starboard'][1]} AS starboard_lon FROM fix")
def f08(spark, d):
    edges = geo.swath_edges(F.col("lat"), F.col("lon"), F.pmod(F.col("id"), F.lit(360)), F.lit(50.0), F.lit(60.0))
    return fixes(spark, d).select("id", *[rounded(e, 7).alias(n) for e, n in zip(edges, ("port_lat", "port_lon", "starboard_lat", "starboard_lon"), strict=True)])


@query("f10_x10_attach_geo", f"WITH {DET_SQL}, {REF_SQL} SELECT id, {R7.format(corners_sql('lat', '(x / 4095.0)', '(y / 4095.0)'))} AS lat, {R7.format(corners_sql('lon', '(x / 4095.0)', '(y / 4095.0)'))} AS lon, CASE WHEN ref.strip IS NULL THEN 'no reference' ELSE 'corners' END AS basis FROM det LEFT JOIN ref USING (strip)")
def x10(spark, d):
    rows = detections(spark, d).join(references(spark, d).withColumn("basis", F.lit("corners")), "strip", "left")
    u, v = F.col("x") / SIZE, F.col("y") / SIZE
    return rows.select("id", rounded(between_corners("lat", u, v), 7).alias("lat"), rounded(between_corners("lon", u, v), 7).alias("lon"), F.coalesce("basis", F.lit("no reference")).alias("basis"))


@query("x41_footprints", f"WITH {REF_SQL} SELECT strip, CAST(lat_bl AS DOUBLE) AS south, CAST(lat_tr AS DOUBLE) AS north, CAST(lon_tl AS DOUBLE) AS west, CAST(lon_br AS DOUBLE) AS east FROM ref")
def x41(spark, d):
    at = {"tl": (0, 0), "tr": (1, 0), "bl": (0, 1), "br": (1, 1)}
    lat, lon = ([between_corners(n, F.lit(float(u)), F.lit(float(v))) for u, v in at.values()] for n in ("lat", "lon"))
    sides = {"south": F.least(*lat), "north": F.greatest(*lat), "west": F.least(*lon), "east": F.greatest(*lon)}
    return references(spark, d).select("strip", *[rounded(c, 7).alias(n) for n, c in sides.items()])


@query("f10_along_track", f"""WITH {DET_SQL}, {FIX_SQL}, row AS (SELECT device AS strip, lat, lon, id % 360 AS heading, row_number() OVER (PARTITION BY device ORDER BY t_s, id) - 1 AS r, count(*) OVER (PARTITION BY device) AS n FROM fix),
  q AS (SELECT det.id AS id, lat, lon, cos(radians(heading)) * (x - 2048) * 0.1 AS e, -sin(radians(heading)) * (x - 2048) * 0.1 AS n_ FROM det JOIN row ON row.strip = det.strip AND r = least(n - 1, y * n // 4096))
  SELECT id, {R7.format('lat + degrees(n_ / (' + MERIDIAN.format('lat') + '))')} AS lat, {R7.format('lon + degrees(e / (' + PRIME.format('lat') + ' * cos(radians(lat))))')} AS lon FROM q""")
def f10(spark, d):
    w = Window.partitionBy("device")
    rows = fixes(spark, d).select(F.col("device").alias("strip"), "lat", "lon", F.pmod(F.col("id"), F.lit(360)).alias("heading"), (F.row_number().over(w.orderBy("t_s", "id")) - 1).alias("r"), F.count("*").over(w).alias("n"))
    sizes = rows.groupBy("strip").agg(F.count("*").alias("n"))
    det = detections(spark, d).select("id", "strip", "x", "y").join(sizes, "strip")
    det = det.withColumn("r", F.least(F.col("n") - 1, F.floor(F.col("y") * F.col("n") / 4096)).cast("int")).drop("n")
    across = (F.col("x") - 2048) * 0.1
    lat, lon = geo.offset(F.col("lat"), F.col("lon"), F.cos(F.radians("heading")) * across, -F.sin(F.radians("heading")) * across)
    return det.join(rows.drop("n"), ["strip", "r"]).select("id", rounded(lat, 7).alias("lat"), rounded(lon, 7).alias("lon"))


@query("f12_extrapolated", f"""WITH {NAV_SQL}, c AS (SELECT strip, r, depth FROM nav WHERE r % 10 = 5), s AS (SELECT strip, r AS x0, depth AS y0, lead(r) OVER w AS x1, lead(depth) OVER w AS y1, lag(r) OVER w IS NULL AS first_ FROM c WINDOW w AS (PARTITION BY strip ORDER BY r)),
  l AS (SELECT *, CASE WHEN first_ THEN -1 ELSE x0 END AS low, CASE WHEN lead(x1) OVER (PARTITION BY strip ORDER BY x0) IS NULL THEN 1e9 ELSE x1 END AS high FROM s WHERE x1 IS NOT NULL), one AS (SELECT strip, any_value(depth) AS v FROM c GROUP BY strip HAVING count(*) = 1)
  SELECT nav.strip, nav.r, {R4.format('coalesce(y0 + (y1 - y0) * (nav.r - x0) / (x1 - x0), v)')} AS depth FROM nav LEFT JOIN l ON nav.strip = l.strip AND nav.r >= low AND nav.r < high LEFT JOIN one ON nav.strip = one.strip""")
def f12(spark, d):
    nav = nav_rows(spark, d).select("strip", "r", "depth")
    at = joins.interpolated(nav.select("strip", "r"), nav.filter("r % 10 = 5"), ["strip"], "r", "depth", "v")
    return at.select("strip", "r", rounded(F.col("v"), 4).alias("depth"))


GRID_SQL = "grid AS (SELECT p_partkey % 40 AS i, p_partkey // 40 AS j, CASE WHEN p_size % 7 > 0 THEN p_retailprice END AS v FROM part), pt AS (SELECT c_custkey AS id, (c_custkey * 37 % 390) / 10.0 AS x, (c_custkey * 53 % 40) / 10.0 AS y FROM customer)"


def depth_grid(spark, d):
    return table(spark, d, "part").select((F.col("p_partkey") % 40).alias("i"), F.floor(F.col("p_partkey") / 40).alias("j"), F.when(F.col("p_size") % 7 > 0, F.col("p_retailprice")).alias("v"))


def grid_points(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.pmod(F.col("c_custkey") * 37, F.lit(390)) / 10.0).alias("x"), (F.pmod(F.col("c_custkey") * 53, F.lit(40)) / 10.0).alias("y"))


@query("f13_bilinear_sample", f"""WITH {GRID_SQL}, k AS (SELECT id, floor(x) + di AS i, floor(y) + dj AS j, CASE di WHEN 1 THEN x - floor(x) ELSE 1 - x + floor(x) END * CASE dj WHEN 1 THEN y - floor(y) ELSE 1 - y + floor(y) END AS w FROM pt, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) o(di, dj))
  SELECT id, {R4.format('CASE WHEN sum(CASE WHEN v IS NOT NULL THEN w ELSE 0 END) > 1e-9 THEN sum(w * coalesce(v, 0)) / sum(CASE WHEN v IS NOT NULL THEN w ELSE 0 END) END')} AS depth FROM k LEFT JOIN grid USING (i, j) GROUP BY id""")
def f13(spark, d):
    return joins.bilinear(grid_points(spark, d), depth_grid(spark, d), "x", "y", "v", "s").select("id", rounded(F.col("s"), 4).alias("depth"))


@query("x27_nearest_cell", f"WITH {GRID_SQL} SELECT id, v AS depth FROM pt LEFT JOIN grid ON i = floor(x + 0.5) AND j = floor(y + 0.5)")
def x27(spark, d):
    p = grid_points(spark, d).select("id", F.floor(F.col("x") + 0.5).alias("i"), F.floor(F.col("y") + 0.5).alias("j"))
    return p.join(depth_grid(spark, d), ["i", "j"], "left").select("id", F.col("v").alias("depth"))


@query("f21_fastest_step", f"WITH {NAV_SQL} SELECT strip, t_s // 86400 AS day, max(sqrt(depth * depth + heading * heading)) AS fastest FROM nav GROUP BY 1, 2")
def f21(spark, d):
    return nav_rows(spark, d).groupBy("strip", F.floor(F.col("t_s") / 86400).alias("day")).agg(F.max(F.sqrt(F.col("depth") * F.col("depth") + F.col("heading") * F.col("heading"))).alias("fastest"))


SIDE_SQL = f"{DET_SQL}, side AS (SELECT DISTINCT strip, 0.05 + strip % 7 * 0.01 AS m FROM det WHERE strip % 3 = 0), man AS (SELECT strip, min_by(0.1 + id % 5 * 0.01, id) AS m FROM det WHERE strip % 2 = 0 GROUP BY strip)"


@query("x11_strip_resolution", f"WITH {SIDE_SQL} SELECT strip, CAST(round(coalesce(side.m, man.m), 4) AS DOUBLE) AS m_per_px, CASE WHEN side.m IS NOT NULL THEN 'sidecar' WHEN man.m IS NOT NULL THEN 'manifest' ELSE 'unknown' END AS basis FROM (SELECT DISTINCT strip FROM det) LEFT JOIN side USING (strip) LEFT JOIN man USING (strip)")
def x11(spark, d):
    det = detections(spark, d)
    side = det.filter("strip % 3 = 0").select("strip", (0.05 + F.col("strip") % 7 * 0.01).alias("s")).distinct()
    manifest = det.filter("strip % 2 = 0").groupBy("strip").agg(F.min_by(0.1 + F.col("id") % 5 * 0.01, "id").alias("m"))
    rows = det.select("strip").distinct().join(side, "strip", "left").join(manifest, "strip", "left")
    basis = F.when(F.col("s").isNotNull(), "sidecar").when(F.col("m").isNotNull(), "manifest").otherwise("unknown")
    return rows.select("strip", F.round(F.coalesce("s", "m"), 4).alias("m_per_px"), basis.alias("basis"))


@query("x12_reference_choice", f"WITH {DET_SQL}, t AS (SELECT strip, count(CASE WHEN id % 5 = 0 THEN 1 END) AS located FROM det GROUP BY strip) SELECT strip, CASE WHEN strip % 4 = 0 THEN 'ping sidecar' WHEN located >= 12 THEN 'manifest refit' WHEN located > 0 THEN 'tile inherit' END AS reference FROM t")
def x12(spark, d):
    t = detections(spark, d).groupBy("strip").agg(F.count_if(F.col("id") % 5 == 0).alias("located"))
    return t.select("strip", F.when(F.col("strip") % 4 == 0, "ping sidecar").when(F.col("located") >= 12, "manifest refit").when(F.col("located") > 0, "tile inherit").alias("reference"))


ACROSS = "sqrt(greatest(pow(({0} - 2048) * 0.05, 2) - pow(alt, 2), 0))"


@query("x13_geotag_size", f"""WITH {DET_SQL}, b AS (SELECT id, x AS x1, x + 40 AS x2, y AS y1, y + 60 AS y2, 5.0 + id % 9 AS alt FROM det), g AS (SELECT *, {ACROSS.format('x1')} AS g1, {ACROSS.format('x2')} AS g2 FROM b)
  SELECT id, {R4.format('CASE WHEN (x1 < 2048) <> (x2 < 2048) THEN g1 + g2 ELSE abs(g2 - g1) END')} AS width_m, {R4.format('(y2 - y1) * 0.08')} AS length_m FROM g""")
def x13(spark, d):
    alt = 5.0 + F.col("id") % 9
    det = detections(spark, d)
    ground = lambda px: geo.ground_range(F.abs((px - 2048) * 0.05), alt)
    x1, x2 = F.col("x"), F.col("x") + 40
    width = F.when((x1 < 2048) != (x2 < 2048), ground(x1) + ground(x2)).otherwise(F.abs(ground(x2) - ground(x1)))
    return det.select("id", rounded(width, 4).alias("width_m"), rounded(F.lit(60) * F.lit(0.08), 4).alias("length_m"))


POS_SQL = f"{NAV_SQL}, pos AS (SELECT strip, r, t_s, floor(depth / 20) AS v, heading FROM nav)"


def positions(spark, d):
    return nav_rows(spark, d).select("strip", "r", "t_s", F.floor(F.col("depth") / 20).cast("double").alias("v"), "heading")


def changes(rows):
    """Marks the rows whose value is not that of the row before, and keeps their value only."""
    before = F.lag("v").over(Window.partitionBy("strip").orderBy("r"))
    return rows.withColumn("known", F.when(before.isNull() | (before != F.col("v")), F.col("v")))


CHANGE_SQL = f"{POS_SQL}, ch AS (SELECT *, CASE WHEN lag(v) OVER (PARTITION BY strip ORDER BY r) IS NULL OR lag(v) OVER (PARTITION BY strip ORDER BY r) <> v THEN v END AS known FROM pos)"
GAP_SQL = """g AS (SELECT *, last_value(known IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN known IS NOT NULL THEN {0} END IGNORE NULLS) OVER b AS x0, first_value(known IGNORE NULLS) OVER f AS v1, first_value(CASE WHEN known IS NOT NULL THEN {0} END IGNORE NULLS) OVER f AS x1 FROM ch
  WINDOW b AS (PARTITION BY strip ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY strip ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("w15_repeated_fixes", f"WITH {CHANGE_SQL}, {GAP_SQL.format('t_s')} SELECT strip, r, {R4.format('CASE WHEN known IS NOT NULL THEN known WHEN v1 IS NULL THEN v0 WHEN x1 = x0 THEN v0 ELSE v0 + (v1 - v0) * (t_s - x0) / (x1 - x0) END')} AS v FROM g")
def w15(spark, d):
    return windows.filled_along(changes(positions(spark, d)), ["strip"], "r", "t_s", "known", "w").select("strip", "r", rounded(F.col("w"), 4).alias("v"))


@query("x22_repeat_rows", f"WITH {CHANGE_SQL}, {GAP_SQL.format('r')}, n AS (SELECT *, count(known) OVER (PARTITION BY strip) AS c, count(*) OVER (PARTITION BY strip) AS n FROM g) SELECT strip, r, {R4.format('CASE WHEN c < 2 OR c >= 0.9 * n THEN v WHEN known IS NOT NULL THEN known WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (r - x0) / (x1 - x0) END')} AS v FROM n")
def x22(spark, d):
    w = Window.partitionBy("strip")
    rows = changes(positions(spark, d)).withColumn("c", F.count("known").over(w)).withColumn("n", F.count("*").over(w))
    rows = windows.filled_along(rows, ["strip"], "r", "r", "known", "w")
    return rows.select("strip", "r", rounded(F.when((F.col("c") < 2) | (F.col("c") >= 0.9 * F.col("n")), F.col("v")).otherwise(F.col("w")), 4).alias("v"))


def spacing_sql(w):
    return f"nullif(abs(last_value(v) OVER ({w}) - first_value(v) OVER ({w})) / nullif(count(*) OVER ({w}) - 1, 0), 0)"


WIDE = [f"PARTITION BY strip ORDER BY r ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING" for k in (10, 50, 250)] + ["PARTITION BY strip ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"]


@query("w20_widening_spacing", f"WITH {POS_SQL} SELECT strip, r, {R4.format('coalesce(' + ', '.join(map(spacing_sql, WIDE)) + ')')} AS per_row FROM pos")
def w20(spark, d):
    whole = Window.partitionBy("strip").orderBy("r")
    each = []
    for k in (10, 50, 250, None):
        w = whole.rowsBetween(-k, k) if k else whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        step = F.abs(F.last("v").over(w) - F.first("v").over(w)) / F.nullif(F.count("*").over(w) - 1, F.lit(0))
        each.append(F.nullif(step, F.lit(0.0)))
    return positions(spark, d).select("strip", "r", rounded(F.coalesce(*each), 4).alias("per_row"))


@query("x23_median_spacing", f"WITH {FIX_SQL}, s AS (SELECT device, {hav_sql('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS step FROM fix WINDOW w AS (PARTITION BY device ORDER BY t_s, id)) SELECT device, {R4.format('quantile_cont(step, 0.5)')} AS spacing FROM s WHERE step IS NOT NULL GROUP BY device")
def x23(spark, d):
    w = Window.partitionBy("device").orderBy("t_s", "id")
    step = geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return fixes(spark, d).select("device", step.alias("step")).filter("step IS NOT NULL").groupBy("device").agg(rounded(F.median("step"), 4).alias("spacing"))


@query("x21_course_fill", f"""WITH {FIX_SQL}, n AS (SELECT id, CASE WHEN id % 5 > 0 THEN id % 360 END AS heading, coalesce(lead(lat) OVER w, lat) - coalesce(lag(lat) OVER w, lat) AS north, (coalesce(lead(lon) OVER w, lon) - coalesce(lag(lon) OVER w, lon)) * cos(radians(lat)) AS east FROM fix WINDOW w AS (PARTITION BY device ORDER BY t_s, id))
  SELECT id, {R4.format('coalesce(heading, CASE WHEN north <> 0 OR east <> 0 THEN (degrees(atan2(east, north)) + 360) % 360 END)')} AS heading FROM n""")
def x21(spark, d):
    w = Window.partitionBy("device").orderBy("t_s", "id")
    slope = lambda c: F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c))
    north, east = slope("lat"), slope("lon") * F.cos(F.radians("lat"))
    course = F.when((north != 0) | (east != 0), F.pmod(F.degrees(F.atan2(east, north)) + 360, F.lit(360.0)))
    return fixes(spark, d).select("id", rounded(F.coalesce(F.when(F.col("id") % 5 > 0, F.col("id") % 360).cast("double"), course), 4).alias("heading"))


@query("f53_survey_clock", f"""WITH {NAV_SQL}, c AS (SELECT strip % 4 AS survey, strip, r, CASE WHEN strip % 11 > 0 THEN t_s END AS t FROM nav), m AS (SELECT survey, min(t) AS start, count(*) > count(t) AS lacks FROM c GROUP BY survey)
  SELECT c.survey, strip, r, CASE WHEN lacks THEN row_number() OVER (PARTITION BY c.survey ORDER BY strip, r) - 1 ELSE t - start END AS clock, CASE WHEN lacks THEN 'order' ELSE 'time' END AS basis FROM c JOIN m ON m.survey = c.survey""")
def f53(spark, d):
    rows = nav_rows(spark, d).select((F.col("strip") % 4).alias("survey"), "strip", "r", F.when(F.col("strip") % 11 > 0, F.col("t_s")).alias("t"))
    w = Window.partitionBy("survey")
    lacks = F.count("*").over(w) > F.count("t").over(w)
    clock = F.when(lacks, F.row_number().over(w.orderBy("strip", "r")) - 1).otherwise(F.col("t") - F.min("t").over(w))
    return rows.select("survey", "strip", "r", clock.cast("long").alias("clock"), F.when(lacks, "order").otherwise("time").alias("basis"))


@query("f52_drogue_status", f"WITH {NAV_SQL} SELECT strip, r, CASE WHEN lost < 946684800 THEN 'unknown' WHEN t_s < lost THEN 'before' WHEN t_s <= lost + 86400 THEN 'inside' ELSE 'after' END AS status FROM (SELECT strip, r, t_s, CASE WHEN strip % 5 = 0 THEN 0 ELSE 1704067200 + strip * 3600 END AS lost FROM nav)")
def f52(spark, d):
    lost = F.when(F.col("strip") % 5 == 0, F.lit(0)).otherwise(1704067200 + F.col("strip") * 3600)
    t = F.col("t_s")
    return nav_rows(spark, d).select("strip", "r", F.when(lost < 946684800, "unknown").when(t < lost, "before").when(t <= lost + 86400, "inside").otherwise("after").alias("status"))


@query("w24_survey_time", f"WITH {NAV_SQL}, s AS (SELECT strip % 4 AS survey, strip, min(t_s) AS first_t FROM nav WHERE quality <> 'error' GROUP BY 1, 2) SELECT survey, min(first_t) AS start, count(*) AS sidecars FROM s GROUP BY survey")
def w24(spark, d):
    s = nav_rows(spark, d).filter("quality <> 'error'").groupBy((F.col("strip") % 4).alias("survey"), "strip").agg(F.min("t_s").alias("first_t"))
    return s.groupBy("survey").agg(F.min("first_t").alias("start"), F.count("*").alias("sidecars"))


@query("x38_map_frames", f"WITH {DET_SQL}, w AS (SELECT strip, max(x) + 1 AS width FROM det GROUP BY strip) SELECT strip, width, sum(width + 100) OVER (ORDER BY strip) - width - 100 AS left_ FROM w")
def x38(spark, d):
    w = detections(spark, d).groupBy("strip").agg((F.max("x") + 1).alias("width"))
    return windows.numbered(w, "strip", F.col("width") + 100).select("strip", "width", (F.col("before")).alias("left_"))

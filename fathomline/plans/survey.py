"""Survey queries: detections, severity, hotspots, scans, strips."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.functions import geo, text
from fathomline.functions.score import rounded, tier_rank
from fathomline.operators import hazards, joins, sequential, windows
from fathomline.plans.registry import query
from fathomline.plans.views import CELL, DEFAULT_FLOOR, DEFAULT_WEIGHT, DET_SQL, FLOORS, POLICY_SQL, SCORED_SQL, TIERS, detections, policy, table

R4 = "CAST(round(CAST({} AS DECIMAL(18,8)), 4) AS DOUBLE)"


def tiered(spark, d):
    return hazards.scored(detections(spark, d), policy(spark), FLOORS, TIERS, DEFAULT_WEIGHT, DEFAULT_FLOOR)


CELLS_SQL = f"""{SCORED_SQL},
  cls AS (SELECT strip, x // {CELL} AS cell_x, y // {CELL} AS cell_y, class, count(*) AS n, sum(CAST(severity AS DECIMAL(18,8))) AS total, max(severity) AS most, min(tier_rank) AS tier_rank,
    sum(CAST(confidence AS DECIMAL(18,8))) AS conf, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, max(row(severity, confidence, id)) AS top FROM tiered WHERE NOT suppressed GROUP BY 1, 2, 3, 4),
  cells AS (SELECT strip, cell_x, cell_y, CAST(sum(n) AS BIGINT) AS detection_count, {R4.format('sum(total)')} AS total_severity, {R4.format('max(most)')} AS max_severity, min(tier_rank) AS tier_rank,
    max_by(class, row(total, n, class)) AS dominant_class, count(class) AS hazard_diversity, {R4.format('CAST(sum(conf) AS DOUBLE) / sum(n)')} AS confidence_mean, max(x1) - min(x0) AS width_px, max(y1) - min(y0) AS height_px, max(top)[3] AS top_id
    FROM cls GROUP BY 1, 2, 3),
  risked AS (SELECT *, {R4.format('max_severity + 0.5 * (total_severity - max_severity)')} AS risk_score, {R4.format(f'detection_count * 1e6 / ({CELL} * {CELL})')} AS density FROM cells),
  ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY risk_score DESC, max_severity DESC, detection_count DESC, strip, cell_x, cell_y) AS INTEGER) AS priority_rank FROM risked)"""
HOT_COLUMNS = "strip, cell_x, cell_y, detection_count, total_severity, max_severity, tier_rank, dominant_class, hazard_diversity, width_px, height_px, top_id, risk_score, density, priority_rank"


@query("a01_hotspot_worklist", f"WITH {CELLS_SQL} SELECT {HOT_COLUMNS}, printf('H%03d', priority_rank) AS hotspot_id FROM ranked")
def a01(spark, d):
    hot = hazards.hotspots(tiered(spark, d).filter(~F.col("suppressed")), CELL)
    return hot.select(*HOT_COLUMNS.split(", "), "hotspot_id")


@query("o01_top_hotspots", f"WITH {CELLS_SQL} SELECT {HOT_COLUMNS} FROM ranked WHERE tier_rank <= 1 AND detection_count > 1 ORDER BY risk_score DESC, priority_rank LIMIT 20")
def o01(spark, d):
    hot = hazards.hotspots(tiered(spark, d).filter(~F.col("suppressed")), CELL)
    return hot.select(*HOT_COLUMNS.split(", ")).filter("tier_rank <= 1 AND detection_count > 1").orderBy(F.desc("risk_score"), "priority_rank").limit(20)


@query("p01_global_coordinates", f"WITH {DET_SQL} SELECT id, CAST(round(CAST((x + x + 31) / 2.0 AS DECIMAL(18,8)), 2) AS DOUBLE) AS global_x, CAST(round(CAST((y + y + 17) / 2.0 AS DECIMAL(18,8)), 2) AS DOUBLE) AS global_y, x + 31 AS x2, y + 17 AS y2 FROM det")
def p01(spark, d):
    return detections(spark, d).select("id", rounded((F.col("x") + F.col("x") + 31) / 2.0, 2).alias("global_x"), rounded((F.col("y") + F.col("y") + 17) / 2.0, 2).alias("global_y"), (F.col("x") + 31).alias("x2"), (F.col("y") + 17).alias("y2"))


@query("p02_metric_size", f"WITH {DET_SQL}, res AS (SELECT c_custkey AS strip, CASE WHEN c_acctbal > 0 THEN 0.05 + (c_custkey % 10) / 100.0 END AS m_per_px FROM customer) SELECT id, {R4.format('31 * m_per_px')} AS width_m, {R4.format('17 * m_per_px')} AS length_m, CASE WHEN m_per_px IS NULL THEN 'pixels only' ELSE 'strip resolution' END AS basis FROM det LEFT JOIN res USING (strip)")
def p02(spark, d):
    res = table(spark, d, "customer").select(F.col("c_custkey").alias("strip"), F.when(F.col("c_acctbal") > 0, 0.05 + (F.col("c_custkey") % 10) / 100.0).alias("m"))
    rows = detections(spark, d).join(res, "strip", "left")
    return rows.select("id", rounded(31 * F.col("m"), 4).alias("width_m"), rounded(17 * F.col("m"), 4).alias("length_m"), F.when(F.col("m").isNull(), "pixels only").otherwise("strip resolution").alias("basis"))


@query("p03_p04_severity", f"WITH {SCORED_SQL} SELECT id, shown_class, class_withheld, weight, severity, tier_rank, action FROM tiered")
def p03(spark, d):
    return tiered(spark, d).select("id", "shown_class", "class_withheld", "weight", "severity", "tier_rank", "action")


@query("p05_target_selection", f"WITH {DET_SQL} SELECT strip, count(*) FILTER (NOT suppressed) AS targets, count(*) FILTER (suppressed) AS left_out FROM det WHERE class IN ('error', 'purchase') GROUP BY strip")
def p05(spark, d):
    wanted = text.has_token_run(F.col("class"), F.lit("error")) | text.has_token_run(F.col("class"), F.lit("purchases"))
    return detections(spark, d).filter(wanted).groupBy("strip").agg(F.count_if(~F.col("suppressed")).alias("targets"), F.count_if("suppressed").alias("left_out"))


@query("p06_find_detections", f"""WITH {SCORED_SQL} SELECT count(*) FILTER (class <> 'error') AS other_class, count(*) FILTER (class = 'error' AND confidence < 0.25) AS weak, count(*) FILTER (class = 'error' AND confidence >= 0.25 AND suppressed) AS suppressed_n,
  count(*) FILTER (class = 'error' AND confidence >= 0.25 AND NOT suppressed) AS found FROM tiered""")
def p06(spark, d):
    family, strong = F.col("class") == "error", F.col("confidence") >= 0.25
    return tiered(spark, d).agg(F.count_if(~family).alias("other_class"), F.count_if(family & ~strong).alias("weak"), F.count_if(family & strong & F.col("suppressed")).alias("suppressed_n"), F.count_if(family & strong & ~F.col("suppressed")).alias("found"))


@query("p07_filtered_detections", f"WITH {DET_SQL} SELECT strip, class, count(*) AS n FROM det WHERE suppressed GROUP BY strip, class")
def p07(spark, d):
    return detections(spark, d).filter("suppressed").groupBy("strip", "class").agg(F.count("*").alias("n"))


@query("p08_detections_view", f"WITH {SCORED_SQL} SELECT id, class, severity, tier_rank FROM tiered WHERE tier_rank IN (0, 1) AND NOT suppressed ORDER BY severity DESC, confidence DESC, id LIMIT 50")
def p08(spark, d):
    return tiered(spark, d).filter(F.col("tier_rank").isin(0, 1) & ~F.col("suppressed")).orderBy(F.desc("severity"), F.desc("confidence"), "id").limit(50).select("id", "class", "severity", "tier_rank")


@query("p09_relook_reasons", f"WITH {SCORED_SQL} SELECT id, concat_ws('; ', CASE WHEN confidence < 0.1 THEN 'low confidence' END, CASE WHEN x < 64 OR x > 4032 THEN 'at the edge' END, CASE WHEN class_withheld IS NOT NULL THEN 'class withheld' END, CASE WHEN tier_rank = 0 THEN 'critical' END) AS reasons FROM tiered WHERE confidence < 0.1 OR x < 64 OR x > 4032 OR class_withheld IS NOT NULL OR tier_rank = 0")
def p09(spark, d):
    why = [("low confidence", F.col("confidence") < 0.1), ("at the edge", (F.col("x") < 64) | (F.col("x") > 4032)), ("class withheld", F.col("class_withheld").isNotNull()), ("critical", F.col("tier_rank") == 0)]
    reasons = F.concat_ws("; ", *[F.when(c, name) for name, c in why])
    return tiered(spark, d).select("id", reasons.alias("reasons")).filter("reasons <> ''")


@query("p10_bbox_intersects", f"WITH {DET_SQL} SELECT id FROM det WHERE x <= 2000 AND x + 31 >= 1000 AND y <= 900 AND y + 17 >= 500")
def p10(spark, d):
    box = (F.col("x"), F.col("y"), F.col("x") + 31, F.col("y") + 17)
    return detections(spark, d).filter(geo.intersects(box, tuple(map(F.lit, (1000, 500, 2000, 900))))).select("id")


@query("p13_p17_verification", f"WITH {DET_SQL} SELECT id, coalesce(CAST(json_extract(props, '$.k') AS INTEGER), 50) AS pct, coalesce(CAST(json_extract(props, '$.k') AS INTEGER), 50) < 20 AND class = 'error' AS suppress FROM det JOIN events ON id = event_id")
def p13(spark, d):
    rows = table(spark, d, "events").withColumn("pct", F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(50)))
    return rows.select(F.col("event_id").alias("id"), "pct", ((F.col("pct") < 20) & (F.col("event_type") == "error")).alias("suppress"))


@query("p19_hotspot_filter", f"WITH {CELLS_SQL} SELECT priority_rank, dominant_class, risk_score FROM ranked WHERE dominant_class IN ('error', 'view') AND tier_rank <= 1 ORDER BY priority_rank LIMIT 25")
def p19(spark, d):
    hot = hazards.hotspots(tiered(spark, d).filter(~F.col("suppressed")), CELL)
    return hot.filter(F.col("dominant_class").isin("error", "view") & (F.col("tier_rank") <= 1)).orderBy("priority_rank").limit(25).select("priority_rank", "dominant_class", "risk_score")


SCANS_SQL = "scans AS (SELECT o_orderkey AS scan_id, o_custkey % 10 AS site, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice / 10000.0 END AS lat, o_orderdate AS created FROM orders), stored AS (SELECT l_orderkey AS scan_id, l_linenumber AS n, l_returnflag AS class, l_discount AS confidence, l_linestatus = 'F' AS suppressed, l_suppkey AS part FROM lineitem)"


def scans(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("scan_id"), (F.col("o_custkey") % 10).alias("site"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice") / 10000.0).alias("lat"), F.col("o_orderdate").alias("created"))


def stored(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scan_id"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("class"), F.col("l_discount").alias("confidence"), (F.col("l_linestatus") == "F").alias("suppressed"))


@query("j01_history", f"WITH {SCANS_SQL} SELECT s.scan_id, count(t.scan_id) AS detections, count(*) FILTER (t.suppressed) AS suppressed_n, count(DISTINCT t.class) AS classes FROM scans s LEFT JOIN stored t USING (scan_id) GROUP BY s.scan_id")
def j01(spark, d):
    per = stored(spark, d).groupBy("scan_id").agg(F.count("*").alias("detections"), F.count_if("suppressed").alias("suppressed_n"), F.countDistinct("class").alias("classes"))
    return scans(spark, d).select("scan_id").join(per, "scan_id", "left").fillna(0)


@query("j02_hazard_map", f"WITH {SCANS_SQL} SELECT site, count(*) AS hazards, count(*) FILTER (lat IS NULL) AS unlocated, max(confidence) AS most FROM scans JOIN stored USING (scan_id) GROUP BY site")
def j02(spark, d):
    return scans(spark, d).join(stored(spark, d), "scan_id").groupBy("site").agg(F.count("*").alias("hazards"), F.count_if(F.col("lat").isNull()).alias("unlocated"), F.max("confidence").alias("most"))


@query("j03_scan_lookup", f"WITH {SCANS_SQL} SELECT t.scan_id, n, class, s.site, s.lat FROM stored t LEFT JOIN scans s USING (scan_id) WHERE confidence > 0.08")
def j03(spark, d):
    return stored(spark, d).filter("confidence > 0.08").join(scans(spark, d), "scan_id", "left").select("scan_id", "n", "class", "site", "lat")


@query("j20_longest_key_policy", "WITH keys(k, w) AS (VALUES ('PROMO', 5), ('PROMO B', 9), ('ECONOMY', 2), ('STANDARD POLISHED', 7), ('BRASS', 1)), fit AS (SELECT p_partkey, p_type, max_by(w, row(CAST(p_type = k AS INTEGER), length(k), k)) AS w FROM part LEFT JOIN keys ON contains(p_type, k) GROUP BY 1, 2) SELECT p_partkey, coalesce(w, 0) AS weight FROM fit")
def j20(spark, d):
    keys = spark.createDataFrame([("PROMO", 5), ("PROMO B", 9), ("ECONOMY", 2), ("STANDARD POLISHED", 7), ("BRASS", 1)], "k string, w int")
    return joins.by_longest_key(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", F.broadcast(keys), "k", ["w"]).select("p_partkey", F.coalesce("w", F.lit(0)).alias("weight"))


@query("j21_class_family", "SELECT event_id, CASE WHEN contains(event_type, 'err') THEN 'fault' WHEN contains(event_type, 'c') THEN 'contact' WHEN contains(event_type, 'sign') THEN 'entry' ELSE 'other' END AS family FROM events")
def j21(spark, d):
    t = F.col("event_type")
    return table(spark, d, "events").select("event_id", F.when(t.contains("err"), "fault").when(t.contains("c"), "contact").when(t.contains("sign"), "entry").otherwise("other").alias("family"))


BOX_SQL = f"{DET_SQL}, box AS (SELECT id, strip, id % 3 AS model, confidence AS score, (x % 160) AS x1, (y % 160) AS y1, (x % 160) + 40 AS x2, (y % 160) + 40 AS y2, x // 1024 AS tile FROM det)"


def boxes(spark, d):
    rows = detections(spark, d)
    x, y = F.col("x") % 160, F.col("y") % 160
    return rows.select("id", "strip", (F.col("id") % 3).alias("model"), F.col("confidence").alias("score"), x.alias("x1"), y.alias("y1"), (x + 40).alias("x2"), (y + 40).alias("y2"), F.floor(F.col("x") / 1024).cast("int").alias("tile"))


@query("j22_iou_pairs", f"""WITH {BOX_SQL} SELECT a.id AS id_a, b.id AS id_b, {R4.format('i * 1.0 / (3200 - i)')} AS iou FROM (SELECT a, b, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS i
  FROM box a JOIN box b ON a.strip = b.strip AND a.tile = b.tile AND a.id < b.id AND a.model <> b.model) WHERE i * 1.0 / (3200 - i) >= 0.3""")
def j22(spark, d):
    return box_pairs(spark, d).select("id_a", "id_b", "iou")


def box_pairs(spark, d):
    a, b = (boxes(spark, d).select(*[F.col(c).alias(c + s) for c in ("id", "model", "x1", "y1", "x2", "y2")], "strip", "tile") for s in ("_a", "_b"))
    side = lambda s: tuple(F.col(c + s) for c in ("x1", "y1", "x2", "y2"))
    pairs = a.join(b, ["strip", "tile"]).filter((F.col("id_a") < F.col("id_b")) & (F.col("model_a") != F.col("model_b")))
    iou = geo.iou(side("_a"), side("_b"))
    return pairs.filter(iou >= 0.3).select("strip", "tile", "id_a", "id_b", rounded(iou, 4).alias("iou"))


@query("j23_inherit_position", f"WITH {SCANS_SQL}, tile AS (SELECT site, avg(lat) AS tile_lat FROM scans GROUP BY site) SELECT scan_id, {R4.format('coalesce(lat, tile_lat)')} AS lat, lat IS NULL AS inherited FROM scans LEFT JOIN tile USING (site)")
def j23(spark, d):
    s = scans(spark, d)
    tile = s.groupBy("site").agg(F.avg("lat").alias("tile_lat"))
    return s.join(tile, "site", "left").select("scan_id", rounded(F.coalesce("lat", "tile_lat"), 4).alias("lat"), F.col("lat").isNull().alias("inherited"))


@query("j28_tile_of_centre", f"""WITH {DET_SQL}, tiles AS (SELECT a.i * 512 AS tx, b.i * 512 AS ty FROM range(8) a(i), range(8) b(i)) SELECT id, tx, ty FROM (SELECT id, tx, ty, row_number() OVER (PARTITION BY id ORDER BY greatest(abs(x - tx - 320), abs(y - ty - 320)), tx, ty) AS n
  FROM det JOIN tiles ON x >= tx AND x < tx + 640 AND y >= ty AND y < ty + 640) WHERE n = 1""")
def j28(spark, d):
    def starts(c):  # tiles of 640 every 512: a point lies in one or two along each axis
        last = F.floor(F.col(c) / 512)
        return F.explode(F.filter(F.array(last - 1, last), lambda k: (k >= 0) & (k < 8) & (F.col(c) < k * 512 + 640)))

    rows = detections(spark, d).withColumn("kx", starts("x")).withColumn("ky", starts("y")).withColumns({"tx": F.col("kx") * 512, "ty": F.col("ky") * 512})
    off = F.greatest(F.abs(F.col("x") - F.col("tx") - 320), F.abs(F.col("y") - F.col("ty") - 320))
    return joins.first_by(rows, ["id"], off, F.col("tx"), F.col("ty")).select("id", "tx", "ty")


@query("a02_dominant_class", f"WITH {SCORED_SQL}, c AS (SELECT strip, class, count(*) AS n, sum(CAST(severity AS DECIMAL(18,8))) AS s FROM tiered GROUP BY 1, 2) SELECT strip, max_by(class, row(s, n, class)) AS dominant FROM c GROUP BY strip")
def a02(spark, d):
    c = tiered(spark, d).groupBy("strip", "class").agg(F.count("*").alias("n"), F.sum(F.col("severity").cast("decimal(18,8)")).alias("s"))
    return c.groupBy("strip").agg(F.max_by("class", F.struct("s", "n", "class")).alias("dominant"))


@query("a03_complete_centroid", f"WITH {SCANS_SQL} SELECT created, CASE WHEN count(lat) = count(*) THEN {R4.format('avg(lat)')} END AS lat FROM scans GROUP BY created")
def a03(spark, d):
    return scans(spark, d).groupBy("created").agg(rounded(hazards.complete_mean(F.col("lat")), 4).alias("lat"))


@query("a04_top_detection", f"WITH {SCORED_SQL} SELECT strip, max(row(severity, confidence, id))[3] AS top_id, max(severity) AS severity FROM tiered GROUP BY strip")
def a04(spark, d):
    return tiered(spark, d).groupBy("strip").agg(F.max(F.struct("severity", "confidence", "id"))["id"].alias("top_id"), F.max("severity").alias("severity"))


@query("a05_highest_tier", f"WITH {SCORED_SQL} SELECT strip, CASE min(tier_rank) WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS tier FROM tiered GROUP BY strip")
def a05(spark, d):
    return tiered(spark, d).groupBy("strip").agg(F.element_at(F.array(*map(F.lit, TIERS)), F.min("tier_rank") + 1).alias("tier"))


@query("a06_tier_histogram", f"WITH {SCORED_SQL}, every(tier_rank) AS (VALUES (0), (1), (2), (3)) SELECT tier_rank, count(t.id) AS n FROM every LEFT JOIN (SELECT * FROM tiered WHERE class = 'signup') t USING (tier_rank) GROUP BY tier_rank")
def a06(spark, d):
    return hazards.dense_counts(tiered(spark, d).filter("class = 'signup'"), "tier_rank", (0, 1, 2, 3))


@query("a07_class_distribution", f"WITH {SCORED_SQL} SELECT class, count(*) AS n, count(*) FILTER (suppressed) AS suppressed_n, max(severity) AS most, CAST(row_number() OVER (ORDER BY count(*) DESC, class) AS INTEGER) AS place FROM tiered GROUP BY class")
def a07(spark, d):
    c = tiered(spark, d).groupBy("class").agg(F.count("*").alias("n"), F.count_if("suppressed").alias("suppressed_n"), F.max("severity").alias("most"))
    return c.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "class")))


@query("a08_stats_rollup", f"WITH {SCORED_SQL} SELECT tier_rank, class, count(*) AS n FROM tiered WHERE NOT suppressed GROUP BY GROUPING SETS ((tier_rank), (class), ())")
def a08(spark, d):
    rows = tiered(spark, d).filter("NOT suppressed")
    return rows.groupingSets([[F.col("tier_rank")], [F.col("class")], []], "tier_rank", "class").agg(F.count("*").alias("n"))


@query("a32_merge_provenance", f"WITH {DET_SQL} SELECT strip, class, count(*) AS members, count(DISTINCT x // 512) AS tiles, {R4.format('max(sqrt((x - mx) * (x - mx) + (y - my) * (y - my)))')} AS spread_px FROM (SELECT *, min(x) OVER w AS mx, min(y) OVER w AS my FROM det WINDOW w AS (PARTITION BY strip, class)) GROUP BY strip, class")
def a32(spark, d):
    w = Window.partitionBy("strip", "class")
    rows = detections(spark, d).withColumns({"mx": F.min("x").over(w), "my": F.min("y").over(w)})
    far = F.sqrt((F.pow(F.col("x") - F.col("mx"), 2) + F.pow(F.col("y") - F.col("my"), 2)))
    return rows.groupBy("strip", "class").agg(F.count("*").alias("members"), F.countDistinct(F.floor(F.col("x") / 512)).alias("tiles"), rounded(F.max(far), 4).alias("spread_px"))


@query("o08_hazards_by_tier", f"WITH {SCORED_SQL} SELECT id, tier_rank, row_number() OVER (ORDER BY tier_rank, id) AS place FROM tiered")
def o08(spark, d):
    return windows.numbered(tiered(spark, d).select("id", "tier_rank"), [F.col("tier_rank"), F.col("id")]).select("id", "tier_rank", "place")


@query("o09_spatial_order", f"WITH {DET_SQL} SELECT id, row_number() OVER (PARTITION BY strip ORDER BY y, x, id) AS place FROM det")
def o09(spark, d):
    return detections(spark, d).select("id", F.row_number().over(Window.partitionBy("strip").orderBy("y", "x", "id")).cast("long").alias("place"))


@query("f14_iou", f"WITH {BOX_SQL} SELECT id, CAST(round(CAST(greatest(least(x2, 120) - greatest(x1, 60), 0) * greatest(least(y2, 120) - greatest(y1, 60), 0) / (1600.0 + 3600 - greatest(least(x2, 120) - greatest(x1, 60), 0) * greatest(least(y2, 120) - greatest(y1, 60), 0)) AS DECIMAL(18,8)), 4) AS DOUBLE) AS iou FROM box")
def f14(spark, d):
    iou = geo.iou(tuple(map(F.col, ("x1", "y1", "x2", "y2"))), tuple(map(F.lit, (60.0, 60.0, 120.0, 120.0))))
    return boxes(spark, d).select("id", rounded(iou, 4).alias("iou"))


@query("f26_tile_offsets", "SELECT p_partkey, unnest(list_distinct(list_concat(range(0, greatest(p_size * 50 - 640, 0), 512), [greatest(p_size * 50 - 640, 0)]))) AS start_px FROM part")
def f26(spark, d):
    last = F.greatest(F.col("p_size") * 50 - 640, F.lit(0)).cast("long")
    starts = F.array_distinct(F.concat(F.filter(F.sequence(F.lit(0).cast("long"), last, F.when(last > 0, F.lit(512)).otherwise(1).cast("long")), lambda k: k < last), F.array(last)))
    return table(spark, d, "part").select("p_partkey", F.explode(starts).alias("start_px"))


@query("f42_tile_names", "WITH n AS (SELECT l_orderkey, l_linenumber, l_suppkey, concat(l_returnflag, '_', l_orderkey, '_', l_linenumber, '_', l_suppkey, '.png') AS name FROM lineitem) SELECT name, regexp_extract(name, '^(.+)_([0-9]+)_([0-9]+)', 1) AS strip, CAST(l_linenumber AS INTEGER) AS tile_x, CAST(l_suppkey AS INTEGER) AS tile_y FROM n")
def f42(spark, d):
    name = F.concat_ws("_", "l_returnflag", "l_orderkey", "l_linenumber", F.concat(F.col("l_suppkey"), F.lit(".png")))
    strip, x, y = text.tile_parts(F.col("name"))
    return table(spark, d, "lineitem").select(name.alias("name")).select("name", strip.alias("strip"), x.alias("tile_x"), y.alias("tile_y"))


@query("k02_action_list", f"WITH {SCORED_SQL} SELECT id, class, severity, coalesce(action, 'none') AS action FROM tiered WHERE NOT suppressed ORDER BY severity DESC, id LIMIT 200")
def k02(spark, d):
    return tiered(spark, d).filter("NOT suppressed").orderBy(F.desc("severity"), "id").limit(200).select("id", "class", "severity", F.coalesce("action", F.lit("none")).alias("action"))


@query("k04_geojson_counts", f"WITH {SCANS_SQL} SELECT site, count(lat) AS features, count(*) - count(lat) AS unlocated FROM scans GROUP BY site")
def k04(spark, d):
    return scans(spark, d).groupBy("site").agg(F.count("lat").alias("features"), F.count_if(F.col("lat").isNull()).alias("unlocated"))


@query("d28_output_checks", f"""WITH {SCORED_SQL} SELECT 'confidence in range' AS rule, count(*) FILTER (confidence < 0 OR confidence > 1) AS violations FROM tiered UNION ALL SELECT 'severity above weight', count(*) FILTER (severity > weight + 0.00005) FROM tiered
  UNION ALL SELECT 'withheld without unknown', count(*) FILTER (class_withheld IS NOT NULL AND shown_class <> 'unknown') FROM tiered UNION ALL SELECT 'id repeated', count(*) - count(DISTINCT id) FROM tiered""")
def d28(spark, d):
    t = tiered(spark, d)
    one = t.agg(
        F.count_if((F.col("confidence") < 0) | (F.col("confidence") > 1)).alias("a"), F.count_if(F.col("severity") > F.col("weight") + 0.00005).alias("b"),
        F.count_if(F.col("class_withheld").isNotNull() & (F.col("shown_class") != "unknown")).alias("c"), (F.count("*") - F.countDistinct("id")).alias("e"),
    )
    return one.select(F.expr("stack(4, 'confidence in range', a, 'severity above weight', b, 'withheld without unknown', c, 'id repeated', e) AS (rule, violations)"))


@query("d03_cross_model_merge")
def d03(spark, d):
    return sequential.merged_boxes(boxes(spark, d), ["strip", "tile"], 0.3).select("id", "kept_by")


@query("x17_box_suppression")
def x17(spark, d):
    return sequential.merged_boxes(boxes(spark, d), ["strip", "tile"], 0.45, across_models=False).select("id", "kept_by")


@query("d04_greedy_clusters")
def d04(spark, d):
    rows = detections(spark, d).select("id", "strip", "class", "x", "y", F.col("confidence").alias("score"))
    return sequential.clusters(rows, ["strip", "class"], 300.0).select("id", "rep")


@query("d05_j26_greedy_match")
def d05(spark, d):
    return sequential.matched_boxes(boxes(spark, d), ["strip", "tile"], 0.3).select("a", "b", "iou")

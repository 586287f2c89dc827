"""Tool, report and import queries: profiles of surveys, arguments, nested documents, selections and tallies."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.functions import text
from fathomline.functions.score import rounded
from fathomline.operators import joins, staging, windows
from fathomline.plans.survey import tiered
from fathomline.plans.registry import query
from fathomline.plans.telemetry import R4
from fathomline.plans.views import DET_SQL, FIX_SQL, NAV_SQL, SCORED_SQL, detections, fixes, nav_rows, table
from fathomline.sources import store

TIERED = f"WITH {SCORED_SQL}"


@query("x01_list_surveys", f"{TIERED} SELECT strip % 8 AS survey, count(*) AS detections, count(CASE WHEN suppressed THEN 1 END) AS suppressed, count(CASE WHEN tier_rank <= 1 THEN 1 END) AS urgent, strip % 8 IN (SELECT o_orderkey % 8 FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey < 12) AS has_triage FROM tiered GROUP BY strip % 8")
def x01(spark, d):
    counts = tiered(spark, d).groupBy((F.col("strip") % 8).alias("survey")).agg(F.count("*").alias("detections"), F.count_if("suppressed").alias("suppressed"), F.count_if(F.col("tier_rank") <= 1).alias("urgent"))
    triage = table(spark, d, "orders").filter("o_orderkey % 3 = 0 AND o_orderkey < 12").select((F.col("o_orderkey") % 8).alias("survey"), F.lit(True).alias("has")).distinct()
    return counts.join(triage, "survey", "left").select("survey", "detections", "suppressed", "urgent", F.coalesce("has", F.lit(False)).alias("has_triage"))


@query("x02_survey_summary", f"{TIERED} SELECT strip % 8 AS survey, count(DISTINCT strip) AS strips, count(DISTINCT class) AS classes, {R4.format('avg(CAST(confidence AS DECIMAL(18,8)))')} AS mean_confidence, max(severity) AS worst, max_by(id, row(severity, -id)) AS worst_id FROM tiered GROUP BY 1")
def x02(spark, d):
    rows = tiered(spark, d).withColumn("survey", F.col("strip") % 8)
    return rows.groupBy("survey").agg(F.countDistinct("strip").alias("strips"), F.countDistinct("class").alias("classes"), rounded(F.avg("confidence"), 4).alias("mean_confidence"), F.max("severity").alias("worst"), F.max_by("id", F.struct("severity", -F.col("id"))).alias("worst_id"))


@query("x03_synthetic_flag", "SELECT user_id AS strip, user_id = 3 OR bool_or(contains(props, '99')) OR bool_or(event_type = 'error' AND value > 190) AS synthetic FROM events GROUP BY user_id")
def x03(spark, d):
    e = table(spark, d, "events")
    any_ = F.bool_or(F.contains("props", F.lit("99")) | ((F.col("event_type") == "error") & (F.col("value") > 190)))
    return e.groupBy(F.col("user_id").alias("strip")).agg(any_.alias("a")).select("strip", ((F.col("strip") == 3) | F.col("a")).alias("synthetic"))


@query("x04_position", f"WITH {DET_SQL} SELECT id, CASE WHEN strip % 2 = 0 THEN 'geo' ELSE 'pixel' END AS frame, CAST(CASE WHEN strip % 2 = 0 THEN 10 + y * 0.0001 ELSE y END AS DOUBLE) AS a, CAST(CASE WHEN strip % 2 = 0 THEN 79 + x * 0.0001 ELSE x END AS DOUBLE) AS b FROM det")
def x04(spark, d):
    located = F.col("strip") % 2 == 0
    at = F.when(located, F.struct(F.lit("geo").alias("frame"), (10 + F.col("y") * 0.0001).alias("a"), (79 + F.col("x") * 0.0001).alias("b")))
    at = at.otherwise(F.struct(F.lit("pixel").alias("frame"), F.col("y").cast("double").alias("a"), F.col("x").cast("double").alias("b")))
    return detections(spark, d).select("id", at.alias("at")).select("id", "at.frame", rounded(F.col("at.a"), 4).alias("a"), rounded(F.col("at.b"), 4).alias("b"))


@query("x05_strip_of_id", "WITH n AS (SELECT DISTINCT 'S' || user_id AS strip FROM events), q AS (SELECT event_id, 'S' || user_id || '-' || event_id AS name FROM events) SELECT event_id, min(strip) AS strip FROM q JOIN n ON starts_with(name, strip) GROUP BY event_id")
def x05(spark, d):
    e = table(spark, d, "events")
    strips = e.select(F.concat(F.lit("S"), "user_id").alias("strip")).distinct()
    name = F.concat(F.lit("S"), "user_id", F.lit("-"), "event_id")
    # every beginning of the name is looked up, so that the join is one on equal keys
    begins = e.select("event_id", F.explode(F.transform(F.sequence(F.lit(1), F.length(name)), lambda n: F.left(name, n))).alias("strip"))
    return begins.join(strips, "strip").groupBy("event_id").agg(F.min("strip").alias("strip"))


NEAR = "CASE event_id % 4 WHEN 0 THEN '10.5, 79.25' WHEN 1 THEN '10.5,79.25,' || CAST(event_id AS VARCHAR) WHEN 2 THEN 'north' ELSE '95,200,10' END"


@query("x06_near_argument", f"WITH a AS (SELECT event_id, string_split({NEAR}, ',') AS p FROM events), n AS (SELECT event_id, TRY_CAST(trim(p[1]) AS DOUBLE) AS lat, TRY_CAST(trim(p[2]) AS DOUBLE) AS lon, coalesce(TRY_CAST(trim(p[3]) AS DOUBLE), 1000.0) AS radius FROM a) SELECT event_id, lat, lon, radius FROM n WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND radius > 0")
def x06(spark, d):
    raw = F.expr("CASE event_id % 4 WHEN 0 THEN '10.5, 79.25' WHEN 1 THEN '10.5,79.25,' || CAST(event_id AS STRING) WHEN 2 THEN 'north' ELSE '95,200,10' END")
    part = lambda k: F.trim(F.get(F.split(raw, ","), F.lit(k))).try_cast("double")
    rows = table(spark, d, "events").select("event_id", part(0).alias("lat"), part(1).alias("lon"), F.coalesce(part(2), F.lit(1000.0)).alias("radius"))
    return rows.filter("lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND radius > 0")


CATALOG = (("ring", 0.7), ("small ring", 0.9), ("widget", 0.4), ("red", 0.2))


@query("x07_assistant_severity", "WITH c(k, s) AS (VALUES " + ", ".join(f"('{k}', CAST({s} AS DOUBLE))" for k, s in CATALOG) + "), b AS (SELECT p_partkey, max_by(s, row(p_name = k, length(k), k)) AS s FROM part JOIN c ON contains(p_name, k) GROUP BY 1) SELECT p_partkey, CASE WHEN p_size > 45 THEN 1.0 ELSE coalesce(s, 0.1) END AS severity FROM part LEFT JOIN b USING (p_partkey)")
def x07(spark, d):
    catalog = spark.createDataFrame(CATALOG, "k string, s double")
    rows = joins.by_longest_key(table(spark, d, "part").select("p_partkey", "p_name", "p_size"), "p_name", catalog, "k", ["s"])
    return rows.select("p_partkey", F.when(F.col("p_size") > 45, 1.0).otherwise(F.coalesce("s", F.lit(0.1))).alias("severity"))


@query("x08_prior_targets", f"WITH {DET_SQL}, doc AS (SELECT o_orderkey AS id, o_orderkey % 8 AS survey FROM orders WHERE o_orderkey % 8 < 4), raw AS (SELECT id, strip % 8 AS survey FROM det WHERE class IN ('error', 'signup') AND NOT suppressed) SELECT 'triage' AS origin, id, survey FROM doc UNION ALL SELECT 'detection', id, survey FROM raw WHERE survey NOT IN (SELECT survey FROM doc)")
def x08(spark, d):
    doc = table(spark, d, "orders").select(F.lit("triage").alias("origin"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 8).alias("survey")).filter("survey < 4")
    raw = detections(spark, d).filter("class IN ('error', 'signup') AND NOT suppressed").select(F.lit("detection").alias("origin"), "id", (F.col("strip") % 8).alias("survey"))
    return doc.unionByName(raw.join(doc.select("survey").distinct(), "survey", "left_anti").select("origin", "id", "survey"))


@query("x09_plan_area", "SELECT p_partkey, CASE WHEN p_size - 3 > 0 AND p_size % 7 > 0 THEN CAST((p_size - 3) * (p_size % 7) AS BIGINT) END AS area FROM part")
def x09(spark, d):
    a, b = F.col("p_size") - 3, F.col("p_size") % 7
    return table(spark, d, "part").select("p_partkey", F.when((a > 0) & (b > 0), a * b).cast("long").alias("area"))


@query("x16_verification_path", f"WITH {DET_SQL} SELECT strip, CASE WHEN bool_or(id % 97 = 0) THEN 'stored fields' WHEN bool_or(NOT suppressed) THEN 'recompute' ELSE 'skip' END AS path FROM det GROUP BY strip")
def x16(spark, d):
    g = detections(spark, d).groupBy("strip").agg(F.bool_or(F.col("id") % 97 == 0).alias("a"), F.bool_or(~F.col("suppressed")).alias("b"))
    return g.select("strip", F.when(F.col("a"), "stored fields").when(F.col("b"), "recompute").otherwise("skip").alias("path"))


@query("x19_throughput", f"SELECT s_suppkey, {R4.format('1000.0 / (64 + s_suppkey % 7) * 2')} AS tiles_per_km, {R4.format('3.6 * (64 + s_suppkey % 7) / 2 / (0.2 + s_suppkey % 5 * 0.1)')} AS km_per_h, {R4.format('3.6 * (64 + s_suppkey % 7) / 2 / (0.2 + s_suppkey % 5 * 0.1) / 7.408')} AS real_time_factor FROM supplier")
def x19(spark, d):
    k = F.col("s_suppkey")
    metres, seconds = (64 + k % 7) / 2, 0.2 + k % 5 * 0.1  # of a tile along the track; to look at it
    speed = 3.6 * metres / seconds
    return table(spark, d, "supplier").select("s_suppkey", rounded(1000 / metres, 4).alias("tiles_per_km"), rounded(speed, 4).alias("km_per_h"), rounded(speed / 7.408, 4).alias("real_time_factor"))


@query("x25_harbour_points", "SELECT s_nationkey, count(*) AS n, CASE WHEN count(*) = 1 THEN 'point' ELSE 'representative' END AS kind, CAST(round(CAST(avg(CAST(10 + s_suppkey * 0.01 AS DECIMAL(18,8))) AS DECIMAL(18,8)), 4) AS DOUBLE) AS lat FROM supplier GROUP BY s_nationkey")
def x25(spark, d):
    g = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), rounded(F.avg(10 + F.col("s_suppkey") * 0.01), 4).alias("lat"))
    return g.select("s_nationkey", "n", F.when(F.col("n") == 1, "point").otherwise("representative").alias("kind"), "lat")


@query("x33_handoff", "SELECT user_id, max_by(event_type, row(value, event_id)) AS top_impact, CASE WHEN count(CASE WHEN event_type = 'error' THEN 1 END) > 0 THEN max(value) END AS chance, count(DISTINCT event_type) AS stages FROM events GROUP BY user_id")
def x33(spark, d):
    error = F.count_if(F.col("event_type") == "error") > 0
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("value", "event_id")).alias("top_impact"), F.when(error, F.max("value")).alias("chance"), F.countDistinct("event_type").alias("stages"))


REGISTRY = (("en", "the", "North"), ("en", "zzzz", "North"), ("fr", "des", "South"), ("de", "und", "East"), ("es", "zzzz", "West"))


@query("x34_authorities", "WITH r(lang, name, place) AS (VALUES " + ", ".join(str(r) for r in REGISTRY) + "), s AS (SELECT DISTINCT source, lang FROM documents), f AS (SELECT DISTINCT source, d.lang, name, place FROM documents d JOIN r ON d.lang = r.lang AND contains(lower(d.text), ' ' || name || ' ')) SELECT s.source, s.lang, coalesce(name, 'none') AS authority, place FROM s LEFT JOIN f ON s.source IS NOT DISTINCT FROM f.source AND s.lang = f.lang")
def x34(spark, d):
    registry = F.broadcast(spark.createDataFrame(REGISTRY, "lang string, name string, place string"))
    docs = table(spark, d, "documents").select("source", "lang", F.lower("text").alias("t"))
    held = docs.join(registry, "lang").filter(F.contains("t", F.concat(F.lit(" "), "name", F.lit(" ")))).groupBy(F.col("source").alias("_s"), F.col("lang").alias("_l"), "name", "place").agg(F.count("*").alias("_n"))
    s = docs.select("source", "lang").distinct()
    return s.join(held, s["source"].eqNullSafe(held["_s"]) & (s["lang"] == held["_l"]), "left").select("source", "lang", F.coalesce("name", F.lit("none")).alias("authority"), "place")


@query("x36_normalised_column", f"WITH b AS (SELECT event_id, value, event_id % 20 AS bin FROM events), m AS (SELECT bin, quantile_cont(value, 0.5) AS median FROM b GROUP BY bin) SELECT event_id, {R4.format('value / median')} AS level FROM b JOIN m USING (bin)")
def x36(spark, d):
    b = table(spark, d, "events").select("event_id", "value", (F.col("event_id") % 20).alias("bin"))
    return b.join(b.groupBy("bin").agg(F.median("value").alias("median")), "bin").select("event_id", rounded(F.col("value") / F.col("median"), 4).alias("level"))


@query("x37_rebuilt_strip", f"WITH {DET_SQL} SELECT strip, x // 256 AS i, y // 256 AS j, max_by(confidence, row(ts, id)) AS pixel, count(*) AS writers FROM det GROUP BY 1, 2, 3")
def x37(spark, d):
    cell = [F.floor(F.col(c) / 256).alias(n) for c, n in (("x", "i"), ("y", "j"))]
    return detections(spark, d).groupBy("strip", *cell).agg(F.max_by("confidence", F.struct("ts", "id")).alias("pixel"), F.count("*").alias("writers"))


KINDS = "CASE p_partkey % 5 WHEN 0 THEN 'xtf' WHEN 1 THEN 'tiff' WHEN 2 THEN 'image' WHEN 3 THEN 'nav' ELSE 'other' END"


@query("x42_pipeline_plan", f"WITH f AS (SELECT p_brand, p_partkey, {KINDS} AS kind FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CASE kind WHEN 'xtf' THEN 1 WHEN 'tiff' THEN 2 WHEN 'image' THEN 3 ELSE 9 END, p_partkey) AS n FROM f) SELECT p_brand, p_partkey, CASE WHEN kind NOT IN ('xtf', 'tiff', 'image') THEN 'not a source' WHEN n = 1 THEN 'use' ELSE 'another source comes first' END AS plan FROM r")
def x42(spark, d):
    f = table(spark, d, "part").select("p_brand", "p_partkey", F.expr(KINDS).alias("kind"))
    order = F.coalesce(F.array_position(F.array(*map(F.lit, ("xtf", "tiff", "image"))), F.col("kind")), F.lit(0))
    order = F.when(order == 0, 9).otherwise(order)
    f = f.withColumn("n", F.row_number().over(Window.partitionBy("p_brand").orderBy(order, "p_partkey")))
    return f.select("p_brand", "p_partkey", F.when(~F.col("kind").isin("xtf", "tiff", "image"), "not a source").when(F.col("n") == 1, "use").otherwise("another source comes first").alias("plan"))


@query("x44_eval_tallies", f"SELECT coalesce(lang, 'all') AS category, count(*) AS cases, CAST(sum(quality) AS BIGINT) AS passed, {R4.format('avg(quality)')} AS rate FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)")
def x44(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return rows.rollup("lang").agg(F.count("*").alias("cases"), F.sum("quality").alias("passed"), rounded(F.avg("quality"), 4).alias("rate")).select(F.coalesce("lang", F.lit("all")).alias("category"), "cases", "passed", "rate")


@query("x28_clipped_boxes", f"WITH {DET_SQL}, b AS (SELECT id, class, greatest(x, 1000) AS x1, greatest(y, 500) AS y1, least(x + 200, 3000) AS x2, least(y + 100, 2500) AS y2 FROM det) SELECT class, count(*) AS boxes, CAST(sum((x2 - x1) * (y2 - y1)) AS BIGINT) AS area FROM b WHERE x1 < x2 AND y1 < y2 GROUP BY class")
def x28(spark, d):
    b = detections(spark, d).select("class", F.greatest("x", F.lit(1000)).alias("x1"), F.greatest("y", F.lit(500)).alias("y1"), F.least(F.col("x") + 200, F.lit(3000)).alias("x2"), F.least(F.col("y") + 100, F.lit(2500)).alias("y2"))
    return b.filter("x1 < x2 AND y1 < y2").groupBy("class").agg(F.count("*").alias("boxes"), F.sum((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area"))


@query("o02_detections_by_severity", f"{TIERED} SELECT id, severity, confidence FROM tiered ORDER BY severity DESC, confidence DESC, id LIMIT 50")
def o02(spark, d):
    return tiered(spark, d).orderBy(F.desc("severity"), F.desc("confidence"), "id").limit(50).select("id", "severity", "confidence")


@query("o10_display_order", f"{TIERED} SELECT id, row_number() OVER (ORDER BY suppressed, tier_rank, severity DESC, id) AS place FROM tiered")
def o10(spark, d):
    rows = tiered(spark, d).select("id", "suppressed", "tier_rank", "severity")
    return windows.numbered(rows, [F.col("suppressed"), F.col("tier_rank"), F.desc("severity"), F.col("id")]).select("id", "place")


NESTED = "CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN '{\"m\": ' || props || '}' ELSE '{\"k\": \"none\"}' END"


@query("f60_first_number", f"SELECT event_id, coalesce(TRY_CAST(json_extract_string({NESTED}, '$.k') AS DOUBLE), TRY_CAST(json_extract_string({NESTED}, '$.m.k') AS DOUBLE)) AS v FROM events")
def f60(spark, d):
    j = F.expr(NESTED)
    found = [F.get_json_object(j, p).try_cast("double") for p in ("$.k", "$.m.k")]
    return table(spark, d, "events").select("event_id", F.coalesce(*found).alias("v"))


@query("f61_finite", "SELECT event_id, CASE WHEN event_id % 10 > 1 THEN value END AS v, list_filter([CASE WHEN event_id % 10 > 1 THEN value END, 1.0], lambda z: z IS NOT NULL) AS kept FROM events")
def f61(spark, d):
    v = F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).when(F.col("event_id") % 10 == 1, F.lit(float("inf"))).otherwise(F.col("value"))
    clean = lambda z: F.when(~F.isnan(z) & (F.abs(z) < F.lit(float("inf"))), z)
    kept = F.filter(F.transform(F.array(v, F.lit(1.0)), clean), lambda z: z.isNotNull())
    return table(spark, d, "events").select("event_id", clean(v).alias("v"), kept.alias("kept"))


@query("f62_coordinate_bounds", f"WITH {FIX_SQL} SELECT device, min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east FROM (SELECT device, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM fix) GROUP BY device")
def f62(spark, d):
    doc = F.to_json(F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")))
    at = F.from_json(doc, "type string, coordinates array<double>")["coordinates"]
    rows = fixes(spark, d).select("device", at.alias("c"))
    return rows.groupBy("device").agg(F.min(F.col("c")[1]).alias("south"), F.max(F.col("c")[1]).alias("north"), F.min(F.col("c")[0]).alias("west"), F.max(F.col("c")[0]).alias("east"))


@query("f63_compact_json", f"WITH {DET_SQL} SELECT id, CAST(to_json({{'id': id, 'class': class, 'at': [x, y]}}) AS VARCHAR) AS doc FROM det")
def f63(spark, d):
    return detections(spark, d).select("id", F.to_json(F.struct("id", "class", F.array("x", "y").alias("at"))).alias("doc"))


PROSE = "CASE event_id % 3 WHEN 0 THEN 'Sure.' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN 'plan: ' || props || ' and so on' ELSE 'no plan' END"


@query("f64_plan_in_prose", f"SELECT event_id, TRY_CAST(json_extract_string(nullif(regexp_extract({PROSE}, '\\{{[^{{}}]*\\}}', 0), ''), '$.k') AS BIGINT) AS k FROM events")
def f64(spark, d):
    plan = F.nullif(F.regexp_extract(F.expr(PROSE), r"\{[^{}]*\}", 0), F.lit(""))
    return table(spark, d, "events").select("event_id", F.get_json_object(plan, "$.k").try_cast("long").alias("k"))


@query("f44_unique_ids", "WITH c AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS name FROM part) SELECT p_partkey, CASE WHEN n = 1 THEN name ELSE name || '-' || n END AS id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p_partkey) AS n FROM c)")
def f44(spark, d):
    name = F.regexp_replace(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    rows = table(spark, d, "part").select("p_partkey", name.alias("name")).withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy("p_partkey")))
    return rows.select("p_partkey", F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat("name", F.lit("-"), "n")).alias("id"))


COMPASS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


@query("f27_degrees_and_compass", f"WITH s AS (SELECT event_id, 36000 + event_id * 31 % 3600 AS s, event_id % 360 AS h FROM events) SELECT event_id, (s // 3600) || ' ' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ' ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS dms, {list(COMPASS)}[CAST(floor((h + 22.5) / 45) AS INTEGER) % 8 + 1] AS compass FROM s")
def f27(spark, d):
    s = (36000 + F.col("event_id") * 31 % 3600).cast("long")
    dms = F.format_string("%d %02d %02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    point = F.array(*map(F.lit, COMPASS))[(F.floor((F.col("event_id") % 360 + 22.5) / 45) % 8).cast("int")]
    return table(spark, d, "events").select("event_id", dms.alias("dms"), point.alias("compass"))


@query("f30_class_names", "SELECT p_partkey, regexp_replace(regexp_replace(lower(trim('  ' || upper(p_name) || '_/' || p_type || ' ')), '[\\s_/]+', '-', 'g'), '^-+|-+$', '', 'g') AS name FROM part")
def f30(spark, d):
    raw = F.concat(F.lit("  "), F.upper("p_name"), F.lit("_/"), "p_type", F.lit(" "))
    return table(spark, d, "part").select("p_partkey", text.class_name(raw).alias("name"))


@query("f32_plain_words", "WITH w AS (SELECT p_partkey, trim(regexp_replace(lower(p_name || 's & ' || p_type || '!'), '[^a-z0-9]+', ' ', 'g')) AS plain FROM part) SELECT p_partkey, plain, array_to_string(list_transform(string_split(plain, ' '), lambda v: CASE WHEN length(v) > 3 AND ends_with(v, 's') AND NOT ends_with(v, 'ss') THEN v[:-2] ELSE v END), ' ') AS singular FROM w")
def f32(spark, d):
    plain = text.alnum(F.concat("p_name", F.lit("s & "), "p_type", F.lit("!")))
    rows = table(spark, d, "part").select("p_partkey", plain.alias("plain"))
    return rows.select("p_partkey", "plain", F.array_join(F.transform(F.split("plain", " "), text.singular), " ").alias("singular"))


@query("s14_catalog", "SELECT label, count(*) AS items, count(embedding) AS embedded, count(*) = count(embedding) OR count(embedding) = 0 AS consistent FROM embeddings GROUP BY label")
def s14(spark, d):
    g = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("items"), F.count("embedding").alias("embedded"))
    return g.withColumn("consistent", (F.col("items") == F.col("embedded")) | (F.col("embedded") == 0))


@query("s22_hazard_import", "SELECT event_id AS id, coalesce(event_type, 'unknown') AS class, least(greatest(CAST(json_extract(props, '$.k') AS DOUBLE) / 100, 0), 1) AS confidence FROM events")
def s22(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("double") / 100
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.coalesce("event_type", F.lit("unknown")).alias("class"), F.least(F.greatest(k, F.lit(0.0)), F.lit(1.0)).alias("confidence"))


@query("p12_tile_content", f"SELECT user_id AS strip, event_id // 50 AS tile, {R4.format('stddev_pop(value) / 255')} AS content, count(*) >= 2 AND stddev_pop(value) / 255 >= 0.1 AS kept FROM events GROUP BY 1, 2")
def p12(spark, d):
    g = table(spark, d, "events").groupBy(F.col("user_id").alias("strip"), F.floor(F.col("event_id") / 50).alias("tile")).agg((F.stddev_pop("value") / 255).alias("c"), F.count("*").alias("n"))
    return g.select("strip", "tile", rounded(F.col("c"), 4).alias("content"), ((F.col("n") >= 2) & (F.col("c") >= 0.1)).alias("kept"))


@query("u02_coverage_points", f"WITH {DET_SQL}, {FIX_SQL}, {NAV_SQL}, p AS (SELECT strip, 'detection' AS kind, x AS a FROM det UNION ALL SELECT device, 'fix', CAST(floor(lat * 100) AS INTEGER) FROM fix UNION ALL SELECT strip, 'nav', CAST(r AS INTEGER) FROM nav WHERE altitude IS NOT NULL) SELECT strip, kind, count(*) AS points, min(a) AS low, max(a) AS high FROM p GROUP BY 1, 2")
def u02(spark, d):
    parts = (
        detections(spark, d).select("strip", F.lit("detection").alias("kind"), F.col("x").alias("a")),
        fixes(spark, d).select(F.col("device").alias("strip"), F.lit("fix").alias("kind"), F.floor(F.col("lat") * 100).cast("int").alias("a")),
        nav_rows(spark, d).filter("altitude IS NOT NULL").select("strip", F.lit("nav").alias("kind"), F.col("r").cast("int").alias("a")),
    )
    return reduce(lambda x, y: x.unionByName(y), parts).groupBy("strip", "kind").agg(F.count("*").alias("points"), F.min("a").alias("low"), F.max("a").alias("high"))


@query("u06_merged_layers", "WITH l AS (SELECT n_regionkey AS kind, 'nation' AS layer, n_name AS name FROM nation UNION ALL SELECT s_nationkey % 5, 'supplier', s_name FROM supplier) SELECT kind, count(*) AS features, min(name) AS first_name, count(DISTINCT layer) AS layers FROM l GROUP BY kind")
def u06(spark, d):
    a = table(spark, d, "nation").select(F.col("n_regionkey").alias("kind"), F.lit("nation").alias("layer"), F.col("n_name").alias("name"))
    b = table(spark, d, "supplier").select((F.col("s_nationkey") % 5).alias("kind"), F.lit("supplier").alias("layer"), F.col("s_name").alias("name"))
    return a.unionByName(b).groupBy("kind").agg(F.count("*").alias("features"), F.min("name").alias("first_name"), F.countDistinct("layer").alias("layers"))


@query("k01_nested_document", f"WITH {DET_SQL} SELECT strip, CAST(to_json({{'strip': strip, 'detections': list({{'id': id, 'class': class}} ORDER BY id)}}) AS VARCHAR) AS doc FROM det WHERE NOT suppressed GROUP BY strip")
def k01(spark, d):
    rows = detections(spark, d).filter("NOT suppressed").groupBy("strip").agg(F.array_sort(F.collect_list(F.struct("id", "class"))).alias("detections"))
    return rows.select("strip", F.to_json(F.struct("strip", "detections")).alias("doc"))


@query("k05_relook_csv", f"WITH {DET_SQL} SELECT strip, string_agg(id || ',' || x || ',' || y, ';' ORDER BY id) AS lines FROM det WHERE class = 'error' GROUP BY strip")
def k05(spark, d):
    line = F.concat_ws(",", "id", "x", "y")
    rows = detections(spark, d).filter("class = 'error'").groupBy("strip").agg(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))).alias("l"))
    return rows.select("strip", F.array_join(F.transform("l", lambda z: z["line"]), ";").alias("lines"))


@query("k06_manifest_rows", f"WITH {DET_SQL} SELECT strip, x // 1024 AS tx, y // 1024 AS ty, strip || '_' || (x // 1024 * 1024) || '_' || (y // 1024 * 1024) || '.png' AS tile, count(*) AS marks FROM det GROUP BY ALL")
def k06(spark, d):
    tx, ty = F.floor(F.col("x") / 1024), F.floor(F.col("y") / 1024)
    g = detections(spark, d).groupBy("strip", tx.alias("tx"), ty.alias("ty")).agg(F.count("*").alias("marks"))
    return g.withColumn("tile", F.concat("strip", F.lit("_"), F.col("tx") * 1024, F.lit("_"), F.col("ty") * 1024, F.lit(".png")))


@query("k08_cascade_delete", f"WITH {DET_SQL} SELECT strip, count(*) AS left_ FROM det WHERE strip NOT IN (SELECT strip FROM det GROUP BY strip HAVING max(ts) < TIMESTAMP '2024-01-20') GROUP BY strip")
def k08(spark, d):
    """Strips and their detections in two stores; strips that ended early are deleted with what was found in them."""
    det = detections(spark, d).select("id", "strip", F.col("ts").cast("timestamp").alias("ts"))
    ended = det.groupBy("strip").agg(F.max("ts").alias("ended"))
    at = f"{staging.shared_folder(spark)}/stores-{uuid.uuid4().hex}"
    strips, found = store.Store(spark, f"{at}/strips", ["strip"], ended.schema), store.Store(spark, f"{at}/detections", ["id"], det.schema)
    strips.insert(ended)
    found.insert(det)
    store.cascade(strips, found, ended.filter(F.col("ended") < F.lit("2024-01-20").cast("timestamp")), {"strip": "strip"})
    return found.read().groupBy("strip").agg(F.count("*").alias("left_"))


@query("d25_keyword_plan", "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '(list|which|que) ') THEN 'list_surveys' WHEN contains(lower(text), 'near') OR contains(lower(text), 'der ') THEN 'find_detections' WHEN length(text) < 80 THEN 'survey_summary' ELSE 'none' END AS tool FROM conversations WHERE role = 'user'")
def d25(spark, d):
    t = F.lower("text")
    tool = F.when(t.rlike("(list|which|que) "), "list_surveys").when(F.contains(t, F.lit("near")) | F.contains(t, F.lit("der ")), "find_detections").when(F.length("text") < 80, "survey_summary").otherwise("none")
    return table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", tool.alias("tool"))

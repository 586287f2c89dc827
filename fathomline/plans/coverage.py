"""Coverage, replay, sonar-surface and calibration queries. Areas are counted in cells of a raster."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.functions import geo
from fathomline.functions.score import rounded
from fathomline.operators import windows
from fathomline.plans.registry import query
from fathomline.plans.retrieval import LAB_SQL, docs, predictions
from fathomline.plans.telemetry import R4, hav_sql
from fathomline.plans.views import DET_SQL, FIX_SQL, NAV_SQL, detections, fixes, nav_rows, table

R6 = "CAST(round(CAST({} AS DECIMAL(18,8)), 6) AS DOUBLE)"
#: A mark images the cells (of 64 pixels) two to either side of its own, and the nadir leaves out its own.
SWATH_SQL = f"{DET_SQL}, cells AS (SELECT strip % 8 AS survey, strip, x // 64 + dx AS i, y // 64 AS j, dx = 0 AS nadir, ts, id FROM det, (VALUES (-2), (-1), (0), (1), (2)) o(dx))"


def swath(spark, d):
    det = detections(spark, d)
    offsets = F.explode(F.array(*map(F.lit, (-2, -1, 0, 1, 2)))).alias("dx")
    rows = det.select((F.col("strip") % 8).alias("survey"), "strip", F.floor(F.col("x") / 64).alias("x0"), F.floor(F.col("y") / 64).alias("j"), "ts", "id", offsets)
    return rows.select("survey", "strip", (F.col("x0") + F.col("dx")).alias("i"), "j", (F.col("dx") == 0).alias("nadir"), "ts", "id")


@query("a17_d09_areas", f"WITH {SWATH_SQL}, c AS (SELECT survey, i, j, count(DISTINCT strip) AS strips, bool_and(nadir) AS hidden FROM cells GROUP BY 1, 2, 3) SELECT survey, count(*) * 4096 AS covered, count(CASE WHEN NOT hidden THEN 1 END) * 4096 AS imaged, count(CASE WHEN hidden THEN 1 END) * 4096 AS nadir_only, count(CASE WHEN strips > 1 THEN 1 END) * 4096 AS overlap, (max(i) - min(i) + 1) * (max(j) - min(j) + 1) * 4096 AS box FROM c GROUP BY survey")
def a17(spark, d):
    c = swath(spark, d).groupBy("survey", "i", "j").agg(F.countDistinct("strip").alias("strips"), F.bool_and("nadir").alias("hidden"))
    area = lambda x: (x * 4096).cast("long")
    side = lambda k: F.max(k) - F.min(k) + 1
    return c.groupBy("survey").agg(area(F.count("*")).alias("covered"), area(F.count_if(~F.col("hidden"))).alias("imaged"), area(F.count_if("hidden")).alias("nadir_only"), area(F.count_if(F.col("strips") > 1)).alias("overlap"), area(side("i") * side("j")).alias("box"))


DAY_SQL = "first_ AS (SELECT survey, i, j, epoch_us(min(ts)) // 86400000000 AS day FROM cells GROUP BY 1, 2, 3), new AS (SELECT survey, day, count(*) AS n FROM first_ GROUP BY 1, 2)"


def new_cells(spark, d):
    first = swath(spark, d).groupBy("survey", "i", "j").agg(F.floor(F.unix_micros(F.min(F.col("ts").cast("timestamp"))) / 86400000000).alias("day"))
    return first.groupBy("survey", "day").agg(F.count("*").alias("n"))


@query("w22_cumulative_area", f"WITH {SWATH_SQL}, {DAY_SQL} SELECT survey, day, n * 4096 AS added, CAST(sum(n) OVER (PARTITION BY survey ORDER BY day) AS BIGINT) * 4096 AS area FROM new")
def w22(spark, d):
    w = Window.partitionBy("survey").orderBy("day")
    return new_cells(spark, d).select("survey", "day", (F.col("n") * 4096).alias("added"), (F.sum("n").over(w) * 4096).alias("area"))


@query("st09_replay", f"WITH {FIX_SQL}, s AS (SELECT id, device, t_s, {hav_sql('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS step, row_number() OVER w AS n FROM fix WINDOW w AS (PARTITION BY device ORDER BY t_s, id)) SELECT device, n, t_s, t_s - first_value(t_s) OVER (PARTITION BY device ORDER BY n) AS elapsed, {R4.format('sum(coalesce(CAST(step AS DECIMAL(18,8)), 0)) OVER (PARTITION BY device ORDER BY n)')} AS travelled FROM s")
def st09(spark, d):
    w = Window.partitionBy("device").orderBy("t_s", "id")
    step = geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    s = fixes(spark, d).select("device", "t_s", F.row_number().over(w).alias("n"), F.coalesce(step.cast("decimal(18,8)"), F.lit(0)).alias("step"))
    by = Window.partitionBy("device").orderBy("n")
    return s.select("device", "n", "t_s", (F.col("t_s") - F.first("t_s").over(by)).alias("elapsed"), rounded(F.sum("step").over(by), 4).alias("travelled"))


@query("d24_relook_lines", f"""WITH {SWATH_SQL}, r AS (SELECT DISTINCT survey, i, j FROM cells), l AS (SELECT survey, i, j, lead(j) OVER (PARTITION BY survey, i ORDER BY j) AS next_j FROM r) SELECT survey, i * 64 + 32 AS x, (j + 1) * 64 AS y_from, next_j * 64 AS y_to, CASE WHEN i % 2 = 0 THEN 0 ELSE 180 END AS heading FROM l WHERE next_j - j > 3""")
def d24(spark, d):
    r = swath(spark, d).select("survey", "i", "j").distinct()
    gap = r.withColumn("next_j", F.lead("j").over(Window.partitionBy("survey", "i").orderBy("j"))).filter("next_j - j > 3")
    return gap.select("survey", (F.col("i") * 64 + 32).alias("x"), ((F.col("j") + 1) * 64).alias("y_from"), (F.col("next_j") * 64).alias("y_to"), F.when(F.col("i") % 2 == 0, 0).otherwise(180).alias("heading"))


EGN = "n AS (SELECT strip, r, CAST(floor(altitude / 25) AS INTEGER) AS band, r % 16 AS bin, depth FROM nav WHERE altitude IS NOT NULL), m AS (SELECT band, bin, avg(CAST(depth AS DECIMAL(18,6))) AS mean, coalesce(stddev_pop(depth), 0) AS sd FROM n GROUP BY 1, 2)"


@query("a33_gain_surface", f"WITH {NAV_SQL}, {EGN} SELECT band, bin, count(*) AS kept, {R4.format('avg(CAST(depth AS DECIMAL(18,6)))')} AS gain FROM n JOIN m USING (band, bin) WHERE abs(depth - mean) <= 1.5 * sd + 0.001 GROUP BY 1, 2")
def a33(spark, d):
    n = nav_rows(spark, d).filter("altitude IS NOT NULL").select(F.floor(F.col("altitude") / 25).cast("int").alias("band"), (F.col("r") % 16).alias("bin"), "depth")
    m = n.groupBy("band", "bin").agg(F.avg("depth").alias("mean"), F.stddev_pop("depth").alias("sd"))
    return n.join(m, ["band", "bin"]).filter("abs(depth - mean) <= 1.5 * sd + 0.001").groupBy("band", "bin").agg(F.count("*").alias("kept"), rounded(F.avg("depth"), 4).alias("gain"))


@query("d13_stretched", f"WITH {NAV_SQL}, q AS (SELECT strip, quantile_cont(depth, 0.02) AS low, quantile_cont(depth, 0.98) AS high FROM nav GROUP BY strip) SELECT strip, r, {R4.format('CASE WHEN high > low THEN least(greatest((depth - low) / (high - low), 0), 1) ELSE 0 END')} AS level FROM nav JOIN q USING (strip)")
def d13(spark, d):
    nav = nav_rows(spark, d).select("strip", "r", "depth")
    q = nav.groupBy("strip").agg(F.percentile("depth", 0.02).alias("low"), F.percentile("depth", 0.98).alias("high"))
    level = F.when(F.col("high") > F.col("low"), F.least(F.greatest((F.col("depth") - F.col("low")) / (F.col("high") - F.col("low")), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return nav.join(q, "strip").select("strip", "r", rounded(level, 4).alias("level"))


@query("d14_altitude_source", f"""WITH {NAV_SQL}, b AS (SELECT strip, r, altitude, CASE WHEN r % 6 > 0 THEN depth END AS tracked, last_value(altitude IGNORE NULLS) OVER (PARTITION BY strip ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM nav)
  SELECT strip, r, coalesce(altitude, tracked, held) AS altitude, CASE WHEN altitude IS NOT NULL THEN 'sensor' WHEN tracked IS NOT NULL THEN 'bottom track' WHEN held IS NOT NULL THEN 'held' ELSE 'none' END AS source FROM b""")
def d14(spark, d):
    w = Window.partitionBy("strip").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    b = nav_rows(spark, d).select("strip", "r", F.col("altitude").alias("a"), F.when(F.col("r") % 6 > 0, F.col("depth")).alias("t"), F.last("altitude", ignorenulls=True).over(w).alias("h"))
    source = F.when(F.col("a").isNotNull(), "sensor").when(F.col("t").isNotNull(), "bottom track").when(F.col("h").isNotNull(), "held").otherwise("none")
    return b.select("strip", "r", F.coalesce("a", "t", "h").alias("altitude"), source.alias("source"))


@query("f11_equidistant", f"""WITH {FIX_SQL}, c AS (SELECT id, lat, lon, sin(radians(10.5)) * sin(radians(lat)) + cos(radians(10.5)) * cos(radians(lat)) * cos(radians(lon - 79.5)) AS cosc FROM fix), k AS (SELECT *, CASE WHEN cosc > 1 - 1e-14 THEN 1 ELSE acos(cosc) / sin(acos(cosc)) END AS k FROM c)
  SELECT id, CAST(round(CAST(6371008.8 * k * cos(radians(lat)) * sin(radians(lon - 79.5)) AS DECIMAL(18,8)), 1) AS DOUBLE) AS east, CAST(round(CAST(6371008.8 * k * (cos(radians(10.5)) * sin(radians(lat)) - sin(radians(10.5)) * cos(radians(lat)) * cos(radians(lon - 79.5))) AS DECIMAL(18,8)), 1) AS DOUBLE) AS north FROM k""")
def f11(spark, d):
    east, north = geo.equidistant(F.lit(10.5), F.lit(79.5), F.col("lat"), F.col("lon"))
    return fixes(spark, d).select("id", rounded(east, 1).alias("east"), rounded(north, 1).alias("north"))


@query("a35_segments", f"WITH {FIX_SQL}, b AS (SELECT DISTINCT device, t_s // 21600 AS b FROM fix), s AS (SELECT device, b, lead(b, 3) OVER (PARTITION BY device ORDER BY b) AS e FROM b) SELECT device, count(*) AS steps, count(CASE WHEN e = b + 3 THEN 1 END) AS segments FROM s GROUP BY device")
def a35(spark, d):
    b = fixes(spark, d).select("device", F.floor(F.col("t_s") / 21600).alias("b")).distinct()
    s = b.withColumn("e", F.lead("b", 3).over(Window.partitionBy("device").orderBy("b")))
    return s.groupBy("device").agg(F.count("*").alias("steps"), F.count_if(F.col("e") == F.col("b") + 3).alias("segments"))


GRID = [round(0.25 * 16 ** (k / 40), 4) for k in range(41)]


@query("d12_temperature_fit", f"WITH {LAB_SQL}, z AS (SELECT y, ln(greatest(least(p, 0.9999), 0.0001) / (1 - greatest(least(p, 0.9999), 0.0001))) AS z FROM p), t(t) AS (SELECT CAST(unnest({GRID}) AS DOUBLE)), l AS (SELECT t, {R6.format('avg(greatest(z / t, 0) - z / t * y + ln(1 + exp(-abs(z / t))))')} AS loss FROM z, t GROUP BY t) SELECT min_by(t, row(loss, t)) AS temperature, min(loss) AS loss FROM l")
def d12(spark, d):
    from fathomline.functions.score import log_loss, logit

    # labels are folded to one row a logit first; the temperatures then multiply those rows only
    z = predictions(spark, d).groupBy(logit(F.col("p")).alias("z"), "y").agg(F.count("*").alias("n"))
    rows = z.withColumn("t", F.explode(F.array(*map(F.lit, GRID))))
    loss = F.sum(log_loss(F.col("z") / F.col("t"), F.col("y")) * F.col("n")) / F.sum("n")
    return rows.groupBy("t").agg(rounded(loss, 6).alias("loss")).agg(F.min_by("t", F.struct("loss", "t")).alias("temperature"), F.min("loss").alias("loss"))


@query("st07_link_progress", f"""WITH {FIX_SQL}, link AS (SELECT device, id AS link_id, t_s AS start, coalesce(lead(t_s) OVER (PARTITION BY device ORDER BY t_s, id), 9999999999) AS end_, lat AS lat0, lon AS lon0 FROM fix WHERE event = 'signup')
  SELECT f.id AS id, link_id, f.t_s - start AS elapsed, {R4.format(hav_sql('(lat0 + (f.t_s - start) * 1e-7)', 'lon0', 'f.lat', 'f.lon'))} AS apart FROM fix f JOIN link l ON f.device = l.device AND f.t_s >= start AND f.t_s < end_""")
def st07(spark, d):
    from fathomline.operators import joins

    f = fixes(spark, d)
    links = f.filter("event = 'signup'").select("device", "t_s", "id", "lat", "lon")
    # of links that start in one second the last one is open; the earlier ones hold no time
    links = links.groupBy("device", "t_s").agg(F.max(F.struct(F.col("id").alias("link_id"), F.col("t_s").alias("start"), F.col("lat").alias("lat0"), F.col("lon").alias("lon0"))).alias("link"))
    rows = joins.asof(f.select("id", "device", "t_s", "lat", "lon"), links, ["device"], "t_s", ["link"]).filter("link IS NOT NULL").select("id", "t_s", "lat", "lon", "link.*")
    elapsed = F.col("t_s") - F.col("start")
    return rows.select("id", "link_id", elapsed.alias("elapsed"), rounded(geo.haversine(F.col("lat0") + elapsed * 1e-7, F.col("lon0"), F.col("lat"), F.col("lon")), 4).alias("apart"))


def packed_passages(text: str | None, target: int = 900, overlap: int = 150) -> list[str]:
    """Paragraphs packed up to ``target`` characters; a new passage begins with the last ``overlap`` characters of the one before."""
    out: list[str] = []
    held = ""
    for paragraph in (text or "").split("\n"):
        if not paragraph.strip():
            continue
        if held and len(held) + 1 + len(paragraph) > target:
            out.append(held)
            held = held[-overlap:] + "\n" + paragraph
        else:
            held = held + "\n" + paragraph if held else paragraph
    return [*out, held] if held else out


@query("f35_passages", """WITH RECURSIVE p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, s FROM (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE regexp_matches(s, '[^\\s]')),
  w AS (SELECT doc_id, i, s AS held, CAST(1 AS BIGINT) AS n FROM p WHERE i = 1 UNION ALL SELECT w.doc_id, p.i, CASE WHEN length(held) + 1 + length(s) > 900 THEN right(held, 150) || chr(10) || s ELSE held || chr(10) || s END, CASE WHEN length(held) + 1 + length(s) > 900 THEN n + 1 ELSE n END FROM w JOIN p ON p.doc_id = w.doc_id AND p.i = w.i + 1)
  SELECT doc_id, n - 1 AS place, max_by(held, i) AS passage FROM w GROUP BY doc_id, n""")
def f35(spark, d):
    @F.pandas_udf("array<string>")
    def passages(texts: pd.Series) -> pd.Series:
        return texts.map(packed_passages)

    return docs(spark, d).select("doc_id", F.posexplode(passages("text")).alias("place", "passage")).select("doc_id", F.col("place").cast("long").alias("place"), "passage")


@query("k11_stored_index")
def k11(spark, d):
    """Passages, weights and term statistics as tables, as :func:`search.save` writes them; here the size of each."""
    from fathomline.operators import search, staging

    # texts are cut once, for the index and for each count
    passages = staging.written(f35(spark, d).select(F.concat_ws("#", "doc_id", "place").alias("passage_id"), "passage"), "passages")
    terms, idf = search.index(passages, "passage_id", "passage")
    sizes = [x.agg(F.count("*").alias("n")).withColumn("of", F.lit(name)) for name, x in (("passages", passages), ("weights", terms), ("terms", idf))]
    return sizes[0].unionByName(sizes[1]).unionByName(sizes[2])

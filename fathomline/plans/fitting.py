"""Queries that fit curves: calibration of scores, by folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.score import rounded
from fathomline.operators import calibration
from fathomline.plans.registry import query
from fathomline.plans.views import table

DATA_SQL = "x AS (SELECT event_type AS class, event_id % 5 AS fold, CASE WHEN (event_id * 7919) % 1000 < value * 3 THEN 1 ELSE 0 END AS y, least(greatest(least(value / 200.0, 1.0), 0.0001), 0.9999) AS p FROM events), d AS (SELECT class, fold, y, ln(p / (1 - p)) AS z FROM x)"


def newton(name: str, sets: str, platt: bool, rounds: int = 9) -> str:
    """Newton's method without damping, written out, for each class and set of ``sets``."""
    out = [f"{name}0 AS (SELECT class, h, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b FROM (SELECT DISTINCT class FROM d), {sets} s(h))"]
    for k in range(rounds):
        sums = f"""SELECT class, h, a, b, sum((p - y) * z) AS ga, sum(p - y) AS gb, sum(p * (1 - p) * z * z) AS aa, sum(p * (1 - p) * z) AS ab, sum(p * (1 - p)) AS bb
          FROM (SELECT i.*, d.y, d.z, 1 / (1 + exp(-(a * z + b))) AS p FROM {name}{k} i JOIN d ON d.class = i.class AND d.fold <> h) GROUP BY ALL"""
        step = "a - (ga * bb - gb * ab) / (aa * bb - ab * ab) AS a, b - (gb * aa - ga * ab) / (aa * bb - ab * ab) AS b" if platt else "a - ga / aa AS a, b"
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT class, h, {step} FROM ({sums}))")
    return ", ".join(out)


R3 = "CAST(round(CAST({} AS DECIMAL(18,8)), 3) AS DOUBLE)"
FITS_SQL = f"WITH {DATA_SQL}, {newton('t', 'range(-1, 5)', False)}, {newton('q', 'range(-1, 5)', True)}"
LOSS_SQL = "avg(greatest({0}, 0) - ({0}) * y + ln(1 + exp(-abs({0}))))"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("class"), (k % 5).cast("int").alias("fold"), ((k * 7919) % 1000 < F.col("value") * 3).cast("int").alias("y"), F.least(F.col("value") / 200.0, F.lit(1.0)).alias("p"))


@query("d12_fits", f"{FITS_SQL} SELECT class, 'temperature' AS method, CAST(h AS INTEGER) AS held_out, {R3.format('a')} AS a, {R3.format('b')} AS b FROM t9 UNION ALL SELECT class, 'platt', CAST(h AS INTEGER), {R3.format('a')}, {R3.format('b')} FROM q9")
def d12_fits(spark, d):
    found = calibration.fits(scored(spark, d), ["class"], "p", "y", "fold")
    return found.select("class", "method", "held_out", rounded(F.col("a"), 3).alias("a"), rounded(F.col("b"), 3).alias("b"))


@query("d12_chosen_method", f"""{FITS_SQL}, cv AS (SELECT d.class, count(*) AS n, sum(y)::BIGINT AS positives, {LOSS_SQL.format('z')} AS ci, {LOSS_SQL.format('t9.a * z')} AS ct, {LOSS_SQL.format('q9.a * z + q9.b')} AS cp
    FROM d JOIN t9 ON t9.class = d.class AND t9.h = d.fold JOIN q9 ON q9.class = d.class AND q9.h = d.fold GROUP BY 1)
  SELECT class, CASE WHEN cp < ct - 0.002 THEN 'platt' ELSE 'temperature' END AS method, n, positives, {R3.format('ci')} AS cv_identity, {R3.format('ct')} AS cv_temperature, {R3.format('cp')} AS cv_platt FROM cv""")
def d12_chosen(spark, d):
    found = calibration.chosen(scored(spark, d), ["class"], "p", "y", "fold")
    return found.select("class", "method", "n", "positives", *(rounded(F.col(c), 3).alias(c) for c in ("cv_identity", "cv_temperature", "cv_platt")))

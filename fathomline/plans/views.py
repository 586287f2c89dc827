"""The library's inputs as views of the driver's tables, in DataFrame form and in SQL for the oracles. Integer arithmetic only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Own policy: weight of each class, confidence floor, least tier, action.
POLICY = (("error", 1.0, 0.30, "high", "inspect now"), ("purchase", 0.8, 0.10, "low", "survey again"), ("signup", 0.6, 0.05, "low", "note"), ("click", 0.4, 0.02, "low", "note"))
DEFAULT_WEIGHT, DEFAULT_FLOOR = 0.25, 0.0
FLOORS = {"critical": 0.6, "high": 0.35, "medium": 0.12}
TIERS = ("critical", "high", "medium", "low")
CELL = 512

POLICY_SQL = "policy(class, weight, floor_, least_tier, action) AS (VALUES " + ", ".join(f"('{c}', CAST({w} AS DOUBLE), CAST({f} AS DOUBLE), '{t}', '{a}')" for c, w, f, t, a in POLICY) + ")"
DET_SQL = """det AS (SELECT event_id AS id, user_id AS strip, event_type AS class, least(value / 200.0, 1.0) AS confidence,
    CAST((event_id * 7919) % 4096 AS INTEGER) AS x, CAST((event_id * 104729) % 4096 AS INTEGER) AS y, event_id % 11 = 0 AS suppressed, ts FROM events)"""
SCORED_SQL = f"""{DET_SQL}, {POLICY_SQL},
  scored AS (SELECT d.*, coalesce(p.weight, {DEFAULT_WEIGHT}) AS weight,
    CASE WHEN d.confidence < coalesce(p.floor_, {DEFAULT_FLOOR}) THEN 'unknown' ELSE d.class END AS shown_class,
    CASE WHEN d.confidence < coalesce(p.floor_, {DEFAULT_FLOOR}) THEN d.class END AS class_withheld,
    CAST(round(CAST(coalesce(p.weight, {DEFAULT_WEIGHT}) * d.confidence AS DECIMAL(18,8)), 4) AS DOUBLE) AS severity,
    coalesce(p.least_tier, 'low') AS least_tier, p.action FROM det d LEFT JOIN policy p ON d.class = p.class),
  tiered AS (SELECT *, CASE WHEN severity >= 0.6 THEN 0 WHEN severity >= 0.35 OR least_tier = 'high' THEN 1 WHEN severity >= 0.12 THEN 2 ELSE 3 END AS tier_rank FROM scored)"""
FIX_SQL = """fix AS (SELECT event_id AS id, user_id AS device, epoch_us(ts) // 1000000 AS t_s, 10 + (event_id * 31 % 1000) / 1000.0 AS lat, 79 + (event_id * 37 % 1000) / 1000.0 AS lon, event_type AS event, value FROM events)"""
NAV_SQL = """nav AS (SELECT user_id AS strip, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r, epoch_us(ts) // 1000000 AS t_s,
    CASE WHEN event_id % 7 IN (3, 4) THEN NULL ELSE value END AS altitude, event_id % 360 AS heading, event_type AS quality, value AS depth FROM events)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: str):
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 1000000).cast("long")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("strip"), F.col("event_type").alias("class"), F.least(F.col("value") / 200.0, F.lit(1.0)).alias("confidence"),
        F.pmod(F.col("event_id") * 7919, F.lit(4096)).cast("int").alias("x"), F.pmod(F.col("event_id") * 104729, F.lit(4096)).cast("int").alias("y"),
        (F.pmod(F.col("event_id"), F.lit(11)) == 0).alias("suppressed"), "ts",
    )


def policy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLICY, "class string, weight double, floor_ double, least_tier string, action string")


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("device"), epoch("ts").alias("t_s"), (10 + F.pmod(F.col("event_id") * 31, F.lit(1000)) / 1000.0).alias("lat"),
        (79 + F.pmod(F.col("event_id") * 37, F.lit(1000)) / 1000.0).alias("lon"), F.col("event_type").alias("event"), "value",
    )


def nav_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("strip"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("r"), epoch("ts").alias("t_s"),
        F.when(~F.pmod(F.col("event_id"), F.lit(7)).isin(3, 4), F.col("value")).alias("altitude"), F.pmod(F.col("event_id"), F.lit(360)).alias("heading"), F.col("event_type").alias("quality"), F.col("value").alias("depth"),
    )

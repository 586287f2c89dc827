"""From detections to scored, tiered contacts, hotspots and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.score import rounded, tier_rank
from fathomline.operators import windows


def scored(detections: DataFrame, policy: DataFrame, floors: dict[str, float], tiers: tuple[str, ...], weight: float, floor: float) -> DataFrame:
    """Adds weight, shown_class (unknown below the class's confidence floor), class_withheld, severity, tier_rank and action.

    ``policy`` (class, weight, floor_, least_tier, action) is a table of settings, one row a class; classes without a row take the defaults.
    """
    p = F.broadcast(policy.withColumnRenamed("class", "_class"))
    rows = detections.join(p, F.col("class") == F.col("_class"), "left").drop("_class")
    below = F.col("confidence") < F.coalesce("floor_", F.lit(floor))
    rows = rows.withColumns({
        "weight": F.coalesce("weight", F.lit(weight)),
        "shown_class": F.when(below, F.lit("unknown")).otherwise(F.col("class")),
        "class_withheld": F.when(below, F.col("class")),
        "severity": rounded(F.coalesce("weight", F.lit(weight)) * F.col("confidence"), 4),
        "least_tier": F.coalesce("least_tier", F.lit(tiers[-1])),
    })
    by_score = F.lit(len(tiers) - 1)
    for name in sorted(floors, key=floors.get):
        by_score = F.when(F.col("severity") >= floors[name], tiers.index(name)).otherwise(by_score)
    return rows.withColumn("tier_rank", F.least(by_score, tier_rank(F.col("least_tier"), tiers)).cast("int")).drop("floor_")


def hotspots(rows: DataFrame, cell: int, spread: float = 0.5) -> DataFrame:
    """One ranked row for each cell of a strip: counts, severities, dominant class, top contact, risk.

    Totals are rounded before the risk is taken from them. The dominant class has the largest sum of severity, then number, then name; the top contact the largest
    severity, then confidence, then id. Two partial aggregations by cell, the first also by class; no row of the input is shuffled unaggregated.
    """
    at = {"cell_x": F.floor(F.col("x") / cell).cast("int"), "cell_y": F.floor(F.col("y") / cell).cast("int")}
    keys = ["strip", "cell_x", "cell_y"]
    exact = F.col("severity").cast("decimal(18,8)")
    classes = rows.withColumns(at).groupBy(*keys, "class").agg(
        F.count("*").alias("n"), F.sum(exact).alias("total"), F.max("severity").alias("most"), F.min("tier_rank").alias("tier_rank"), F.sum(F.col("confidence").cast("decimal(18,8)")).alias("conf"),
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.max(F.struct("severity", "confidence", "id")).alias("top"),
    )
    cells = classes.groupBy(*keys).agg(
        F.sum("n").alias("detection_count"), rounded(F.sum("total"), 4).alias("total_severity"), rounded(F.max("most"), 4).alias("max_severity"), F.min("tier_rank").alias("tier_rank"),
        F.max_by("class", F.struct("total", "n", "class")).alias("dominant_class"), F.count("class").alias("hazard_diversity"), rounded(F.sum("conf") / F.sum("n"), 4).alias("confidence_mean"),
        F.max("x1").alias("_x1"), F.min("x0").alias("_x0"), F.max("y1").alias("_y1"), F.min("y0").alias("_y0"), F.max("top")["id"].alias("top_id"),
    )
    cells = cells.withColumns({
        "risk_score": rounded(F.col("max_severity") + spread * (F.col("total_severity") - F.col("max_severity")), 4),
        "density": rounded(F.col("detection_count") * 1e6 / (cell * cell), 4),
        "width_px": F.col("_x1") - F.col("_x0"), "height_px": F.col("_y1") - F.col("_y0"),
    })
    order = [F.desc("risk_score"), F.desc("max_severity"), F.desc("detection_count"), *map(F.col, keys)]
    cells = windows.numbered(cells.drop("_x0", "_x1", "_y0", "_y1"), order).drop("before").withColumnRenamed("place", "priority_rank")
    return cells.withColumn("hotspot_id", F.format_string("H%03d", "priority_rank"))


def dense_counts(rows: DataFrame, column: str, values: tuple, name: str = "n") -> DataFrame:
    """column, n for every value, 0 where none has it."""
    every = rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} {rows.schema[column].dataType.simpleString()}")
    return every.join(rows.groupBy(column).agg(F.count("*").alias(name)), column, "left").fillna(0, [name])


def complete_mean(x: Column) -> Column:
    """Mean, or null if any value is missing."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.avg(x))

"""Segments of equally spaced observations, chosen greedily with a least distance between their starts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.operators.staging import deleted, written


def starts(rows: DataFrame, by: list[str], order: str, n: int, step: int, usable: Column) -> DataFrame:
    """by, order: observations with which ``n`` usable ones, exactly ``step`` apart, begin."""
    w = Window.partitionBy(*by).orderBy(order)
    ahead = w.rowsBetween(0, n - 1)
    rows = rows.withColumn("_ok", usable.cast("int")).withColumn("_gap", F.lead(order).over(w) - F.col(order))
    steps = w.rowsBetween(0, n - 2)
    rows = rows.select(*by, order, F.count("*").over(ahead).alias("_n"), F.min("_ok").over(ahead).alias("_all"), F.min("_gap").over(steps).alias("_low"), F.max("_gap").over(steps).alias("_high"))
    return rows.filter((F.col("_n") == n) & (F.col("_all") == 1) & ((F.lit(n) == 1) | ((F.col("_low") == step) & (F.col("_high") == step)))).select(*by, order)


def spaced(points: DataFrame, by: list[str], order: str, least: int) -> DataFrame:
    """The points that a greedy walk takes: the first of each key, then always the next one at least ``least`` after the last taken.

    Each point's successor comes from an as-of window; which points the walk from the first one meets follows by doubling: in round k the marked points mark those 2^k successors on. After
    as many rounds as the longest walk has binary digits none is left, and no task folds over a key's history. Points of a key must differ in ``order``.
    """
    asked = points.select(*by, (F.col(order) + least).alias("_at"), F.lit(0).alias("_kind"), F.col(order).alias("_from"), F.lit(None).cast(points.schema[order].dataType).alias("_to"))
    given = points.select(*by, F.col(order).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(points.schema[order].dataType).alias("_from"), F.col(order).alias("_to"))
    w = Window.partitionBy(*by).orderBy("_at", "_kind").rowsBetween(0, Window.unboundedFollowing)
    jump = asked.unionByName(given).withColumn("next", F.first("_to", ignorenulls=True).over(w)).filter("_kind = 0").select(*by, F.col("_from").alias(order), "next")
    first = F.row_number().over(Window.partitionBy(*by).orderBy(order)) == 1
    now = written(jump.withColumn("taken", first), "walk")
    while now.filter("next IS NOT NULL").limit(1).count():
        marked = now.filter("taken AND next IS NOT NULL").select(*by, F.col("next").alias(order), F.lit(True).alias("_hit")).distinct()
        after = now.filter("next IS NOT NULL").select(*by, F.col(order).alias("next"), F.col("next").alias("_after"))
        stepped = now.join(marked, [*by, order], "left").join(after, [*by, "next"], "left")
        previous, now = now, written(stepped.select(*by, order, F.col("_after").alias("next"), (F.col("taken") | F.coalesce("_hit", F.lit(False))).alias("taken")), "walk")
        deleted(previous)
    return now.filter("taken").select(*by, order)


def spread(points: DataFrame, by: list[str], order: str, most: int) -> DataFrame:
    """At most ``most`` points of each key, evenly spread over its record with its first and last ones (halves are rounded to even); with ``depth``, their number from 0."""
    w = Window.partitionBy(*by)
    rows = points.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_m", F.count("*").over(w))
    picks = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda j: F.bround(j * (F.col("_m") - 1) / F.lit(float(max(most - 1, 1))), 0).cast("long"))
    rows = rows.filter((F.col("_m") <= most) | F.array_contains(picks, F.col("_i").cast("long")))
    return rows.drop("_i", "_m").withColumn("depth", F.row_number().over(w.orderBy(order)) - 1)


def round_robin(points: DataFrame, by: list[str], order: str, most: int) -> DataFrame:
    """The first ``most`` points when the keys take turns: all firsts in the order of the keys, then all seconds, and so on."""
    return points.orderBy("depth", *by, order).limit(most)


def segments(rows: DataFrame, by: list[str], order: str, n: int, step: int, least: int, per_key: int, most: int, usable: Column | None = None) -> DataFrame:
    """by, order (of the first observation), depth: segments of ``n`` observations ``step`` apart, starts ``least`` apart, ``per_key`` of a key and ``most`` in all."""
    found = spaced(starts(rows, by, order, n, step, F.lit(True) if usable is None else usable), by, order, least)
    return round_robin(spread(found, by, order, per_key), by, order, most)

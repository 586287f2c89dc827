"""Operators over ordered rows, as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sessions(rows: DataFrame, by: list[str], order: list[str], breaks: Column, name: str = "session") -> DataFrame:
    """Numbers runs of rows from 1; a row for which ``breaks`` holds starts a new one."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(name, 1 + F.sum(F.when(F.coalesce(breaks, F.lit(False)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def islands(rows: DataFrame, by: list[str], order: str, flag: Column) -> DataFrame:
    """by, flag, start, end, n: runs of consecutive rows with an equal flag."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = rows.withColumn("flag", flag).withColumn("_i", F.row_number().over(w))
    rows = rows.withColumn("_k", F.col("_i") - F.row_number().over(Window.partitionBy(*by, "flag").orderBy(order)))
    return rows.groupBy(*by, "flag", "_k").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n")).drop("_k")


def filled(rows: DataFrame, by: list[str], order: str, value: str, out: str, limit: int | None = None, ends: bool = False) -> DataFrame:
    """Linear filling of gaps between known values, of at most ``limit`` rows; with ``ends`` the outer gaps take the nearest value."""
    w = Window.partitionBy(*by).orderBy(order)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(value).alias("v")))
    rows = rows.withColumn("_i", F.row_number().over(w))
    rows = rows.withColumn("_a", F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    a, b, i = F.col("_a"), F.col("_b"), F.col("_i")
    line = a["v"] + (b["v"] - a["v"]) * (i - a["i"]) / (b["i"] - a["i"])
    line = line if limit is None else F.when(b["i"] - a["i"] - 1 <= limit, line)
    inner = F.when(a.isNotNull() & b.isNotNull(), line)
    outer = F.when(a.isNull() | b.isNull(), F.coalesce(a["v"], b["v"])) if ends else F.lit(None)
    return rows.withColumn(out, F.coalesce(F.col(value), inner, outer)).drop("_i", "_a", "_b")


def smoothed(rows: DataFrame, by: list[str], order: str, value: str, out: str, half: int) -> DataFrame:
    """Centred mean of the known values; towards the ends the window shrinks on both sides alike."""
    whole = Window.partitionBy(*by)
    w = whole.orderBy(order)
    rows = rows.withColumn("_i", F.row_number().over(w)).withColumn("_h", F.least(F.lit(half), F.col("_i") - 1, F.count("*").over(whole) - F.col("_i")))
    near = F.collect_list(F.struct(F.col("_i").alias("i"), F.col(value).alias("v"))).over(w.rowsBetween(-half, half))
    kept = F.filter(near, lambda s: (F.abs(s["i"] - F.col("_i")) <= F.col("_h")) & s["v"].isNotNull())
    mean = F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda acc, s: acc + s["v"]) / F.size(kept))
    return rows.withColumn(out, mean).drop("_i", "_h")


def capped_top(rows: DataFrame, query: list[str], group: str, order: list[Column], cap: int, k: int) -> DataFrame:
    """The first ``k`` rows of each query; those beyond ``cap`` of one group come only after all others (rank_in_group, rank)."""
    w = Window.partitionBy(*query, group).orderBy(*order)
    rows = rows.withColumn("rank_in_group", F.row_number().over(w))
    over = (F.col("rank_in_group") > cap).cast("int")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*query).orderBy(over, *order))).filter(F.col("rank") <= k)


def thinned(rows: DataFrame, by: list[str], order: str, step: int) -> DataFrame:
    """Every ``step``-th row and the last one."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = rows.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    return rows.filter((F.col("_i") % step == 0) | (F.col("_i") == F.col("_n") - 1)).drop("_i", "_n")


def gated(rows: DataFrame, by: list[str], fields: list[str], order: str, distance, fastest: float, patience: int) -> DataFrame:
    """by, order, accepted: fixes whose speed from the last accepted one is possible; after ``patience`` refusals in a row the next fix is taken.

    A fold over each key's ordered fixes, as a fix's fate depends on those before. ``distance(a, b)`` is a column of two fix structs.
    """
    fixes = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("_f"))
    start = F.struct(F.lit(None).cast(fixes.schema["_f"].dataType.elementType).alias("last"), F.lit(0).alias("refused"), F.array().cast("array<boolean>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        ok = acc["last"].isNull() | (acc["refused"] >= patience) | (distance(acc["last"], x) <= fastest * (x[order] - acc["last"][order]))
        return F.struct(F.when(ok, x).otherwise(acc["last"]).alias("last"), F.when(ok, 0).otherwise(acc["refused"] + 1).alias("refused"), F.array_append(acc["out"], ok).alias("out"))

    fixes = fixes.withColumn("_o", F.aggregate("_f", start, step)["out"])
    return fixes.select(*by, F.explode(F.arrays_zip("_f", "_o")).alias("_z")).select(*by, F.col(f"_z._f.{order}").alias(order), F.col("_z._o").alias("accepted"))


def filled_along(rows: DataFrame, by: list[str], order: str, at: str, value: str, out: str) -> DataFrame:
    """Known values, and straight lines over ``at`` between them; before the first known value null, after the last one that value."""
    w = Window.partitionBy(*by).orderBy(order)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("x"), F.col(value).alias("v")))
    a, b = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("_a", a).withColumn("_b", b)
    a, b = F.col("_a"), F.col("_b")
    line = F.when(b.isNull() | (b["x"] == a["x"]), a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * (F.col(at) - a["x"]) / (b["x"] - a["x"]))
    return rows.withColumn(out, F.coalesce(F.col(value), line)).drop("_a", "_b")


def numbered(rows: DataFrame, order: str | list[Column], amount: Column | None = None) -> DataFrame:
    """``rows`` with ``place``, their number from 1 in the order of all rows, and ``before``, the sum of ``amount`` (1) over all earlier rows.

    The order must be total. Rows are dealt by ranges and sorted there; each range's total, one row a range, is all that meets in one place, so no
    task sees the whole table. The dealt rows are persisted, as both uses of them must see the same ranges; Spark may drop and rebuild them.
    """
    order = [F.col(order)] if isinstance(order, str) else list(order)
    dealt = rows.withColumn("_amount", F.lit(1) if amount is None else amount).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).persist()
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    dealt = dealt.withColumn("_n", F.row_number().over(inside)).withColumn("_s", F.sum("_amount").over(inside))
    totals = dealt.groupBy("_part").agg(F.count("*").alias("_rows"), F.sum("_amount").alias("_sum"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    totals = totals.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_r0"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_s0"))
    out = dealt.join(F.broadcast(totals), "_part")  # one row a range
    return out.withColumn("place", F.col("_r0") + F.col("_n")).withColumn("before", F.col("_s0") + F.col("_s") - F.col("_amount")).drop("_part", "_amount", "_n", "_s", "_r0", "_s0")

"""Fits of calibration curves: sigmoid(a * logit(score) + b), with b = 0 for a temperature 1 / a.

Spark only adds up losses, gradients and curvatures; the steps are column expressions on one row for each fit. All fits of all groups, methods and folds go on in the same pass over the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.score import log_loss, logit, sigmoid
from fathomline.operators.staging import deleted, written

#: A temperature lies between 1 / 20 and 20.
STEEPEST = 20.0
METHODS = ("temperature", "platt")
EVERY = -1


def fits(rows: DataFrame, by: list[str], score: str, label: str, fold: str | None = None, folds: int = 5, rounds: int = 30, tolerance: float = 1e-7) -> DataFrame:
    """by, method, held_out (the fold left out, -1: none), a, b, loss (mean over the rows fitted), n: the best curves by Newton's method with damping.

    A step that makes the loss larger is taken back and shortened. Groups of one label only have no best slope; theirs stops at the bound. ``fold`` names the rows' fold (0 to ``folds`` - 1); without it only
    whole groups are fitted. Rows with a null score or label take no part.
    """
    data = rows.filter(F.col(score).isNotNull()).select(*by, logit(F.col(score)).alias("z"), F.col(label).cast("double").alias("y"), (F.lit(None) if fold is None else F.col(fold)).cast("int").alias("fold")).filter("y IS NOT NULL")
    data = written(data, "calibration-rows")
    held = [EVERY, *range(folds if fold is not None else 0)]
    one = {"a": 1.0, "b": 0.0, "ta": 1.0, "tb": 0.0, "loss": float("inf"), "damp": 1.0, "ga": 0.0, "gb": 0.0, "haa": 0.0, "hab": 0.0, "hbb": 0.0, "n": 0.0, "step": float("inf")}
    sets = F.array(*(F.struct(F.lit(m).alias("method"), F.lit(h).alias("held_out")) for m in METHODS for h in held))
    now = written(data.select(*by).distinct().select(*by, F.inline(sets)).select("*", *(F.lit(v).alias(k) for k, v in one.items())), "calibration-fits")
    for _ in range(rounds):
        trials = now.groupBy(*by).agg(F.collect_list(F.struct("method", "held_out", "ta", "tb")).alias("sets"))  # as many as methods x folds
        z, y, p = F.col("z"), F.col("y"), sigmoid(F.col("ta") * F.col("z") + F.col("tb"))
        met = data.join(trials, by).select(*by, "z", "y", "fold", F.inline("sets")).filter("fold IS NULL OR fold != held_out")
        curve = p * (1 - p)
        met = met.groupBy(*by, "method", "held_out").agg(
            F.sum(log_loss(F.col("ta") * z + F.col("tb"), y)).alias("l"), F.sum((p - y) * z).alias("na"), F.sum(p - y).alias("nb"), F.sum(curve * z * z).alias("naa"), F.sum(curve * z).alias("nab"), F.sum(curve).alias("nbb"), F.count("*").cast("double").alias("m")
        )
        previous, now = now, written(stepped(now.join(met, [*by, "method", "held_out"], "left"), by), "calibration-fits")
        deleted(previous)
        if now.filter(F.col("step") > tolerance).limit(1).count() == 0:
            break
    # the frame reads its last table; the rows are read no more
    deleted(data)
    return now.select(*by, "method", "held_out", "a", "b", (F.col("loss") / F.col("n")).alias("loss"), F.col("n").cast("long").alias("n"))


def stepped(met: DataFrame, by: list[str]) -> DataFrame:
    """The fits after one look at their trial points; ``step`` is how far the next ones are, or 0 where the last step gained next to nothing."""
    better = F.col("m").isNotNull() & (F.col("l") <= F.col("loss"))
    take = lambda new, old: F.when(better, F.col(new)).otherwise(F.col(old))
    settled = F.abs(F.col("loss") - F.col("l")) < 1e-9 * F.col("m")
    rows = met.filter("m IS NOT NULL").select(
        settled.alias("settled"),
        *by, "method", "held_out", take("ta", "a").alias("a"), take("tb", "b").alias("b"), take("l", "loss").alias("loss"), take("na", "ga").alias("ga"), take("nb", "gb").alias("gb"), take("naa", "haa").alias("haa"),
        take("nab", "hab").alias("hab"), take("nbb", "hbb").alias("hbb"), take("m", "n").alias("n"), F.greatest(F.lit(1e-12), F.col("damp") * F.when(better, 0.1).otherwise(10.0)).alias("damp"),
    )
    # the rows' number counts beside the curvature, so that a flat place does not throw the next step to the bounds
    more = lambda c: F.col(c) + F.col("damp") * (F.col(c) + 0.1 * F.col("n")) + 1e-9
    haa, hbb, hab = more("haa"), more("hbb"), F.col("hab")
    det = F.greatest(haa * hbb - hab * hab, F.lit(1e-18))
    platt = F.col("method") == "platt"
    da = F.when(platt, (F.col("ga") * hbb - F.col("gb") * hab) / det).otherwise(F.col("ga") / haa)
    db = F.when(platt, (F.col("gb") * haa - F.col("ga") * hab) / det).otherwise(F.lit(0.0))
    low = F.when(platt, -STEEPEST).otherwise(1 / STEEPEST)
    rows = rows.withColumn("ta", F.least(F.greatest(F.col("a") - da, low), F.lit(STEEPEST))).withColumn("tb", F.least(F.greatest(F.col("b") - db, F.lit(-50.0)), F.lit(50.0)))
    return rows.withColumn("step", F.when(F.col("settled"), 0.0).otherwise(F.greatest(F.abs(F.col("ta") - F.col("a")), F.abs(F.col("tb") - F.col("b"))))).select(*by, "method", "held_out", "a", "b", "ta", "tb", "loss", "damp", "ga", "gb", "haa", "hab", "hbb", "n", "step")


def chosen(rows: DataFrame, by: list[str], score: str, label: str, fold: str, folds: int = 5, margin: float = 0.002) -> DataFrame:
    """by, method, temperature, a, b, n, positives, cv_identity, cv_temperature, cv_platt: the fits of whole groups, and the method by held-out loss.

    Each row's held-out loss is that under the fit that left its fold out; the two-parameter curve is chosen only where its mean is lower by ``margin``.
    """
    found = written(fits(rows, by, score, label, fold, folds), "calibration-found")
    out = found.filter(F.col("held_out") != EVERY).groupBy(*by, "held_out").agg(*(F.max(F.when(F.col("method") == m, F.col(c))).alias(f"{m}_{c}") for m in METHODS for c in ("a", "b")))
    z, y = F.col("z"), F.col("y")
    data = rows.filter(F.col(score).isNotNull()).select(*by, logit(F.col(score)).alias("z"), F.col(label).cast("double").alias("y"), F.col(fold).cast("int").alias("held_out")).filter("y IS NOT NULL")
    losses = data.join(out, [*by, "held_out"]).groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("y").cast("long").alias("positives"), F.avg(log_loss(z, y)).alias("cv_identity"), F.avg(log_loss(z * F.col("temperature_a"), y)).alias("cv_temperature"), F.avg(log_loss(z * F.col("platt_a") + F.col("platt_b"), y)).alias("cv_platt")
    )
    whole = found.filter(F.col("held_out") == EVERY).groupBy(*by).agg(F.max(F.when(F.col("method") == "temperature", 1 / F.col("a"))).alias("temperature"), *(F.max(F.when(F.col("method") == "platt", F.col(c))).alias(c) for c in ("a", "b")))
    method: Column = F.when(F.col("cv_platt") < F.col("cv_temperature") - margin, "platt").otherwise("temperature")
    return losses.join(whole, by).select(*by, method.alias("method"), "temperature", "a", "b", "n", "positives", "cv_identity", "cv_temperature", "cv_platt")

"""Mixing sources to target weights by balanced sampling with the cube method.

Every source has a target in words. The ratio of target to size says how often each of its documents is taken: the whole part surely,
the rest with the fractional inclusion probability, drawn so that each source's words and documents come out near their expectation.
The flight phase moves the probabilities of three documents at a time along the null space of the two balancing constraints until one
of them is 0 or 1. It runs inside blocks of documents, then over what the blocks left, and so on, until about a dozen documents a source
remain; the landing tries all roundings of these and takes the one nearest to the targets.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.llm.common import staged

EPS = 1e-9


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, 0 for null: the places where a word starts."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))), F.lit(0))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """source, source_size, target. Sources by code point, null last, take ``weights`` in turn and share the total size by weight.

    A target stops at ``most`` times its source's size and the excess goes to the others by weight, until none is above: sources in
    the order of size per weight are capped as long as the share of the rest is above their cap. The rows are one a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1))
    per = per.withColumns({"cap": most * F.col("source_size"), "total": F.sum("source_size").over(Window.partitionBy())})
    fill = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (F.col("total") - before) / rest).withColumn("place", F.row_number().over(fill))
    level = F.min(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.struct("place", "level"))).over(Window.partitionBy())["level"]
    return per.withColumn("target", F.least(F.col("cap").cast("double"), F.col("w") * F.coalesce(level, F.lit(0.0)))).select("source", "source_size", "target")


def flight(p: np.ndarray, size: np.ndarray, chance: np.ndarray, leave: int) -> np.ndarray:
    """Probabilities after the flight over one block, in the order given; about ``leave`` of them, two at least, stay inside (0, 1)."""
    p = p.copy()
    inside = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    p[(p <= EPS) | (p >= 1 - EPS)] = np.round(p[(p <= EPS) | (p >= 1 - EPS)])
    live: list[int] = []
    for i in inside[: max(0, len(inside) - leave)]:
        live.append(i)
        while len(live) == 3:
            a, b, c = (float(size[j]) for j in live)
            u = [c - b, a - c, b - a]  # orthogonal to (1, 1, 1) and to the sizes
            if not any(u):
                u = [1.0, -1.0, 0.0]
            up = min(((1 - p[j]) / x if x > 0 else -p[j] / x) for j, x in zip(live, u, strict=True) if x)
            down = min((p[j] / x if x > 0 else (p[j] - 1) / x) for j, x in zip(live, u, strict=True) if x)
            step = up if chance[i] * (up + down) < down else -down
            for j, x in zip(live, u, strict=True):
                p[j] += step * x
                if p[j] < EPS or p[j] > 1 - EPS:
                    p[j] = round(p[j])
            live = [j for j in live if 0 < p[j] < 1]
    return p


def landed(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The rounding of the last fractional documents, out of all, that keeps their words, then their number, nearest to the expectation."""
    p = p.copy()
    left = np.flatnonzero((p > 0) & (p < 1))
    if len(left):
        choices = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
        words = np.abs(choices @ size[left] - p[left] @ size[left]) / max(1.0, float(size[left].sum()))
        number = np.abs(choices.sum(1) - p[left].sum()) / len(left)
        p[left] = choices[np.argmin(words + 0.01 * number)]
    return p


def flown(rows: DataFrame, group: Column, last: bool, leave: int = 12) -> DataFrame:
    """One flight over each (source, group). ``last``: land what is left."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["draw", "doc_id", "row_key"], kind="stable", na_position="last")
        size = pdf["size"].to_numpy()
        p = flight(pdf["p"].to_numpy(), size, pdf["chance"].to_numpy(), leave)
        return pdf.assign(p=landed(p, size) if last else p)

    rows = rows.withColumn("grp", group)
    return rows.groupBy("source", "grp").applyInPandas(run, rows.schema).drop("grp")


def mixture(docs: DataFrame, block_rows: int = 2000, fan_in: int = 256, seed: int = 7, **targets) -> DataFrame:
    """doc_id, row_key, size, source, source_size, target, copies, taken: one row per document row.

    Size is the number of words, 0 for a null text. A document of a source without words is not taken. Repeated rows are documents of
    their own and may be taken differently, a null doc_id is allowed, null is a source of its own (the last), other columns only
    count towards ``row_key``, and an empty table gives an empty result. Draws come from hashes of the row, so reruns agree.
    """
    key = F.xxhash64(*(F.col(f"`{c}`") for c in sorted(docs.columns)))
    rows = staged(docs.select("doc_id", "source", key.alias("row_key"), word_count(F.col("text")).cast("long").alias("size")), "mix-sizes")
    largest = rows.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, math.ceil(largest / block_rows))
    per = source_targets(rows, **targets).withColumnRenamed("source", "of")
    # one row a source joins back; a hot source is salted by the block, which every row has
    rows = rows.withColumn("block", F.pmod(F.xxhash64("row_key", "doc_id", F.lit(seed)), F.lit(blocks)))
    rows = rows.join(per, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    unit = lambda salt: (F.pmod(F.xxhash64("row_key", "doc_id", F.lit(seed), F.lit(salt)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    rows = rows.withColumns({"base": F.floor(ratio), "p": ratio - F.floor(ratio), "draw": unit(1), "chance": unit(2)})
    done = None
    while True:
        last = blocks == 1
        moved = staged(flown(rows, F.col("block"), last), "mix-flight")
        if last:
            done = moved if done is None else done.unionByName(moved)
            break
        settled = moved.filter("p = 0 or p = 1")
        done = settled if done is None else done.unionByName(settled)
        blocks = math.ceil(blocks / fan_in)
        rows = moved.filter("p > 0 and p < 1").withColumn("block", F.floor(F.col("block") / fan_in))
    copies = (F.col("base") + F.col("p")).cast("long")
    return done.select("doc_id", "row_key", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents the mix takes, each as often as it is taken, with the columns of ``docs``.

    Equal rows are interchangeable: their copies are added up and one of them is repeated that often.
    """
    chosen = mixture(docs, **options).groupBy(F.col("doc_id").alias("of"), F.col("row_key").alias("key")).agg(F.sum("copies").cast("int").alias("copies"))
    row_key = F.xxhash64(*(F.col(f"`{c}`") for c in sorted(docs.columns)))
    repeats = docs.groupBy(F.col("doc_id").alias("re_of"), row_key.alias("re_key")).count().filter("count > 1")
    rows = docs.select(F.struct("*").alias("row"), row_key.alias("row_key"), F.col("doc_id").alias("row_of"))
    rows = rows.join(chosen.filter("copies > 0"), F.col("row_of").eqNullSafe(F.col("of")) & (F.col("row_key") == F.col("key")))
    if not repeats.isEmpty():
        rows = rows.dropDuplicates(["row_of", "row_key"])
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).select("row.*")

"""Bounded, repeatable samples of labelled documents for the trained operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, per_class: dict[int, int], seed: int = 11, most_chars: int = 200_000) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, text and label of at most ``per_class[y]`` documents of each class outside the held-out fold, and how many labels each class has.

    Which ones are taken follows from a hash of the id. Ids whose labels contradict each other, null ids and null labels take no part. Of rows that
    repeat an id the first text counts. Texts of more than ``most_chars`` characters are no examples, so the sample is bounded in rows and in bytes.
    """
    named = labels.select("doc_id", F.col(label).cast("int").alias("label")).dropna()
    named = named.filter(remainder(F.col("doc_id"), modulus) != held_out)
    named = named.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").drop("most")
    counts = {r["label"]: r["count"] for r in named.groupBy("label").count().collect()}
    taken = None
    for y, n in per_class.items():
        part = named.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n)
        taken = part if taken is None else taken.unionByName(part)
    # at most sum(per_class) rows
    taken = F.broadcast(taken.withColumnRenamed("doc_id", "of"))
    rows = docs.select("doc_id", "text").join(taken, F.col("doc_id") == F.col("of")).filter(F.coalesce(F.length("text"), F.lit(0)) <= most_chars)
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label"), counts

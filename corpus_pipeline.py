"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathomline.llm import cube, factorisation, jaccard, packing, secrets
from fathomline.llm.common import discard, staged, table


#: Pieces of text whose ids a worker caches in the packing: fewer than where it runs alone, as the executor also holds what the stages before grew to.
PIECES = 200_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores below a half go; it learns from the labels beside the documents.

    Null and empty texts are scored like others, rows without an id too; repeated rows share their fate. Other columns pass through, whatever their names. An
    empty table stays empty. Without labels all stay.
    """
    return factorisation.accepted(docs, factorisation.fitted(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity 0.8 on 5-word shingles join, the one with the smallest id stays.

    Rows without an id and texts without words (null and empty ones) stay; of rows that repeat id and text one stays. Other columns pass through. An
    empty table stays empty.
    """
    return jaccard.representatives(docs, words=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blotted out where they were found; every row stays, repeated ones, null and empty texts and null ids and sources too, and so do other columns."""
    return secrets.redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated so that the sources meet their target weights.

    A null source is one of its own, texts without words have size 0, repeated rows are documents of their own. Other columns pass through. An empty table stays empty.
    """
    return cube.mixed_documents(docs)


def packs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens, each window with the sources' shares.

    A null text is its end id alone, a null source a queue of its own, repeated rows are documents of their own, other columns are ignored, an empty table has no pieces.
    """
    return packing.packed(docs, pieces=PIECES)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("secret scans", secret_scan), ("mixing sources", mixing), ("packing", packs)]

#: No stage but the mixing targets can be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn; each result is written to the shared folder and read back as the next one's documents."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

"""Packed exchanges for operators that compare hashes of all documents.

Documents are dealt into blocks by a hash of their id. A block's hashes are made unique in numpy, cut into parts by hash value, and shuffled as
one binary row for each (block, part), so a hash that fills a third of the corpus reaches its part once for each block at most.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import text_bytes

BLOCK_BYTES = 4 << 20


def dealt(docs: DataFrame, least: int = 64, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """doc_id, text and block of every row, and the number of blocks; rows with one id share a block, rows without an id are dealt by their text."""
    rows, size = text_bytes(docs)
    n = max(least if rows > 1000 else 1, math.ceil(size / block_bytes))
    return docs.select("doc_id", "text", F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(n)).cast("int").alias("block")), n


def parts_of(h: np.ndarray, n: int) -> list[np.ndarray]:
    """Positions of the hashes of each part, in the order of the hashes; ``h`` is sorted."""
    edges = np.searchsorted(h, np.array([(k << 64) // n for k in range(1, n)], dtype=np.uint64))
    return np.split(np.arange(len(h)), edges)


def runs(h: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts in a sorted array."""
    return np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, dtype=np.int64)


def packed(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names)

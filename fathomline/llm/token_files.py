"""Token-id files by an adaptive context-mixing range coder.

Ids are coded in blocks of whole documents, each on its own: see :mod:`fathomline.llm.range_coder`. Files are Parquet with a row for each
block, so they may be in any store that Spark writes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.llm.common import blocks, text_bytes
from fathomline.llm.range_coder import decode, encode
from fathomline.llm.tokens import encoder, tokenizer_path

FILE_SCHEMA = "shard int, block int, start long, n_ids long, doc_ids array<long>, lengths array<long>, code binary"


def write_tokens(docs: DataFrame, path: str, end: int = 2, vocabulary: str | None = None, shard_bytes: int = 16 << 20) -> None:
    """Encode the texts of ``docs`` in ascending doc_id order (null first; equal ids by their text's hash) into token files under ``path``.

    Each document ends with the id ``end``; null and empty texts are that id alone. Repeated rows are documents of their own, a long text stays in one
    block, an empty table makes files without rows, and other columns are ignored.
    """
    vocabulary = vocabulary or tokenizer_path()
    shards = max(1, -(-text_bytes(docs)[1] // shard_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        for batch in blocks(batches, most=24 << 20):  # the more texts at once, the fewer distinct pieces
            ids, lengths = encoder(vocabulary).ended(batch.column("text"), end)
            row = at = 0
            for part in blocks(iter([batch]), most=6 << 20):
                lens = lengths[row : row + part.num_rows]
                stream = ids[at : at + lens.sum()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([len(stream)], pa.int64()), pa.array([part.column("doc_id").cast(pa.int64()).to_pylist()], pa.list_(pa.int64())), pa.array([lens.tolist()], pa.list_(pa.int64())), pa.array([encode(stream)], pa.binary())],
                    names=["shard", "block", "start", "n_ids", "doc_ids", "lengths", "code"],
                )
                row, at, block, start = row + part.num_rows, at + len(stream), block + 1, start + len(stream)

    rows = docs.select("doc_id", "text").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows.mapInArrow(run, FILE_SCHEMA).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, with ``with_ids``, ids, from token files."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                stream = decode(r["code"])
                ends = np.cumsum(r["lengths"])
                ids = [stream[e - n : e] for e, n in zip(ends, r["lengths"], strict=True)]
                n = len(ids)
                columns = [pa.array(r["doc_ids"], pa.int64()), pa.array([r["shard"]] * n, pa.int32()), pa.array(r["start"] + ends - r["lengths"], pa.int64()), pa.array(r["lengths"], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())]
                names = ["doc_id", "shard", "in_shard", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array([x.tolist() for x in ids], pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    docs = files.mapInArrow(run, "doc_id long, shard int, in_shard long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    docs = docs.join(shards.select("shard", before.alias("before")), "shard")
    return docs.select("doc_id", (F.col("before") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)

"""A streaming source that follows files which grow by lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from fathomline.sources.ranges import REQUEST, Bytes, Span, files_below, spans

SCHEMA = "path string, position long, value string"


class LineTail(DataSource):
    """``spark.readStream.format("line_tail")``: path, position (the byte at which the line begins) and value of each whole line of the files below ``path``.

    The offset is, for each file, the byte after its last line end, so a line that is still being written waits for the batch in which its end is there, and a stream that
    restarts from its checkpoint goes on after the lines it has given. New files are picked up; a file that has become shorter was written anew and is read from its beginning.
    Lines may be of any length. Blank lines are left out. Options: path, suffix (of names), splitBytes (of the new part of a file that one task reads).
    """

    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LineTailReader:
        return LineTailReader(self.options)


class LineTailReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.suffix = tuple(filter(None, [options.get("suffix", "").lower()]))
        self.most = int(options.get("splitBytes", 16 << 20))
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for path, size in files_below(self.root, self.suffix):
            since = self.known.get(path, 0)
            if size != since:
                self.known[path] = self.whole(path, size, since if since <= size else 0)
        return dict(self.known)

    def whole(self, path: str, size: int, since: int) -> int:
        """The byte after the last line end of the first ``size`` bytes; ``since`` if there is none after it."""
        file = Bytes(self.root, path)
        end = size
        while end > since:
            start = max(since, end - REQUEST)
            k = file.at(start, end - start).rfind(b"\n")
            if k >= 0:
                file.close()
                return start + k + 1
            end = start
        file.close()
        return since

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path, upto in sorted(end.items()):
            since = start.get(path, 0)
            out += spans(path, since if since <= upto else 0, upto, upto, self.most)
        return out

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        """Lines that begin in the partition; its last one may end after it."""
        file = Bytes(self.root, partition.path)
        place = partition.start
        if place and file.at(place - 1, 1) != b"\n":
            place = file.find(b"\n", place, partition.size) + 1 or partition.size
        rows: list[tuple[str, int, str]] = []
        held = 0
        while place < partition.end:
            end = file.find(b"\n", place, partition.size)
            if end < 0:
                break
            line = file.at(place, end - place).decode("utf-8", "replace").removesuffix("\r")
            if line.strip():
                rows.append((partition.path, place, line))
                held += len(line)
            place = end + 1
            if held > 4 << 20 or len(rows) >= 10_000:
                yield self.batch(rows)
                rows, held = [], 0
        if rows:
            yield self.batch(rows)
        file.close()

    @staticmethod
    def batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
        path, position, value = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(path), pa.array(position, pa.int64()), pa.array(value)], names=["path", "position", "value"])


def tailed(spark: SparkSession, path: str, suffix: str = "", split_bytes: int = 16 << 20) -> DataFrame:
    """path, position and value of the lines below ``path`` as a stream that gives each whole line once."""
    spark.dataSource.register(LineTail)
    return spark.readStream.format("line_tail").option("suffix", suffix).option("splitBytes", str(split_bytes)).load(path)


def job_events(spark: SparkSession, path: str, after: int | None = None) -> DataFrame:
    """path, position, job_id, seq, ts, type, stage and message of the job events that are appended below ``path``; with ``after`` only those of a larger seq.

    Lines that are no JSON objects with a seq are left out.
    """
    shape = "job_id string, seq long, ts timestamp, type string, stage string, message string"
    lines = tailed(spark, path, ".jsonl").select("path", "position", F.from_json("value", shape).alias("e")).filter("e.seq IS NOT NULL")
    events = lines.select("path", "position", "e.*")
    return events if after is None else events.filter(F.col("seq") > after)

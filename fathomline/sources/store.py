"""Tables that change: versions by manifest, merge on read, and documents that are replaced as a whole.

A version is a small manifest that names the segments it consists of. Segments are written first and never changed; a version comes into being when its manifest is renamed to its number,
which fails if another writer was first. So readers see whole versions only, a write that fails leaves nothing behind but an unnamed folder, and older versions stay readable until they are
vacuumed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from fathomline.sources.ranges import opened


class Conflict(Exception):
    """Another writer has made the version first; read again and retry."""


class Store:
    """A table with a key, in a folder that driver and executors share.

    ``upsert`` and ``delete`` add a segment of rows or of keys; a row lives where no later segment names its key. :meth:`compacted` writes the rows that live as one segment. Keys hold no nulls;
    of rows that repeat a key within one call one is kept, the largest by its other columns.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], schema: T.StructType) -> None:
        self.spark, self.path, self.key, self.schema = spark, path.rstrip("/"), key, schema
        self.jvm = spark.sparkContext._jvm
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        """The versions there are, oldest first; an empty store has none."""
        at = self._at("_versions")
        if not self.fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def segments(self, version: int) -> list[dict]:
        text = self.spark.read.text(f"{self.path}/_versions/{version:010d}.json", wholetext=True).first()[0]
        return json.loads(text)["segments"]

    def _committed(self, version: int, segments: list[dict]) -> int:
        """Name the segments as a version; a file of its own, renamed to the version's number unless that is taken."""
        made = self._at(f"_versions/.{uuid.uuid4().hex}")
        out = self.fs.create(made)
        out.write(bytearray(json.dumps({"segments": segments}).encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri() if "://" in self.path else self.fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(made, self._at(f"_versions/{version:010d}.json"), none)
        except Exception as e:
            self.fs.delete(made, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version} of {self.path} is there already") from None
            raise
        return version

    def _added(self, rows: DataFrame, kind: str, after: int | None) -> int:
        found = self.versions()
        last = (found[-1] if found else 0) if after is None else after
        name = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        before = self.segments(last) if last else []
        return self._committed(last + 1, [*before, {"path": name, "kind": kind}])

    def upsert(self, rows: DataFrame, after: int | None = None) -> int:
        """Put rows in the place of those with their keys, or beside the others; gives the new version. ``after``: the version the rows were made from; a later one is a :class:`Conflict`."""
        rows = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields))
        others = [c for c in rows.columns if c not in self.key]
        one = rows.dropna(subset=self.key).groupBy(*self.key).agg(F.max(F.struct(*others)).alias("_r")).select(*self.key, "_r.*") if others else rows.dropna(subset=self.key).distinct()
        return self._added(one.select(*self.schema.names), "rows", after)

    def insert(self, rows: DataFrame) -> int:
        """Rows of new keys; a key that lives already raises ValueError, and nothing is written."""
        found = self.versions()
        last = found[-1] if found else 0
        if last and self.read(last).join(rows.select(*self.key), self.key, "left_semi").limit(1).count():
            raise ValueError("a key is there already")
        return self.upsert(rows, last)

    def delete(self, keys: DataFrame, after: int | None = None) -> int:
        """Rows of these keys live no longer."""
        return self._added(keys.select(*self.key).dropna().distinct(), "deletes", after)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows that live in a version, by default the last one."""
        found = self.versions()
        version = (found[-1] if found else 0) if version is None else version
        segments = self.segments(version) if version else []
        if not segments:
            return self.spark.createDataFrame([], self.schema)
        keys = T.StructType([self.schema[k] for k in self.key])
        frames = []
        for k, s in enumerate(segments):
            rows = self.spark.read.schema(self.schema if s["kind"] == "rows" else keys).parquet(f"{self.path}/{s['path']}")
            frames.append(rows.withColumn("_segment", F.lit(k)))
        if len(frames) == 1:
            return frames[0].drop("_segment") if segments[0]["kind"] == "rows" else self.spark.createDataFrame([], self.schema)
        last = None
        for f in frames[1:]:
            last = f.select(*self.key, "_segment") if last is None else last.unionByName(f.select(*self.key, "_segment"))
        last = last.groupBy(*self.key).agg(F.max("_segment").alias("_last"))
        live = None
        for f, s in zip(frames, segments, strict=True):
            if s["kind"] == "rows":
                live = f if live is None else live.unionByName(f)
        if live is None:
            return self.spark.createDataFrame([], self.schema)
        return live.join(last, self.key, "left").filter("_last IS NULL OR _last <= _segment").select(*self.schema.names)

    def compacted(self) -> int:
        """A version of one segment with the same rows."""
        last = self.versions()[-1]
        name = f"data/{uuid.uuid4().hex}"
        self.read(last).write.parquet(f"{self.path}/{name}")
        return self._committed(last + 1, [{"path": name, "kind": "rows"}])

    def vacuumed(self, keep: int = 1) -> list[str]:
        """Forget all but the last ``keep`` versions and delete the segments that only they named (and those of failed writes)."""
        found = self.versions()
        for v in found[: -keep or None]:
            self.fs.delete(self._at(f"_versions/{v:010d}.json"), False)
        named = {s["path"] for v in found[-keep:] for s in self.segments(v)}
        at = self._at("data")
        gone = [f"data/{s.getPath().getName()}" for s in (self.fs.listStatus(at) if self.fs.exists(at) else [])]
        gone = [g for g in gone if g not in named]
        for g in gone:
            self.fs.delete(self._at(g), True)
        return gone


def cascade(parents: Store, children: Store, keys: DataFrame, foreign: dict[str, str]) -> tuple[int, int]:
    """Delete parents and the children that name them (``foreign``: parent key -> column of the children); children first, so that none is seen without its parent."""
    gone = keys.select(*(F.col(p).alias(c) for p, c in foreign.items())).distinct()
    return children.delete(children.read().join(gone, list(foreign.values()), "left_semi")), parents.delete(keys)


# --- documents replaced as a whole --------------------------------------------------------------------------------------------------------------------

POINTER = "_current.json"


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


class Documents(DataSource):
    """``df.write.format("documents").mode("overwrite").save(path)``: rows as JSON lines that take the place of what was there at once.

    Tasks write parts to a new folder; the commit renames a pointer that names them, and then deletes the folder that it named before. Until then, and after a write that fails, readers
    (:func:`documents`) see the old rows; an aborted write's folder is deleted, but for what tasks that were still ending wrote later, which no pointer names.
    """

    @classmethod
    def name(cls) -> str:
        return "documents"

    def writer(self, schema: T.StructType, overwrite: bool) -> DocumentsWriter:
        return DocumentsWriter(self.options["path"], schema.names, overwrite)


class DocumentsWriter(DataSourceWriter):
    def __init__(self, path: str, names: list[str], overwrite: bool) -> None:
        self.path, self.names, self.overwrite = path, names, overwrite
        self.folder = f"write-{uuid.uuid4().hex}"

    def _open(self) -> tuple[fs.FileSystem, str]:
        system, at = opened(self.path)
        return system, at.rstrip("/")

    def write(self, rows: Iterator[Row]) -> Part:
        from pyspark import TaskContext

        system, at = self._open()
        system.create_dir(f"{at}/{self.folder}")
        name = f"{self.folder}/part-{TaskContext.get().partitionId():05d}-{TaskContext.get().taskAttemptId()}.json"
        n = 0
        with system.open_output_stream(f"{at}/{name}") as out:
            for row in rows:
                out.write(json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False).encode() + b"\n")
                n += 1
        return Part(name, n)

    def commit(self, messages: list[Part | None]) -> None:
        system, at = self._open()
        before = pointed(system, at)
        parts = [m for m in messages if m is not None]
        kept = [] if self.overwrite or before is None else before["parts"]
        text = json.dumps({"parts": [*kept, *(p.name for p in parts)], "rows": sum(p.rows for p in parts) + (0 if self.overwrite or before is None else before["rows"])})
        system.create_dir(at)
        with system.open_output_stream(f"{at}/.{self.folder}") as out:
            out.write(text.encode())
        system.move(f"{at}/.{self.folder}", f"{at}/{POINTER}")
        if self.overwrite and before is not None:
            for folder in {p.split("/")[0] for p in before["parts"]}:
                system.delete_dir(f"{at}/{folder}")

    def abort(self, messages: list[Part | None]) -> None:
        system, at = self._open()
        if system.get_file_info(f"{at}/{self.folder}").type == fs.FileType.Directory:
            system.delete_dir(f"{at}/{self.folder}")


def pointed(system: fs.FileSystem, at: str) -> dict | None:
    if system.get_file_info(f"{at}/{POINTER}").type != fs.FileType.File:
        return None
    with system.open_input_stream(f"{at}/{POINTER}") as f:
        return json.loads(f.read())


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that :class:`Documents` last put in place; none if there was no write."""
    system, at = opened(path)
    found = pointed(system, at.rstrip("/"))
    if not found or not found["parts"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json([f"{path.rstrip('/')}/{p}" for p in found["parts"]])


def replaced(rows: DataFrame, path: str) -> None:
    """Put ``rows`` in the place of the documents at ``path``, all at once."""
    rows.sparkSession.dataSource.register(Documents)
    rows.write.format("documents").mode("overwrite").save(path)

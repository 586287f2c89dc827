"""Passages of long texts: split at headings, packed from paragraphs, and kept as a stored index that searches read."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.operators import blocks, staging


def marked(line: Column) -> Column:
    """A heading as Markdown writes it."""
    return line.startswith("#")


def title(line: Column) -> Column:
    return F.trim(F.ltrim(line, F.lit("#")))


def sections(rows: DataFrame, column: str, heading: Callable[[Column], Column] = marked) -> DataFrame:
    """``rows`` without ``column``, with section (from 0), heading and body: the lines between two headings; what precedes the first has the heading ''.

    Stays in the JVM and shuffles nothing. Sections of blank lines only are left out but counted. A null text has none.
    """
    lines = F.split(column, "\r\n|[\n\r]")
    places = F.sequence(F.lit(0), F.size("ps_lines") - 1)
    rows = rows.withColumn("ps_lines", lines).filter("ps_lines IS NOT NULL")
    rows = rows.withColumn("ps_marks", F.concat(F.array(F.lit(-1)), F.filter(places, lambda i: heading(F.get("ps_lines", i)))))
    end = lambda k: F.coalesce(F.get("ps_marks", k + 1), F.size("ps_lines"))
    body = lambda at, k: F.array_join(F.slice("ps_lines", at + 2, end(k) - at - 1), "\n")
    name = lambda at: F.when(at < 0, F.lit("")).otherwise(title(F.get("ps_lines", at)))
    found = F.transform("ps_marks", lambda at, k: F.struct(name(at).alias("heading"), body(at, k).alias("body")))
    out = rows.select(*[c for c in rows.columns if c not in (column, "ps_lines", "ps_marks")], F.posexplode(found).alias("section", "ps_section"))
    return out.select("*", "ps_section.heading", "ps_section.body").drop("ps_section").filter(F.col("body").rlike(r"\S"))


def packed(paragraphs: Sequence[str], target: int, overlap: int, glue: str) -> list[str]:
    """Paragraphs joined up to ``target`` characters; each further passage begins with the last ``overlap`` characters of the one before. A longer paragraph stays whole."""
    out: list[list[str]] = []
    size = 0
    for p in paragraphs:
        if out and size + len(glue) + len(p) <= target:
            out[-1].append(p)
            size += len(glue) + len(p)
            continue
        tail = glue.join(out[-1])[-overlap:] if out and overlap else ""
        out.append([tail, p] if tail else [p])
        size = len(tail) + len(glue) + len(p) if tail else len(p)
    return [glue.join(x) for x in out]


def passages(rows: DataFrame, column: str, heading: Callable[[Column], Column] = marked, between: str = r"\n\s*\n", glue: str = "\n\n", target: int = 900, overlap: int = 150) -> DataFrame:
    """``rows`` without ``column``, with section, heading, place (from 0 in a section) and passage, which never straddles a heading.

    Packing depends on what was packed before, so it runs text by text in Arrow batches; a passage that grew in an aggregate over arrays would be copied at every step.
    """

    @F.pandas_udf("array<string>")
    def pack(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda ps: packed(list(ps), target, overlap, glue))

    split = F.filter(F.transform(F.split("body", between), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    cut = sections(rows, column, heading)
    keep = [c for c in cut.columns if c != "body"]
    return cut.withColumn("body", split).select(*keep, F.posexplode(pack("body")).alias("place", "passage"))


def fingerprint(spark: SparkSession, sources: DataFrame, *parameters: object) -> str:
    """Changes when a file behind ``sources`` is added, removed or rewritten, or a parameter is another. Asks for the files' state only."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    state = []
    for name in sorted(sources.inputFiles()):
        at = jvm.org.apache.hadoop.fs.Path(name)
        found = at.getFileSystem(conf).getFileStatus(at)
        state.append([name, found.getLen(), found.getModificationTime()])
    return hashlib.sha256(json.dumps([state, [str(p) for p in parameters]]).encode()).hexdigest()


class PassageIndex:
    """Passages with their length, the blocks of their index and the term statistics, as tables in one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.passages, self.blocks, self.idf = (spark.read.parquet(f"{path}/{name}") for name in ("passages", "blocks", "idf"))

    def hits(self, queries: DataFrame, query: str, column: str) -> DataFrame:
        """query, passage_id, score of all passages that share a term with the query."""
        return blocks.hits(self.blocks, blocks.asked(queries, query, column, self.idf), query, "passage_id")

    def leading(self, queries: DataFrame, query: str, column: str, k: int, group: Callable[[pa.Array], pa.Array] | None = None) -> DataFrame:
        """:meth:`hits` without rows that cannot be among the first ``k`` of their query, where it takes some rows of a ``group`` of passages before the others."""
        return blocks.hits(self.blocks, blocks.asked(queries, query, column, self.idf), query, "passage_id", k, group=group)

    def top(self, queries: DataFrame, query: str, column: str, k: int) -> DataFrame:
        """query, passage_id, score, rank: the ``k`` best passages with a score above zero, ties to the smaller id."""
        w = Window.partitionBy(query).orderBy(F.desc("score"), "passage_id")
        found = blocks.hits(self.blocks, blocks.asked(queries, query, column, self.idf), query, "passage_id", k, positive=True)
        return found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def stored(spark: SparkSession, name: str, mark: str, build: Callable[[], DataFrame], column: str = "passage") -> PassageIndex:
    """The index ``name`` of fingerprint ``mark`` from the shared folder; it is built there once, from the rows (with passage_id, unique) that ``build`` gives.

    It is built aside and renamed when whole, so a reader never sees half of one. Of two sessions that build it at once the second one drops its own.
    """
    path = f"{staging.shared_folder(spark)}/{name}-{mark[:32]}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        aside = f"{path}.{uuid.uuid4().hex}"
        build().withColumn("size", F.length(column)).write.parquet(f"{aside}/passages")
        blocks.build(spark.read.parquet(f"{aside}/passages"), "passage_id", column, aside)
        half = jvm.org.apache.hadoop.fs.Path(aside)
        # a rename onto a folder that is there already may move into it: whoever finds one drops its own
        if fs.exists(at) or not fs.rename(half, at):
            fs.delete(half, True)
    return PassageIndex(spark, path)

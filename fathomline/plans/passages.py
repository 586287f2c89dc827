"""Queries over passages: sections cut at headings, and searches that read a stored index instead of building one."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.functions import text
from fathomline.functions.score import rounded
from fathomline.operators import blocks, passages, search, windows
from fathomline.plans.registry import query
from fathomline.plans.retrieval import R6, STOPS
from fathomline.plans.views import table

#: The documents' lines are paragraphs, and short ones head a section.
SHORT = 60
CUT_SQL = f"""line AS (SELECT doc_id, i, trim(s, chr(9) || chr(11) || chr(12) || ' ') AS s, length(s) <= {SHORT} AND regexp_matches(s, '[^\\s]') AS h FROM (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS s FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r]') AS l FROM documents))),
  sect AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM line), head AS (SELECT doc_id, section, trim(ltrim(s, '#')) AS heading FROM sect WHERE h),
  p AS (SELECT doc_id, section, row_number() OVER (PARTITION BY doc_id, section ORDER BY i) AS i, s FROM sect WHERE NOT h AND s <> ''),
  w AS (SELECT doc_id, section, i, s AS held, CAST(0 AS BIGINT) AS place FROM p WHERE i = 1 UNION ALL SELECT w.doc_id, w.section, p.i, CASE WHEN length(held) + 1 + length(s) > 900 THEN right(held, 150) || chr(10) || s ELSE held || chr(10) || s END,
    CASE WHEN length(held) + 1 + length(s) > 900 THEN place + 1 ELSE place END FROM w JOIN p ON p.doc_id = w.doc_id AND p.section = w.section AND p.i = w.i + 1),
  passage AS (SELECT doc_id, CAST(section AS BIGINT) AS section, coalesce(any_value(heading), '') AS heading, place, max_by(held, i) AS passage FROM w LEFT JOIN head USING (doc_id, section) GROUP BY doc_id, section, place),
  shown AS (SELECT *, doc_id || '#' || section || '.' || place AS passage_id FROM passage)"""
WORDS_SQL = f"list_filter(regexp_extract_all(lower({{}}), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({STOPS}))"
INDEX_SQL = f"""{CUT_SQL}, t AS (SELECT passage_id, term, count(*) AS tf FROM (SELECT passage_id, unnest({WORDS_SQL.format('passage')}) AS term FROM shown) GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM shown),
  idf AS (SELECT term, count(*) AS df, ln((any_value(n) + 1.0) / (count(*) + 1)) + 1 AS idf FROM t, n GROUP BY term),
  raw AS (SELECT passage_id, term, (1 + ln(tf)) * idf AS w FROM t JOIN idf USING (term)), weight AS (SELECT passage_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY passage_id)) AS w FROM raw)"""
HIT_SQL = f"""{INDEX_SQL}, qtok AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({WORDS_SQL.format('text')}) AS term FROM benchmark) GROUP BY 1, 2),
  qraw AS (SELECT item_id, term, (1 + ln(tf)) * idf AS w FROM qtok JOIN idf USING (term)), qw AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM qraw),
  hit AS (SELECT item_id, passage_id, {R6.format('sum(CAST(qw.w * weight.w AS DECIMAL(18,12)))')} AS score FROM qw JOIN weight USING (term) GROUP BY 1, 2)"""


def short(line: Column) -> Column:
    return (F.length(line) <= SHORT) & line.rlike(r"\S")


def cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.passages(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", short, between="\n", glue="\n")
    found = found.withColumns({"section": F.col("section").cast("long"), "place": F.col("place").cast("long")})
    return found.withColumn("passage_id", F.concat(F.col("doc_id"), F.lit("#"), F.col("section"), F.lit("."), F.col("place")))


def index(spark: SparkSession, sf_dir: str) -> passages.PassageIndex:
    mark = passages.fingerprint(spark, table(spark, sf_dir, "documents"), SHORT, 900, 150, text.STOP_WORDS)
    return passages.stored(spark, "passage-blocks", mark, lambda: cut(spark, sf_dir))


def document(passage_ids: pa.Array) -> pa.Array:
    return pc.list_element(pc.split_pattern(passage_ids, "#", max_splits=1), 0)


@query("f35_sections", f"WITH RECURSIVE {CUT_SQL} SELECT doc_id, section, heading, place, passage FROM passage")
def f35_sections(spark, d):
    return cut(spark, d).drop("passage_id")


@query("k11_index_terms", f"WITH RECURSIVE {INDEX_SQL} SELECT term, df, {R6.format('any_value(idf)')} AS idf, {R6.format('max(w)')} AS heaviest FROM weight JOIN idf USING (term) GROUP BY term, df")
def k11_terms(spark, d):
    """Statistics and weights as the stored index holds them."""
    found = index(spark, d)
    return blocks.heaviest(found.blocks).join(found.idf, "term").select("term", "df", rounded(F.col("idf"), 6).alias("idf"), rounded(F.col("w"), 6).alias("heaviest"))


@query("o04_passage_search", f"WITH RECURSIVE {HIT_SQL} SELECT item_id, passage_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, passage_id) AS rank FROM hit WHERE score > 0) WHERE rank <= 8")
def o04_passages(spark, d):
    return index(spark, d).top(table(spark, d, "benchmark"), "item_id", "text", 8).select("item_id", "passage_id", "score", "rank")


@query("w04_passages_a_document", f"""WITH RECURSIVE {HIT_SQL}, g AS (SELECT h.*, doc_id, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY score DESC, passage_id) AS in_doc FROM hit h JOIN shown USING (passage_id)),
  o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY in_doc > 3, score DESC, passage_id) AS rank FROM g) SELECT item_id, passage_id, doc_id, rank FROM o WHERE rank <= 8""")
def w04_passages(spark, d):
    rows = index(spark, d).leading(table(spark, d, "benchmark"), "item_id", "text", 8, document)
    rows = rows.withColumn("doc_id", F.substring_index("passage_id", "#", 1).cast("long"))
    return windows.capped_top(rows, ["item_id"], "doc_id", [F.desc("score"), F.col("passage_id")], 3, 8).select("item_id", "passage_id", "doc_id", F.col("rank").cast("long").alias("rank"))


@query("o07_passage_rerank", f"""WITH RECURSIVE {HIT_SQL}, wide AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, passage_id) AS n FROM hit WHERE score > 0),
  r AS (SELECT item_id, passage_id, row_number() OVER (PARTITION BY item_id ORDER BY length(passage) DESC, n) AS rank FROM wide JOIN shown USING (passage_id) WHERE n <= 20) SELECT * FROM r WHERE rank <= 5""")
def o07_passages(spark, d):
    found = index(spark, d)
    wide = found.top(table(spark, d, "benchmark"), "item_id", "text", 20).withColumnRenamed("rank", "n")
    wide = wide.join(found.passages.select("passage_id", "size"), "passage_id")
    w = Window.partitionBy("item_id").orderBy(F.desc("size"), "n")
    return wide.withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 5").select("item_id", "passage_id", "rank")


def holders(documents: DataFrame, items: DataFrame, idf: DataFrame) -> DataFrame:
    """item_id, doc_id of all documents whose text holds the item's whole text.

    An item is sought in documents that hold its rarest inner term: a term between its first and last word is a whole word there too. Items without one (a word or two, stop words,
    no words at all) are sought in every document.
    """
    docs = documents.select("doc_id", "text")
    b = items.select("item_id", F.col("text").alias("item")).filter("item IS NOT NULL")
    inner = text.tokens(F.regexp_replace(F.lower("item"), r"^[a-z0-9]+|[a-z0-9]+\z", ""))
    terms = b.withColumn("inner", F.array_distinct(inner))
    rarest = terms.select("item_id", "item", F.explode("inner").alias("term")).join(idf.select("term", "df"), "term", "left").groupBy("item_id", "item").agg(F.min(F.struct("df", "term"))["term"].alias("term"))
    # few items go to the tasks, so that no row of a document and a word is shuffled
    few = items.count() <= search.SENT
    held = docs.select("doc_id", F.explode(F.split(blocks.words(F.col("text")), " ")).alias("term")).join(F.broadcast(rarest) if few else rarest, "term").select("doc_id", "item_id", "item").distinct()
    held = held.join(docs, "doc_id").filter(F.contains("text", F.col("item")))
    rest = docs.join(terms.filter(F.size("inner") == 0), F.contains("text", F.col("item")))
    return held.select("item_id", "doc_id").unionByName(rest.select("item_id", "doc_id"))


@query("a21_passage_hit_rates", f"""WITH RECURSIVE {HIT_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, passage_id) AS rank FROM hit WHERE score > 0),
  truth AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), f AS (SELECT t.item_id, min(rank) FILTER (rank <= 10) AS best FROM (SELECT DISTINCT item_id FROM truth) t LEFT JOIN (SELECT item_id, rank FROM r JOIN shown USING (passage_id) SEMI JOIN truth USING (item_id, doc_id)) USING (item_id) GROUP BY 1)
  SELECT count(*) AS queries, {R6.format('avg(CASE WHEN best = 1 THEN 1.0 ELSE 0.0 END)')} AS hit_1, {R6.format('avg(CASE WHEN best IS NOT NULL THEN 1.0 ELSE 0.0 END)')} AS hit_k, {R6.format('avg(coalesce(1.0 / best, 0))')} AS mrr FROM f""")
def a21_passages(spark, d):
    """Right answers are the documents that hold the whole item; items that none holds are no queries."""
    found = index(spark, d)
    ranked = found.top(table(spark, d, "benchmark"), "item_id", "text", 10)
    truth = holders(table(spark, d, "documents"), table(spark, d, "benchmark"), found.idf)
    ranked = ranked.select("item_id", F.substring_index("passage_id", "#", 1).cast("long").alias("doc_id"), "rank")
    best = truth.join(ranked, ["item_id", "doc_id"], "left").groupBy("item_id").agg(F.min("rank").alias("best"))  # the truth is sought once
    return search.rank_quality(best, "best")

"""The queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import cube, factorisation, jaccard, line_blocks, neighbours, packing, periodic, prefixes, probing, repetition, secrets, substrings, token_files
from fathomline.llm.common import discard, shared_folder, table


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probing.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed(table(spark, sf_dir, "documents"), texts=False)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_coverage(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.withColumn("value_sha256", F.sha2("value", 256)).drop("value", "row_key")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = cube.mixture(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source", "source_size", "target", "copies", "taken")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_tokens(table(spark, sf_dir, "documents"), path)
    return token_files.read_tokens(spark, path, with_ids=False)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factorisation.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic.digests(periodic.periodic(docs.withColumn("text", periodic.looped(F.col("doc_id"), F.col("text")))))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = prefixes.turns(table(spark, sf_dir, "conversations"))
    found = prefixes.trie(*prefixes.rebuilt(turned))
    discard(turned)
    return found.drop("x", "y")


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return line_blocks.extracted(pages).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {f.__name__: f for f in (op1_nearest_neighbours, op2_substring_dedup, op3_toxicity, op4_quality_rules, op5_secret_scan, op6_packing, op7_source_mixing, op8_token_files, op9_quality_classifier, op10_jaccard_join, op11_periodic_runs, op12_prefix_trie, op13_html_extraction)}

#: SQL that counts all pairs and windows in one process: for small tables, as an oracle. The other operators cannot be said in SQL as a whole; tests hold
#: them against brute force, round trips or held-out labels.
WORD = "[^\\x20\\x09-\\x0D]+"
JACCARD_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
  link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)), both_ AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
  reach AS (SELECT a AS node, a AS r FROM both_ UNION SELECT reach.node, both_.b FROM reach JOIN both_ ON both_.a = reach.r)
  SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(m, d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(r) AS m FROM reach GROUP BY 1) USING (doc_id)"""
SUBSTRING_SQL = f"""WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{WORD}'), []) AS w FROM documents),
  win AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w)), again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
  gone AS (SELECT DISTINCT doc_id, i + k AS j FROM again, range(0, 20) r(k)), word AS (SELECT doc_id, j, w[j] AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM w)),
  kept AS (SELECT doc_id, string_agg(v, ' ' ORDER BY j) AS t FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY 1), lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
  SELECT doc_id, len(w) AS n_words, coalesce(lost.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)"""

#: crc32 of the decimal digits of an integer, bit by bit.
CRC32 = (
    "xor(list_reduce(list_concat([4294967295], list_transform(string_split({0}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: "
    "list_reduce(list_concat([xor(a::BIGINT, b::BIGINT)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"
)
TRIE_SQL = f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
  c AS (SELECT conv_id, {CRC32.format("conv_id")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM conversations)),
  r AS (SELECT c.conv_id, 0 AS own, p, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND p < h UNION ALL SELECT conv_id, 1, p, role, text FROM c JOIN t USING (conv_id) WHERE p >= h),
  s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, p) AS d, role, text FROM r),
  k AS (SELECT conv_id, d, sha256(string_agg(role || chr(1) || text, chr(2)) OVER (PARTITION BY conv_id ORDER BY d)) AS k, len(regexp_extract_all(text, '{WORD}')) AS w FROM s UNION ALL SELECT conv_id, 0, '', 0 FROM c),
  n AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n, min(w) AS w FROM k GROUP BY 1, 2),
  up AS (SELECT DISTINCT a.d, a.k, b.k AS pk FROM k a JOIN k b ON b.conv_id = a.conv_id AND b.d = a.d - 1), ch AS (SELECT d - 1 AS d, pk AS k, count(*) AS n FROM up GROUP BY 1, 2),
  v AS (SELECT n.*, coalesce(ch.n, 0) AS kids FROM n LEFT JOIN ch USING (d, k)),
  roll AS (SELECT a.d, a.k, count(*) FILTER (kids = 0) AS leaves, sum((v.n - 1) * v.w)::BIGINT AS saved FROM v JOIN k a ON a.conv_id = v.conv_id AND a.d <= v.d GROUP BY 1, 2),
  e AS (SELECT d, k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, max(d) AS d FROM k GROUP BY 1) JOIN k USING (conv_id, d) GROUP BY 1, 2)
  SELECT v.conv_id, v.d::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n AS n_convs, v.kids AS n_children, leaves AS n_leaves, saved AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
  FROM v JOIN roll USING (d, k) LEFT JOIN up USING (d, k) LEFT JOIN n p ON p.d = v.d - 1 AND p.k = up.pk LEFT JOIN e ON e.d = v.d AND e.k = v.k"""
#: Holds for pages that mark their article as the given ones do.
ARTICLE_SQL = """WITH a AS (SELECT page_id, url, regexp_extract(html, '<article>(.*?)(</article>|$)', 1, 's') AS a FROM pages),
  b AS (SELECT page_id, i, trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(b[i], '</?b>|<br>', '', 'g'), '&quot;?', '"', 'g'), '&lt;', '<'), '&gt;', '>'), '\\s+', ' ', 'g')) AS b
    FROM (SELECT page_id, b, unnest(range(1, len(b) + 1)) AS i FROM (SELECT page_id, regexp_split_to_array(a, '</?(?:p|h1)>') AS b FROM a))),
  t AS (SELECT page_id, string_agg(regexp_replace(replace(b, '&#x27;', chr(39)), '&amp;?', '&', 'g'), chr(10) || chr(10) ORDER BY i) AS text FROM b WHERE b <> '' GROUP BY 1)
  SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars FROM a LEFT JOIN t USING (page_id)"""

ORACLE_SQL: dict[str, str] = {"op2_substring_dedup": SUBSTRING_SQL, "op10_jaccard_join": JACCARD_SQL, "op12_prefix_trie": TRIE_SQL, "op13_html_extraction": ARTICLE_SQL}

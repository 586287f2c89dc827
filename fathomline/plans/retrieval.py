"""Retrieval and answer-check queries: tokens, weights, nearest vectors, citations, conversations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.functions import text, vector
from fathomline.functions.score import rounded
from fathomline.operators import projection, search, windows
from fathomline.plans.registry import query
from fathomline.plans.views import table

R6 = "CAST(round(CAST({} AS DECIMAL(18,8)), 6) AS DOUBLE)"
STOPS = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
TOK_SQL = f"tok AS (SELECT doc_id, source, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({STOPS})) AS words FROM documents)"
TERM_SQL = f"""{TOK_SQL}, t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS term FROM tok) GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents),
  idf AS (SELECT term, count(*) AS df, ln((any_value(n) + 1.0) / (count(*) + 1)) + 1 AS idf FROM t, n GROUP BY term),
  raw AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM t JOIN idf USING (term)), weight AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM raw)"""
Q_SQL = f"""qtok AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({STOPS}))) AS term FROM benchmark) GROUP BY 1, 2),
  qraw AS (SELECT item_id, term, (1 + ln(tf)) * idf AS w FROM qtok JOIN idf USING (term)), qw AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM qraw),
  hits AS (SELECT item_id, doc_id, {R6.format('sum(CAST(qw.w * weight.w AS DECIMAL(18,12)))')} AS score FROM qw JOIN weight USING (term) GROUP BY 1, 2)"""


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", "text")


def index(spark, d):
    return search.index(docs(spark, d), "doc_id", "text")


def hits(spark, d):
    return search.hits(table(spark, d, "benchmark"), "item_id", "text", index(spark, d), "doc_id")


@query("f33_tokens", f"WITH {TOK_SQL} SELECT doc_id, len(words) AS n, coalesce(len(list_distinct(words)), 0) AS n_distinct, greatest(len(words) - 1, 0) AS n_bigrams, coalesce(words[1] || ' ' || words[2], '') AS first_bigram FROM tok")
def f33(spark, d):
    w = docs(spark, d).select("doc_id", text.tokens(F.col("text")).alias("w")).withColumn("b", text.bigrams(F.col("w")))
    first = F.coalesce(F.get("b", F.lit(0)), F.lit(""))
    return w.select("doc_id", F.size("w").cast("long").alias("n"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.size("b").cast("long").alias("n_bigrams"), first.alias("first_bigram"))


@query("a20_idf", f"WITH {TERM_SQL} SELECT term, df, {R6.format('idf')} AS idf FROM idf WHERE df >= 5")
def a20(spark, d):
    return index(spark, d)[1].filter("df >= 5").select("term", "df", rounded(F.col("idf"), 6).alias("idf"))


@query("f36_tfidf_weights", f"WITH {TERM_SQL} SELECT doc_id, count(*) AS terms, {R6.format('max(w)')} AS heaviest FROM weight GROUP BY doc_id")
def f36(spark, d):
    return index(spark, d)[0].groupBy("doc_id").agg(F.count("*").alias("terms"), rounded(F.max("w"), 6).alias("heaviest"))


@query("j24_o04_sparse_search", f"WITH {TERM_SQL}, {Q_SQL} SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM hits WHERE score > 0) WHERE rank <= 8")
def o04(spark, d):
    return search.top(hits(spark, d), "item_id", "doc_id", 8)


@query("w04_capped_search", f"""WITH {TERM_SQL}, {Q_SQL}, g AS (SELECT h.*, source, row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, doc_id) AS in_source FROM hits h JOIN documents USING (doc_id)),
  o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY in_source > 2, score DESC, doc_id) AS rank FROM g) SELECT item_id, doc_id, source, rank FROM o WHERE rank <= 8""")
def w04(spark, d):
    rows = search.leading(hits(spark, d).join(docs(spark, d).select("doc_id", "source"), "doc_id"), "item_id", "doc_id", 8, "source", 2)
    return windows.capped_top(rows, ["item_id"], "source", [F.desc("score"), F.col("doc_id")], 2, 8).select("item_id", "doc_id", "source", F.col("rank").cast("long").alias("rank"))


@query("a21_hit_rates", f"""WITH {TERM_SQL}, {Q_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM hits), truth AS (SELECT item_id, item_id % 7 AS s FROM benchmark),
  f AS (SELECT t.item_id, min(rank) FILTER (doc_id % 7 = s AND rank <= 10) AS best FROM truth t LEFT JOIN r USING (item_id) GROUP BY 1)
  SELECT count(*) AS queries, {R6.format('avg(CASE WHEN best = 1 THEN 1.0 ELSE 0.0 END)')} AS hit_1, {R6.format('avg(CASE WHEN best IS NOT NULL THEN 1.0 ELSE 0.0 END)')} AS hit_k, {R6.format('avg(coalesce(1.0 / best, 0))')} AS mrr FROM f""")
def a21(spark, d):
    ranked = search.top(hits(spark, d), "item_id", "doc_id", 10)
    truth = table(spark, d, "benchmark").select("item_id", (F.col("item_id") % 7).alias("s"))
    best = truth.join(ranked, "item_id", "left").groupBy("item_id").agg(F.min(F.when(F.col("doc_id") % 7 == F.col("s"), F.col("rank"))).alias("best"))
    return search.rank_quality(best, "best")


VEC_SQL = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v)"


@query("j25_o05_dense_search", f"WITH {VEC_SQL}, p AS (SELECT q.vec_id AS query_id, u.vec_id, {R6.format('list_inner_product(q.e, u.e)')} AS score FROM u q JOIN u ON q.vec_id <> u.vec_id WHERE q.vec_id % 50 = 0) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 10")
def j25(spark, d):
    return search.nearest_exact(table(spark, d, "embeddings"), F.col("vec_id") % 50 == 0, 10)


@query("o06_a22_approximate_recall")
def o06(spark, d):
    v = table(spark, d, "embeddings")
    exact = search.nearest_exact(v, F.col("vec_id") % 50 == 0, 10)
    return search.recall(search.nearest_hashed(v, F.col("vec_id") % 50 == 0, 10), exact)


@query("f65_pearson", f"WITH {VEC_SQL}, m AS (SELECT vec_id, list_transform(e, lambda x: x - list_sum(e) / 64) AS c FROM v), n AS (SELECT vec_id, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) AS c FROM m) SELECT a.vec_id, {R6.format('list_inner_product(a.c, b.c)')} AS r FROM n a, n b WHERE b.vec_id = 0")
def f65(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", vector.centred(vector.doubles(F.col("embedding"))).alias("c"))
    one = v.filter("vec_id = 0").select(F.col("c").alias("o"))
    return v.crossJoin(F.broadcast(one)).select("vec_id", rounded(vector.dot(F.col("c"), F.col("o")), 6).alias("r"))


@query("o07_rerank", f"WITH {TERM_SQL}, {Q_SQL}, w AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS n FROM hits), r AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY n_chars DESC, n) AS rank FROM w JOIN documents USING (doc_id) WHERE n <= 20) SELECT * FROM r WHERE rank <= 5")
def o07(spark, d):
    wide = search.top(hits(spark, d), "item_id", "doc_id", 20).withColumnRenamed("rank", "n").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    w = Window.partitionBy("item_id").orderBy(F.desc("n_chars"), "n")
    return wide.withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 5").select("item_id", "doc_id", "rank")


@query("o12_best_sentence", "WITH s AS (SELECT doc_id, i, sentence FROM (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS sentence FROM (SELECT doc_id, regexp_split_to_array(replace(replace(text, '\n', ' '), '. ', '.\n'), '\n') AS l FROM documents)) WHERE length(trim(sentence)) > 0), c AS (SELECT doc_id, i, sentence, length(sentence) - length(replace(sentence, 'th', 't')) AS n FROM s) SELECT doc_id, min(row(-n, i))[2] - 1 AS place, max(n) AS overlap FROM c GROUP BY doc_id")
def o12(spark, d):
    flat = F.split(F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(". "), F.lit(".\n")), "\n")
    s = docs(spark, d).select("doc_id", F.posexplode(flat).alias("place", "sentence")).filter(F.length(F.trim("sentence")) > 0)
    s = s.withColumn("n", F.length("sentence") - F.length(F.replace("sentence", F.lit("th"), F.lit("t"))))
    return s.groupBy("doc_id").agg(F.min(F.struct(-F.col("n"), "place"))["place"].cast("long").alias("place"), F.max("n").cast("long").alias("overlap"))


CONV_SQL = "c AS (SELECT conv_id, turn, role, text, lower(text) AS t FROM conversations)"


def turns(spark, d):
    return table(spark, d, "conversations")


@query("p20_follow_ups", f"WITH {CONV_SQL} SELECT conv_id, turn, len(list_filter(regexp_split_to_array(t, '[ \n]+'), lambda w: w <> '')) <= 6 OR starts_with(t, 'and ') OR regexp_matches(t, '(^|[^a-z])(it|that|this)([^a-z]|$)') AS follow_up FROM c WHERE role = 'user'")
def p20(spark, d):
    t = F.lower("text")
    short = F.size(F.filter(F.split(t, "[ \n]+"), lambda w: w != "")) <= 6
    return turns(spark, d).filter("role = 'user'").select("conv_id", "turn", (short | t.startswith("and ") | t.rlike("(^|[^a-z])(it|that|this)([^a-z]|$)")).alias("follow_up"))


@query("p21_p22_routing", f"WITH {CONV_SQL} SELECT conv_id, turn, CASE WHEN contains(t, '?') AND regexp_matches(t, '[0-9]') THEN 'lookup' WHEN contains(t, '?') THEN 'question' WHEN regexp_matches(t, '^(the|a|an) ') THEN 'statement' WHEN len(t) < 60 THEN 'short' ELSE 'other' END AS route FROM c")
def p21(spark, d):
    t = F.lower("text")
    route = F.when(t.contains("?") & t.rlike("[0-9]"), "lookup").when(t.contains("?"), "question").when(t.rlike("^(the|a|an) "), "statement").when(F.length(t) < 60, "short").otherwise("other")
    return turns(spark, d).select("conv_id", "turn", route.alias("route"))


@query("p23_argument_coercion", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, TRY_CAST(event_type AS INTEGER) AS bad FROM events")
def p23(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.col("event_type").try_cast("int").alias("bad"))


@query("w25_carried_terms", f"""WITH {CONV_SQL}, u AS (SELECT conv_id, turn, t, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM c WHERE role = 'user'),
  w AS (SELECT conv_id, n, unnest(l) AS term, generate_subscripts(l, 1) AS i FROM (SELECT conv_id, n, regexp_extract_all(t, '[a-z]+') AS l FROM u WHERE n <= 3)), f AS (SELECT conv_id, term, min(row(n, i)) AS o FROM w WHERE length(term) > 3 GROUP BY 1, 2),
  k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY o) AS place FROM f) SELECT conv_id, term, place FROM k WHERE place <= 12""")
def w25(spark, d):
    u = turns(spark, d).filter("role = 'user'").withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).filter("n <= 3")
    w = u.select("conv_id", "n", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("i", "term")).filter(F.length("term") > 3)
    first = w.groupBy("conv_id", "term").agg(F.min(F.struct("n", "i")).alias("o"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("o")).cast("long")
    return first.withColumn("place", place).filter("place <= 12").select("conv_id", "term", "place")


@query("f37_numbers", "SELECT doc_id, len(regexp_extract_all(text, '[0-9]+(?:,[0-9]{3})*(?:\\.[0-9]+)?')) AS n, coalesce(list_max(list_transform(regexp_extract_all(text, '[0-9]+(?:,[0-9]{3})*(?:\\.[0-9]+)?'), lambda x: length(replace(x, ',', '')))), 0) AS longest FROM documents")
def f37(spark, d):
    rows = docs(spark, d).select("doc_id", text.numbers(F.col("text")).alias("n"))
    return rows.select("doc_id", F.size("n").cast("long").alias("n"), F.coalesce(F.array_max(F.transform("n", F.length)), F.lit(0)).cast("long").alias("longest"))


ANS_SQL = "ans AS (SELECT conv_id, turn, text || ' [' || (turn % 5) || '] and [' || (conv_id % 9) || ']' AS answer, 4 AS sources FROM conversations)"


@query("j27_f39_citations", f"WITH {ANS_SQL}, m AS (SELECT conv_id, turn, sources, CAST(unnest(list_distinct(regexp_extract_all(answer, '\\[([0-9]{{1,3}})\\]', 1))) AS INTEGER) AS mark FROM ans) SELECT conv_id, turn, count(*) AS markers, count(*) FILTER (mark < 1 OR mark > sources) AS unresolved FROM m GROUP BY 1, 2")
def j27(spark, d):
    answer = F.concat(F.col("text"), F.lit(" ["), F.col("turn") % 5, F.lit("] and ["), F.col("conv_id") % 9, F.lit("]"))
    m = turns(spark, d).select("conv_id", "turn", F.explode(text.citations(answer)).alias("mark"))
    return m.groupBy("conv_id", "turn").agg(F.count("*").alias("markers"), F.count_if((F.col("mark") < 1) | (F.col("mark") > 4)).alias("unresolved"))


@query("f38_unsourced_numbers", "WITH a AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(text, '[0-9]+'))) AS n FROM conversations), b AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(text, '[0-9]+')) AS n FROM conversations WHERE turn = 0) SELECT conv_id, turn, count(*) AS unsourced FROM a WHERE turn > 0 AND NOT EXISTS (SELECT 1 FROM b WHERE b.conv_id = a.conv_id AND b.n = a.n) GROUP BY 1, 2")
def f38(spark, d):
    found = F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)))
    n = turns(spark, d).select("conv_id", "turn", F.explode(found).alias("n"))
    return n.filter("turn > 0").join(n.filter("turn = 0").select("conv_id", "n").distinct(), ["conv_id", "n"], "left_anti").groupBy("conv_id", "turn").agg(F.count("*").alias("unsourced"))


@query("f40_f41_redacted_snippets", "WITH r AS (SELECT doc_id, regexp_replace(regexp_replace(text, 'AKIA[A-Z0-9]{16}', '[key]', 'g'), '(password|token|secret)(\\s*[=:]\\s*)(\\S+)', '\\1\\2[hidden]', 'g') AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 200 THEN rtrim(left(t, 200), ' ') || '...' ELSE t END AS snippet FROM r")
def f40(spark, d):
    return docs(spark, d).select("doc_id", text.snippet(text.redacted_keys(F.col("text")), 200).alias("snippet"))


@query("f43_url_basename", "SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base FROM pages")
def f43(spark, d):
    return table(spark, d, "pages").select("page_id", text.basename(F.col("url")).alias("base"))


@query("f46_script", "SELECT doc_id, CASE WHEN regexp_matches(text, '[ऀ-ॿ]') THEN 'devanagari' WHEN regexp_matches(text, '[஀-௿]') THEN 'tamil' WHEN regexp_matches(text, '[Ѐ-ӿ]') THEN 'cyrillic' WHEN regexp_matches(text, '[À-ɏ]') THEN 'latin-ext' WHEN regexp_matches(text, '[A-Za-z]') THEN 'latin' ELSE 'none' END AS script FROM documents")
def f46(spark, d):
    return docs(spark, d).select("doc_id", text.script(F.col("text")).alias("script"))


@query("f34_content_terms", f"SELECT conv_id, turn, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9-]*'), lambda w: length(w) > 2 AND w NOT IN ({STOPS})))) AS terms FROM conversations")
def f34(spark, d):
    return turns(spark, d).select("conv_id", "turn", F.size(text.content_terms(F.col("text"))).cast("long").alias("terms"))


@query("f47_query_expansion", "SELECT event_id, list_aggregate(list_distinct(CASE event_type WHEN 'error' THEN ['error', 'fault', 'failure'] WHEN 'click' THEN ['click', 'tap'] ELSE [event_type] END), 'count') AS n, CASE event_type WHEN 'error' THEN 'error fault failure' WHEN 'click' THEN 'click tap' ELSE event_type END AS expanded FROM events")
def f47(spark, d):
    more = F.create_map(F.lit("error"), F.array(F.lit("fault"), F.lit("failure")), F.lit("click"), F.array(F.lit("tap")))
    words = F.array_distinct(F.concat(F.array("event_type"), F.coalesce(more[F.col("event_type")], F.array().cast("array<string>"))))
    return table(spark, d, "events").select("event_id", F.size(words).cast("long").alias("n"), F.array_join(words, " ").alias("expanded"))


@query("o11_u05_ledger", "WITH f AS (SELECT conv_id, role, lower(left(text, 12)) AS k, min(turn) AS turn FROM conversations GROUP BY 1, 2, 3), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, k) AS number FROM f) SELECT conv_id, turn, number FROM n WHERE number <= 3")
def o11(spark, d):
    first = turns(spark, d).groupBy("conv_id", "role", F.lower(F.left("text", F.lit(12))).alias("k")).agg(F.min("turn").alias("turn"))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "k")).cast("long")
    return first.withColumn("number", number).filter("number <= 3").select("conv_id", "turn", "number")


@query("d27_answer_checks", f"WITH {ANS_SQL} SELECT conv_id % 4 AS category, count(*) AS cases, count(*) FILTER (len(answer) >= 40) AS long_enough, count(*) FILTER (NOT contains(lower(answer), 'cannot')) AS no_refusal, count(*) FILTER (conv_id % 9 BETWEEN 1 AND 4) AS resolved FROM ans GROUP BY ROLLUP (conv_id % 4)")
def d27(spark, d):
    answer = F.concat(F.col("text"), F.lit(" ["), F.col("turn") % 5, F.lit("] and ["), F.col("conv_id") % 9, F.lit("]"))
    rows = turns(spark, d).select((F.col("conv_id") % 4).alias("category"), answer.alias("answer"), F.col("conv_id"))
    return rows.rollup("category").agg(F.count("*").alias("cases"), F.count_if(F.length("answer") >= 40).alias("long_enough"), F.count_if(~F.lower("answer").contains("cannot")).alias("no_refusal"), F.count_if((F.col("conv_id") % 9).between(1, 4)).alias("resolved"))


@query("x35_name_in_corpus", "WITH s AS (SELECT conv_id, turn, regexp_replace(lower(text), '\\s+', ' ', 'g') AS t FROM conversations) SELECT conv_id, turn, contains(t, 'in the') AS named FROM s")
def x35(spark, d):
    return turns(spark, d).select("conv_id", "turn", F.regexp_replace(F.lower("text"), r"\s+", " ").contains("in the").alias("named"))


@query("x43_coverage_gap", "SELECT event_type AS class, count(*) AS n, event_type NOT IN ('error', 'click') AS gap FROM events GROUP BY event_type")
def x43(spark, d):
    covered = spark.createDataFrame([("error",), ("click",)], "k string")
    n = table(spark, d, "events").groupBy(F.col("event_type").alias("class")).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(covered), n["class"] == F.col("k"), "left").select("class", "n", F.col("k").isNull().alias("gap"))


@query("u03_u04_set_operations", "SELECT (SELECT count(*) FROM (SELECT DISTINCT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS unlabelled, (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS labelled")
def u03(spark, d):
    ids, named = docs(spark, d).select("doc_id"), table(spark, d, "labels").select("doc_id")
    return ids.subtract(named).agg(F.count("*").alias("unlabelled")).crossJoin(ids.intersect(named).agg(F.count("*").alias("labelled")))


LAB_SQL = "p AS (SELECT doc_id, quality AS y, ((doc_id * 37) % 1000) / 1000.0 AS p FROM labels)"


def predictions(spark, d):
    return table(spark, d, "labels").select("doc_id", F.col("quality").alias("y"), (F.pmod(F.col("doc_id") * 37, F.lit(1000)) / 1000.0).alias("p"))


@query("a18_reliability", f"WITH {LAB_SQL}, b AS (SELECT least(CAST(floor(p * 10) AS INTEGER), 9) AS bin, p, y FROM p) SELECT CAST(r.bin AS INTEGER) AS bin, count(b.bin) AS n, {R6.format('avg(p)')} AS mean_p, {R6.format('avg(y)')} AS observed, {R6.format('abs(avg(p) - avg(y))')} AS gap FROM range(10) r(bin) LEFT JOIN b ON b.bin = r.bin GROUP BY r.bin")
def a18(spark, d):
    b = predictions(spark, d).withColumn("bin", F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("int"))
    every = spark.range(10).select(F.col("id").cast("int").alias("bin"))
    g = b.groupBy("bin").agg(F.count("*").alias("n"), rounded(F.avg("p"), 6).alias("mean_p"), rounded(F.avg("y"), 6).alias("observed"), rounded(F.abs(F.avg("p") - F.avg("y")), 6).alias("gap"))
    return every.join(g, "bin", "left").fillna(0, ["n"])


@query("a18_calibration_error", f"WITH {LAB_SQL}, b AS (SELECT least(CAST(floor(p * 10) AS INTEGER), 9) AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM p GROUP BY 1) SELECT {R6.format('sum(n * gap) / sum(n)')} AS ece FROM b")
def ece(spark, d):
    b = predictions(spark, d).groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg("p") - F.avg("y")).alias("gap"))
    return b.agg(rounded(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 6).alias("ece"))


@query("a19_a34_fold_log_loss", f"WITH {LAB_SQL}, z AS (SELECT doc_id % 5 AS fold, y, ln(greatest(least(p, 0.9999), 0.0001) / (1 - greatest(least(p, 0.9999), 0.0001))) AS z FROM p) SELECT fold, {R6.format('avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z))))')} AS loss FROM z GROUP BY fold")
def a19(spark, d):
    from fathomline.functions.score import log_loss, logit

    return predictions(spark, d).groupBy((F.col("doc_id") % 5).alias("fold")).agg(rounded(F.avg(log_loss(logit(F.col("p")), F.col("y"))), 6).alias("loss"))


@query("s13_page_titles", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang FROM pages")
def s13(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"))


@query("f45_sentences", "SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: length(trim(s)) > 0)) AS n FROM documents")
def f45(spark, d):
    return docs(spark, d).select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("n"))


#: Twelve hex digits of a digest say the place, the next four the sign.
SIGN_SQL = "md5('0:' || r || ':' || term) AS h FROM weight, range(4) t(r)"


@query("d19_projected", f"""WITH {TERM_SQL}, s AS (SELECT doc_id, w, {SIGN_SQL}), p AS (SELECT doc_id, CAST('0x' || h[1:12] AS BIGINT) % 64 AS dim, CAST(sum(CAST(CASE WHEN CAST('0x' || h[13:16] AS BIGINT) % 2 = 0 THEN w ELSE -w END AS DECIMAL(18,12))) AS DOUBLE) AS v FROM s GROUP BY 1, 2)
  SELECT doc_id, dim, {R6.format('v / sqrt(sum(v * v) OVER (PARTITION BY doc_id))')} AS v FROM p WHERE v <> 0""")
def d19(spark, d):
    found = projection.projected(index(spark, d)[0], "doc_id", 64, 4)
    return found.select("doc_id", "dim", rounded(F.col("v"), 6).alias("v"))


@query("d20_catalogue_matches", f"""WITH {VEC_SQL}, p AS (SELECT u.vec_id, c.vec_id AS entry, {R6.format('list_inner_product(u.e, c.e)')} AS score FROM u JOIN u c ON c.vec_id % 50 = 0)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, entry) AS rank FROM p) WHERE rank <= 3 AND score > 0""")
def d20(spark, d):
    v = table(spark, d, "embeddings").withColumn("text", F.lit(""))
    catalogue = v.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "entry")
    return projection.catalogue_matches(v, catalogue, "vec_id", "entry", "text")

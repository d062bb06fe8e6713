"""Text operators over documents, benchmark and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helioscope.functions import extract
from helioscope.functions import text as T
from helioscope.operators.graph import cut, neighbour_similarity
from helioscope.operators.prefix import lagged
from helioscope.plans.registry import query
from helioscope.session import load

WORDS = "SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents"


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", T.words(F.col("text")).alias("w"))


@query(f"WITH t AS ({WORDS}), x AS (SELECT unnest(w) AS token FROM t) SELECT token, count(*) AS n FROM x GROUP BY ALL")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return tokens(spark, d).select(F.explode("w").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH t AS ({WORDS}), x AS (SELECT doc_id, unnest(w) AS token FROM t), c AS (SELECT doc_id, token, count(*) AS tf FROM x GROUP BY ALL), f AS (SELECT token, count(*) AS df FROM c GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents)
    SELECT doc_id, round(max(tf * ln((1 + n) / (1 + df))), 5) AS top_tfidf, count(*) AS terms FROM c JOIN f USING (token), n GROUP BY ALL""")
def tfidf_summary(spark: SparkSession, d: str) -> DataFrame:
    t = tokens(spark, d)
    c = t.select("doc_id", F.explode("w").alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("tf"))
    c = cut(c)
    f = c.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    n = F.broadcast(t.agg(F.count(F.lit(1)).alias("n")))
    w = F.col("tf") * F.ln((1 + F.col("n")) / (1 + F.col("df")))
    return c.join(f, "token").crossJoin(n).groupBy("doc_id").agg(F.round(F.max(w), 5).alias("top_tfidf"), F.count(F.lit(1)).alias("terms"))


@query(f"WITH t AS ({WORDS}), x AS (SELECT unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END) AS gram FROM t) SELECT gram, count(*) AS n FROM x GROUP BY ALL HAVING count(*) > 1")
def ngrams_word(spark: SparkSession, d: str) -> DataFrame:
    return tokens(spark, d).select(F.explode(T.ngrams(F.col("w"), 2)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("""WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark), x AS (SELECT item_id, unnest(list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), CASE WHEN len(w) > 2 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 2]) ELSE [] END)) AS pair FROM t)
    SELECT item_id, pair, count(*) AS n FROM x GROUP BY ALL""")
def skip_grams(spark: SparkSession, d: str) -> DataFrame:
    w = load(spark, d, "benchmark").select("item_id", T.words(F.col("text")).alias("w"))
    return w.select("item_id", F.explode(T.skipgrams(F.col("w"), 1)).alias("pair")).groupBy("item_id", "pair").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH t AS ({WORDS}), p AS (SELECT unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: struct_pack(a := w[i], b := w[i + 1])) ELSE [] END) AS p FROM t), c AS (SELECT p.a AS a, p.b AS b, count(*) AS n FROM p GROUP BY ALL),
    m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS s FROM c) SELECT a, b, n, round(ln(n * s / (na * nb)), 5) AS pmi FROM m WHERE n >= 5""")
def collocations(spark: SparkSession, d: str) -> DataFrame:
    c = cut(tokens(spark, d).select(F.inline(T.neighbours(F.col("w")))).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))
    na, nb = c.groupBy("a").agg(F.sum("n").alias("na")), c.groupBy("b").agg(F.sum("n").alias("nb"))
    s = F.broadcast(c.agg(F.sum("n").alias("s")))
    x = c.where("n >= 5").join(na, "a").join(nb, "b").crossJoin(s)
    return x.select("a", "b", "n", F.round(F.ln(F.col("n") * F.col("s") / (F.col("na") * F.col("nb"))), 5).alias("pmi"))


@query("""WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark)
    SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS jaccard FROM t a JOIN t b ON a.item_id < b.item_id WHERE len(list_intersect(a.w, b.w)) > 0""")
def jaccard_benchmark_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that share a word, found over the words; set sizes give the union."""
    w = load(spark, d, "benchmark").select("item_id", F.array_distinct(T.words(F.col("text"))).alias("w"))
    e = w.select("item_id", F.size("w").alias("k"), F.explode("w").alias("token"))
    a, b = e.select(F.col("item_id").alias("a"), F.col("k").alias("ka"), "token"), e.select(F.col("item_id").alias("b"), F.col("k").alias("kb"), "token")
    c = a.join(b, "token").where("a < b").groupBy("a", "b", "ka", "kb").agg(F.count(F.lit(1)).alias("n"))
    return c.select("a", "b", F.round(F.col("n") / (F.col("ka") + F.col("kb") - F.col("n")), 6).alias("jaccard"))


@query("""WITH t AS (SELECT item_id, regexp_replace(lower(text), '[^a-z ]', '', 'g') AS s FROM benchmark)
    SELECT item_id, levenshtein(s, lag(s) OVER (ORDER BY item_id)) AS distance FROM t""")
def levenshtein_benchmark(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "benchmark").select("item_id", F.regexp_replace(F.lower("text"), "[^a-z ]", "").alias("s"))
    return lagged(x, ["s"], "item_id").select("item_id", F.levenshtein("s", "last_s").cast("bigint").alias("distance"))


@query()
def skip_grams_documents(spark: SparkSession, d: str) -> DataFrame:
    return tokens(spark, d).select("doc_id", F.explode(T.skipgrams(F.col("w"), 1)).alias("pair")).groupBy("doc_id", "pair").agg(F.count(F.lit(1)).alias("n"))


@query()
def jaccard_document_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that share a word, found over the words."""
    e = tokens(spark, d).select(F.col("doc_id").alias("src"), F.explode(F.array_distinct("w")).alias("dst"))
    return neighbour_similarity(e, 6).select("a", "b", "jaccard")


@query("""SELECT doc_id, length(text) AS chars, len(regexp_extract_all(text, '[A-Za-z]+')) AS words, len(regexp_extract_all(text, '[0-9]')) AS digits, len(regexp_extract_all(text, '[A-Z]')) AS capitals, len(regexp_extract_all(text, '\\n')) AS newlines,
    len(regexp_extract_all(text, 'https?://')) AS urls, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+')) AS emails FROM documents""")
def text_stats(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    n = lambda p: T.count_matches(t, p).cast("bigint")
    return load(spark, d, "documents").select("doc_id", F.length(t).cast("bigint").alias("chars"), n("[A-Za-z]+").alias("words"), n("[0-9]").alias("digits"), n("[A-Z]").alias("capitals"), n("\n").alias("newlines"), n("https?://").alias("urls"), n("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+").alias("emails"))


@query(f"""WITH t AS ({WORDS}), x AS (SELECT doc_id, unnest(w) AS token FROM t), c AS (SELECT doc_id, token, count(*) AS n FROM x GROUP BY ALL)
    SELECT doc_id, round(count(*) / sum(n), 6) AS type_token, round(ln(max(t)) - sum(n * ln(n)) / max(t), 5) + 0 AS entropy, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END)::BIGINT AS hapaxes FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS t FROM c) GROUP BY ALL""")
def lexical_diversity(spark: SparkSession, d: str) -> DataFrame:
    c = tokens(spark, d).select("doc_id", F.explode("w").alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))
    # -sum(n/t ln(n/t)) = ln t - sum(n ln n) / t, so one aggregate does
    t = F.sum("n")
    return c.groupBy("doc_id").agg(F.round(F.count(F.lit(1)) / t, 6).alias("type_token"), (F.round(F.ln(t) - F.sum(F.col("n") * F.ln("n")) / t, 5) + 0).alias("entropy"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("hapaxes"))


@query("""WITH h AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w, lag(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) OVER (ORDER BY item_id) AS r FROM benchmark)
    SELECT item_id, round(len(list_intersect(w, r)) / len(w), 6) AS precision, round(len(list_intersect(w, r)) / len(r), 6) AS recall FROM h WHERE r IS NOT NULL AND len(w) > 0 AND len(r) > 0""")
def rouge1_benchmark(spark: SparkSession, d: str) -> DataFrame:
    w = F.array_distinct(T.words(F.col("text")))
    x = load(spark, d, "benchmark").select("item_id", w.alias("w"))
    x = lagged(x, ["w"], "item_id").withColumnRenamed("last_w", "r").where("r IS NOT NULL AND size(w) > 0 AND size(r) > 0")
    n = F.size(F.array_intersect("w", "r"))
    return x.select("item_id", F.round(n / F.size("w"), 6).alias("precision"), F.round(n / F.size("r"), 6).alias("recall"))


@query("""SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns, string_agg(role, '>' ORDER BY turn) AS path, max(length(text)) AS longest FROM conversations GROUP BY ALL""")
def conversation_paths(spark: SparkSession, d: str) -> DataFrame:
    p = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return load(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.array_join(p, ">").alias("path"), F.max(F.length("text")).cast("bigint").alias("longest"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT line, count(DISTINCT doc_id) AS docs FROM l WHERE length(line) > 20 GROUP BY ALL HAVING count(DISTINCT doc_id) > 1""")
def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") > 20)
    return x.groupBy("line").agg(F.count_distinct("doc_id").alias("docs")).where("docs > 1")


@query("""SELECT page_id, regexp_extract(url, '^https?://([^/:]+)', 1) AS host, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS text_chars, len(regexp_extract_all(html, '<a ')) AS links FROM pages""")
def page_stats(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/:]+)", 1).alias("host"), F.length(F.regexp_replace("html", "<[^>]*>", "")).cast("bigint").alias("text_chars"), T.count_matches(F.col("html"), "<a ").cast("bigint").alias("links"))


KINDS = " UNION ALL ".join(f"SELECT o_orderkey, '{k}' AS kind, unnest(regexp_extract_all(t, '{p}')) AS x FROM s" for k, p in [*extract.ENTITIES.items(), *((f"temporal_{k}", p) for k, p in extract.TEMPORAL.items())])


@query(f"""WITH s AS (SELECT o_orderkey, 'On ' || strftime(o_orderdate, '%Y-%m-%d') || ' order ' || o_orderkey || ' cost $' || floor(o_totalprice)::BIGINT || ', due in ' || o_orderkey % 40 || ' days or next Monday; write to c' || o_custkey || '@example.org, see https://example.org/o/' || o_orderkey || ' or call 555-' || (100 + o_orderkey % 900) || '-0199 between 9:00 - 17:30 in Summer' AS t FROM orders),
    k AS ({KINDS}) SELECT o_orderkey, kind, count(*) AS n, min(x) AS least, max(x) AS most FROM k GROUP BY ALL""")
def extracted_expressions(spark: SparkSession, d: str) -> DataFrame:
    """Entities and expressions of time in a sentence on each order."""
    k = F.col("o_orderkey")
    words = ["On ", F.date_format("o_orderdate", "yyyy-MM-dd"), " order ", k, " cost $", F.floor("o_totalprice").cast("bigint"), ", due in ", k % 40, " days or next Monday; write to c", F.col("o_custkey")]
    words += ["@example.org, see https://example.org/o/", k, " or call 555-", 100 + k % 900, "-0199 between 9:00 - 17:30 in Summer"]
    t = load(spark, d, "orders").select("o_orderkey", F.concat(*(F.lit(w) if isinstance(w, str) else w.cast("string") for w in words)).alias("t"))
    x = t.select("o_orderkey", F.inline(F.concat(extract.entities(F.col("t")), extract.temporal(F.col("t")))))
    return x.groupBy("o_orderkey", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("least"), F.max("text").alias("most"))

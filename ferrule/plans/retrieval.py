"""Search over documents, elements and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.functions.text import TOKEN, humanize_name
from ferrule.operators import search
from ferrule.plans.registry import Registry
from ferrule.plans.statistics import CUR
from ferrule.sources.tables import current_elements, table

R = Registry()
TOKENS_SQL = f"regexp_extract_all(lower({{0}}), '{TOKEN.replace(chr(123), chr(123) * 2).replace(chr(125), chr(125) * 2)}')"
QUERY = ["nightly", "rebuild", "cache"]


def bm25_sql(source: str, key: str, text: str, terms: list[str], boost: float = 1.0) -> str:
    tf = ", ".join(f"len(list_filter(ts, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(terms)))
    some = " OR ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""(WITH docs AS (SELECT {key}, {TOKENS_SQL.format(text)} AS ts FROM {source} WHERE {text} IS NOT NULL), c AS (SELECT {key}, len(ts) AS dl, {tf} FROM docs WHERE len(ts) > 0),
 g AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM c) SELECT {key}, {boost} * ({score}) AS score FROM c, g WHERE {some})"""


@R.query("search_regexp", f"WITH {CUR} SELECT element_id FROM cur WHERE length(raw_code) <= 8191 AND regexp_matches(raw_code, 'except [A-Z][A-Za-z]+Error|throw new') AND element_type IN ('function', 'method')")
def search_regexp(spark: SparkSession, d: str) -> DataFrame:
    rows = current_elements(spark, d, "element_id", "element_type", "raw_code", types=("function", "method")).where(F.col("element_type").isin("function", "method"))
    return rows.where((F.length("raw_code") <= search.KEYWORD_LIMIT) & F.col("raw_code").rlike("except [A-Z][A-Za-z]+Error|throw new")).select("element_id")


@R.query("search_wildcard", "SELECT doc_id FROM documents WHERE length(text) <= 8191 AND text ILIKE '%keeps % rows%'")
def search_wildcard(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(search.wildcard(F.col("text"), "*keeps * rows*")).select("doc_id")


@R.query("search_proximity", f"""WITH t AS (SELECT doc_id, {TOKENS_SQL.format("text")} AS ts FROM documents), p AS (SELECT doc_id, unnest(ts) AS w, generate_subscripts(ts, 1) AS i FROM t),
 a AS (SELECT doc_id, i FROM p WHERE w = 'tests'), b AS (SELECT doc_id, i - 1 AS i FROM p WHERE w = 'compare'), c AS (SELECT doc_id, i - 2 AS i FROM p WHERE w = 'expect')
 SELECT DISTINCT a.doc_id FROM a JOIN b USING (doc_id) JOIN c USING (doc_id) WHERE greatest(a.i, b.i, c.i) - least(a.i, b.i, c.i) <= 8""")
def search_proximity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(search.proximity(F.col("text"), ["tests", "compare", "expect"], 8)).select("doc_id")


@R.query("find_files_glob", "SELECT DISTINCT repository, relative_path FROM file_states WHERE relative_path LIKE 'src/%\\_1%.ts' ESCAPE '\\'")
def find_files_glob(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_states").where(search.glob(F.col("relative_path"), "src/**_1*.ts")).select("repository", "relative_path").distinct()


@R.query("find_by_name", f"WITH {CUR} SELECT element_id, element_type FROM cur WHERE name IN ('log', 'index', 'publish_registry') OR lower(name) LIKE 'scan%'")
def find_by_name(spark: SparkSession, d: str) -> DataFrame:
    return current_elements(spark, d, "element_id", "element_type", "name").where(F.col("name").isin("log", "index", "publish_registry") | F.lower("name").startswith("scan")).select("element_id", "element_type")


@R.query("bm25_documents", f"SELECT doc_id, round(score, 8) AS score FROM {bm25_sql('documents', 'doc_id', 'text', QUERY)}")
def bm25_documents(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(table(spark, d, "documents"), "doc_id", "text", QUERY).select("doc_id", F.round("score", 8).alias("score"))


HUMAN_SQL = r"trim(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '_+', ' ', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '\s+', ' ', 'g')))"
WORDS = ["stale", "registry", "path"]


@R.query("bm25_best_fields", f"WITH {CUR}, f AS (SELECT element_id, {HUMAN_SQL.format('name')} AS name_text, docstring, signature FROM cur), s AS (SELECT * FROM {bm25_sql('f', 'element_id', 'name_text', WORDS, 3.0)} UNION ALL SELECT * FROM {bm25_sql('f', 'element_id', 'docstring', WORDS)} UNION ALL SELECT * FROM {bm25_sql('f', 'element_id', 'signature', WORDS, 2.0)}) SELECT element_id, round(max(score), 8) AS score FROM s GROUP BY 1")
def bm25_best_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = current_elements(spark, d, "element_id", "name", "docstring", "signature").withColumn("name_text", humanize_name(F.col("name")))
    return search.best_fields(rows, "element_id", {"name_text": 3.0, "docstring": 1.0, "signature": 2.0}, WORDS).select("element_id", F.round("score", 8).alias("score"))


@R.query("fuzzy_vocabulary", f"WITH w AS (SELECT unnest({TOKENS_SQL.format('text')}) AS token FROM documents), v AS (SELECT token, count(*) AS n FROM w GROUP BY 1) SELECT token, n FROM v WHERE abs(length(token) - 8) <= 2 AND levenshtein(token, 'registri') <= 2")
def fuzzy_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return search.fuzzy_terms(table(spark, d, "documents"), "text", "registri")


@R.query("highlight", "SELECT doc_id, regexp_replace(text, '(?i)\\b(nightly|rebuild)\\b', '<em>\\1</em>', 'g') AS marked FROM documents WHERE regexp_matches(text, '(?i)\\b(nightly|rebuild)\\b')")
def highlight(spark: SparkSession, d: str) -> DataFrame:
    p = r"(?i)\b(nightly|rebuild)\b"
    return table(spark, d, "documents").where(F.col("text").rlike(p)).select("doc_id", F.regexp_replace("text", p, "<em>$1</em>").alias("marked"))


VEC_SQL = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


@R.query("knn_min_score", f"WITH {VEC_SQL}, q AS (SELECT vec FROM v WHERE id = 7) SELECT v.id, round(list_cosine_similarity(v.vec, q.vec), 6) AS score FROM v, q WHERE v.id <> 7 AND list_cosine_similarity(v.vec, q.vec) >= 0.3")
def knn_min_score(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    q = rows.where("id = 7").select(F.col("vec").alias("q"))  # one row
    return rows.where("id <> 7").join(F.broadcast(q)).withColumn("s", search.cosine(F.col("vec"), F.col("q"))).where("s >= 0.3").select("id", F.round("s", 6).alias("score"))


@R.query("semantic_topk", f"WITH {VEC_SQL}, s AS (SELECT a.id AS query_id, b.id, list_cosine_similarity(a.vec, b.vec) AS score FROM v a, v b WHERE a.id % 50 = 0 AND a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS place FROM s WHERE score >= 0.1) SELECT query_id, id, round(score, 6) AS score, CAST(place AS INTEGER) AS place FROM r WHERE place <= 10")
def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).select("id", "vec")
    return search.exact_topk(rows.where("id % 50 = 0"), rows, 10, 0.1).select("query_id", "id", F.round("score", 6).alias("score"), "place")


@R.query("rrf_three_signals", f"""WITH {VEC_SQL}, s AS (SELECT a.id AS query_id, b.id, list_cosine_similarity(a.vec, b.vec) AS s1, CAST(a.label = b.label AS DOUBLE) AS s2, -CAST(abs(a.id - b.id) AS DOUBLE) AS s3 FROM v a, v b WHERE a.id % 50 = 0 AND a.id <> b.id),
 r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(s1, 9) DESC, id) AS r1, row_number() OVER (PARTITION BY query_id ORDER BY s2 DESC, id) AS r2, row_number() OVER (PARTITION BY query_id ORDER BY s3 DESC, id) AS r3 FROM s),
 f AS (SELECT query_id, id, 1.0 / (60 + r1) + 1.0 / (60 + r2) + 1.0 / (60 + r3) AS rrf FROM r), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, id) AS place FROM f) SELECT query_id, id, round(rrf, 9) AS rrf FROM t WHERE place <= 10""")
def rrf_three_signals(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    n = rows.count()
    near = search.exact_topk(rows.where("id % 50 = 0").select("id", "vec"), rows.select("id", "vec"), n, -1.0)
    both = near.join(rows.select(F.col("id").alias("query_id"), F.col("label").alias("ql")), "query_id").join(rows.select("id", "label"), "id")
    key = ["query_id", "id"]
    order = Window.partitionBy("query_id")
    signals = [F.round("score", 9).desc(), (F.col("ql") == F.col("label")).desc(), F.abs(F.col("query_id") - F.col("id")).asc()]
    rrf = sum((F.lit(1.0) / (search.RRF_K + F.row_number().over(order.orderBy(s, "id"))) for s in signals), F.lit(0.0))
    ranked = both.select(*key, rrf.alias("rrf"))
    return ranked.withColumn("place", F.row_number().over(order.orderBy(F.round("rrf", 12).desc(), "id"))).where("place <= 10").select(*key, F.round("rrf", 9).alias("rrf"))


HYBRID_SQL = f"""WITH {CUR}, f AS (SELECT element_id, row_id, docstring, CAST(summary_embedding AS DOUBLE[]) AS vec FROM cur WHERE len(summary_embedding) = 64),
 q AS (SELECT vec FROM f WHERE row_id = (SELECT min(row_id) FROM f)), tx AS (SELECT * FROM {bm25_sql('f', 'element_id', 'docstring', WORDS)}),
 vx AS (SELECT f.element_id, list_cosine_similarity(f.vec, q.vec) + 1 AS score FROM f, q WHERE isfinite(list_sum(f.vec)) AND list_sum(list_transform(f.vec, lambda x: x * x)) > 0)
 SELECT coalesce(tx.element_id, vx.element_id) AS element_id, round(coalesce(tx.score, 0) / (SELECT max(score) FROM tx) + coalesce(vx.score, 0) / (SELECT max(score) FROM vx), 6) AS score
 FROM tx FULL JOIN vx USING (element_id) ORDER BY coalesce(tx.score, 0) / (SELECT max(score) FROM tx) + coalesce(vx.score, 0) / (SELECT max(score) FROM vx) DESC, 1 LIMIT 20"""


@R.query("hybrid_norm_sum", HYBRID_SQL)
def hybrid_norm_sum(spark: SparkSession, d: str) -> DataFrame:
    f = current_elements(spark, d, "element_id", "row_id", "docstring", "summary_embedding").where(F.size("summary_embedding") == 64)
    q = f.groupBy().agg(F.min_by("summary_embedding", "row_id").alias("q"))
    text = search.bm25(f, "element_id", "docstring", WORDS)
    square = F.aggregate("summary_embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    vec = f.where((square > 0) & ~F.isnan(square) & (square < float("inf"))).join(F.broadcast(q)).select("element_id", (search.cosine(F.col("summary_embedding"), F.col("q")) + 1).alias("vec_score"))
    top = F.broadcast(text.agg(F.max("score").alias("t")).join(vec.agg(F.max("vec_score").alias("v"))))
    both = text.join(vec, "element_id", "full").join(top)
    score = F.coalesce("score", F.lit(0.0)) / F.col("t") + F.coalesce("vec_score", F.lit(0.0)) / F.col("v")
    return both.select("element_id", score.alias("raw")).orderBy(F.col("raw").desc(), "element_id").limit(20).select("element_id", F.round("raw", 6).alias("score"))

"""Counts, facets, roll-ups, top-k and collapse over elements, files and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.functions import tiers
from ferrule.plans.registry import Registry
from ferrule.sources.tables import current_elements, latest_per_key, newest_files, table

R = Registry()

#: SQL of the current rows of code_elements and the newest rows of file_states.
CUR = "cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY element_id ORDER BY indexed_at DESC NULLS LAST, row_id DESC) AS rn FROM code_elements) WHERE rn = 1)"
NEW = "newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repository, username, relative_path ORDER BY scanned_at DESC NULLS LAST, row_id DESC) AS rn FROM file_states) WHERE rn = 1)"
TYPES = ["class", "constant", "file", "function", "method", "namespace", "variable"]


@R.query("repo_stats", f"WITH {CUR} SELECT scope, repository, count(*) AS n_elements, count(*) FILTER (element_type = 'file') AS n_files, count(DISTINCT language) AS n_languages, CAST(sum(line_end - line_start + 1) FILTER (element_type = 'file') AS BIGINT) AS n_lines FROM cur GROUP BY 1, 2")
def repo_stats(spark: SparkSession, d: str) -> DataFrame:
    is_file = F.col("element_type") == "file"
    return current_elements(spark, d, "scope", "repository", "element_type", "language", "line_start", "line_end").groupBy("scope", "repository").agg(
        F.count("*").alias("n_elements"), F.count_if(is_file).alias("n_files"), F.count_distinct("language").alias("n_languages"), F.sum(F.when(is_file, F.col("line_end") - F.col("line_start") + 1)).alias("n_lines")
    )


@R.query("repo_languages", f"""WITH {CUR}, n AS (SELECT scope, repository, language, count(*) AS n FROM cur GROUP BY 1, 2, 3),
  r AS (SELECT *, row_number() OVER (PARTITION BY scope, repository ORDER BY n DESC, language) AS place FROM n) SELECT scope, repository, language, n AS n_elements, CAST(place AS INTEGER) AS place FROM r WHERE place <= 20""")
def repo_languages(spark: SparkSession, d: str) -> DataFrame:
    n = current_elements(spark, d, "scope", "repository", "language").groupBy("scope", "repository", "language").agg(F.count("*").alias("n_elements"))
    w = Window.partitionBy("scope", "repository").orderBy(F.col("n_elements").desc(), "language")
    return n.withColumn("place", F.row_number().over(w)).where("place <= 20")


@R.query("dashboard_pivot", f"WITH {CUR} SELECT repository, " + ", ".join(f"count(*) FILTER (element_type = '{t}') AS n_{t}" for t in TYPES) + ", count(*) FILTER (docstring IS NOT NULL AND trim(docstring) <> '') AS n_documented, count(*) FILTER (is_test) AS n_tests, count(*) FILTER (is_async) AS n_async, count(DISTINCT username) AS n_users FROM cur GROUP BY 1")
def dashboard_pivot(spark: SparkSession, d: str) -> DataFrame:
    rows = current_elements(spark, d, "repository", "username", "element_type", "docstring", "is_test", "is_async")
    return rows.groupBy("repository").agg(
        *[F.count_if(F.col("element_type") == t).alias(f"n_{t}") for t in TYPES], F.count_if(F.trim("docstring") != "").alias("n_documented"), F.count_if("is_test").alias("n_tests"), F.count_if("is_async").alias("n_async"), F.count_distinct("username").alias("n_users")
    )


@R.query("browse_stats", f"WITH {CUR} SELECT element_type, language, count(*) AS n FROM cur GROUP BY GROUPING SETS ((element_type), (language), ())")
def browse_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = current_elements(spark, d, "element_type", "language")
    t, g = F.col("element_type"), F.col("language")
    return rows.groupingSets([[t], [g], []], t, g).agg(F.count("*").alias("n"))


@R.query("browse_filters", " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS facet, {c} AS value FROM code_elements" for c in ("scope", "repository", "username", "element_type", "language")))
def browse_filters(spark: SparkSession, d: str) -> DataFrame:
    cols = ["scope", "repository", "username", "element_type", "language"]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in cols]))
    return table(spark, d, "code_elements").select(*cols).distinct().select(pairs.alias("p")).select("p.*").distinct()


@R.query("search_filters", "SELECT DISTINCT source, lang, doc_type FROM documents")
def search_filters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("source", "lang", "doc_type").distinct()


@R.query("repo_users", f"WITH {CUR} SELECT repository, username, count(*) AS n_elements, count(*) FILTER (element_type = 'file') AS n_files FROM cur GROUP BY 1, 2")
def repo_users(spark: SparkSession, d: str) -> DataFrame:
    return current_elements(spark, d, "repository", "username", "element_type").groupBy("repository", "username").agg(F.count("*").alias("n_elements"), F.count_if(F.col("element_type") == "file").alias("n_files"))


@R.query("file_detail", f"WITH {CUR} SELECT repository, relative_path, element_type, count(*) AS n, count(DISTINCT username) AS n_contributors, min(line_start) AS first_line, max(line_end) AS last_line FROM cur GROUP BY 1, 2, 3")
def file_detail(spark: SparkSession, d: str) -> DataFrame:
    return current_elements(spark, d, "repository", "relative_path", "element_type", "username", "line_start", "line_end").groupBy("repository", "relative_path", "element_type").agg(
        F.count("*").alias("n"), F.count_distinct("username").alias("n_contributors"), F.min("line_start").alias("first_line"), F.max("line_end").alias("last_line")
    )


@R.query("pattern_terms", f"""WITH {CUR}, x AS (SELECT unnest(decorators) AS pattern, element_id FROM cur),
 r AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY element_id) AS place, count(*) OVER (PARTITION BY pattern) AS n FROM x) SELECT pattern, n, list(element_id ORDER BY place) AS examples FROM r WHERE place <= 3 GROUP BY 1, 2""")
def pattern_terms(spark: SparkSession, d: str) -> DataFrame:
    x = current_elements(spark, d, "element_id", "decorators").select(F.explode("decorators").alias("pattern"), "element_id")
    n = x.groupBy("pattern").agg(F.count("*").alias("n"))
    w = Window.partitionBy("pattern").orderBy("element_id")
    few = x.withColumn("place", F.row_number().over(w)).where("place <= 3")
    return few.groupBy("pattern").agg(F.array_sort(F.collect_list("element_id")).alias("examples")).join(n, "pattern")


@R.query("incomplete_files", f"WITH {CUR} SELECT repository, username, relative_path, count(*) AS n_incomplete FROM cur WHERE element_type IN ('function', 'method') AND docstring IS NOT NULL AND trim(docstring) <> '' AND (summary_embedding IS NULL OR code_embedding IS NULL) GROUP BY 1, 2, 3")
def incomplete_files(spark: SparkSession, d: str) -> DataFrame:
    rows = current_elements(spark, d, "repository", "username", "relative_path", "element_type", "docstring", "summary_embedding", "code_embedding")
    return rows.where(F.col("element_type").isin("function", "method") & (F.trim("docstring") != "") & (F.col("summary_embedding").isNull() | F.col("code_embedding").isNull())).groupBy("repository", "username", "relative_path").agg(F.count("*").alias("n_incomplete"))


@R.query("index_stats", f"WITH {CUR} SELECT count(*) AS n, round(100.0 * count(summary_embedding) / count(*), 4) AS summary_pct, round(100.0 * count(code_embedding) / count(*), 4) AS code_pct, count(*) FILTER (len(summary_embedding) = 64) AS n_full FROM cur")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return current_elements(spark, d, "summary_embedding", "code_embedding").agg(
        F.count("*").alias("n"), F.round(100.0 * F.count("summary_embedding") / F.count("*"), 4).alias("summary_pct"), F.round(100.0 * F.count("code_embedding") / F.count("*"), 4).alias("code_pct"), F.count_if(F.size("summary_embedding") == 64).alias("n_full")
    )


@R.query("largest_by_type", f"WITH {CUR}, r AS (SELECT element_type, element_id, length(raw_code) AS chars, row_number() OVER (PARTITION BY element_type ORDER BY length(raw_code) DESC NULLS LAST, element_id) AS place, count(*) OVER (PARTITION BY element_type) AS n FROM cur) SELECT element_type, element_id, chars, n FROM r WHERE place = 1")
def largest_by_type(spark: SparkSession, d: str) -> DataFrame:
    rows = current_elements(spark, d, "element_type", "element_id", "raw_code").select("element_type", "element_id", F.length("raw_code").cast("long").alias("chars"))
    n = rows.groupBy("element_type").agg(F.count("*").alias("n"))
    return latest_per_key(rows.withColumn("order_id", F.col("element_id")), ["element_type"], ["chars"]).select("element_type", "chars").join(rows, ["element_type", "chars"]).groupBy("element_type", "chars").agg(F.min("element_id").alias("element_id")).join(n, "element_type")


@R.query("largest_elements", f"WITH {CUR} SELECT element_id, element_type, length(raw_code) AS chars FROM cur WHERE raw_code IS NOT NULL ORDER BY chars DESC, element_id LIMIT 25")
def largest_elements(spark: SparkSession, d: str) -> DataFrame:
    return current_elements(spark, d, "element_id", "element_type", "raw_code").where(F.col("raw_code").isNotNull()).select("element_id", "element_type", F.length("raw_code").cast("long").alias("chars")).orderBy(F.col("chars").desc(), "element_id").limit(25)


@R.query("tier_histogram", f"""WITH {CUR}, t(tier) AS (VALUES {", ".join(f"({t})" for t in tiers.TIERS)}),
 e AS (SELECT element_type, length(raw_code) AS chars, {tiers.element_tier_sql("element_type", "length(raw_code)")} AS tier FROM cur WHERE raw_code IS NOT NULL)
 SELECT CAST(t.tier AS INTEGER) AS tier, count(e.chars) AS n, max(e.chars) AS max_chars, count(*) FILTER (e.element_type = 'file') AS n_files, count(*) FILTER (e.element_type IN ('function', 'method')) AS n_functions FROM t LEFT JOIN e ON e.tier = t.tier GROUP BY 1""")
def tier_histogram(spark: SparkSession, d: str) -> DataFrame:
    rows = current_elements(spark, d, "element_type", "raw_code").where(F.col("raw_code").isNotNull()).select("element_type", F.length("raw_code").cast("long").alias("chars"))
    by = rows.withColumn("tier", tiers.element_tier(F.col("element_type"), F.col("chars"))).groupBy("tier").agg(
        F.count("*").alias("n"), F.max("chars").alias("max_chars"), F.count_if(F.col("element_type") == "file").alias("n_files"), F.count_if(F.col("element_type").isin("function", "method")).alias("n_functions")
    )
    every = spark.createDataFrame([(t,) for t in tiers.TIERS], "tier int")
    return every.join(by, "tier", "left").select("tier", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "n_files", "n_functions")], "max_chars")


@R.query("largest_functions", f"WITH {CUR} SELECT element_id, line_end - line_start + 1 AS n_lines FROM cur WHERE element_type IN ('function', 'method') AND NOT coalesce(is_test, false) AND line_end - line_start + 1 >= 10 ORDER BY n_lines DESC, element_id LIMIT 50")
def largest_functions(spark: SparkSession, d: str) -> DataFrame:
    rows = current_elements(spark, d, "element_id", "element_type", "is_test", "line_start", "line_end").withColumn("n_lines", F.col("line_end") - F.col("line_start") + 1)
    return rows.where(F.col("element_type").isin("function", "method") & ~F.coalesce("is_test", F.lit(False)) & (F.col("n_lines") >= 10)).select("element_id", "n_lines").orderBy(F.col("n_lines").desc(), "element_id").limit(50)


@R.query("async_code", f"WITH {CUR} SELECT repository, language, count(*) FILTER (is_async) AS n_async, count(*) FILTER (is_async AND is_test) AS n_async_tests FROM cur GROUP BY 1, 2 HAVING count(*) FILTER (is_async) > 0")
def async_code(spark: SparkSession, d: str) -> DataFrame:
    return current_elements(spark, d, "repository", "language", "is_async", "is_test").groupBy("repository", "language").agg(F.count_if("is_async").alias("n_async"), F.count_if(F.col("is_async") & F.col("is_test")).alias("n_async_tests")).where("n_async > 0")


@R.query("overlay_user_wins", f"WITH {CUR}, r AS (SELECT scope, repository, relative_path, element_type, name, byte_offset, username, element_id, row_number() OVER (PARTITION BY scope, repository, relative_path, element_type, name, byte_offset ORDER BY CASE WHEN username = 'main' THEN 0 ELSE 1 END DESC, username, element_id) AS place FROM cur) SELECT element_id, username FROM r WHERE place = 1")
def overlay_user_wins(spark: SparkSession, d: str) -> DataFrame:
    key = ["scope", "repository", "relative_path", "element_type", "name", "byte_offset"]
    rows = current_elements(spark, d, *key, "username", "element_id")
    w = Window.partitionBy(*key).orderBy((F.col("username") != "main").desc(), "username", "element_id")
    return rows.withColumn("place", F.row_number().over(w)).where("place = 1").select("element_id", "username")


@R.query("collapse_by_hash", f"WITH {NEW}, r AS (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY CASE WHEN username = 'main' THEN 0 ELSE 1 END, scanned_at DESC, row_id) AS place, count(*) OVER (PARTITION BY file_hash) AS n FROM newest WHERE NOT is_deleted AND file_hash IS NOT NULL) SELECT file_hash, repository, relative_path, n AS n_copies FROM r WHERE place = 1")
def collapse_by_hash(spark: SparkSession, d: str) -> DataFrame:
    rows = newest_files(spark, d, "file_hash", "repository", "username", "relative_path", "scanned_at", "row_id", "is_deleted").where("NOT is_deleted AND file_hash IS NOT NULL")
    n = rows.groupBy("file_hash").agg(F.count("*").alias("n_copies"))
    w = Window.partitionBy("file_hash").orderBy(F.col("username") != "main", F.col("scanned_at").desc(), "row_id")
    return rows.withColumn("place", F.row_number().over(w)).where("place = 1").select("file_hash", "repository", "relative_path").join(n, "file_hash")


@R.query("top_hits_per_source", "WITH r AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) AS place FROM documents) SELECT source, doc_id, n_chars, CAST(place AS INTEGER) AS place FROM r WHERE place <= 5")
def top_hits_per_source(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("source").orderBy(F.col("n_chars").desc_nulls_last(), "doc_id")
    return table(spark, d, "documents").select("source", "doc_id", "n_chars").withColumn("place", F.row_number().over(w)).where("place <= 5")


@R.query("document_terms", "SELECT source, count(*) AS n, count(DISTINCT lang) AS n_langs, mode(doc_type) AS main_type, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) FILTER (repository IS NULL) AS n_unplaced, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share_pct FROM documents GROUP BY 1")
def document_terms(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("n_langs"), F.mode("doc_type").alias("main_type"), F.sum("n_chars").alias("chars"), F.count_if(F.col("repository").isNull()).alias("n_unplaced"))
    return g.withColumn("share_pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


@R.query("counts_by_path", f"WITH {CUR} SELECT repository, username, relative_path, count(*) AS n FROM cur WHERE element_type <> 'file' GROUP BY 1, 2, 3")
def counts_by_path(spark: SparkSession, d: str) -> DataFrame:
    return current_elements(spark, d, "repository", "username", "relative_path", "element_type").where("element_type <> 'file'").groupBy("repository", "username", "relative_path").agg(F.count("*").alias("n"))


@R.query("file_tree", f"""WITH {NEW}, p AS (SELECT DISTINCT repository, string_split(relative_path, '/') AS parts FROM newest WHERE NOT is_deleted),
 x AS (SELECT repository, array_to_string(parts[1:k], '/') AS node, k = len(parts) AS is_file FROM (SELECT repository, parts, unnest(range(1, len(parts) + 1)) AS k FROM p))
 SELECT repository, node, is_file, count(*) AS n_files FROM x GROUP BY 1, 2, 3""")
def file_tree(spark: SparkSession, d: str) -> DataFrame:
    p = newest_files(spark, d, "repository", "relative_path", "is_deleted").where("NOT is_deleted").select("repository", F.split("relative_path", "/").alias("parts")).distinct()
    x = p.select("repository", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("k"))
    return x.groupBy("repository", F.array_join(F.slice("parts", F.lit(1), F.col("k")), "/").alias("node"), (F.col("k") == F.size("parts")).alias("is_file")).agg(F.count("*").alias("n_files"))


@R.query("languages_of_files", f"WITH {NEW} SELECT repository, language, count(*) AS n_files, CAST(sum(coalesce(line_count, 0)) AS BIGINT) AS n_lines, CAST(sum(file_size) AS BIGINT) AS n_bytes FROM newest WHERE NOT is_deleted GROUP BY 1, 2")
def languages_of_files(spark: SparkSession, d: str) -> DataFrame:
    return newest_files(spark, d, "repository", "language", "line_count", "file_size", "is_deleted").where("NOT is_deleted").groupBy("repository", "language").agg(F.count("*").alias("n_files"), F.sum(F.coalesce("line_count", F.lit(0))).alias("n_lines"), F.sum("file_size").alias("n_bytes"))


@R.query("processing_state", f"WITH {CUR} SELECT element_id, docstring IS NOT NULL AND trim(docstring) <> '' AS has_text, coalesce(len(summary_embedding) > 0, false) AS has_summary_vector, coalesce(len(code_embedding) > 0, false) AS has_code_vector FROM cur WHERE element_type IN ('function', 'method', 'class')")
def processing_state(spark: SparkSession, d: str) -> DataFrame:
    rows = current_elements(spark, d, "element_id", "element_type", "docstring", "summary_embedding", "code_embedding", types=("function", "method", "class")).where(F.col("element_type").isin("function", "method", "class"))
    return rows.select("element_id", F.coalesce(F.trim("docstring") != "", F.lit(False)).alias("has_text"), F.coalesce(F.size("summary_embedding") > 0, F.lit(False)).alias("has_summary_vector"), F.coalesce(F.size("code_embedding") > 0, F.lit(False)).alias("has_code_vector"))

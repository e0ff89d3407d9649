"""Scalar functions and line rules over names, code and documentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions import code as C
from ferrule.functions import text as T
from ferrule.functions import tiers
from ferrule.operators import rules
from ferrule.plans.registry import Registry
from ferrule.plans.retrieval import HUMAN_SQL
from ferrule.plans.statistics import CUR
from ferrule.sources.tables import current_elements, table

R = Registry()
BLANK = "(docstring IS NULL OR trim(regexp_replace(docstring, '\\s', ' ', 'g')) = '')"


@R.query("humanized_names", f"WITH {CUR} SELECT DISTINCT name, {HUMAN_SQL.format('name')} AS words FROM cur")
def humanized_names(spark: SparkSession, d: str) -> DataFrame:
    return current_elements(spark, d, "name").distinct().withColumn("words", T.humanize_name(F.col("name")))


@R.query("normalized_terms", """WITH t AS (SELECT DISTINCT lower(trim(w)) AS t, w FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part UNION SELECT unnest(['databases', 'classes', 'boxes', 'statuses', 'Queries', 'ies', 'analysis', 'status', 'bus', 'glass', 'matches', 'keys ', 'pies']) AS w))
 SELECT DISTINCT w AS term, CASE WHEN t LIKE '%us' OR t LIKE '%is' THEN t WHEN t LIKE '%ies' AND length(t) > 4 THEN left(t, length(t) - 3) || 'y' WHEN t LIKE '%ies' THEN t WHEN t LIKE '%sses' THEN left(t, length(t) - 2) WHEN t LIKE '%xes' OR t LIKE '%ches' OR t LIKE '%shes' THEN left(t, length(t) - 2)
  WHEN t LIKE '%ses' AND length(t) > 4 THEN left(t, length(t) - 2) WHEN t LIKE '%s' AND length(t) > 3 AND t NOT LIKE '%ss' THEN left(t, length(t) - 1) ELSE t END AS normal FROM t""")
def normalized_terms(spark: SparkSession, d: str) -> DataFrame:
    extra = ["databases", "classes", "boxes", "statuses", "Queries", "ies", "analysis", "status", "bus", "glass", "matches", "keys ", "pies"]
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("term")).union(spark.createDataFrame([(w,) for w in extra], "term string")).distinct()
    return words.withColumn("normal", T.normalize_term(F.col("term")))


@R.query("element_hashes", f"WITH {CUR} SELECT element_id, sha256(element_id) AS hash_id, substr(sha256(scope || ':' || repository || ':' || relative_path || ':' || element_type || ':' || name), 1, 12) AS short_id, sha256(coalesce(raw_code, '') || coalesce(docstring, '')) AS content_hash, element_id = scope || ':' || repository || ':' || username || ':' || relative_path || ':' || element_type || ':' || name || ':' || byte_offset AS is_regular FROM cur")
def element_hashes(spark: SparkSession, d: str) -> DataFrame:
    parts = ["scope", "repository", "username", "relative_path", "element_type", "name", "byte_offset"]
    rows = current_elements(spark, d, "element_id", *parts, "raw_code", "docstring")
    return rows.select(
        "element_id", F.sha2("element_id", 256).alias("hash_id"), F.substring(F.sha2(T.element_id(*[F.col(p) for p in ("scope", "repository", "relative_path", "element_type", "name")]), 256), 1, 12).alias("short_id"),
        T.content_hash(F.col("raw_code"), F.col("docstring")).alias("content_hash"), (F.col("element_id") == T.element_id(*[F.col(p) for p in parts])).alias("is_regular"),
    )


VIS_SQL = "CASE WHEN name LIKE '\\_\\_%' ESCAPE '\\' AND name LIKE '%\\_\\_' ESCAPE '\\' THEN 'public' WHEN name LIKE '\\_\\_%' ESCAPE '\\' THEN 'private' WHEN name LIKE '\\_%' ESCAPE '\\' THEN 'protected' ELSE 'public' END"


@R.query("public_api", f"WITH {CUR} SELECT element_id, {VIS_SQL} AS by_name, coalesce(visibility, {VIS_SQL}) = 'public' AND NOT coalesce(is_test, false) AS is_public_api FROM cur WHERE element_type IN ('class', 'function', 'method')")
def public_api(spark: SparkSession, d: str) -> DataFrame:
    rows = current_elements(spark, d, "element_id", "element_type", "name", "visibility", "is_test", types=("class", "function", "method")).where(F.col("element_type").isin("class", "function", "method"))
    own = T.visibility(F.col("name"))
    return rows.select("element_id", own.alias("by_name"), ((F.coalesce("visibility", own) == "public") & ~F.coalesce("is_test", F.lit(False))).alias("is_public_api"))


def _tests_sql() -> str:
    return "CASE language " + " ".join(f"WHEN '{k}' THEN regexp_matches(relative_path, '{p}')" for k, p in T.TEST_PATHS.items()) + " ELSE false END"


@R.query("test_paths", f"SELECT DISTINCT relative_path, language, coalesce({_tests_sql()}, false) AS is_test FROM file_states")
def test_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_states").select("relative_path", "language").distinct().withColumn("is_test", T.is_test_path(F.col("relative_path"), F.col("language")))


@R.query("code_metrics", f"""WITH {CUR} SELECT element_id, coalesce(length(raw_code), 0) AS chars, coalesce(len(list_filter(string_split(raw_code, chr(10)), lambda x: length(trim(regexp_replace(x, '[\\t\\r]', ' ', 'g'))) > 0)), 0) AS code_lines, CAST({C.complexity_sql()} AS INTEGER) AS complexity,
 length(raw_code) // 2 AS est_tokens FROM cur WHERE element_type IN ('function', 'method')""")
def code_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = current_elements(spark, d, "element_id", "language", "raw_code", types=("function", "method"))
    return rows.select("element_id", F.coalesce(F.length("raw_code"), F.lit(0)).cast("long").alias("chars"), T.code_lines(F.col("raw_code")).alias("code_lines"), C.complexity(F.col("raw_code"), F.col("language")).cast("int").alias("complexity"), F.floor(F.length("raw_code") / 2).alias("est_tokens"))


@R.query("complex_functions", f"WITH m AS ({R.sql['code_metrics']}) SELECT element_id, complexity FROM m WHERE complexity >= 5 ORDER BY complexity DESC, element_id LIMIT 100")
def complex_functions(spark: SparkSession, d: str) -> DataFrame:
    return code_metrics(spark, d).where("complexity >= 5").select("element_id", "complexity").orderBy(F.col("complexity").desc(), "element_id").limit(100)


COVER_SQL = f"""CASE WHEN {BLANK} THEN 0.0 ELSE 0.5 + CASE WHEN NOT regexp_matches(signature, '\\(\\s*\\w') OR regexp_matches(docstring, '(?m)^\\s*(Args|Arguments|Parameters)\\s*:?|@param\\b|:param\\b|^\\s*#\\s*Arguments') THEN 0.25 ELSE 0.0 END
 + CASE WHEN NOT regexp_matches(signature, '(->|\\)\\s*:)\\s*\\w') OR regexp_matches(docstring, '(?m)^\\s*(Returns?|Yields)\\s*:?|@returns?\\b|:returns?:|^\\s*#\\s*Returns') THEN 0.25 ELSE 0.0 END END"""


@R.query("documentation_coverage", f"WITH {CUR} SELECT language, CAST({COVER_SQL} AS DOUBLE) AS coverage, count(*) AS n FROM cur WHERE element_type IN ('function', 'method') AND signature IS NOT NULL GROUP BY 1, 2")
def documentation_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = current_elements(spark, d, "element_type", "language", "signature", "docstring", types=("function", "method")).where(F.col("element_type").isin("function", "method") & F.col("signature").isNotNull())
    cover = T.docstring_coverage(F.col("docstring"), F.col("signature").rlike(r"\(\s*\w"), F.col("signature").rlike(r"(->|\)\s*:)\s*\w"))
    return rows.groupBy("language", cover.alias("coverage")).agg(F.count("*").alias("n"))


@R.query("undocumented", f"WITH {CUR} SELECT element_id FROM cur WHERE element_type IN ('function', 'method') AND coalesce(visibility, 'public') = 'public' AND NOT coalesce(is_test, false) AND {BLANK} ORDER BY element_id LIMIT 200")
def undocumented(spark: SparkSession, d: str) -> DataFrame:
    rows = current_elements(spark, d, "element_id", "element_type", "visibility", "is_test", "docstring", types=("function", "method"))
    blank = F.col("docstring").isNull() | (F.trim(F.regexp_replace("docstring", r"\s", " ")) == "")
    return rows.where(F.col("element_type").isin("function", "method") & (F.coalesce("visibility", F.lit("public")) == "public") & ~F.coalesce("is_test", F.lit(False)) & blank).select("element_id").orderBy("element_id").limit(200)


def _rules_sql() -> str:
    cases = " UNION ALL ".join(f"SELECT element_id, line, '{r.kind}' AS kind, {rules.SEVERITY[r.severity]} AS score FROM l WHERE regexp_matches(content, '{r.pattern.replace(chr(39), chr(39) * 2)}')" + (f" AND NOT regexp_matches(content, '{rules.HARMLESS[r.kind].replace(chr(39), chr(39) * 2)}')" if r.kind in rules.HARMLESS else "") for r in rules.SECURITY)
    return f"""l AS (SELECT element_id, unnest(string_split(regexp_replace(raw_code, '\\r?\\n', chr(10), 'g'), chr(10))) AS content, generate_subscripts(string_split(regexp_replace(raw_code, '\\r?\\n', chr(10), 'g'), chr(10)), 1) AS line FROM cur WHERE element_type IN ('function', 'method')),
 h AS (SELECT * FROM ({cases}) WHERE (element_id, line) NOT IN (SELECT element_id, line FROM l WHERE regexp_matches(content, '^\\s*(#|//|\\*)'))), m AS (SELECT element_id, line, kind, max(score) AS score FROM h GROUP BY 1, 2, 3)"""


SEV_SQL = "CASE score " + " ".join(f"WHEN {v} THEN '{k}'" for k, v in rules.SEVERITY.items()) + " END"


@R.query("security_lines", f"WITH {CUR}, {_rules_sql()} SELECT element_id, CAST(line AS INTEGER) AS line, kind, CAST(score AS INTEGER) AS score, {SEV_SQL} AS severity FROM m")
def security_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = current_elements(spark, d, "element_id", "element_type", "raw_code", types=("function", "method")).where(F.col("element_type").isin("function", "method"))
    return rules.matches(rows, ["element_id"], "raw_code", rules.SECURITY)


@R.query("severity_histogram", f"WITH {CUR}, {_rules_sql()} SELECT {SEV_SQL} AS severity, kind, count(*) AS n_issues, count(DISTINCT element_id) AS n_elements FROM m GROUP BY 1, 2")
def severity_histogram(spark: SparkSession, d: str) -> DataFrame:
    return security_lines(spark, d).groupBy("severity", "kind").agg(F.count("*").alias("n_issues"), F.count_distinct("element_id").alias("n_elements"))


TODO_RE = rules.TODO.replace("'", "''")


@R.query("todo_extract", f"""WITH {CUR}, l AS (SELECT element_id, unnest(string_split(regexp_replace(raw_code, '\\r?\\n', chr(10), 'g'), chr(10))) AS content, generate_subscripts(string_split(regexp_replace(raw_code, '\\r?\\n', chr(10), 'g'), chr(10)), 1) AS line FROM cur WHERE element_type = 'file')
 SELECT element_id, CAST(line AS INTEGER) AS line, regexp_extract(content, '{TODO_RE}', 1) AS kind, regexp_extract(content, '{TODO_RE}', 2) AS assignee, length(regexp_extract(content, '{TODO_RE}', 3)) AS priority, trim(regexp_extract(content, '{TODO_RE}', 4)) AS todo FROM l WHERE regexp_matches(content, '{TODO_RE}')""")
def todo_extract(spark: SparkSession, d: str) -> DataFrame:
    rows = rules.lines(current_elements(spark, d, "element_id", "element_type", "raw_code", types=("file",)).select("element_id", "raw_code"), "raw_code").where(F.col("content").rlike(rules.TODO))
    part = lambda k: F.regexp_extract("content", rules.TODO, k)
    return rows.select("element_id", "line", part(1).alias("kind"), part(2).alias("assignee"), F.length(part(3)).cast("long").alias("priority"), F.trim(part(4)).alias("todo"))


@R.query("section_markers", f"""WITH {CUR}, l AS (SELECT element_id, unnest(string_split(regexp_replace(raw_code, '\\r?\\n', chr(10), 'g'), chr(10))) AS content FROM cur WHERE element_type = 'file') SELECT element_id, count(*) AS n FROM l WHERE regexp_matches(content, '^\\s*[#/]+\\s*(={{3,}}|-{{3,}})\\s*$') GROUP BY 1""")
def section_markers(spark: SparkSession, d: str) -> DataFrame:
    rows = rules.lines(current_elements(spark, d, "element_id", "element_type", "raw_code", types=("file",)).select("element_id", "raw_code"), "raw_code")
    return rows.where(F.col("content").rlike(r"^\s*[#/]+\s*(={3,}|-{3,})\s*$")).groupBy("element_id").agg(F.count("*").alias("n"))


#: Reads of environment variables; the first group that is set is the name. Our own patterns.
ENV = r"(?:os\.environ(?:\.get)?\s*[\[(]|getenv\s*\(|process\.env[.\[]|env::var\s*\(|\$_ENV\s*\[)\s*[\"']?([A-Z][A-Z0-9_]+)"


@R.query("env_usage", f"WITH {CUR}, x AS (SELECT language, element_id, unnest(list_distinct(regexp_extract_all(raw_code, '{ENV.replace(chr(39), chr(39) * 2)}', 1))) AS variable FROM cur WHERE element_type IN ('function', 'method', 'file')) SELECT language, variable, count(*) AS n FROM x GROUP BY 1, 2")
def env_usage(spark: SparkSession, d: str) -> DataFrame:
    """Environment variables that code reads by name."""
    rows = current_elements(spark, d, "language", "raw_code", types=("function", "method", "file"))
    return rows.select("language", F.explode(F.array_distinct(F.regexp_extract_all("raw_code", F.lit(ENV), F.lit(1)))).alias("variable")).groupBy("language", "variable").agg(F.count("*").alias("n"))


# What tells of concurrency, outside comments and texts; our own patterns.
CONCURRENCY = {"async": r"\basync\b", "await": r"\bawait\b|\.await\b", "promise": r"\bnew Promise\b|\bPromise\.(?:all|race|any|resolve)\b|\.then\s*\(", "thread": r"\bthreading\.|\bnew Thread\b|\bthread::spawn\b|\bThreadPoolExecutor\b|\bExecutorService\b", "process": r"\bmultiprocessing\.|\bProcessPoolExecutor\b|\bpcntl_fork\b|\bchild_process\b", "lock": r"\b(?:R?Lock|Semaphore|Mutex|RwLock|ReentrantLock)\b|\bsynchronized\b", "channel": r"\bmpsc::|\bBlockingQueue\b|\bqueue\.Queue\b", "atomic": r"\bAtomic\w+\b|\bvolatile\b"}


@R.query("concurrency_patterns", f"WITH {CUR}, b AS (SELECT element_id, coalesce(is_async, false) AS marked, {C.bare_sql()} AS code FROM cur WHERE element_type IN ('function', 'method')), x AS (SELECT element_id, list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(code, '{v}')" + (" OR marked" if k == "async" else "") + f" THEN '{k}' END" for k, v in CONCURRENCY.items()) + "], lambda x: x IS NOT NULL)) AS patterns FROM b) SELECT element_id, patterns FROM x WHERE len(patterns) > 0")
def concurrency_patterns(spark: SparkSession, d: str) -> DataFrame:
    rows = current_elements(spark, d, "element_id", "language", "is_async", "raw_code", types=("function", "method"))
    code = rows.select("element_id", F.coalesce("is_async", F.lit(False)).alias("marked"), C.bare_code(F.col("raw_code"), F.col("language")).alias("code"))
    found = F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(F.col("code").rlike(v), F.lit(False)) | (F.col("marked") if k == "async" else F.lit(False)), F.lit(k)) for k, v in CONCURRENCY.items()])))
    return code.select("element_id", found.alias("patterns")).where(F.size("patterns") > 0)


@R.query("keep_drop_ladder", f"""WITH {CUR}, v AS (SELECT name, raw_code FROM cur WHERE element_type IN ('variable', 'constant', 'class')) SELECT {T.drop_reason_sql()} AS reason, count(*) AS n FROM v GROUP BY 1""")
def keep_drop_ladder(spark: SparkSession, d: str) -> DataFrame:
    rows = current_elements(spark, d, "name", "raw_code", types=("variable", "constant", "class"))
    return rows.groupBy(T.drop_reason(F.col("name"), F.col("raw_code")).alias("reason")).agg(F.count("*").alias("n"))


@R.query("context_tier", f"WITH {CUR} SELECT element_id, CAST({tiers.element_tier_sql('element_type', 'length(raw_code)')} AS INTEGER) AS tier FROM cur WHERE raw_code IS NOT NULL")
def context_tier(spark: SparkSession, d: str) -> DataFrame:
    rows = current_elements(spark, d, "element_id", "element_type", "raw_code").where(F.col("raw_code").isNotNull())
    return rows.select("element_id", tiers.element_tier(F.col("element_type"), F.length("raw_code")).alias("tier"))


@R.query("json_props", "SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k_mod, count(*) AS n FROM events GROUP BY 1, 2")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", (F.get_json_object("props", "$.k").cast("long") % 10).alias("k_mod")).agg(F.count("*").alias("n"))


@R.query("trackable_values", "SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_/.]{7,}'), lambda x: contains(x, '_') OR contains(x, '/')))) AS vals FROM documents WHERE regexp_matches(text, '[A-Za-z_][A-Za-z0-9_/.]{7,}')")
def trackable_values(spark: SparkSession, d: str) -> DataFrame:
    p = "[A-Za-z_][A-Za-z0-9_/.]{7,}"
    vals = F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all("text", F.lit(p), F.lit(0)), lambda x: F.contains(x, F.lit("_")) | F.contains(x, F.lit("/")))))
    return table(spark, d, "documents").where(F.col("text").rlike(p)).select("doc_id", vals.alias("vals"))


@R.query("embedding_text", f"WITH {CUR} SELECT c.element_id, concat_ws(' ', c.element_type, {HUMAN_SQL.format('c.name')}, CASE WHEN p.name IS NOT NULL THEN 'in ' || p.name END, CASE WHEN NOT (c.docstring IS NULL OR trim(c.docstring) = '') THEN c.docstring END) AS text FROM cur c LEFT JOIN cur p ON c.parent_id = p.element_id WHERE c.element_type IN ('class', 'function', 'method')")
def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    cur = current_elements(spark, d, "element_id", "parent_id", "element_type", "name", "docstring")
    own = cur.where(F.col("element_type").isin("class", "function", "method"))
    parents = cur.select(F.col("element_id").alias("parent_id"), F.col("name").alias("parent_name"))
    return own.join(parents, "parent_id", "left").select("element_id", F.concat_ws(" ", "element_type", T.humanize_name(F.col("name")), F.when(F.col("parent_name").isNotNull(), F.concat(F.lit("in "), "parent_name")), F.when(F.trim("docstring") != "", F.col("docstring"))).alias("text"))


@R.query("vector_checks", f"WITH {CUR} SELECT CASE WHEN summary_embedding IS NULL THEN 'null' WHEN len(summary_embedding) = 0 THEN 'empty' WHEN len(summary_embedding) <> 64 THEN 'short' WHEN len(list_filter(summary_embedding, lambda x: NOT isfinite(x))) > 0 THEN 'not finite' WHEN len(list_filter(summary_embedding, lambda x: x <> 0)) = 0 THEN 'zero' ELSE 'good' END AS state, count(*) AS n FROM cur GROUP BY 1")
def vector_checks(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("summary_embedding")
    bad = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    state = F.when(v.isNull(), "null").when(F.size(v) == 0, "empty").when(F.size(v) != 64, "short").when(bad, "not finite").when(~F.exists(v, lambda x: x != 0), "zero").otherwise("good")
    return current_elements(spark, d, "summary_embedding").groupBy(state.alias("state")).agg(F.count("*").alias("n"))

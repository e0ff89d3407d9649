"""From source text to elements, imports, calls and sections; calls resolved by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators import parse
from ferrule.plans.registry import Registry
from ferrule.plans.statistics import CUR
from ferrule.sources.tables import current_elements, table

R = Registry()


def files(spark: SparkSession, d: str) -> DataFrame:
    rows = current_elements(spark, d, "row_id", "element_type", "language", "raw_code", types=("file",))
    return rows.select(F.col("row_id").alias("file_id"), "language", F.col("raw_code").alias("text"))


@R.query("parse_elements")
def parse_elements(spark: SparkSession, d: str) -> DataFrame:
    return parse.parsed_elements(files(spark, d))


@R.query("parse_imports")
def parse_imports(spark: SparkSession, d: str) -> DataFrame:
    return parse.parsed_imports(files(spark, d))


@R.query("document_sections", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
 f AS (SELECT *, sum(CASE WHEN starts_with(ltrim(x, ' ' || chr(9)), '```') OR starts_with(ltrim(x, ' ' || chr(9)), '~~~') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS fences FROM l),
 h AS (SELECT doc_id, i, length(regexp_extract(x, '^(#{1,6})\\s+(.*?)\\s*#*\\s*$', 1)) AS level, regexp_extract(x, '^(#{1,6})\\s+(.*?)\\s*#*\\s*$', 2) AS title FROM f WHERE fences % 2 = 0 AND regexp_matches(x, '^(#{1,6})\\s+(.*?)\\s*#*\\s*$')),
 n AS (SELECT doc_id, max(i) AS last FROM l GROUP BY 1)
 SELECT h.doc_id AS file_id, CAST(h.level AS INTEGER) AS level, h.title, CAST(h.i AS INTEGER) AS first_line, CAST(coalesce((SELECT min(k.i) - 1 FROM h k WHERE k.doc_id = h.doc_id AND k.i > h.i AND k.level <= h.level), n.last) AS INTEGER) AS last_line FROM h JOIN n USING (doc_id)""")
def document_sections(spark: SparkSession, d: str) -> DataFrame:
    return parse.sections(table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.lit("markdown").alias("language"), "text"))


CALL = r"([A-Za-z_][A-Za-z0-9_]*)\("
CALLS_SQL = f"""calls AS (SELECT DISTINCT element_id, repository, username, relative_path, parent_id, unnest(regexp_extract_all(raw_code, '{CALL}', 1)) AS callee FROM cur WHERE element_type IN ('function', 'method')),
 defs AS (SELECT element_id, repository, username, relative_path, name FROM cur WHERE element_type IN ('function', 'method'))"""


def calls_and_defs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    key = ["element_id", "repository", "username", "relative_path"]
    cur = current_elements(spark, d, *key, "element_type", "name", "raw_code", types=("function", "method")).where(F.col("element_type").isin("function", "method"))
    return cur.select(*key, F.explode(F.array_distinct(F.regexp_extract_all("raw_code", F.lit(CALL), F.lit(1)))).alias("callee")), cur.select(*key, "name")


@R.query("resolve_calls", f"""WITH {CUR}, {CALLS_SQL}, own AS (SELECT c.element_id, c.callee, min(d.element_id) AS target FROM calls c JOIN defs d ON d.repository = c.repository AND d.username = c.username AND d.relative_path = c.relative_path AND d.name = c.callee AND d.element_id <> c.element_id GROUP BY 1, 2),
 one AS (SELECT repository, name, min(element_id) AS target FROM defs WHERE username = 'main' GROUP BY 1, 2 HAVING count(*) = 1)
 SELECT c.element_id, c.callee, coalesce(o.target, u.target) AS target, CASE WHEN o.target IS NOT NULL THEN 'same_file' ELSE 'unique_name' END AS how FROM calls c LEFT JOIN own o USING (element_id, callee) LEFT JOIN one u ON u.repository = c.repository AND u.name = c.callee AND u.target <> c.element_id WHERE coalesce(o.target, u.target) IS NOT NULL""")
def resolve_calls(spark: SparkSession, d: str) -> DataFrame:
    """First a definition of the name in the same file, else the only one of the repository."""
    calls, defs = calls_and_defs(spark, d)
    here = defs.select(F.col("element_id").alias("t"), "repository", "username", "relative_path", F.col("name").alias("callee"))
    own = calls.join(here, ["repository", "username", "relative_path", "callee"]).where(F.col("t") != F.col("element_id")).groupBy("element_id", "callee").agg(F.min("t").alias("own"))
    one = defs.where("username = 'main'").groupBy("repository", F.col("name").alias("callee")).agg(F.count("*").alias("n"), F.min("element_id").alias("only")).where("n = 1").drop("n")
    both = calls.join(own, ["element_id", "callee"], "left").join(one, ["repository", "callee"], "left")
    only = F.when(F.col("only") != F.col("element_id"), F.col("only"))
    return both.select("element_id", "callee", F.coalesce("own", only).alias("target"), F.when(F.col("own").isNotNull(), "same_file").otherwise("unique_name").alias("how")).where(F.col("target").isNotNull())


@R.query("call_graph_degree", f"WITH r AS ({R.sql['resolve_calls']}) SELECT target, count(DISTINCT element_id) AS n_callers FROM r GROUP BY 1")
def call_graph_degree(spark: SparkSession, d: str) -> DataFrame:
    return resolve_calls(spark, d).groupBy("target").agg(F.count_distinct("element_id").alias("n_callers"))


@R.query("dead_code", f"WITH {CUR}, r AS ({R.sql['resolve_calls']}) SELECT element_id FROM cur WHERE element_type IN ('function', 'method') AND element_id NOT IN (SELECT target FROM r) AND coalesce(len(decorators), 0) = 0 AND coalesce(visibility, 'public') <> 'public' AND NOT coalesce(is_test, false) AND name <> 'main'")
def dead_code(spark: SparkSession, d: str) -> DataFrame:
    rows = current_elements(spark, d, "element_id", "element_type", "decorators", "visibility", "is_test", "name", types=("function", "method")).where(F.col("element_type").isin("function", "method"))
    alive = resolve_calls(spark, d).select(F.col("target").alias("element_id"))
    hidden = (F.coalesce(F.size("decorators"), F.lit(0)) <= 0) & (F.coalesce("visibility", F.lit("public")) != "public") & ~F.coalesce("is_test", F.lit(False)) & (F.col("name") != "main")
    return rows.where(hidden).join(alive, "element_id", "left_anti").select("element_id")


@R.query("usages", f"WITH {CUR}, {CALLS_SQL} SELECT callee AS name, count(*) AS n_usages, count(DISTINCT repository) AS n_repositories FROM calls WHERE callee IN (SELECT name FROM defs) GROUP BY 1")
def usages(spark: SparkSession, d: str) -> DataFrame:
    calls, defs = calls_and_defs(spark, d)
    return calls.withColumnRenamed("callee", "name").join(defs.select("name"), "name", "left_semi").groupBy("name").agg(F.count("*").alias("n_usages"), F.count_distinct("repository").alias("n_repositories"))


@R.query("implementations", f"WITH {CUR} SELECT element_id, regexp_extract(signature, '(?:extends|implements|\\()\\s*([A-Z]\\w+)', 1) AS base FROM cur WHERE element_type = 'class' AND regexp_matches(signature, '(?:extends|implements|\\()\\s*([A-Z]\\w+)')")
def implementations(spark: SparkSession, d: str) -> DataFrame:
    p = r"(?:extends|implements|\()\s*([A-Z]\w+)"
    return current_elements(spark, d, "element_id", "element_type", "signature", types=("class",)).where((F.col("element_type") == "class") & F.col("signature").rlike(p)).select("element_id", F.regexp_extract("signature", p, 1).alias("base"))


@R.query("name_candidates", f"WITH {CUR} SELECT repository, name, count(*) AS n, count(*) = 1 AS is_unique FROM cur WHERE element_type IN ('class', 'function', 'method') GROUP BY 1, 2")
def name_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = current_elements(spark, d, "repository", "name", "element_type", types=("class", "function", "method")).where(F.col("element_type").isin("class", "function", "method"))
    return rows.groupBy("repository", "name").agg(F.count("*").alias("n"), (F.count("*") == 1).alias("is_unique"))

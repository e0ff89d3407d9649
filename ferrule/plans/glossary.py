"""Glossary terms of names with the repositories that they are used in, and imports resolved to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.functions.text import humanize_name, normalize_term
from ferrule.plans.graph import IMPORTS_SQL, imports
from ferrule.plans.registry import Registry
from ferrule.plans.retrieval import HUMAN_SQL
from ferrule.plans.statistics import CUR, NEW
from ferrule.sources.tables import current_elements, newest_files

R = Registry()
NORMAL_SQL = """CASE WHEN t LIKE '%us' OR t LIKE '%is' THEN t WHEN t LIKE '%ies' AND length(t) > 4 THEN left(t, length(t) - 3) || 'y' WHEN t LIKE '%ies' THEN t WHEN t LIKE '%sses' THEN left(t, length(t) - 2) WHEN t LIKE '%xes' OR t LIKE '%ches' OR t LIKE '%shes' THEN left(t, length(t) - 2)
  WHEN t LIKE '%ses' AND length(t) > 4 THEN left(t, length(t) - 2) WHEN t LIKE '%s' AND length(t) > 3 AND t NOT LIKE '%ss' THEN left(t, length(t) - 1) ELSE t END"""
# Words that name nothing in particular.
GENERIC = "get set is has the and for with from this that new old test init main run self".split()
TERMS_SQL = f"w AS (SELECT DISTINCT element_id, repository, {NORMAL_SQL} AS term FROM (SELECT element_id, repository, unnest(string_split({HUMAN_SQL.format('name')}, ' ')) AS t FROM cur WHERE element_type IN ('class', 'function', 'method'))), g AS (SELECT * FROM w WHERE length(term) >= 3 AND regexp_matches(term, '^[a-z]+$') AND term NOT IN ({', '.join(repr(g) for g in GENERIC)}))"


def terms(spark: SparkSession, d: str) -> DataFrame:
    """``element_id, repository, term``: the words of each name in the singular, generic ones left out."""
    rows = current_elements(spark, d, "element_id", "repository", "element_type", "name", types=("class", "function", "method")).where(F.col("element_type").isin("class", "function", "method"))
    words = rows.select("element_id", "repository", F.explode(F.split(humanize_name(F.col("name")), " ")).alias("t"))
    g = words.select("element_id", "repository", normalize_term(F.col("t")).alias("term")).distinct()
    return g.where((F.length("term") >= 3) & F.col("term").rlike("^[a-z]+$") & ~F.col("term").isin(*GENERIC))


@R.query("glossary_terms", f"WITH {CUR}, {TERMS_SQL} SELECT term, count(*) AS total_count, count(DISTINCT repository) AS n_repositories FROM g GROUP BY 1 HAVING count(*) >= 5")
def glossary_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms(spark, d).groupBy("term").agg(F.count("*").alias("total_count"), F.count_distinct("repository").alias("n_repositories")).where("total_count >= 5")


@R.query("glossary_associations", f"""WITH {CUR}, {TERMS_SQL}, n AS (SELECT repository, count(*) AS members FROM cur WHERE element_type IN ('class', 'function', 'method') GROUP BY 1), f AS (SELECT term, repository, count(*) AS frequency FROM g GROUP BY 1, 2)
 SELECT term, repository, frequency, members, round(100.0 * frequency / members, 4) AS percentage FROM f JOIN n USING (repository) WHERE 100.0 * frequency / members >= 5""")
def glossary_associations(spark: SparkSession, d: str) -> DataFrame:
    """Share of a repository's classes and functions whose name has the term, from 5 % on."""
    n = current_elements(spark, d, "repository", "element_type", types=("class", "function", "method")).where(F.col("element_type").isin("class", "function", "method")).groupBy("repository").agg(F.count("*").alias("members"))
    f = terms(spark, d).groupBy("term", "repository").agg(F.count("*").alias("frequency"))
    share = 100.0 * F.col("frequency") / F.col("members")
    return f.join(n, "repository").where(share >= 5).select("term", "repository", "frequency", "members", F.round(share, 4).alias("percentage"))


@R.query("glossary_search", f"WITH {CUR}, {TERMS_SQL} SELECT term, count(*) AS total_count FROM g WHERE contains(term, 'tr') GROUP BY 1")
def glossary_search(spark: SparkSession, d: str) -> DataFrame:
    return terms(spark, d).where(F.contains("term", F.lit("tr"))).groupBy("term").agg(F.count("*").alias("total_count"))


@R.query("glossary_neighbours", f"""WITH {CUR}, {TERMS_SQL}, p AS (SELECT a.term AS a, b.term AS b, count(*) AS n FROM g a JOIN g b ON a.element_id = b.element_id AND a.term < b.term GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS place FROM p) SELECT a, b, n FROM r WHERE place <= 3""")
def glossary_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The three terms that each is most often named together with; a name has few words, so its pairs are few."""
    per = terms(spark, d).groupBy("element_id").agg(F.array_sort(F.collect_set("term")).alias("ts"))
    pairs = F.expr("flatten(transform(ts, (x, i) -> transform(slice(ts, i + 2, size(ts)), y -> struct(x AS a, y AS b))))")
    n = per.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.col("n").desc(), "b"))).where("place <= 3").drop("place")


RESOLVED = """p AS (SELECT DISTINCT repository, relative_path, module, regexp_replace(relative_path, '[^/]*$', '') || regexp_replace(replace(ltrim(module, './'), '.', '/'), '/$', '') AS stem FROM imp WHERE starts_with(module, '.')),
 f AS (SELECT DISTINCT repository, relative_path, regexp_replace(relative_path, '\\.[^./]*$', '') AS stem FROM newest WHERE NOT is_deleted)"""


def resolved(spark: SparkSession, d: str) -> DataFrame:
    """``repository, relative_path, module, file`` of relative imports; file is null if none has the name."""
    rel = imports(spark, d).where(F.col("module").startswith(".")).distinct()
    stem = F.concat(F.regexp_replace("relative_path", "[^/]*$", ""), F.regexp_replace(F.translate(F.ltrim(F.col("module"), F.lit("./")), ".", "/"), "/$", ""))
    files = newest_files(spark, d, "repository", "relative_path", "is_deleted").where("NOT is_deleted").select("repository", F.col("relative_path").alias("file"), F.regexp_replace("relative_path", r"\.[^./]*$", "").alias("stem")).distinct()
    return rel.withColumn("stem", stem).join(files, ["repository", "stem"], "left").drop("stem")


@R.query("import_resolution", f"WITH {CUR}, {NEW}, {IMPORTS_SQL}, {RESOLVED} SELECT p.repository, p.relative_path, p.module, min(f.relative_path) AS target FROM p LEFT JOIN f ON f.repository = p.repository AND f.stem = p.stem GROUP BY 1, 2, 3")
def import_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Relative imports with the first file that they name, null if there is none."""
    return resolved(spark, d).groupBy("repository", "relative_path", "module").agg(F.min("file").alias("target"))


@R.query("import_edges", f"WITH {CUR}, {NEW}, {IMPORTS_SQL}, {RESOLVED} SELECT DISTINCT p.repository, p.relative_path AS src, f.relative_path AS dst FROM p JOIN f ON f.repository = p.repository AND f.stem = p.stem WHERE f.relative_path <> p.relative_path")
def import_edges(spark: SparkSession, d: str) -> DataFrame:
    return resolved(spark, d).where("file <> relative_path").select("repository", F.col("relative_path").alias("src"), F.col("file").alias("dst")).distinct()

"""Relationships, outside references, routes, commands and calls resolved by passes, from the elements' own fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators import graphs, relations, resolve, routes
from ferrule.plans.extraction import CALLS_SQL, calls_and_defs, resolve_calls
from ferrule.plans.extraction import R as EXTRACTION
from ferrule.plans.glossary import resolved as resolved_imports
from ferrule.plans.graph import IMPORTS_SQL, imports
from ferrule.plans.registry import Registry
from ferrule.plans.statistics import CUR
from ferrule.sources.tables import current_elements

R = Registry()
HASH_SQL = "substr(sha256({0}.scope || ':' || {0}.repository || ':' || {0}.relative_path || ':' || {0}.element_type || ':' || {0}.name), 1, 12)"
EDGES_SQL = f"""r AS ({EXTRACTION.sql['resolve_calls']}), edges AS (SELECT c.scope, c.repository, c.username, {HASH_SQL.format('c')} AS source_hash, {HASH_SQL.format('p')} AS target_hash, 'contained_in' AS relationship_type, c.indexed_at FROM cur c JOIN cur p ON p.element_id = c.parent_id
 UNION ALL SELECT c.scope, c.repository, c.username, {HASH_SQL.format('c')}, {HASH_SQL.format('t')}, 'calls', c.indexed_at FROM r JOIN cur c ON c.element_id = r.element_id JOIN cur t ON t.element_id = r.target),
 rel AS (SELECT *, scope || ':' || repository || ':' || source_hash || '→' || target_hash || ':' || relationship_type AS relationship_key, substr(sha256(scope || ':' || repository || ':' || username || ':' || source_hash || '→' || target_hash || ':' || relationship_type), 1, 12) AS relationship_id, CASE WHEN username = 'main' THEN 0 ELSE 1 END AS priority FROM edges WHERE source_hash IS NOT NULL AND target_hash IS NOT NULL),
 one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY relationship_key ORDER BY priority DESC, indexed_at DESC NULLS LAST, relationship_id) AS place FROM rel) WHERE place = 1)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges from elements to what contains them, and from callers to what they call."""
    parts = ["scope", "repository", "relative_path", "element_type", "name"]
    cur = current_elements(spark, d, "element_id", "parent_id", "username", "indexed_at", *parts)
    own = F.substring(F.sha2(F.concat(*[x for p in parts for x in (F.col(p), F.lit(":"))][:-1]), 256), 1, 12)
    nodes = cur.select("element_id", "parent_id", "scope", "repository", "username", "indexed_at", own.alias("source_hash"))
    ends = nodes.select(F.col("element_id").alias("target"), F.col("source_hash").alias("target_hash"))
    inside = nodes.withColumnRenamed("parent_id", "target").withColumn("relationship_type", F.lit("contained_in")).drop("element_id")
    called = nodes.drop("parent_id").join(resolve_calls(spark, d).select("element_id", "target"), "element_id").withColumn("relationship_type", F.lit("calls")).drop("element_id")
    return inside.unionByName(called).join(ends, "target").drop("target")


def collapsed(spark: SparkSession, d: str) -> DataFrame:
    return relations.collapsed(relations.relationships(edges(spark, d)))


@R.query("relationship_rows", f"WITH {CUR}, {EDGES_SQL} SELECT relationship_id, relationship_key, CAST(priority AS TINYINT) AS priority, count(*) AS n FROM rel GROUP BY 1, 2, 3")
def relationship_rows(spark: SparkSession, d: str) -> DataFrame:
    return relations.relationships(edges(spark, d)).groupBy("relationship_id", "relationship_key", "priority").agg(F.count("*").alias("n"))


@R.query("relationships", f"WITH {CUR}, {EDGES_SQL} SELECT relationship_key, username, relationship_type FROM one")
def relationships(spark: SparkSession, d: str) -> DataFrame:
    """One row for each key; a user's copy goes before that of the main branch."""
    return collapsed(spark, d).select("relationship_key", "username", "relationship_type")


@R.query("relationships_by_type", f"WITH {CUR}, {EDGES_SQL} SELECT repository, relationship_type, count(*) AS n FROM one GROUP BY 1, 2")
def relationships_by_type(spark: SparkSession, d: str) -> DataFrame:
    return collapsed(spark, d).groupBy("repository", "relationship_type").agg(F.count("*").alias("n"))


@R.query("outgoing_relationships", f"WITH {CUR}, {EDGES_SQL} SELECT repository, source_hash, relationship_type, count(*) AS n_targets FROM one GROUP BY 1, 2, 3")
def outgoing_relationships(spark: SparkSession, d: str) -> DataFrame:
    return collapsed(spark, d).groupBy("repository", "source_hash", "relationship_type").agg(F.count("*").alias("n_targets"))


@R.query("incoming_relationships", f"WITH {CUR}, {EDGES_SQL} SELECT repository, target_hash, relationship_type, count(*) AS n_sources FROM one GROUP BY 1, 2, 3")
def incoming_relationships(spark: SparkSession, d: str) -> DataFrame:
    return collapsed(spark, d).groupBy("repository", "target_hash", "relationship_type").agg(F.count("*").alias("n_sources"))


@R.query("external_refs", f"WITH {CUR}, {IMPORTS_SQL} SELECT 'package' AS ref_type, split_part(split_part(module, '.', 1), '::', 1) AS name, count(*) AS n_uses, count(DISTINCT repository) AS n_repositories FROM imp WHERE module <> '' AND NOT starts_with(module, '.') AND NOT starts_with(module, 'crate') GROUP BY 1, 2 ORDER BY n_uses DESC, name LIMIT 100")
def external_refs(spark: SparkSession, d: str) -> DataFrame:
    """The hundred packages from outside that are imported most."""
    outside = imports(spark, d).where(~F.col("module").startswith(".") & ~F.col("module").startswith("crate"))
    name = F.split_part(F.split_part("module", F.lit("."), F.lit(1)), F.lit("::"), F.lit(1))
    return outside.groupBy(F.lit("package").alias("ref_type"), name.alias("name")).agg(F.count("*").alias("n_uses"), F.count_distinct("repository").alias("n_repositories")).orderBy(F.col("n_uses").desc(), "name").limit(100)


# --- routes and commands: told by decorators ---------------------------------------------------------


def decorated(spark: SparkSession, d: str) -> DataFrame:
    cols = ["element_id", "repository", "username", "relative_path", "name", "language", "decorators"]
    return current_elements(spark, d, *cols, types=("function", "method", "class")).where(F.size("decorators") > 0)


@R.query("http_routes")
def http_routes(spark: SparkSession, d: str) -> DataFrame:
    return routes.http_routes(decorated(spark, d))


@R.query("route_tree")
def route_tree(spark: SparkSession, d: str) -> DataFrame:
    rows = decorated(spark, d)
    return routes.route_tree(routes.http_routes(rows), rows, "/api/v1")


@R.query("cli_commands", f"WITH {CUR}, x AS (SELECT repository, username, element_id, name, regexp_extract(unnest(decorators), '^\\s*[@#]?\\[?\\s*([\\w.:]+)', 1) AS dn FROM cur WHERE element_type IN ('function', 'method', 'class')) SELECT repository, username, element_id, name, ends_with(dn, 'group') AS is_group FROM x WHERE regexp_matches(dn, '(^|\\.)(command|group)$')")
def cli_commands(spark: SparkSession, d: str) -> DataFrame:
    return routes.commands(decorated(spark, d)).select("repository", "username", "element_id", "name", "is_group")


@R.query("command_tree")
def command_tree(spark: SparkSession, d: str) -> DataFrame:
    return routes.command_tree(routes.commands(decorated(spark, d)))


# --- calls -------------------------------------------------------------------------------------------

BASES = r"(?:extends|implements)\s+([\w\s,.\\]+)|class\s+\w+\s*\(([^)]*)\)"


def definitions(spark: SparkSession, d: str) -> DataFrame:
    return current_elements(spark, d, "element_id", "repository", "username", "relative_path", "parent_id", "element_type", "name", "signature", types=("class", "function", "method"))


def bases(defs: DataFrame) -> DataFrame:
    """``repository, username, type, base, place`` from the classes' signatures."""
    said = F.concat_ws(",", F.regexp_extract("signature", BASES, 1), F.regexp_extract("signature", BASES, 2))
    rows = defs.where("element_type = 'class'").select("repository", "username", F.col("name").alias("type"), F.posexplode(F.split(said, ",")).alias("place", "b"))
    return rows.select("repository", "username", "type", "place", F.regexp_extract("b", r"(\w+)\s*$", 1).alias("base")).where(F.col("base") != "")


def names_imported(spark: SparkSession, d: str) -> DataFrame:
    """``repository, username, relative_path, name, alias, file`` of Python's and scripts' imports of names from the project's files."""
    files = current_elements(spark, d, "repository", "username", "relative_path", "language", "raw_code", types=("file",))
    python = r"(?m)^[ \t]*from[ \t]+([.\w]+)[ \t]+import[ \t]+\(?([^()#\r\n]+)"
    script = r"(?m)^[ \t]*import[ \t]+(?:\w+[ \t]*,[ \t]*)?\{([^}]+)\}[ \t]+from[ \t]+['\"]([^'\"]+)"
    found = files.select("repository", "username", "relative_path", F.when(F.col("language") == "python", F.regexp_extract_all("raw_code", F.lit(python), F.lit(0))).alias("p"), F.when(F.col("language").isin("javascript", "typescript"), F.regexp_extract_all("raw_code", F.lit(script), F.lit(0))).alias("s"))
    key = ["repository", "username", "relative_path"]
    of_python = found.select(*key, F.explode("p").alias("x")).select(*key, F.regexp_extract("x", python, 1).alias("module"), F.regexp_extract("x", python, 2).alias("names"))
    of_script = found.select(*key, F.explode("s").alias("x")).select(*key, F.regexp_extract("x", script, 2).alias("module"), F.regexp_extract("x", script, 1).alias("names"))
    each = of_python.unionByName(of_script).select(*key, "module", F.explode(F.split("names", ",")).alias("n"))
    one = each.select(*key, "module", F.regexp_extract("n", r"^\s*(\*|\w+)", 1).alias("name"), F.regexp_extract("n", r"(\w+|\*)\s*$", 1).alias("alias")).where("name <> ''")
    known = resolved_imports(spark, d).where(F.col("file").isNotNull()).groupBy("repository", "relative_path", "module").agg(F.min("file").alias("file"))
    return one.join(known, ["repository", "relative_path", "module"]).drop("module")


@R.query("resolve_call_passes")
def resolve_call_passes(spark: SparkSession, d: str) -> DataFrame:
    """Calls resolved by import, file, base class, constructor, annotation, return type, affinity and unique name."""
    functions = current_elements(spark, d, "element_id", "repository", "username", "relative_path", "parent_id", "signature", "raw_code", types=("function", "method"))
    defs = definitions(spark, d)
    return resolve.resolved(functions, defs, names_imported(spark, d), bases(defs))


@R.query("resolution_rates")
def resolution_rates(spark: SparkSession, d: str) -> DataFrame:
    """How many calls each pass resolves, by language."""
    functions = current_elements(spark, d, "element_id", "language", types=("function", "method"))
    return resolve_call_passes(spark, d).join(functions, "element_id").groupBy("language", "how").agg(F.count("*").alias("n_calls"))


@R.query("unresolved_calls", f"WITH {CUR}, {CALLS_SQL}, r AS ({EXTRACTION.sql['resolve_calls']}) SELECT c.element_id, count(*) AS n_unresolved FROM calls c ANTI JOIN r USING (element_id, callee) GROUP BY 1")
def unresolved_calls(spark: SparkSession, d: str) -> DataFrame:
    """Functions with calls that have a name but no target."""
    calls, _ = calls_and_defs(spark, d)
    return calls.join(resolve_calls(spark, d).select("element_id", "callee"), ["element_id", "callee"], "left_anti").groupBy("element_id").agg(F.count("*").alias("n_unresolved"))


@R.query("linked_references", f"WITH {CUR}, {CALLS_SQL}, l AS (SELECT DISTINCT c.element_id, d.element_id AS target FROM calls c JOIN defs d ON d.repository = c.repository AND d.username = c.username AND d.name = c.callee AND d.element_id <> c.element_id) SELECT element_id, target FROM (SELECT *, row_number() OVER (PARTITION BY element_id ORDER BY target) AS place FROM l) WHERE place <= 10")
def linked_references(spark: SparkSession, d: str) -> DataFrame:
    """The first ten definitions that each function's calls may mean, itself left out."""
    from pyspark.sql import Window

    calls, defs = calls_and_defs(spark, d)
    there = defs.select("repository", "username", F.col("name").alias("callee"), F.col("element_id").alias("target"))
    links = calls.select("element_id", "repository", "username", "callee").join(there, ["repository", "username", "callee"]).where("element_id <> target").select("element_id", "target").distinct()
    return links.withColumn("place", F.row_number().over(Window.partitionBy("element_id").orderBy("target"))).where("place <= 10").drop("place")


@R.query("element_call_chain", f"WITH RECURSIVE {CUR}, r AS ({EXTRACTION.sql['resolve_calls']}), w AS (SELECT element_id AS id, 0 AS depth FROM r WHERE element_id IN (SELECT element_id FROM cur WHERE is_test) UNION SELECT r.target, w.depth + 1 FROM w JOIN r ON r.element_id = w.id WHERE w.depth < 5) SELECT id, min(depth) AS depth FROM w GROUP BY 1")
def element_call_chain(spark: SparkSession, d: str) -> DataFrame:
    """What tests reach by resolved calls within five steps."""
    links = resolve_calls(spark, d).select(F.col("element_id").alias("src"), F.col("target").alias("dst"))
    tests = current_elements(spark, d, "element_id", "is_test", types=("function", "method")).where("is_test")
    starts = links.select(F.col("src").alias("id")).join(tests.select(F.col("element_id").alias("id")), "id", "left_semi")
    return graphs.chain(links, starts, 5)


@R.query("unreached_elements", f"WITH RECURSIVE {CUR}, r AS ({EXTRACTION.sql['resolve_calls']}), w AS (SELECT element_id AS id FROM cur WHERE element_type IN ('function', 'method') AND (is_test OR name = 'main' OR coalesce(visibility, 'public') = 'public') UNION SELECT r.target FROM w JOIN r ON r.element_id = w.id) SELECT element_id FROM cur WHERE element_type IN ('function', 'method') AND element_id NOT IN (SELECT id FROM w)")
def unreached_elements(spark: SparkSession, d: str) -> DataFrame:
    """Functions that no public function, test or ``main`` reaches by resolved calls, over any number of steps."""
    rows = current_elements(spark, d, "element_id", "is_test", "name", "visibility", types=("function", "method"))
    links = resolve_calls(spark, d).select(F.col("element_id").alias("src"), F.col("target").alias("dst"))
    alive = rows.where(F.coalesce("is_test", F.lit(False)) | (F.col("name") == "main") | (F.coalesce("visibility", F.lit("public")) == "public"))
    reached = graphs.chain(links, alive.select(F.col("element_id").alias("id")), 1_000_000)
    return rows.select("element_id").join(reached.select(F.col("id").alias("element_id")), "element_id", "left_anti")

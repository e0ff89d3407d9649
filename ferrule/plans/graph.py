"""Graph and hierarchy questions: callers, dead nodes, chains, imports, containment, roll-ups, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.operators import clusters, graphs, hierarchy
from ferrule.plans.registry import Registry
from ferrule.plans.statistics import CUR
from ferrule.plans.structure import WALK
from ferrule.sources.tables import current_elements, table

R = Registry()


@R.query("dead_nodes", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AND o_orderstatus <> 'P'")
def dead_nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderstatus <> 'P'").select("o_orderkey").join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@R.query("callers_of", "SELECT l_partkey, count(DISTINCT l_orderkey) AS n_callers, count(*) AS n_calls, min(l_orderkey) AS first_caller FROM lineitem GROUP BY 1")
def callers_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("n_callers"), F.count("*").alias("n_calls"), F.min("l_orderkey").alias("first_caller"))


@R.query("dependents", "SELECT s.s_suppkey, count(DISTINCT o.o_custkey) AS n_dependents FROM supplier s LEFT JOIN lineitem l ON l.l_suppkey = s.s_suppkey LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY 1")
def dependents(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey").distinct().join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey", "left")
    return table(spark, d, "supplier").select("s_suppkey").join(li, F.col("l_suppkey") == F.col("s_suppkey"), "left").groupBy("s_suppkey").agg(F.count_distinct("o_custkey").alias("n_dependents"))


IMPORTS_SQL = f"""imp AS (SELECT repository, relative_path, CASE WHEN language = 'python' THEN regexp_extract(l, '^(?:from|import)\\s+([\\w.]+)', 1) WHEN language IN ('javascript', 'typescript') THEN regexp_extract(l, '^import .*''([^'']+)'';', 1) WHEN language = 'rust' THEN regexp_extract(l, '^use\\s+([\\w:]+)', 1) WHEN language = 'java' THEN regexp_extract(l, '^import\\s+(?:static\\s+)?([\\w.]+)', 1) WHEN language = 'php' THEN regexp_extract(l, '^use\\s+\\\\?([A-Za-z][\\w\\\\]*)\\s*(?:;|as)', 1) ELSE '' END AS module
 FROM (SELECT repository, relative_path, language, unnest(string_split(regexp_replace(raw_code, '\\r', '', 'g'), chr(10))) AS l FROM cur WHERE element_type = 'file'))"""


def imports(spark: SparkSession, d: str) -> DataFrame:
    files = current_elements(spark, d, "repository", "relative_path", "language", "element_type", "raw_code", types=("file",))
    lines = files.select("repository", "relative_path", "language", F.explode(F.split(F.regexp_replace("raw_code", "\r", ""), "\n")).alias("l"))
    module = F.when(F.col("language") == "python", F.regexp_extract("l", r"^(?:from|import)\s+([\w.]+)", 1)).when(F.col("language").isin("javascript", "typescript"), F.regexp_extract("l", r"^import .*'([^']+)';", 1)).when(F.col("language") == "rust", F.regexp_extract("l", r"^use\s+([\w:]+)", 1)).when(F.col("language") == "java", F.regexp_extract("l", r"^import\s+(?:static\s+)?([\w.]+)", 1)).when(F.col("language") == "php", F.regexp_extract("l", r"^use\s+\\?([A-Za-z][\w\\]*)\s*(?:;|as)", 1)).otherwise("")
    return lines.select("repository", "relative_path", module.alias("module")).where("module <> ''")


@R.query("import_dependents", f"WITH {CUR}, {IMPORTS_SQL} SELECT module, count(*) AS n_imports, count(DISTINCT repository || chr(10) || relative_path) AS n_files FROM imp WHERE module <> '' GROUP BY 1")
def import_dependents(spark: SparkSession, d: str) -> DataFrame:
    return imports(spark, d).groupBy("module").agg(F.count("*").alias("n_imports"), F.count_distinct("repository", "relative_path").alias("n_files"))


@R.query("internal_external_split", f"WITH {CUR}, {IMPORTS_SQL} SELECT repository, count(*) FILTER (starts_with(module, '.') OR starts_with(module, 'crate')) AS n_internal, count(*) FILTER (NOT (starts_with(module, '.') OR starts_with(module, 'crate'))) AS n_external FROM imp WHERE module <> '' GROUP BY 1")
def internal_external_split(spark: SparkSession, d: str) -> DataFrame:
    inside = F.col("module").startswith(".") | F.col("module").startswith("crate")
    return imports(spark, d).groupBy("repository").agg(F.count_if(inside).alias("n_internal"), F.count_if(~inside).alias("n_external"))


# One graph of customers, orders, parts and suppliers; the kinds are told apart by a prefix.
EDGE_SQL = """e AS (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders UNION SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    def links(name: str, a: str, x: str, b: str, y: str) -> DataFrame:
        return table(spark, d, name).select(F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst"))

    parts = [links("orders", "c", "o_custkey", "o", "o_orderkey"), links("lineitem", "o", "l_orderkey", "p", "l_partkey"), links("lineitem", "p", "l_partkey", "s", "l_suppkey"), links("supplier", "s", "s_suppkey", "n", "s_nationkey")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@R.query("call_chain_depth", f"WITH RECURSIVE {EDGE_SQL}, w AS (SELECT 'c7' AS id, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.id WHERE w.depth < 4) SELECT id, min(depth) AS depth FROM w GROUP BY 1")
def call_chain_depth(spark: SparkSession, d: str) -> DataFrame:
    return graphs.chain(edges(spark, d), spark.createDataFrame([("c7",)], "id string"), 4)


@R.query("caller_chain_depth", f"WITH RECURSIVE {EDGE_SQL}, w AS (SELECT 's3' AS id, 0 AS depth UNION SELECT e.src, w.depth + 1 FROM w JOIN e ON e.dst = w.id WHERE w.depth < 3) SELECT id, min(depth) AS depth FROM w GROUP BY 1")
def caller_chain_depth(spark: SparkSession, d: str) -> DataFrame:
    back = edges(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graphs.chain(back, spark.createDataFrame([("s3",)], "id string"), 3)


@R.query("cycle_nodes", WALK + """, lost AS (SELECT element_id AS a, parent_id AS b FROM current_rows WHERE row_id NOT IN (SELECT row_id FROM walk)), reach AS (SELECT a, b FROM lost UNION SELECT r.a, l.b FROM reach r JOIN lost l ON l.a = r.b) SELECT DISTINCT a AS id FROM reach WHERE a = b""")
def cycle_nodes(spark: SparkSession, d: str) -> DataFrame:
    cur = current_elements(spark, d, "element_id", "parent_id")
    return graphs.cycle_nodes(cur.select(F.col("element_id").alias("src"), F.col("parent_id").alias("dst")))


@R.query("tree_roots", f"WITH {CUR} SELECT element_id FROM cur EXCEPT SELECT element_id FROM cur WHERE parent_id IN (SELECT element_id FROM cur)")
def tree_roots(spark: SparkSession, d: str) -> DataFrame:
    cur = current_elements(spark, d, "element_id", "parent_id")
    return cur.select("element_id").exceptAll(cur.where(F.col("parent_id").isNotNull()).join(cur.select(F.col("element_id").alias("parent_id")), "parent_id", "left_semi").select("element_id"))


@R.query("entry_points", f"WITH {CUR} SELECT element_id, CASE WHEN len(list_filter(decorators, lambda x: regexp_matches(lower(x), 'route|get|post|api'))) > 0 THEN 'http' WHEN len(list_filter(decorators, lambda x: regexp_matches(lower(x), 'command|click|cli'))) > 0 THEN 'cli' WHEN len(list_filter(decorators, lambda x: regexp_matches(lower(x), 'test|fixture'))) > 0 THEN 'test' WHEN len(list_filter(decorators, lambda x: regexp_matches(lower(x), 'task|job|retry'))) > 0 THEN 'async' WHEN name = 'main' THEN 'main' ELSE 'other' END AS kind FROM cur WHERE element_type IN ('function', 'method') AND (len(decorators) > 0 OR name = 'main')")
def entry_points(spark: SparkSession, d: str) -> DataFrame:
    rows = current_elements(spark, d, "element_id", "element_type", "name", "decorators", types=("function", "method")).where(F.col("element_type").isin("function", "method") & ((F.size("decorators") > 0) | (F.col("name") == "main")))
    has = lambda p: F.exists("decorators", lambda x: F.lower(x).rlike(p))
    kind = F.when(has("route|get|post|api"), "http").when(has("command|click|cli"), "cli").when(has("test|fixture"), "test").when(has("task|job|retry"), "async").when(F.col("name") == "main", "main").otherwise("other")
    return rows.select("element_id", kind.alias("kind"))


@R.query("tightest_parent", f"""WITH {CUR}, x AS (SELECT repository, username, relative_path, row_id AS id, line_start AS first, line_end AS last FROM cur WHERE element_type <> 'file' AND line_start IS NOT NULL AND line_end >= line_start),
 j AS (SELECT a.id, b.id AS parent_id, row_number() OVER (PARTITION BY a.id ORDER BY b.last - b.first, -b.id) AS place FROM x a JOIN x b USING (repository, username, relative_path) WHERE b.id <> a.id AND b.first <= a.first AND b.last >= a.last AND (b.last - b.first > a.last - a.first OR b.id < a.id)) SELECT id, parent_id FROM j WHERE place = 1""")
def tightest_parent(spark: SparkSession, d: str) -> DataFrame:
    key = ["repository", "username", "relative_path"]
    rows = current_elements(spark, d, *key, "row_id", "element_type", "line_start", "line_end").where("element_type <> 'file'")
    return graphs.tightest_parent(rows.select(*key, F.col("row_id").alias("id"), F.col("line_start").alias("first"), F.col("line_end").alias("last")), key)


@R.query("comments_near", f"""WITH {CUR}, l AS (SELECT repository, username, relative_path, unnest(string_split(raw_code, chr(10))) AS content, generate_subscripts(string_split(raw_code, chr(10)), 1) AS line FROM cur WHERE element_type = 'file'),
 c AS (SELECT * FROM l WHERE regexp_matches(content, '^\\s*(#|//)')) SELECT t.element_id, count(*) AS n FROM cur t JOIN c USING (repository, username, relative_path) WHERE t.element_type IN ('function', 'method') AND c.line BETWEEN t.line_start - 3 AND t.line_start GROUP BY 1""")
def comments_near(spark: SparkSession, d: str) -> DataFrame:
    key = ["repository", "username", "relative_path"]
    lines = current_elements(spark, d, *key, "raw_code", types=("file",)).select(*key, F.posexplode(F.split("raw_code", "\n")).alias("at", "content")).where(F.col("content").rlike(r"^\s*(#|//)")).select(*key, (F.col("at") + 1).alias("line"))
    targets = current_elements(spark, d, *key, "element_id", "line_start", types=("function", "method")).select(*key, F.col("element_id").alias("id"), F.col("line_start").alias("at"))
    return graphs.near_lines(lines, targets, key, 3).groupBy(F.col("id").alias("element_id")).agg(F.count("*").alias("n"))


@R.query("rollup_to_ancestors", WALK + """, own AS (SELECT w.row_id, w.ancestors, c.is_async, c.docstring, c.element_type FROM walk w JOIN current_rows c USING (row_id)), up AS (SELECT unnest(list_append(ancestors, row_id)) AS row_id, is_async, docstring, element_type FROM own)
 SELECT row_id, count(*) AS n, count(*) FILTER (is_async) AS n_async, count(*) FILTER (element_type IN ('function', 'method') AND docstring IS NULL) AS n_undocumented FROM up GROUP BY 1""")
def rollup_to_ancestors(spark: SparkSession, d: str) -> DataFrame:
    cur = current_elements(spark, d, "row_id", "element_id", "name", "parent_id", "is_async", "docstring", "element_type")
    nodes = hierarchy.hierarchies(cur.withColumnRenamed("row_id", "id")).where(F.col("ancestors").isNotNull()).select("id", "ancestors")
    facts = cur.select(F.col("row_id").alias("id"), F.coalesce("is_async", F.lit(False)).alias("a"), (F.col("element_type").isin("function", "method") & F.col("docstring").isNull()).alias("u"))
    up = nodes.join(facts, "id").select(F.explode(F.concat("ancestors", F.array("id"))).alias("row_id"), "a", "u")
    return up.groupBy("row_id").agg(F.count("*").alias("n"), F.count_if("a").alias("n_async"), F.count_if("u").alias("n_undocumented"))


@R.query("element_chains", WALK + "SELECT w.element_id, len(w.ancestors) AS n_containers, p.element_id AS root_element FROM walk w JOIN current_rows p ON p.row_id = w.root_id")
def element_chains(spark: SparkSession, d: str) -> DataFrame:
    cur = current_elements(spark, d, "row_id", "element_id", "name", "parent_id")
    nodes = hierarchy.hierarchies(cur.withColumnRenamed("row_id", "id")).where(F.col("root_id").isNotNull())
    return nodes.join(cur.select(F.col("row_id").alias("root_id"), F.col("element_id").alias("root_element")), "root_id").select("element_id", F.size("ancestors").cast("long").alias("n_containers"), "root_element")


# --- clusters: labels are clusters, memberships follow from the cosine to their centroids ------------

V = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings), x AS (SELECT id, label, unnest(vec) AS value, generate_subscripts(vec, 1) AS pos FROM v), c0 AS (SELECT label, pos, avg(value) AS value FROM x GROUP BY 1, 2), cen AS (SELECT label, list(value ORDER BY pos) AS centroid, count(*) AS dims FROM c0 GROUP BY 1)"
M = V + ", s AS (SELECT v.id, cen.label, greatest(list_cosine_similarity(v.vec, cen.centroid), 0) AS s FROM v, cen), m AS (SELECT id, label, s / sum(s) OVER (PARTITION BY id) AS w FROM s QUALIFY sum(s) OVER (PARTITION BY id) > 0)"
A = M + ", a AS (SELECT x.label AS a, y.label AS b, sum(x.w * y.w) AS affinity FROM m x JOIN m y USING (id) GROUP BY 1, 2)"


def rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


@R.query("centroid", f"WITH {V} SELECT label, list_transform(centroid, lambda z: round(z, 8)) AS centroid FROM cen")
def centroid(spark: SparkSession, d: str) -> DataFrame:
    return clusters.centroids(rows(spark, d)).select("label", F.transform("centroid", lambda z: F.round(z, 8)).alias("centroid"))


@R.query("soft_membership", f"WITH {M} SELECT id, label, round(w, 8) AS w FROM m WHERE w >= 0.01")
def soft_membership(spark: SparkSession, d: str) -> DataFrame:
    return clusters.memberships(rows(spark, d)).where("w >= 0.01").select("id", "label", F.round("w", 8).alias("w"))


@R.query("primary_cluster", f"WITH {M}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(w, 10) DESC, label) AS place FROM m) SELECT id, label, round(w, 8) AS w FROM r WHERE place = 1")
def primary_cluster(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("id").orderBy(F.round("w", 10).desc(), "label")
    return clusters.memberships(rows(spark, d)).withColumn("place", F.row_number().over(w)).where("place = 1").select("id", "label", F.round("w", 8).alias("w"))


@R.query("affinity_matrix", f"WITH {A} SELECT a, b, round(affinity, 6) AS affinity FROM a")
def affinity_matrix(spark: SparkSession, d: str) -> DataFrame:
    return clusters.affinities(clusters.memberships(rows(spark, d))).select("a", "b", F.round("affinity", 6).alias("affinity"))


@R.query("affinity_p90", f"WITH {A} SELECT round(quantile_cont(affinity, 0.9), 6) AS p90, count(*) AS n FROM a WHERE a < b")
def affinity_p90(spark: SparkSession, d: str) -> DataFrame:
    a = clusters.affinities(clusters.memberships(rows(spark, d)))
    return a.where("a < b").agg(F.round(F.percentile("affinity", 0.9), 6).alias("p90"), F.count("*").alias("n"))


@R.query("connected_features", f"WITH {A}, p AS (SELECT quantile_cont(affinity, 0.9) AS p90 FROM a WHERE a < b) SELECT a, b, round(affinity, 6) AS affinity FROM a, p WHERE a <> b AND round(affinity, 9) >= round(p90, 9)")
def connected_features(spark: SparkSession, d: str) -> DataFrame:
    a = clusters.affinities(clusters.memberships(rows(spark, d)))
    p = a.where("a < b").agg(F.percentile("affinity", 0.9).alias("p90"))
    return a.where("a <> b").join(F.broadcast(p)).where(F.round("affinity", 9) >= F.round("p90", 9)).select("a", "b", F.round("affinity", 6).alias("affinity"))


@R.query("feature_members", f"WITH {M}, r AS (SELECT label, id, w, row_number() OVER (PARTITION BY label ORDER BY round(w, 10) DESC, id) AS place FROM m WHERE w >= 0.15) SELECT label, id, round(w, 8) AS w, CAST(place AS INTEGER) AS place FROM r WHERE place <= 15")
def feature_members(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("label").orderBy(F.round("w", 10).desc(), "id")
    return clusters.memberships(rows(spark, d)).where("w >= 0.15").withColumn("place", F.row_number().over(w)).where("place <= 15").select("label", "id", F.round("w", 8).alias("w"), "place")


@R.query("shared_members", f"WITH {M}, k AS (SELECT id, label FROM m WHERE w >= 0.12) SELECT x.label AS a, y.label AS b, count(*) AS n_shared FROM k x JOIN k y ON x.id = y.id AND x.label < y.label GROUP BY 1, 2")
def shared_members(spark: SparkSession, d: str) -> DataFrame:
    k = clusters.memberships(rows(spark, d)).where("w >= 0.12").groupBy("id").agg(F.array_sort(F.collect_set("label")).alias("ls"))  # as many labels as there are clusters
    x = k.select(F.explode(F.expr("flatten(transform(ls, (p, i) -> transform(slice(ls, i + 2, size(ls)), q -> struct(p AS a, q AS b))))")).alias("p"))
    return x.groupBy("p.a", "p.b").agg(F.count("*").alias("n_shared"))


@R.query("vector_map")
def vector_map(spark: SparkSession, d: str) -> DataFrame:
    """Two coordinates of each vector (principal components) with their bounds."""
    return clusters.coordinates(rows(spark, d), 2)


@R.query("hard_clusters")
def hard_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters found from the vectors alone: spherical k-means, fitted on all rows."""
    return clusters.spherical_kmeans(rows(spark, d), 10)

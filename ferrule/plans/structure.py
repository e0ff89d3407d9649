"""Queries on heavy keys (problem 6) and on hierarchies (problem 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators import hierarchy, skew
from ferrule.plans.registry import Registry
from ferrule.sources.tables import current_elements, table

R = Registry()
KEYS = ["repository", "relative_path"]
HEAVY_SHARE = 0.05

CURRENT = """current_rows AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY element_id ORDER BY indexed_at DESC NULLS LAST, row_id DESC) AS rn
  FROM code_elements) WHERE rn = 1)"""
WALK = f"""WITH RECURSIVE {CURRENT},
walk AS (
  SELECT c.row_id, c.element_id, c.row_id AS root_id, c.element_id AS root_element_id, 0 AS depth, coalesce(c.name, '') AS path, CAST([] AS BIGINT[]) AS ancestors
  FROM current_rows c LEFT JOIN current_rows p ON c.parent_id = p.element_id WHERE p.row_id IS NULL
  UNION ALL
  SELECT c.row_id, c.element_id, w.root_id, w.root_element_id, w.depth + 1, w.path || '/' || coalesce(c.name, ''), list_append(w.ancestors, w.row_id)
  FROM walk w JOIN current_rows c ON c.parent_id = w.element_id)"""


def totals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "code_elements")
    size = (F.col("line_end") - F.col("line_start") + 1).cast("long")
    return skew.keyed_totals(skew.rows_by_key(rows.select(*KEYS, "line_start", "line_end", "indexed_at", "row_id"), KEYS, size, "indexed_at", "row_id"))


@R.query(
    "p6_key_totals",
    """WITH r AS (SELECT 'repository' AS key_field, repository AS key_value, line_end - line_start + 1 AS size, indexed_at AS seen, row_id FROM code_elements
  UNION ALL SELECT 'relative_path', relative_path, line_end - line_start + 1, indexed_at, row_id FROM code_elements),
g AS (SELECT *, epoch_us(seen) - epoch_us(lag(seen) OVER (PARTITION BY key_field, key_value ORDER BY seen, row_id)) AS gap FROM r)
SELECT key_field, key_value, count(*) AS n_rows, CAST(sum(size) AS BIGINT) AS total_size, min(seen) AS first_at, max(seen) AS last_at, max(gap) AS widest_gap_us
FROM g GROUP BY 1, 2""",
)
def p6_key_totals(spark: SparkSession, d: str) -> DataFrame:
    return totals(spark, d)


@R.query(
    "p6_found",
    """SELECT key_field, key_value FROM (SELECT 'repository' AS key_field, repository AS key_value, count(*) AS n FROM code_elements GROUP BY 2
  UNION ALL SELECT 'relative_path', relative_path, count(*) FROM code_elements GROUP BY 2) WHERE n > (SELECT count(*) FROM code_elements) * 0.05""",
)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_keys(totals(spark, d), HEAVY_SHARE).select("key_field", "key_value")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    rows = current_elements(spark, d, "row_id", "element_id", "name", "parent_id")
    return hierarchy.hierarchies(rows.withColumnRenamed("row_id", "id"))


@R.query(
    "p7_hierarchy",
    WALK
    + """, kids AS (SELECT a AS row_id, count(*) AS n FROM (SELECT unnest(ancestors) AS a FROM walk) GROUP BY 1)
SELECT c.element_id, w.root_id, CAST(w.depth AS INTEGER) AS depth, w.path, CASE WHEN w.row_id IS NULL THEN NULL ELSE coalesce(k.n, 0) END AS n_descendants, w.row_id IS NULL AS looped
FROM current_rows c LEFT JOIN walk w ON c.row_id = w.row_id LEFT JOIN kids k ON c.row_id = k.row_id""",
)
def p7_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    found = hierarchy.cut(nodes(spark, d))
    below = hierarchy.descendant_pairs(found).groupBy(F.col("ancestor_id").alias("id")).agg(F.count("*").alias("n"))
    n = F.when(F.col("root_id").isNotNull(), F.coalesce("n", F.lit(0)))
    return found.join(below, "id", "left").select("element_id", "root_id", "depth", "path", n.alias("n_descendants"), (F.col("in_loop") | F.col("below_loop")).alias("looped"))


@R.query(
    "p7_descendants",
    WALK + "SELECT unnest(ancestors) AS ancestor_id, row_id AS descendant_id, CAST(depth - generate_subscripts(ancestors, 1) + 1 AS INTEGER) AS distance FROM walk",
)
def p7_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendant_pairs(nodes(spark, d))


@R.query(
    "p7_found",
    WALK + "SELECT c.element_id FROM current_rows c WHERE c.row_id NOT IN (SELECT row_id FROM walk)",
)
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    rows = current_elements(spark, d, "row_id", "element_id", "name", "parent_id")
    return hierarchy.looped_nodes(rows.withColumnRenamed("row_id", "id")).select("element_id")

"""Snapshot differences, key lookups, upserts and deletions, relocation and orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators import changes
from ferrule.plans.registry import Registry
from ferrule.plans.statistics import CUR, NEW
from ferrule.sources.tables import current_elements, latest_per_key, newest_files, table

R = Registry()
KEY = ["repository", "relative_path"]

# Two snapshots of the main branch: the first scan of each file is the stored state, the newest the disk's.
OLD_SQL = "old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repository, username, relative_path ORDER BY scanned_at, row_id) AS rn FROM file_states) WHERE rn = 1)"


def first_scans(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "file_states").select("repository", "username", "relative_path", "file_hash", "is_deleted", "scanned_at", "row_id")
    t = F.col("scanned_at").cast("timestamp_ntz")
    micros = F.lit(0) - F.unix_micros(t.cast("timestamp"))
    return latest_per_key(rows.withColumns({"back": micros, "back_id": -F.col("row_id")}), ["repository", "username", "relative_path"], ["back", "back_id"]).drop("back", "back_id")


@R.query("diff_main", f"""WITH {NEW}, {OLD_SQL}, n AS (SELECT * FROM newest WHERE username = 'main' AND NOT is_deleted), o AS (SELECT * FROM old WHERE username = 'main' AND NOT is_deleted)
 SELECT coalesce(n.repository, o.repository) AS repository, coalesce(n.relative_path, o.relative_path) AS relative_path,
 CASE WHEN o.relative_path IS NULL THEN 'new' WHEN n.relative_path IS NULL THEN 'deleted' WHEN n.file_hash IS DISTINCT FROM o.file_hash THEN 'modified' ELSE 'unchanged' END AS change
 FROM n FULL JOIN o ON n.repository = o.repository AND n.relative_path = o.relative_path""")
def diff_main(spark: SparkSession, d: str) -> DataFrame:
    new = newest_files(spark, d, *KEY, "username", "file_hash", "is_deleted").where("username = 'main' AND NOT is_deleted")
    old = first_scans(spark, d).where("username = 'main' AND NOT is_deleted")
    return changes.compare_main(new, old, KEY).select(*KEY, "change")


@R.query("diff_user_3way", f"""WITH {NEW}, u AS (SELECT repository, username, relative_path, file_hash, is_deleted FROM newest WHERE username <> 'main'), m AS (SELECT repository, relative_path, file_hash, is_deleted FROM newest WHERE username = 'main')
 SELECT u.repository, u.username, u.relative_path, CASE WHEN u.is_deleted AND m.relative_path IS NOT NULL AND NOT m.is_deleted THEN 'deleted_by_user' WHEN u.is_deleted THEN 'already_deleted' WHEN m.relative_path IS NULL OR m.is_deleted THEN 'new'
  WHEN u.file_hash = m.file_hash THEN 'same_as_main' ELSE 'modified' END AS change FROM u LEFT JOIN m USING (repository, relative_path)""")
def diff_user_3way(spark: SparkSession, d: str) -> DataFrame:
    rows = newest_files(spark, d, *KEY, "username", "file_hash", "is_deleted")
    return changes.compare_user(rows.where("username <> 'main'"), rows.where("username = 'main'"), KEY).select(*KEY, "username", "change")


@R.query("relocation_by_hash", f"""WITH {NEW}, {OLD_SQL}, gone AS (SELECT o.repository, o.relative_path, o.file_hash FROM old o JOIN newest n USING (repository, username, relative_path) WHERE o.username = 'main' AND n.is_deleted AND o.file_hash IS NOT NULL),
 r AS (SELECT g.repository, g.relative_path AS old_path, n.relative_path AS new_path, row_number() OVER (PARTITION BY g.repository, g.relative_path ORDER BY n.relative_path) AS place FROM gone g JOIN newest n ON n.repository = g.repository AND n.file_hash = g.file_hash AND n.username = 'main' AND NOT n.is_deleted AND n.relative_path <> g.relative_path)
 SELECT repository, old_path, new_path FROM r WHERE place = 1""")
def relocation_by_hash(spark: SparkSession, d: str) -> DataFrame:
    new = newest_files(spark, d, "repository", "username", "relative_path", "file_hash", "is_deleted").where("username = 'main'")
    gone = first_scans(spark, d).where("username = 'main' AND file_hash IS NOT NULL").select("repository", "relative_path", "file_hash").join(new.where("is_deleted").select("repository", "relative_path"), KEY, "left_semi")
    return changes.relocated(gone, new.where("NOT is_deleted"))


@R.query("orphan_paths", f"WITH {CUR}, {NEW} SELECT DISTINCT c.repository, c.username, c.relative_path FROM cur c WHERE NOT EXISTS (SELECT 1 FROM newest n WHERE n.repository = c.repository AND n.username = c.username AND n.relative_path = c.relative_path AND NOT n.is_deleted)")
def orphan_paths(spark: SparkSession, d: str) -> DataFrame:
    key = ["repository", "username", "relative_path"]
    return current_elements(spark, d, *key).distinct().join(newest_files(spark, d, *key, "is_deleted").where("NOT is_deleted"), key, "left_anti")


@R.query("unparsed_files", f"WITH {NEW} SELECT n.repository, n.username, n.relative_path FROM newest n WHERE NOT n.is_deleted AND NOT EXISTS (SELECT 1 FROM parsed_files p WHERE p.repository = n.repository AND p.username = n.username AND p.relative_path = n.relative_path)")
def unparsed_files(spark: SparkSession, d: str) -> DataFrame:
    key = ["repository", "username", "relative_path"]
    return newest_files(spark, d, *key, "is_deleted").where("NOT is_deleted").drop("is_deleted").join(table(spark, d, "parsed_files").select(*key), key, "left_anti")


@R.query("stale_versions", f"WITH {CUR} SELECT e.row_id FROM code_elements e WHERE e.row_id NOT IN (SELECT row_id FROM cur)")
def stale_versions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_elements").select("row_id").join(current_elements(spark, d, "row_id"), "row_id", "left_anti")


@R.query("multi_get", f"WITH {CUR}, w AS (SELECT DISTINCT parent_id AS wanted FROM code_elements WHERE element_type = 'method') SELECT w.wanted, c.row_id, c.name, c.element_type FROM w LEFT JOIN cur c ON c.element_id = w.wanted")
def multi_get(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "code_elements").where("element_type = 'method'").select(F.col("parent_id").alias("wanted")).distinct()
    cur = current_elements(spark, d, "element_id", "row_id", "name", "element_type")
    return wanted.join(cur, F.col("element_id") == F.col("wanted"), "left").select("wanted", "row_id", "name", "element_type")


@R.query("existing_parents", f"WITH {CUR} SELECT DISTINCT element_id FROM cur WHERE element_id IN (SELECT parent_id FROM cur)")
def existing_parents(spark: SparkSession, d: str) -> DataFrame:
    cur = current_elements(spark, d, "element_id", "parent_id")
    return cur.select("element_id").join(cur.select(F.col("parent_id").alias("element_id")), "element_id", "left_semi")


@R.query("upsert_last_writer", "SELECT doc_type, repository, count(*) AS n, max(created_at) AS last_at FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY created_at DESC NULLS LAST, doc_id DESC) AS rn FROM documents) WHERE rn = 1 GROUP BY 1, 2")
def upsert_last_writer(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "doc_type", "repository", "created_at").withColumn("key", F.md5("text"))
    return latest_per_key(docs.drop("text"), ["key"], ["created_at", "doc_id"]).groupBy("doc_type", "repository").agg(F.count("*").alias("n"), F.max("created_at").alias("last_at"))


@R.query("delete_then_count", f"WITH {CUR}, {NEW}, gone AS (SELECT repository, username, relative_path FROM newest WHERE is_deleted) SELECT c.repository, count(*) AS n_left FROM cur c LEFT JOIN gone g USING (repository, username, relative_path) WHERE g.relative_path IS NULL GROUP BY 1")
def delete_then_count(spark: SparkSession, d: str) -> DataFrame:
    key = ["repository", "username", "relative_path"]
    gone = newest_files(spark, d, *key, "is_deleted").where("is_deleted").select(*key)
    return changes.delete_by_key(current_elements(spark, d, *key), gone, key).groupBy("repository").agg(F.count("*").alias("n_left"))


@R.query("hash_updates", f"WITH {CUR}, {NEW} SELECT c.repository, c.relative_path, c.username, n.file_hash, n.element_count FROM cur c LEFT JOIN newest n USING (repository, username, relative_path) WHERE c.element_type = 'file'")
def hash_updates(spark: SparkSession, d: str) -> DataFrame:
    key = ["repository", "username", "relative_path"]
    files = current_elements(spark, d, *key, "element_type", types=("file",)).drop("element_type")
    return changes.update_by_key(files.withColumns({"file_hash": F.lit(None).cast("string"), "element_count": F.lit(None).cast("int")}), newest_files(spark, d, *key, "file_hash", "element_count"), key, ["file_hash", "element_count"])


@R.query("context_of_methods", f"""WITH {CUR} SELECT m.element_id, p.name AS parent_name, p.element_type AS parent_type, coalesce(k.n_siblings, 0) AS n_siblings FROM cur m LEFT JOIN cur p ON m.parent_id = p.element_id
 LEFT JOIN (SELECT parent_id, count(*) - 1 AS n_siblings FROM cur WHERE parent_id IS NOT NULL GROUP BY 1) k ON k.parent_id = m.parent_id WHERE m.element_type = 'method'""")
def context_of_methods(spark: SparkSession, d: str) -> DataFrame:
    cur = current_elements(spark, d, "element_id", "parent_id", "name", "element_type")
    parents = cur.select(F.col("element_id").alias("parent_id"), F.col("name").alias("parent_name"), F.col("element_type").alias("parent_type"))
    kids = cur.where(F.col("parent_id").isNotNull()).groupBy("parent_id").agg((F.count("*") - 1).alias("n_siblings"))
    return cur.where("element_type = 'method'").join(parents, "parent_id", "left").join(kids, "parent_id", "left").select("element_id", "parent_name", "parent_type", F.coalesce("n_siblings", F.lit(0)).alias("n_siblings"))


@R.query("children_in_order", f"WITH {CUR} SELECT parent_id, list(name ORDER BY line_start NULLS LAST, row_id) AS children FROM cur WHERE parent_id IS NOT NULL GROUP BY 1")
def children_in_order(spark: SparkSession, d: str) -> DataFrame:
    cur = current_elements(spark, d, "row_id", "parent_id", "line_start", "name").where(F.col("parent_id").isNotNull())
    rank = F.struct(F.col("line_start").isNull().alias("none"), "line_start", "row_id", "name")
    return cur.groupBy("parent_id").agg(F.transform(F.array_sort(F.collect_list(rank)), lambda x: x["name"]).alias("children"))


@R.query("browse_page", f"WITH {CUR} SELECT c.element_id, c.language, p.name AS parent_name FROM cur c LEFT JOIN cur p ON c.parent_id = p.element_id WHERE c.element_type = 'class' ORDER BY c.element_id LIMIT 50 OFFSET 100")
def browse_page(spark: SparkSession, d: str) -> DataFrame:
    cur = current_elements(spark, d, "element_id", "parent_id", "name", "element_type", "language")
    page = cur.where("element_type = 'class'").orderBy("element_id").offset(100).limit(50)
    return page.select("element_id", "language", "parent_id").join(cur.select(F.col("element_id").alias("parent_id"), F.col("name").alias("parent_name")), "parent_id", "left").select("element_id", "language", "parent_name")

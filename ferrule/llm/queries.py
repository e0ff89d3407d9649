"""Queries of the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm import docpairs, endings, handwritten, leaks, neighbours, packing, split, syntax
from ferrule.plans.registry import Registry
from ferrule.session import cut
from ferrule.sources.tables import current_elements, latest_per_key, newest_files, table

R = Registry()
FILE = ["repository", "username", "relative_path"]
CURRENT = """WITH current_rows AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY element_id ORDER BY indexed_at DESC NULLS LAST, row_id DESC) AS rn
  FROM code_elements) WHERE rn = 1)"""


def registries() -> list[Registry]:
    return [R]


def file_key() -> F.Column:
    return F.concat_ws("\x1f", *FILE)


def current_files(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Current ``file`` elements; the type is part of the element_id, so the filter may come first."""
    rows = table(spark, d, "code_elements").where(F.col("element_type") == "file")
    need = list(dict.fromkeys(["element_id", "row_id", "indexed_at", *columns]))
    return latest_per_key(rows.select(*need), ["element_id"], ["indexed_at", "row_id"]).select(*columns)


# --- 1 ---------------------------------------------------------------------------------------------


@R.query("p1_pieces")
def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_oversized(current_elements(spark, d, "element_id", "raw_code"))


@R.query("p1_found", f"{CURRENT} SELECT element_id FROM current_rows WHERE length(raw_code) > 8191")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Only oversized rows can be found, so only these carry their text into a join; all others are keys."""
    rows = table(spark, d, "code_elements")
    now = current_elements(spark, d, "element_id", "row_id")
    large = rows.where(F.length("raw_code") > split.LIMIT).select("element_id", "row_id", "raw_code")
    pieces = split.split_oversized(large.join(now, ["element_id", "row_id"], "left_semi"))
    return pieces.where((F.col("n_pieces") > 1) & (F.col("piece_no") == 0)).select("element_id")


# --- 2 ---------------------------------------------------------------------------------------------

VECTORS = ["summary_embedding", "code_embedding"]
SIMILAR = 0.9


def field_name() -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in VECTORS]), F.col("field") + 1)


@R.query("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs are found and kept by row_id; only those that remain get their element_ids."""
    rows = table(spark, d, "code_elements")
    near = neighbours.settled(neighbours.nearest(rows, VECTORS, least=SIMILAR), rows, VECTORS, SIMILAR)
    pairs = near.select("field", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ids = rows.select("row_id", "element_id")
    named = pairs.join(ids.withColumnsRenamed({"row_id": "a", "element_id": "ea"}), "a").join(ids.withColumnsRenamed({"row_id": "b", "element_id": "eb"}), "b")
    return named.select(field_name().alias("field"), F.least("ea", "eb").alias("element_id_a"), F.greatest("ea", "eb").alias("element_id_b"))


#: Candidates, as a share of the collection, at which the search for all ten neighbours ends.
ASCENT = 0.75


@R.query("p2_neighbours")
def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar of every row whose id is divisible by 50, among all rows.

    Most of these neighbours are hardly similar, so the search ascends until the nodes hold a fixed share of
    the collection; its cost grows as that of any search of these queries in all rows.
    """
    near = neighbours.nearest(table(spark, d, "code_elements"), VECTORS, candidates=lambda n: ASCENT * n, ask=lambda c: c % 50 == 0)
    return near.select(field_name().alias("field"), F.col("a").alias("row_id"), F.col("b").alias("neighbour_row_id"), F.round("sim", 3).alias("similarity"), "place")


# --- 3 ---------------------------------------------------------------------------------------------


def pairs(spark: SparkSession, d: str) -> DataFrame:
    cols = ["element_id", *FILE, "language", "name", "signature", "docstring", "raw_code", "line_start"]
    rows = table(spark, d, "code_elements").where(F.col("element_type").isin("function", "method"))
    functions = latest_per_key(rows.select(*cols, "row_id", "indexed_at"), ["element_id"], ["indexed_at", "row_id"])
    files = current_files(spark, d, *FILE, "language", "raw_code")
    return docpairs.documented_functions(
        functions.withColumn("file_key", file_key()), files.select(file_key().alias("file_key"), "language", F.col("raw_code").alias("text"))
    )


@R.query("p3_pairs")
def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d)


@R.query("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("element_id").distinct()


# --- 4 ---------------------------------------------------------------------------------------------


def written_elsewhere(spark: SparkSession, d: str) -> DataFrame:
    """Texts are judged where the current rows are found, and only what they tell meets the scans.

    Of files without text only the place tells.
    """
    files = newest_files(spark, d, *FILE, "language", "is_deleted").where(~F.coalesce("is_deleted", F.lit(False))).drop("is_deleted")
    texts = current_files(spark, d, *FILE, "indexed_at", "row_id", "raw_code").withColumnRenamed("raw_code", "text")
    judged = latest_per_key(cut(handwritten.judge(texts, "indexed_at", "row_id")), FILE, ["indexed_at", "row_id"]).drop("indexed_at", "row_id")
    seen = cut(files.join(judged.hint("merge"), FILE, "left"))
    versions = table(spark, d, "code_elements").where(F.col("element_type") == "file").select(*FILE, F.col("raw_code").alias("text"))
    known = handwritten.decided(seen.where(F.col("is_tiny").isNotNull()), versions)
    return known.unionByName(seen.where(F.col("is_tiny").isNull()).select(*FILE, handwritten.kind_by_place().alias("kind")).where(F.col("kind").isNotNull()))


@R.query("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return written_elsewhere(spark, d).select(*FILE).distinct()


@R.query("p4_kinds")
def p4_kinds(spark: SparkSession, d: str) -> DataFrame:
    return written_elsewhere(spark, d).groupBy("repository", "kind").agg(F.count("*").alias("n_files"))


# --- 5 ---------------------------------------------------------------------------------------------


def checked(spark: SparkSession, d: str) -> DataFrame:
    """Every current file with the verdict on its text; ``is_valid`` is true where there is nothing to judge."""
    files = current_files(spark, d, "row_id", *FILE, "language", "raw_code")
    found = syntax.validity(files.select(F.col("row_id").alias("id"), "language", F.col("raw_code").alias("text")))
    keys = current_files(spark, d, "row_id", *FILE, "language").withColumnRenamed("row_id", "id")
    return keys.join(found, "id", "left").withColumn("is_valid", F.coalesce("is_valid", F.lit(True)))


@R.query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """TOML files are judged as all others, but by the definition of the cases never count as one."""
    return checked(spark, d).where(~F.col("is_valid") & (F.col("language") != "toml")).select(*FILE).distinct()


@R.query("p5_rates")
def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of invalid files by repository and by language, and how many the parser's messages tell of."""
    said = table(spark, d, "parsed_files").select(*FILE, F.explode("parse_errors").alias("said"))
    said = said.where(F.col("said").rlike("(?i)syntax|unexpected|eof")).select(*FILE).distinct().withColumn("reported", F.lit(True))
    files = checked(spark, d).join(said, FILE, "left")
    by = F.explode(F.array(F.struct(F.lit("repository").alias("key_field"), F.col("repository").alias("key_value")), F.struct(F.lit("language").alias("key_field"), F.col("language").alias("key_value"))))
    return files.select(by.alias("k"), "is_valid", "reported").groupBy("k.key_field", "k.key_value").agg(
        F.count("*").alias("n_files"), F.count_if(~F.col("is_valid")).alias("n_invalid"), (F.count_if(~F.col("is_valid")) / F.count("*")).alias("share_invalid"), F.count_if(F.coalesce("reported", F.lit(False))).alias("n_reported")
    )


# --- 8 ---------------------------------------------------------------------------------------------


@R.query("p8_containers")
def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.token_counts(table(spark, d, "documents")))


@R.query("p8_fill")
def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are, by twentieths of the capacity."""
    fill = p8_containers(spark, d).where(F.col("container").isNotNull()).groupBy("container").agg(F.sum("n_tokens").alias("used"))
    return fill.groupBy(F.floor(F.col("used") * 20 / packing.CAPACITY).alias("twentieths")).agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"))


@R.query("p8_bound")
def p8_bound(spark: SparkSession, d: str) -> DataFrame:
    """Containers in use beside the least number that could hold all tokens, and the share of their room in use."""
    fill = p8_containers(spark, d).where(F.col("container").isNotNull()).agg(F.count_distinct("container").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    room = F.col("n_containers") * packing.CAPACITY
    return fill.select("n_containers", F.ceil(F.col("n_tokens") / packing.CAPACITY).alias("least_containers"), "n_tokens", (F.col("n_tokens") / room).alias("share_used"))


# --- 9 ---------------------------------------------------------------------------------------------


@R.query("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


@R.query("p9_leaked_items")
def p9_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """How many documents each evaluation item leaked into, also 0."""
    n = p9_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n"))
    return table(spark, d, "eval_items").join(n, "item_id", "left").select("item_id", "suite", F.coalesce("n", F.lit(0)).alias("n_documents"))


# --- 10 --------------------------------------------------------------------------------------------


@R.query("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return endings.truncated(table(spark, d, "documents")).where("is_cut").select("doc_id")


@R.query("p10_sources")
def p10_sources(spark: SparkSession, d: str) -> DataFrame:
    """Share of truncated rows of each source."""
    return endings.truncated(table(spark, d, "documents")).groupBy("source").agg(
        F.count("*").alias("n_documents"), F.count_if("is_cut").alias("n_cut"), (F.count_if("is_cut") / F.count("*")).alias("share_cut"), F.count_if(F.col("at_limit").isNotNull()).alias("n_at_limit")
    )


@R.query("p10_routes")
def p10_routes(spark: SparkSession, d: str) -> DataFrame:
    """How many texts each kind of ending decides, and of how many of them only an exposed limit."""
    by_limit = (F.col("ending") == "open") & F.col("at_limit").isNotNull()
    return endings.truncated(table(spark, d, "documents")).groupBy("route", "ending").agg(
        F.count("*").alias("n_documents"), F.count_if("is_cut").alias("n_cut"), F.count_if(F.col("at_limit").isNotNull()).alias("n_at_limit"), F.count_if(by_limit).alias("n_by_limit")
    )


@R.query("p10_limits")
def p10_limits(spark: SparkSession, d: str) -> DataFrame:
    return endings.limits(endings.measured(table(spark, d, "documents")))

"""Readers of the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "code_elements file_states parsed_files eval_items"
).split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {n: table(spark, folder, n) for n in NAMES}


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the greatest by ``order`` (all descending, nulls last).

    Spark keeps the first row of each key within every map task before the shuffle, so that a key
    with a third of all rows sends at most one row a task. A null key is a key of its own.
    """
    mark = "__rank_of_version"
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn(mark, F.row_number().over(w)).where(F.col(mark) == 1).drop(mark)


def current_elements(spark: SparkSession, folder: str, *columns: str, types: tuple[str, ...] = ()) -> DataFrame:
    """Current rows of ``code_elements``: newest ``indexed_at``, then greatest ``row_id``.

    ``types`` keeps the elements of these types only. The type is part of the ``element_id``, so all versions of an
    element have the same one and the filter may come before the versions are compared: it reaches the scan, and
    the texts of other types are never shuffled.
    """
    rows = table(spark, folder, "code_elements")
    if types:
        rows = rows.where(F.col("element_type").isin(*types))
    need = list(dict.fromkeys(["element_id", "row_id", "indexed_at", *columns]))
    return latest_per_key(rows.select(*need), ["element_id"], ["indexed_at", "row_id"]).select(*columns)


def newest_files(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Newest scan of each (repository, username, relative_path) of ``file_states``."""
    key = ["repository", "username", "relative_path"]
    need = list(dict.fromkeys([*key, "row_id", "scanned_at", *columns]))
    return latest_per_key(table(spark, folder, "file_states").select(*need), key, ["scanned_at", "row_id"]).select(*columns)

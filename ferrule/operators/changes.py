"""Differences between snapshots, and functional updates and deletions of keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare_main(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """``key, change``: new, deleted, modified or unchanged, by ``file_hash`` (null equals null).

    One full outer join on the key; rows with a null key are new or deleted, as null matches nothing.
    """
    a = new.select(*key, F.col("file_hash").alias("new_hash"), F.lit(True).alias("in_new"))
    b = old.select(*key, F.col("file_hash").alias("old_hash"), F.lit(True).alias("in_old"))
    change = F.when(F.col("in_old").isNull(), "new").when(F.col("in_new").isNull(), "deleted").when(~F.col("new_hash").eqNullSafe(F.col("old_hash")), "modified").otherwise("unchanged")
    return a.join(b, key, "full").select(*key, change.alias("change"))


def compare_user(user: DataFrame, main: DataFrame, key: list[str]) -> DataFrame:
    """How each of a user's files stands to the main branch; files equal to main's need no work."""
    m = main.select(*key, F.col("file_hash").alias("main_hash"), F.col("is_deleted").alias("main_deleted"), F.lit(True).alias("in_main"))
    there = F.col("in_main").isNotNull() & ~F.col("main_deleted")
    change = (
        F.when(F.col("is_deleted") & there, "deleted_by_user").when(F.col("is_deleted"), "already_deleted").when(F.col("in_main").isNull() | F.col("main_deleted"), "new").when(F.col("file_hash") == F.col("main_hash"), "same_as_main").otherwise("modified")
    )
    return user.join(m, key, "left").withColumn("change", change)


def relocated(gone: DataFrame, present: DataFrame) -> DataFrame:
    """``repository, old_path, new_path``: a vanished file whose content lives on under another path (the first)."""
    p = present.select("repository", "file_hash", F.col("relative_path").alias("new_path"))
    j = gone.join(p, ["repository", "file_hash"]).where(F.col("new_path") != F.col("relative_path"))
    return j.groupBy("repository", F.col("relative_path").alias("old_path")).agg(F.min("new_path").alias("new_path"))


def delete_by_key(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key isn't in ``gone``; null keys stay."""
    return rows.join(gone.select(*key), key, "left_anti")


def update_by_key(rows: DataFrame, updates: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows with ``columns`` taken from ``updates`` (one row a key) where it has a value."""
    u = updates.select(*key, *[F.col(c).alias(f"__new_{c}") for c in columns])
    out = [F.coalesce(f"__new_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns]
    return rows.join(u, key, "left").select(*out)


def upsert(rows: DataFrame, news: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``news`` in place of those with the same key, and all others."""
    return rows.join(news.select(*key), key, "left_anti").unionByName(news)

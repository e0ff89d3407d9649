"""Relationships between elements as keyed edges, and references to what lies outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ARROW = "→"


def relationship_key(source: Column, target: Column, kind: Column, scope: Column, repository: Column) -> Column:
    """The same for every user's copy of an edge."""
    return F.concat(scope, F.lit(":"), repository, F.lit(":"), source, F.lit(ARROW), target, F.lit(":"), kind)


def relationship_id(source: Column, target: Column, kind: Column, scope: Column, repository: Column, username: Column) -> Column:
    text = F.concat(scope, F.lit(":"), repository, F.lit(":"), username, F.lit(":"), source, F.lit(ARROW), target, F.lit(":"), kind)
    return F.substring(F.sha2(text, 256), 1, 12)


def priority(username: Column) -> Column:
    """A user's copy goes before that of the main branch."""
    return F.when(username == "main", F.lit(0)).otherwise(F.lit(1)).cast("byte")


def relationships(edges: DataFrame) -> DataFrame:
    """``edges`` (``scope, repository, username, source_hash, target_hash, relationship_type``) with their key, id and priority.

    Edges without a source or target are left out.
    """
    c = {k: F.col(k) for k in ("source_hash", "target_hash", "relationship_type", "scope", "repository", "username")}
    s, t, k, sc, r, u = c.values()
    return edges.where(s.isNotNull() & t.isNotNull()).withColumns({"relationship_key": relationship_key(s, t, k, sc, r), "relationship_id": relationship_id(s, t, k, sc, r, u), "priority": priority(u)})


def collapsed(edges: DataFrame) -> DataFrame:
    """One row for each key: the highest priority, then the newest, then the least id."""
    w = Window.partitionBy("relationship_key").orderBy(F.col("priority").desc(), F.col("indexed_at").desc_nulls_last(), "relationship_id")
    return edges.withColumn("__place", F.row_number().over(w)).where(F.col("__place") == 1).drop("__place")

"""Edges, bounded chains, reachability and interval containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.session import cut


def chain(edges: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """``id, depth``: nodes within ``max_depth`` steps of ``starts`` (``id``), at their least depth.

    ``edges``: ``src, dst``. Each step joins only the newest nodes with the edges and drops those seen
    before, so loops end and no path is enumerated. The edges are read and partitioned by ``src`` once, for all steps.
    """
    edges = cut(edges.select("src", "dst").where(F.col("src").isNotNull() & F.col("dst").isNotNull()).repartition("src"))
    seen = cut(starts.select("id").distinct().withColumn("depth", F.lit(0)))
    newest = seen
    for k in range(1, max_depth + 1):
        step = newest.join(edges, newest["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct()
        newest = cut(step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(k)))
        if newest.isEmpty():
            break
        seen = seen.unionByName(newest)
    return seen


def cycle_nodes(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``id``: nodes on a cycle or on a way between two, by dropping nodes without way in or out until none is left."""
    left = cut(edges.select("src", "dst").where(F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct())
    n = left.count()
    for _ in range(max_rounds):
        smaller = cut(left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"))
        m = smaller.count()
        left = smaller
        if m == n:
            break
        n = m
    return left.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def tightest_parent(rows: DataFrame, scope: list[str], bucket: int = 64) -> DataFrame:
    """``id, parent_id``: the smallest other interval of the same scope that contains each one.

    ``rows``: ``scope, id, first, last`` (whole numbers, unique ids). Both sides are cut into buckets of
    ``bucket`` lines: an interval is offered as parent in all buckets that it touches, and looks for one
    in the bucket of its first line only, so candidates meet by an equality and a large scope is spread.
    Of equal intervals the lower id contains the higher. Rows with null bounds have no parent.
    """
    known = rows.where(F.col("first").isNotNull() & F.col("last").isNotNull() & (F.col("last") >= F.col("first")))
    offered = known.select(*scope, F.col("id").alias("pid"), F.col("first").alias("pf"), F.col("last").alias("pl"), F.explode(F.sequence(F.floor(F.col("first") / bucket), F.floor(F.col("last") / bucket))).alias("b"))
    asked = known.select(*scope, "id", "first", "last", F.floor(F.col("first") / bucket).alias("b"))
    inside = (F.col("pf") <= F.col("first")) & (F.col("pl") >= F.col("last")) & (F.col("pid") != F.col("id"))
    wider = (F.col("pl") - F.col("pf") > F.col("last") - F.col("first")) | (F.col("pid") < F.col("id"))
    best = F.min_by("pid", F.struct((F.col("pl") - F.col("pf")).alias("span"), (-F.col("pid")).alias("order")))
    return asked.join(offered, [*scope, "b"]).where(inside & wider).groupBy("id").agg(best.alias("parent_id"))


def near_lines(comments: DataFrame, targets: DataFrame, scope: list[str], distance: int) -> DataFrame:
    """``id, line``: comments up to ``distance`` lines above each target (``id, at``), met by an equality on the line."""
    wanted = targets.select(*scope, "id", F.explode(F.sequence(F.col("at") - distance, F.col("at"))).alias("line"))
    return wanted.join(comments.select(*scope, "line"), [*scope, "line"]).select("id", "line")


def normalized_cycle(nodes: Column) -> Column:
    """A cycle's nodes turned so that the smallest comes first."""
    at = F.array_position(nodes, F.array_min(nodes)).cast("int")
    return F.concat(F.slice(nodes, at, F.size(nodes) - at + 1), F.slice(nodes, F.lit(1), at - 1))


def ranked_first(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__r = 1").drop("__r")

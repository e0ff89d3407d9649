"""Parent-child links to whole hierarchies by tree contraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.session import cut

MAX_ROUNDS = 200


def resolve_parents(rows: DataFrame) -> DataFrame:
    """``id, element_id, name, par`` of ``id, element_id, name, parent_id``.

    ``par`` is the parent's ``id``, null if the parent is null or not among the rows. Rows without
    parent stay out of the join, so that they don't meet in one task.
    """
    keys = rows.select(F.col("element_id").alias("parent_id"), F.col("id").alias("par"))
    own = rows.select("id", "element_id", "name", "parent_id")
    linked = own.where(F.col("parent_id").isNotNull()).join(keys, "parent_id", "left")
    return linked.select("id", "element_id", "name", "par").unionByName(
        own.where(F.col("parent_id").isNull()).select("id", "element_id", "name", F.lit(None).cast("long").alias("par"))
    )


def hierarchies(rows: DataFrame) -> DataFrame:
    """Full path, depth, root and loops of every node of ``id, element_id, name, parent_id``.

    ``id`` (bigint) and ``element_id`` are unique. Each round *rakes* the leaves and *compresses* unary
    chains: a node with one child that is a local maximum (by a hash of id and round) among parent and
    child is spliced out, and the child keeps the spliced nodes in ``chain``. Rounds grow with the
    logarithm of the number of nodes, not with the depth. What never gets raked are loops; compression
    leaves each as one node that is its own parent, with the loop's other members in its chain. The
    recorded contractions are then undone in reverse order, each node taking its path from its parent.

    Result: ``id, element_id, name, root_id, depth, path, ancestors, in_loop, below_loop``; ``path``
    joins the names from the root by ``/`` (null names count as empty) and ``ancestors`` has the ids
    from the root down to the parent. Nodes in or below a loop have no root, depth, path or ancestors.
    Null and dangling parents make a root; an empty table gives an empty result.
    """
    record, core = _contract(rows)
    return _undo(rows, record, core)


def looped_nodes(rows: DataFrame) -> DataFrame:
    """``id, element_id`` of the nodes in or below a loop, by the same contraction.

    Only the loops' cores are expanded again, so the paths of all other nodes are never built.
    """
    record, core = _contract(rows)
    if core is None:
        return rows.sparkSession.createDataFrame([], "id long, element_id string")
    found = [core.select("id", "element_id")]
    for r in range(len(record) - 1, -1, -1):
        known = reduce(DataFrame.unionByName, found).select(F.col("id").alias("par"))
        new = record[r].join(known, "par", "left_semi").select("id", "element_id")
        found.append(cut(new) if r else new)
    return reduce(DataFrame.unionByName, found)


def _contract(rows: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """What each round took out, with the parent at that time, and the loops that remain."""
    alive = resolve_parents(rows).withColumn("chain", F.array().cast("array<struct<id:bigint,name:string>>"))
    record: list[DataFrame] = []
    for r in range(MAX_ROUNDS):
        now = cut(_classified(alive, r))
        by_state = now.groupBy("state").agg(F.count("*").alias("n"), F.count_if(F.col("par") == F.col("id")).alias("loops"))
        counts = {x["state"]: (x["n"], x["loops"]) for x in by_state.collect()}
        if "splice" in counts:  # no node and its parent are spliced out together
            out = now.where(F.col("state") == "splice")
            up = out.select(F.col("id").alias("par"), F.col("par").alias("up"), F.concat("chain", F.array(F.struct("id", "name"))).alias("head"))
            kept = _left(now.where(F.col("state") != "splice"), up, "par")
            chain = F.concat(F.coalesce("head", F.expr("slice(chain, 1, 0)")), "chain")
            kept = kept.select("id", "element_id", "name", F.coalesce("up", "par").alias("par"), chain.alias("chain"), "state")
            record.append(kept.where(F.col("state") == "leaf").unionByName(out).drop("state"))
            alive = kept.where(F.col("state") == "stay").drop("state")
        else:
            record.append(now.where(F.col("state") == "leaf").drop("state"))
            alive = now.where(F.col("state") == "stay").drop("state")
        n, loops = counts.get("stay", (0, 0))
        if n == loops:
            return record, alive if n else None
    raise RuntimeError("contraction did not end")


def _left(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Left join in which rows with a null key take no part in the shuffle."""
    return df.where(F.col(key).isNotNull()).join(other, key, "left").unionByName(df.where(F.col(key).isNull()), allowMissingColumns=True)


def _classified(alive: DataFrame, r: int) -> DataFrame:
    """``alive`` with ``state``: leaf (no child left), splice (to be compressed) or stay."""
    kids = alive.where(F.col("par").isNotNull()).groupBy(F.col("par").alias("id")).agg(F.count("*").alias("n"), F.max("id").alias("kid"))

    def h(c: str):
        return F.xxhash64(F.col(c), F.lit(r))

    inner = (F.col("n") == 1) & F.col("par").isNotNull() & (F.col("par") != F.col("id"))
    splice = inner & (h("id") > h("par")) & ((F.col("kid") == F.col("par")) | (h("id") > h("kid")))
    state = F.when(F.col("n").isNull(), "leaf").when(splice, "splice").otherwise("stay")
    return alive.join(kids, "id", "left").withColumn("state", state).drop("n", "kid")


_DONE = ["id", "element_id", "name", "root_id", "depth", "path", "ancestors", "looped"]


def _undo(rows: DataFrame, record: list[DataFrame], core: DataFrame | None) -> DataFrame:
    """Undo the contractions from the last round to the first."""
    done: list[DataFrame] = []
    if core is not None:
        done.append(
            core.select(
                "id", "element_id", "name", F.lit(None).cast("long").alias("root_id"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("array<bigint>").alias("ancestors"), F.lit(True).alias("looped")
            )
        )
    for r in range(len(record) - 1, -1, -1):
        new = _resolved(record[r], done)
        done.append(cut(new) if r else new)
    whole = reduce(DataFrame.unionByName, done)
    if core is None:
        return whole.select(*_DONE[:-1], F.lit(False).alias("in_loop"), F.lit(False).alias("below_loop"))
    members = core.select(F.explode(F.concat(F.transform("chain", lambda x: x["id"]), F.array("id"))).alias("id"), F.lit(True).alias("member"))
    looped = whole.where("looped").join(members, "id", "left").withColumn("in_loop", F.coalesce("member", F.lit(False)))
    return (
        looped.select(*_DONE[:-1], "in_loop", (~F.col("in_loop")).alias("below_loop"))
        .unionByName(whole.where(~F.col("looped")).select(*_DONE[:-1], F.lit(False).alias("in_loop"), F.lit(False).alias("below_loop")))
    )


def _resolved(part: DataFrame, done: list[DataFrame]) -> DataFrame:
    name = F.coalesce("name", F.lit(""))
    roots = part.where(F.col("par").isNull()).select(
        "id", "element_id", "name", F.col("id").alias("root_id"), F.lit(0).alias("depth"), name.alias("path"), F.array().cast("array<bigint>").alias("ancestors"), F.lit(False).alias("looped")
    )
    if not done:
        return roots
    up = reduce(DataFrame.unionByName, done).select(*[F.col(c).alias(f"up_{c}") for c in ("id", "root_id", "depth", "path", "ancestors", "looped")])
    below = part.where(F.col("par").isNotNull()).join(up, F.col("par") == F.col("up_id"))
    between = F.transform("chain", lambda x: F.coalesce(x["name"], F.lit("")))
    return roots.unionByName(
        below.select(
            "id", "element_id", "name", F.col("up_root_id").alias("root_id"), (F.col("up_depth") + 1 + F.size("chain")).alias("depth"),
            F.when(F.col("up_path").isNotNull(), F.array_join(F.concat(F.array("up_path"), between, F.array(name)), "/")).alias("path"),
            F.concat("up_ancestors", F.array("up_id"), F.transform("chain", lambda x: x["id"])).alias("ancestors"), F.col("up_looped").alias("looped"),
        )
    )


def descendant_pairs(nodes: DataFrame) -> DataFrame:
    """``ancestor_id, descendant_id, distance`` of all nodes that have a path."""
    return nodes.where(F.size("ancestors") > 0).select(
        F.col("id").alias("descendant_id"), F.posexplode("ancestors").alias("at", "ancestor_id"), "depth"
    ).select("ancestor_id", "descendant_id", (F.col("depth") - F.col("at")).alias("distance"))

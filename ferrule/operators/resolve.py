"""Calls resolved to definitions, by passes that each need something else to be known.

Every pass is a join on names that belong to a repository and user (and file), so hot names are only as hot as their
definitions in one repository. The passes are tried in order; the first that finds a target wins. Where a name has
several definitions, the least ``element_id`` is taken, so that results don't depend on the order of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.session import cut

OWNER = ["repository", "username"]
CALL = r"(?:([A-Za-z_$][\w$]*(?:\(\))?)(?:\.|->|::))?([A-Za-z_$][\w$]*)\s*\("
_KEYWORDS = "if for while switch catch return function elif match print super and or not in await yield new def fn func sizeof typeof".split()
#: Variables made by calling a class, and variables made by calling a function.
MADE = r"\$?([A-Za-z_]\w*)\s*(?::\s*[\w\[\]., |<>]+?)?\s*=\s*(?:await\s+)?(?:new\s+)?([A-Z]\w*)\s*\("
GIVEN = r"\$?([A-Za-z_]\w*)\s*=\s*(?:await\s+)?([a-z_]\w*)\s*\("
PARAMETER = r"([A-Za-z_]\w*)\s*:\s*([A-Za-z_][\w.]*(?:\[[^\]]*\])?)"
RETURNS = r"\)\s*(?:->|:)\s*([A-Za-z_][\w.\[\], |]*)"


def base_type(name: Column) -> Column:
    """``Repository`` of ``Optional[db.Repository]``, ``Union[Repository, None]`` or ``Repository | None``; ``list`` of ``list[str]``."""
    t = F.trim(name)
    t = F.regexp_replace(t, r"^(?:typing\.)?Optional\[(.*)\]$", "$1")
    t = F.regexp_replace(t, r"^(?:typing\.)?Union\[\s*([^,\]]+?)\s*,\s*None\s*\]$", "$1")
    t = F.regexp_replace(t, r"^(?:typing\.)?Union\[\s*None\s*,\s*([^,\]]+?)\s*\]$", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"\s*\|\s*None\b", ""), r"\bNone\s*\|\s*", "")
    return F.element_at(F.split(F.trim(F.element_at(F.split(t, r"\["), 1)), r"\."), -1)


def calls(functions: DataFrame) -> DataFrame:
    """``element_id, repository, username, relative_path, parent_id, receiver, callee``: the different calls in each body.

    ``functions``: these with ``raw_code``. The receiver is what stands right before the dot, null if none.
    """
    bodies = functions.select("element_id", *OWNER, "relative_path", "parent_id", F.regexp_extract_all("raw_code", F.lit(CALL), F.lit(0)).alias("found"))
    one = bodies.withColumn("c", F.explode(F.array_distinct("found")))
    part = lambda k: F.regexp_extract("c", CALL, k)
    rows = one.select("element_id", *OWNER, "relative_path", "parent_id", F.when(part(1) != "", part(1)).alias("receiver"), part(2).alias("callee"))
    return rows.where(~F.col("callee").isin(*_KEYWORDS)).distinct()


def _pairs(functions: DataFrame, pattern: str) -> DataFrame:
    rows = functions.select("element_id", *OWNER, "relative_path", F.explode(F.array_distinct(F.regexp_extract_all("raw_code", F.lit(pattern), F.lit(0)))).alias("c"))
    return rows.select("element_id", *OWNER, "relative_path", F.regexp_extract("c", pattern, 1).alias("receiver"), F.regexp_extract("c", pattern, 2).alias("t"))


def receiver_types(functions: DataFrame, definitions: DataFrame) -> DataFrame:
    """``element_id, repository, username, receiver, type``: types of variables by constructor, annotation and return type."""
    made = _pairs(functions, MADE).select("element_id", *OWNER, "receiver", F.col("t").alias("type"), F.lit("constructor").alias("how"))
    notes = functions.select("element_id", *OWNER, F.explode(F.regexp_extract_all(F.coalesce("signature", F.lit("")), F.lit(PARAMETER), F.lit(0))).alias("c"))
    typed = notes.select("element_id", *OWNER, F.regexp_extract("c", PARAMETER, 1).alias("receiver"), base_type(F.regexp_extract("c", PARAMETER, 2)).alias("type"), F.lit("annotation").alias("how"))
    returns = definitions.where(F.col("element_type").isin("function", "method")).select(*OWNER, F.col("name").alias("t"), base_type(F.regexp_extract("signature", RETURNS, 1)).alias("type")).where(F.col("type") != "")
    one = returns.groupBy(*OWNER, "t").agg(F.min("type").alias("type"), F.count_distinct("type").alias("n")).where("n = 1").drop("n")
    given = _pairs(functions, GIVEN).join(one, [*OWNER, "t"]).select("element_id", *OWNER, "receiver", "type", F.lit("return_type").alias("how"))
    return made.unionByName(typed).unionByName(given).where(F.col("type").rlike("^[A-Z]")).distinct()


def methods_by_type(wanted: DataFrame, definitions: DataFrame, bases: DataFrame) -> DataFrame:
    """``wanted`` (with ``type``, ``callee``) with ``target``: the method of the class, or of one of its bases in order.

    ``bases``: ``repository, username, type, base, place``, one level of inheritance. The class's own method goes first.
    """
    classes = definitions.where("element_type = 'class'").select(*OWNER, F.col("element_id").alias("class_id"), F.col("name").alias("holder"))
    methods = definitions.where("element_type = 'method'").select(F.col("parent_id").alias("class_id"), F.col("element_id").alias("target"), F.col("name").alias("callee"))
    held = classes.join(methods, "class_id").select(*OWNER, "holder", "callee", "target")
    own = wanted.withColumn("holder", F.col("type")).withColumn("rank", F.lit(0))
    above = wanted.join(bases.select(*OWNER, "type", F.col("base").alias("holder"), (F.col("place") + 1).alias("rank")), [*OWNER, "type"]).select(*own.columns)
    found = own.unionByName(above).join(held, [*OWNER, "holder", "callee"])
    best = found.groupBy("element_id", "receiver", "callee").agg(F.min(F.struct("rank", "target")).alias("b"))
    return best.select("element_id", "receiver", "callee", F.col("b.target").alias("target"))


def imported(wanted: DataFrame, imports: DataFrame, definitions: DataFrame, depth: int = 3) -> DataFrame:
    """Calls of imported names. ``imports``: ``repository, username, relative_path, name, alias, file``.

    ``file`` is the imported module's file; ``*`` brings in all names of the file that don't begin with an underscore. A
    name that the file itself only imports is followed through at most ``depth`` files.
    """
    defs = definitions.where(F.col("element_type").isin("function", "class", "method")).where(F.col("element_type") != "method").select(*OWNER, F.col("relative_path").alias("file"), "name", F.col("element_id").alias("target"))
    links = imports.where(F.col("file").isNotNull()).select(*OWNER, "relative_path", "name", "alias", "file")
    stars = links.where("name = '*'").drop("name", "alias").join(defs.where(~F.col("name").startswith("_")).drop("target"), [*OWNER, "file"]).withColumn("alias", F.col("name"))
    links = links.where("name <> '*'").unionByName(stars.select(*links.columns)).distinct()
    now = wanted.where(F.col("receiver").isNull()).join(links.withColumnRenamed("alias", "callee"), [*OWNER, "relative_path", "callee"]).select("element_id", "callee", *OWNER, "name", "file")
    found = []
    for _ in range(depth):
        hit = now.join(defs, [*OWNER, "file", "name"]).select("element_id", "callee", "target")
        found.append(hit)
        onward = links.select(*OWNER, F.col("relative_path").alias("file"), F.col("alias").alias("name"), F.col("name").alias("next_name"), F.col("file").alias("next_file"))
        now = now.join(onward, [*OWNER, "file", "name"]).select("element_id", "callee", *OWNER, F.col("next_name").alias("name"), F.col("next_file").alias("file")).distinct()
    every = reduce(DataFrame.unionByName, [f.withColumn("far", F.lit(k)) for k, f in enumerate(found)])
    return every.groupBy("element_id", "callee").agg(F.min(F.struct("far", "target")).alias("b")).select("element_id", F.lit(None).cast("string").alias("receiver"), "callee", F.col("b.target").alias("target"))


def affinity(receiver: Column, class_name: Column, path: Column, same_class: Column) -> Column:
    """How well a receiver's name fits a method's class or file, from 0 to 1.

    1.0 in the caller's own class or where the class begins with the name, 0.8 where it holds it, 0.7 where it holds a part
    of it; of the file's stem 0.6, 0.5 and 0.4. Names and parts of fewer than three letters don't count.
    """
    r, c = F.lower(receiver), F.lower(F.coalesce(class_name, F.lit("")))
    stem = F.regexp_replace(F.element_at(F.split(F.lower(F.coalesce(path, F.lit(""))), "/"), -1), r"\.(py|js|ts)$", "")
    long_ = F.length(r) >= 3
    part = lambda text: F.exists(F.split(r, "_"), lambda x: (F.length(x) >= 3) & F.contains(text, x))

    def ladder(text: Column, a: float, b: float, d: float) -> Column:
        return F.when(text == "", 0.0).when(long_ & F.startswith(text, r), a).when(long_ & F.contains(text, r), b).when(part(text), d).otherwise(0.0)

    return F.when(F.coalesce(same_class, F.lit(False)), 1.0).otherwise(F.greatest(ladder(c, 1.0, 0.8, 0.7), ladder(stem, 0.6, 0.5, 0.4)))


def is_fixture_path(path: Column) -> Column:
    return F.lower(path).rlike("(^|/)(fixtures?|testdata|test_data|mocks?|__mocks__)/")


def is_test_path(path: Column) -> Column:
    return F.lower(path).rlike(r"/tests?/|(^|/)test_[^/]*$|_test\.py$")


def by_affinity(wanted: DataFrame, definitions: DataFrame, least: float = 0.4) -> DataFrame:
    """Calls with a receiver to the method of that name whose class or file fits the receiver best, from ``least`` on.

    Code that is no test isn't resolved to test fixtures.
    """
    methods = definitions.where("element_type = 'method'").select(*OWNER, F.col("name").alias("callee"), F.col("element_id").alias("target"), F.col("relative_path").alias("path"), F.col("parent_id").alias("class_id"), F.regexp_extract("parent_id", r":class:([^:]*):", 1).alias("class_name"))
    both = wanted.where(F.col("receiver").isNotNull()).join(methods, [*OWNER, "callee"]).where((F.col("target") != F.col("element_id")) & (is_test_path(F.col("relative_path")) | ~is_fixture_path(F.col("path"))))
    own = F.col("receiver").isin("self", "this", "cls") & (F.col("class_id") == F.col("parent_id"))
    scored = both.withColumn("score", affinity(F.col("receiver"), F.col("class_name"), F.col("path"), own)).where(F.col("score") >= least)
    best = scored.groupBy("element_id", "receiver", "callee").agg(F.min(F.struct((-F.col("score")).alias("s"), "target")).alias("b"))
    return best.select("element_id", "receiver", "callee", F.col("b.target").alias("target"))


def resolved(functions: DataFrame, definitions: DataFrame, imports: DataFrame, bases: DataFrame) -> DataFrame:
    """``element_id, receiver, callee, target, how`` of all calls that a pass resolves.

    ``functions``: ``element_id, repository, username, relative_path, parent_id, signature, raw_code``; ``definitions``:
    ``element_id, repository, username, relative_path, parent_id, element_type, name, signature``; ``imports`` and ``bases`` as above.
    Passes: ``import``, ``same_file``, ``super``, ``constructor``, ``annotation``, ``return_type``, ``affinity``, ``unique_name``. Null code and names
    give no calls; empty tables give no rows.
    """
    found = cut(calls(functions))  # read by every pass, without the code
    plain = found.where(F.col("receiver").isNull())
    defs = definitions.where(F.col("element_type").isin("function", "class")).select(*OWNER, "relative_path", F.col("name").alias("callee"), F.col("element_id").alias("t"))
    here = plain.join(defs, [*OWNER, "relative_path", "callee"]).where(F.col("t") != F.col("element_id")).groupBy("element_id", "callee").agg(F.min("t").alias("target"))
    unique = defs.groupBy(*OWNER, "callee").agg(F.count("*").alias("n"), F.min("t").alias("target")).where("n = 1")
    alone = plain.join(unique, [*OWNER, "callee"]).where(F.col("target") != F.col("element_id")).select("element_id", "callee", "target")
    classes = definitions.where("element_type = 'class'").select(F.col("element_id").alias("parent_id"), F.col("name").alias("type"))
    above = found.where(F.col("receiver").isin("super()", "super", "parent")).join(classes, "parent_id").join(bases, [*OWNER, "type"]).select("element_id", *OWNER, "receiver", "callee", F.col("base").alias("type"))
    typed = cut(found.where(F.col("receiver").isNotNull()).join(receiver_types(functions, definitions), ["element_id", *OWNER, "receiver"]))
    none = F.lit(None).cast("string").alias("receiver")
    passes = [
        ("import", imported(found, imports, definitions)), ("same_file", here.select("element_id", none, "callee", "target")), ("super", methods_by_type(above, definitions, bases)),
        *[(how, methods_by_type(typed.where(F.col("how") == how).select("element_id", *OWNER, "receiver", "callee", "type"), definitions, bases)) for how in ("constructor", "annotation", "return_type")],
        ("affinity", by_affinity(found, definitions)), ("unique_name", alone.select("element_id", none, "callee", "target")),
    ]
    every = reduce(DataFrame.unionByName, [p.select("element_id", "receiver", "callee", "target", F.lit(k).alias("rank"), F.lit(how).alias("how")) for k, (how, p) in enumerate(passes)])
    best = every.groupBy("element_id", "receiver", "callee").agg(F.min(F.struct("rank", "how", "target")).alias("b"))
    return best.select("element_id", "receiver", "callee", F.col("b.target").alias("target"), F.col("b.how").alias("how"))

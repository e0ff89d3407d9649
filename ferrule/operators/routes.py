"""HTTP routes and commands told by decorators, and the trees that they form.

All is said in column expressions and joins: a decorator is parted into its name and arguments, a small table of
rules (a chain of conditions, no join) tells what it registers, and the trees come from the hierarchy operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.operators.hierarchy import hierarchies

VERBS = "get post put delete patch head options".split()
#: File stems that tell nothing of the router in them; the folder's name is taken instead.
PLAIN_STEMS = "__init__ main app routes views".split()


def decorator_name(decorator: Column) -> Column:
    """``app.route`` of ``@app.route('/x')``."""
    return F.regexp_extract(decorator, r"^\s*[@#]?\[?\s*([\w.:]+)", 1)


def decorator_args(decorator: Column) -> Column:
    """What stands in the parentheses, empty if there are none."""
    return F.regexp_extract(decorator, r"(?s)^\s*[@#]?\[?\s*[\w.:]+\s*\((.*)\)\s*\]?\s*$", 1)


def first_text(args: Column) -> Column:
    """The first quoted argument (also behind a name and ``=``), null if there is none."""
    found = F.regexp_extract(args, r"""^\s*(?:(?:path|value|name)\s*=\s*)?\{?\s*(?:"([^"]*)"|'([^']*)')""", 0)
    bare = F.regexp_extract(found, r"""["'](.*)["']$""", 1)
    return F.when(found != "", bare)


def _last(name: Column) -> Column:
    return F.lower(F.element_at(F.split(F.regexp_replace(name, "::", "."), r"\."), -1))


def http_routes(elements: DataFrame) -> DataFrame:
    """``element_id, method, path, path_params, framework`` of ``element_id, language, decorators``.

    ``x.get('/p')`` and its like (Python and scripts), ``x.route('/p', methods=[...])``, a row for each method,
    ``GetMapping("/p")`` and ``RequestMapping(value=..., method=...)`` (Java), ``GET`` with ``Path`` beside it (Java),
    ``Get('/p')`` of controllers (scripts), and attributes ``get("/p")`` (Rust). Decorators that are null, without a
    path, or of other kinds give no row; repeated decorators give repeated rows.
    """
    e = elements.select("element_id", "language", "decorators")
    d = e.withColumn("d", F.explode("decorators")).withColumns({"name": decorator_name(F.col("d")), "args": decorator_args(F.col("d"))})
    last, dotted = _last(F.col("name")), F.contains("name", F.lit("."))
    text = first_text(F.col("args"))
    java, script, rust = F.col("language") == "java", F.col("language").isin("javascript", "typescript"), F.col("language") == "rust"
    verb = last.isin(*VERBS)
    mapping = F.regexp_extract(F.col("name"), r"^(Get|Post|Put|Delete|Patch)Mapping$", 1)
    beside = F.element_at(F.filter("decorators", lambda x: decorator_name(x) == "Path"), 1)
    listed = F.transform(F.regexp_extract_all(F.regexp_extract("args", r"methods\s*=\s*[\[(]([^\])]*)", 1), F.lit(r"[\"'](\w+)[\"']"), F.lit(1)), lambda x: F.upper(x))
    asked = F.regexp_extract("args", r"method\s*=\s*\{?\s*(?:RequestMethod\.)?(\w+)", 1)
    def made(methods: Column, path: Column, framework: str) -> Column:
        return F.struct(methods.alias("methods"), path.alias("path"), F.lit(framework).alias("framework"))

    found = (
        F.when(java & (mapping != ""), made(F.array(F.upper(mapping)), F.coalesce(text, F.lit("/")), "spring"))
        .when(java & (F.col("name") == "RequestMapping"), made(F.array(F.when(asked != "", F.upper(asked)).otherwise("*")), text, "spring"))
        .when(java & F.col("name").rlike("^(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)$"), made(F.array(F.col("name")), F.coalesce(first_text(decorator_args(beside)), F.lit("/")), "jax-rs"))
        .when((F.col("language") == "python") & dotted & verb, made(F.array(F.upper(last)), text, "fastapi"))
        .when((F.col("language") == "python") & dotted & (last == "route"), made(F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit("GET"))), text, "flask"))
        .when(script & ~dotted & verb, made(F.array(F.upper(last)), F.coalesce(text, F.lit("/")), "nest"))
        .when(script & dotted & verb, made(F.array(F.upper(last)), text, "express"))
        .when(rust & verb, made(F.array(F.upper(last)), text, "actix"))
    )
    out = d.withColumn("r", found).where(F.col("r.path").isNotNull()).select("element_id", F.explode("r.methods").alias("method"), F.col("r.path").alias("path"), F.col("r.framework").alias("framework"))
    params = F.transform(F.regexp_extract_all("path", F.lit(r"[{<:](?:\w+:)?(\w+)[}>]?"), F.lit(1)), lambda x: x)
    return out.select("element_id", "method", "path", params.alias("path_params"), "framework")


def router_name(path: Column) -> Column:
    """A file's stem, or its folder's name where the stem tells nothing."""
    parts = F.split(path, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    folder = F.when(F.size(parts) > 1, F.element_at(parts, F.size(parts) - 1))
    return F.when(stem.isin(*PLAIN_STEMS) & folder.isNotNull() & (folder != "src"), folder).otherwise(stem)


def full_url(path: Column, prefix: str = "") -> Column:
    rooted = F.when((path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    return F.concat(F.lit(prefix.rstrip("/")), rooted)


def route_tree(routes: DataFrame, elements: DataFrame, prefix: str = "") -> DataFrame:
    """``repository, username, relative_path, router, common_prefix, element_id, method, url`` of rows of :func:`http_routes`.

    ``elements``: ``element_id, repository, username, relative_path``. The common prefix of a file's routes is what the
    least and the greatest of their segment lists begin with alike, up to a segment with a parameter; so it needs two
    partial aggregates and no list of a file's routes. A single route's prefix is its first segment.
    """
    key = ["repository", "username", "relative_path"]
    rows = routes.join(elements.select("element_id", *key), "element_id")
    parts = F.split(F.trim(F.col("path"), F.lit("/")), "/")
    open_ = F.array_position(F.transform(parts, lambda x: F.contains(x, F.lit("{"))), True)
    fixed = F.when(open_ > 0, F.slice(parts, 1, open_.cast("int") - 1)).otherwise(parts)
    ends = rows.select(*key, fixed.alias("p"), F.col("path").alias("whole"), parts.alias("all")).groupBy(*key).agg(F.min("p").alias("a"), F.max("p").alias("b"), F.min("all").alias("only"), F.count("*").alias("n"))
    differ = F.array_position(F.zip_with("a", "b", lambda x, y: F.coalesce(x != y, F.lit(True))), True)
    alike = F.when(differ > 0, F.slice("a", 1, differ.cast("int") - 1)).otherwise(F.col("a"))
    shared = F.when(F.col("n") == 1, F.slice("only", 1, 1)).otherwise(alike)
    text = F.when(F.size(F.filter(shared, lambda x: x != "")) > 0, F.concat(F.lit("/"), F.array_join(shared, "/"))).otherwise("")
    return rows.join(ends.select(*key, text.alias("common_prefix")), key).select(*key, router_name(F.col("relative_path")).alias("router"), "common_prefix", "element_id", "method", full_url(F.col("path"), prefix).alias("url"))


def commands(elements: DataFrame) -> DataFrame:
    """``repository, username, element_id, name, parent, is_group, command`` of elements with ``x.command`` or ``x.group`` decorators.

    ``elements``: ``element_id, repository, username, name, decorators``. ``parent`` is what stands before the last dot,
    null for a bare ``command``; ``command`` is the first quoted argument, else the function's name.
    """
    d = elements.select("repository", "username", "element_id", "name", F.explode("decorators").alias("d"))
    d = d.withColumns({"dn": decorator_name(F.col("d")), "args": decorator_args(F.col("d"))}).where(F.col("dn").rlike(r"(^|\.)(command|group)$"))
    parent = F.regexp_extract("dn", r"(?:^|\.)(\w+)\.(?:command|group)$", 1)
    return d.select("repository", "username", "element_id", "name", F.when(~parent.isin("", "click", "typer"), parent).alias("parent"), F.col("dn").endswith("group").alias("is_group"), F.coalesce(first_text(F.col("args")), F.col("name")).alias("command"))


def command_tree(found: DataFrame, entry: str = "") -> DataFrame:
    """``repository, username, element_id, is_group, depth, full_command`` of rows of :func:`commands`.

    Groups are found by their function's name within a repository and user; paths come from the hierarchy operator, so
    their depth is unknown beforehand and groups in a loop come out with null depth and command. ``entry`` is put before
    the command; a root group called ``main`` is the entry itself and left out.
    """
    key = F.concat_ws("\x1f", "repository", "username", "parent")
    groups = found.where("is_group").groupBy("repository", "username", "name").agg(F.min("element_id").alias("group_id"))
    named = groups.select(F.concat_ws("\x1f", "repository", "username", "name").alias("k"), "group_id")
    links = found.withColumn("k", F.when(F.col("parent").isNotNull(), key)).join(named, "k", "left")
    rows = links.select(F.xxhash64("element_id", "command").alias("id"), "element_id", F.when(~(F.col("is_group") & (F.col("name") == "main") & F.col("group_id").isNull()), F.col("command")).otherwise("").alias("name"), F.col("group_id").alias("parent_id"), "repository", "username", "is_group")
    one = rows.dropDuplicates(["element_id"])
    tree = hierarchies(one.select("id", "element_id", "name", "parent_id"))
    words = F.filter(F.concat(F.array(F.lit(entry)), F.split("path", "/")), lambda x: x != "")
    return tree.join(one.select("id", "repository", "username", "is_group"), "id").select("repository", "username", "element_id", "is_group", F.col("depth").cast("int").alias("depth"), F.when(F.col("path").isNotNull(), F.array_join(words, " ")).alias("full_command"))

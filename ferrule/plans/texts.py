"""Questions on the text of code and documentation: tests, types, patterns, side effects, usages, texts for models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.functions import code as C
from ferrule.operators import resolve, rules
from ferrule.plans.registry import Registry
from ferrule.plans.statistics import CUR
from ferrule.sources.tables import current_elements, newest_files, table

R = Registry()
FUNCTIONS = ("function", "method")
Q = "'"
IS_FUNCTION = "element_type IN ('function', 'method')"


def q(pattern: str) -> str:
    return pattern.replace(Q, Q * 2)


@R.query("test_elements", f"""WITH {CUR} SELECT element_id, coalesce(CASE language WHEN 'python' THEN starts_with(name, 'test_') OR coalesce(len(list_filter(decorators, lambda x: regexp_matches(x, '^(pytest|unittest)'))) > 0, false) WHEN 'rust' THEN coalesce(len(list_filter(decorators, lambda x: regexp_matches(x, '^(test|cfg\\(test\\))$'))) > 0, false)
 WHEN 'java' THEN coalesce(len(list_filter(decorators, lambda x: regexp_matches(x, '^@(Test|ParameterizedTest|RepeatedTest)$'))) > 0, false) OR starts_with(name, 'test') OR starts_with(name, 'should') END, false) AS by_name, coalesce(is_test, false) AS as_given FROM cur WHERE element_type IN ('class', 'function', 'method')""")
def test_elements(spark: SparkSession, d: str) -> DataFrame:
    rows = current_elements(spark, d, "element_id", "name", "decorators", "language", "is_test", types=("class", *FUNCTIONS))
    return rows.select("element_id", C.is_test_element(F.col("name"), F.col("decorators"), F.col("language")).alias("by_name"), F.coalesce("is_test", F.lit(False)).alias("as_given"))


TYPE_SQL = "regexp_replace(trim(split_part({0}, '[', 1)), '^.*\\.', '')"


@R.query("type_annotations", f"WITH {CUR} SELECT element_id, len(regexp_extract_all(signature, '{q(resolve.PARAMETER)}')) AS n_typed, nullif({TYPE_SQL.format(f'trim(regexp_replace(regexp_extract(signature, {Q}{q(resolve.RETURNS)}{Q}, 1), {Q}\\s*\\|\\s*None\\b{Q}, {Q}{Q}))')}, '') AS returns FROM cur WHERE {IS_FUNCTION} AND signature IS NOT NULL")
def type_annotations(spark: SparkSession, d: str) -> DataFrame:
    """How many parameters have a type, and the type of the result without what wraps it."""
    rows = current_elements(spark, d, "element_id", "signature", types=FUNCTIONS).where(F.col("signature").isNotNull())
    back = resolve.base_type(F.regexp_extract("signature", resolve.RETURNS, 1))
    return rows.select("element_id", F.size(F.regexp_extract_all("signature", F.lit(resolve.PARAMETER), F.lit(0))).cast("long").alias("n_typed"), F.when(back != "", back).alias("returns"))


DESCRIBED = f"""l AS (SELECT element_id, unnest(string_split_regex(docstring, '\\r?\\n')) AS x, generate_subscripts(string_split_regex(docstring, '\\r?\\n'), 1) AS i FROM cur WHERE {IS_FUNCTION} AND docstring IS NOT NULL),
 s AS (SELECT *, min(i) FILTER (regexp_matches(x, '{C.SECTIONS}')) OVER (PARTITION BY element_id) AS head FROM l)"""


@R.query("descriptions", f"WITH {CUR}, {DESCRIBED} SELECT element_id, coalesce(string_agg(trim(regexp_replace(x, '\\s', ' ', 'g')), ' ' ORDER BY i) FILTER (i < coalesce(head, 1000000) AND trim(regexp_replace(x, '\\s', ' ', 'g')) <> ''), '') AS description FROM s GROUP BY 1")
def descriptions(spark: SparkSession, d: str) -> DataFrame:
    rows = current_elements(spark, d, "element_id", "docstring", types=FUNCTIONS).where(F.col("docstring").isNotNull())
    return rows.select("element_id", C.description(F.col("docstring")).alias("description"))


@R.query("code_texts", f"WITH {CUR} SELECT element_id, md5(concat_ws(chr(10), '# ' || element_type || ': ' || name, '# File: ' || relative_path, CASE WHEN signature <> '' THEN '# Signature: ' || signature END, CASE WHEN raw_code <> '' THEN raw_code END)) AS digest FROM cur WHERE {IS_FUNCTION}")
def code_texts(spark: SparkSession, d: str) -> DataFrame:
    """The text that a code vector is made of: a head of three lines and the code, told by its digest."""
    rows = current_elements(spark, d, "element_id", "element_type", "name", "relative_path", "signature", "raw_code", types=FUNCTIONS)
    head = [F.concat(F.lit("# "), "element_type", F.lit(": "), "name"), F.concat(F.lit("# File: "), "relative_path"), F.when(F.col("signature") != "", F.concat(F.lit("# Signature: "), "signature")), F.when(F.col("raw_code") != "", F.col("raw_code"))]
    return rows.select("element_id", F.md5(F.concat_ws("\n", *head)).alias("digest"))


@R.query("fitted_texts", f"""WITH {CUR}, l AS (SELECT element_id, unnest(string_split(raw_code, chr(10))) AS x, generate_subscripts(string_split(raw_code, chr(10)), 1) AS i, length(raw_code) // 2 AS whole FROM cur WHERE {IS_FUNCTION} AND raw_code IS NOT NULL), s AS (SELECT *, sum(length(x) // 2) OVER (PARTITION BY element_id ORDER BY i) AS used FROM l)
 SELECT element_id, max(whole) > 150 AS is_cut, CAST(CASE WHEN max(whole) <= 150 THEN max(i) ELSE count(*) FILTER (used <= 150) + 1 END AS BIGINT) AS n_lines FROM s GROUP BY 1""")
def fitted_texts(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each function's code that fit a budget of 200 tokens, less a quarter, and whether it was cut."""
    rows = current_elements(spark, d, "element_id", "raw_code", types=FUNCTIONS).where(F.col("raw_code").isNotNull())
    return rows.select("element_id", (F.floor(F.length("raw_code") / 2) > 150).alias("is_cut"), F.size(F.split(C.fitted(F.col("raw_code"), 200), "\n")).cast("long").alias("n_lines"))


LABEL_SQL = "substr(regexp_replace(replace(regexp_replace(lower(trim(string_split(text, chr(10))[1])), '^[\"'']+|[\"'']+$', '', 'g'), ' ', '_'), '[^\\p{L}\\p{N}_]', '', 'g'), 1, 50)"


@R.query("document_labels", f"SELECT {LABEL_SQL} AS label, count(*) AS n FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(lower(text), '^\\W*(label:|the label is|this cluster is about)') GROUP BY 1")
def document_labels(spark: SparkSession, d: str) -> DataFrame:
    """First lines as labels."""
    rows = table(spark, d, "documents").where(F.col("text").isNotNull() & ~F.lower("text").rlike(r"^\W*(label:|the label is|this cluster is about)"))
    return rows.groupBy(C.clean_label(F.element_at(F.split("text", "\n"), 1)).alias("label")).agg(F.count("*").alias("n"))


@R.query("plain_text_rows", "SELECT doc_id, doc_type AS kind, len(string_split(text, chr(10))) AS n_lines, length(text) AS n_chars FROM documents WHERE text IS NOT NULL")
def plain_text_rows(spark: SparkSession, d: str) -> DataFrame:
    """One element for each text."""
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.col("doc_type").alias("kind"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.length("text").cast("long").alias("n_chars"))


@R.query("unit_vectors", "SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 4) AS norm, round(v[1], 5) AS first FROM (SELECT vec_id, CASE WHEN n > 0 THEN list_transform(e, lambda x: x / n) ELSE e END AS v FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings))")
def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", C.unit_vector(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 4).alias("norm"), F.round(F.element_at("v", 1), 5).alias("first"))


@R.query("file_sizes", "SELECT size, count(*) AS n FROM (SELECT CASE WHEN file_size < 1024 THEN printf('%.1f B', CAST(file_size AS DOUBLE)) WHEN file_size < 1048576 THEN printf('%.1f KB', file_size / 1024.0) ELSE printf('%.1f MB', file_size / 1048576.0) END AS size FROM file_states WHERE file_size < 1073741824) GROUP BY 1")
def file_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_states").where(F.col("file_size") < 1 << 30).groupBy(C.format_bytes(F.col("file_size")).alias("size")).agg(F.count("*").alias("n"))


@R.query("comment_lines", f"""WITH {CUR}, l AS (SELECT language, unnest(string_split(raw_code, chr(10))) AS x FROM cur WHERE element_type = 'file') SELECT language, count(*) AS n_lines, count(*) FILTER (CASE language {" ".join(f"WHEN '{k}' THEN regexp_matches(x, '^\\s*{p}')" for k, p in C.COMMENT_START.items())} ELSE false END) AS n_comments FROM l GROUP BY 1""")
def comment_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of files that are comments from their first sign on; counted within the row, so no line is a row."""
    rows = current_elements(spark, d, "language", "raw_code", types=("file",)).where(F.col("raw_code").isNotNull()).select("language", F.split("raw_code", "\n").alias("l"))
    n = C.by_language(F.col("language"), lambda p: F.size(F.filter("l", lambda x: x.rlike(rf"^\s*{p}"))), F.lit(0), C.COMMENT_START)
    return rows.groupBy("language").agg(F.sum(F.size("l")).alias("n_lines"), F.sum(n).alias("n_comments"))


@R.query("path_kinds", "WITH newest AS (SELECT DISTINCT relative_path FROM file_states) SELECT count(*) AS n, regexp_matches(lower(relative_path), '/tests?/|(^|/)test_[^/]*$|_test\\.py$') AS is_test, regexp_matches(lower(relative_path), '(^|/)(fixtures?|testdata|test_data|mocks?|__mocks__)/') AS is_fixture FROM newest GROUP BY 2, 3")
def path_kinds(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("relative_path")
    return table(spark, d, "file_states").select(p).distinct().groupBy(resolve.is_test_path(p).alias("is_test"), resolve.is_fixture_path(p).alias("is_fixture")).agg(F.count("*").alias("n"))


@R.query("main_branches", "SELECT scope, repository, bool_or(username = 'main') AS has_main, count(DISTINCT username) FILTER (username <> 'main') AS n_users FROM code_elements GROUP BY 1, 2")
def main_branches(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "code_elements")
    return rows.groupBy("scope", "repository").agg(F.bool_or(F.col("username") == "main").alias("has_main"), F.count_distinct(F.when(F.col("username") != "main", F.col("username"))).alias("n_users"))


@R.query("configuration_sections", f"WITH {CUR}, l AS (SELECT repository, unnest(string_split(raw_code, chr(10))) AS x FROM cur WHERE element_type = 'file' AND language = 'toml') SELECT repository, regexp_extract(x, '^\\s*\\[+([^\\[\\]]+)\\]+\\s*$', 1) AS section, count(*) AS n FROM l WHERE regexp_matches(x, '^\\s*\\[+([^\\[\\]]+)\\]+\\s*$') GROUP BY 1, 2")
def configuration_sections(spark: SparkSession, d: str) -> DataFrame:
    p = r"^\s*\[+([^\[\]]+)\]+\s*$"
    rows = current_elements(spark, d, "repository", "language", "raw_code", types=("file",)).where("language = 'toml'")
    return rows.select("repository", F.explode(F.split("raw_code", "\n")).alias("x")).where(F.col("x").rlike(p)).groupBy("repository", F.regexp_extract("x", p, 1).alias("section")).agg(F.count("*").alias("n"))


@R.query("variable_usages", f"""WITH {CUR}, v AS (SELECT element_id, repository, username, relative_path, name, line_start FROM cur WHERE element_type IN ('variable', 'constant') AND regexp_matches(name, '^\\w+$')), f AS (SELECT repository, username, relative_path, unnest(string_split(raw_code, chr(10))) AS x, generate_subscripts(string_split(raw_code, chr(10)), 1) AS line FROM cur WHERE element_type = 'file'),
 u AS (SELECT DISTINCT v.element_id, f.line FROM v JOIN f USING (repository, username, relative_path) WHERE f.line <> v.line_start AND list_contains(regexp_extract_all(f.x, '\\w+'), v.name)) SELECT element_id, CAST(line AS INTEGER) AS line FROM (SELECT *, row_number() OVER (PARTITION BY element_id ORDER BY line) AS place FROM u) WHERE place <= 3""")
def variable_usages(spark: SparkSession, d: str) -> DataFrame:
    """The first three lines of the same file, besides its own, that name a variable or constant as a whole word.

    Lines become words and meet the variables by file and word, so no line is compared with every variable.
    """
    key = ["repository", "username", "relative_path"]
    names = current_elements(spark, d, "element_id", *key, "name", "line_start", types=("variable", "constant")).where(F.col("name").rlike(r"^\w+$"))
    files = current_elements(spark, d, *key, "raw_code", types=("file",)).select(*key, F.posexplode(F.split("raw_code", "\n")).alias("at", "x"))
    words = files.select(*key, (F.col("at") + 1).alias("line"), F.explode(F.array_distinct(F.regexp_extract_all("x", F.lit(r"\w+"), F.lit(0)))).alias("name"))
    hits = words.join(names, [*key, "name"]).where("line <> line_start").select("element_id", "line").distinct()
    return hits.withColumn("place", F.row_number().over(Window.partitionBy("element_id").orderBy("line"))).where("place <= 3").drop("place")


NAMES = "click error purchase signup view".split()


@R.query("name_mentions", "SELECT doc_id, list_filter(['click', 'error', 'purchase', 'signup', 'view'], lambda x: contains(text, x)) AS names FROM documents WHERE regexp_matches(text, 'click|error|purchase|signup|view')")
def name_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Which of a given list of names each text mentions."""
    found = F.filter(F.array(*[F.lit(n) for n in NAMES]), lambda x: F.contains(F.col("text"), x))
    return table(spark, d, "documents").select("doc_id", found.alias("names")).where(F.size("names") > 0)


# --- what code does -----------------------------------------------------------------------------------

#: Calls by what they act on besides their result; our own choice.
EFFECTS = {"output": r"\b(?:print|println!|echo|printf|console\.\w+|System\.out\.\w+)\s*\(?", "log": r"\b(?:log|logger|logging|error_log)\b[.:(]", "file": r"\b(?:open|fopen|readFile|writeFile|File::open|unlink|mkdir)\s*\(", "network": r"\b(?:fetch|requests\.\w+|curl_\w+|urlopen|axios\.\w+)\s*\(", "time": r"\b(?:time\(\)|Date\.now|nanoTime|currentTimeMillis|Instant::now|sleep)\b", "chance": r"\b(?:random|rand|Math\.random|mt_rand)\b", "environment": r"\b(?:getenv|environ|process\.env|env::var)\b"}
OWN_STATE = r"(?:\bself|\bthis|\$this)(?:\.|->)\w+\s*(?:[-+*/]?=)[^=]"
BARE = C.bare_sql()


@R.query("side_effects", f"WITH {CUR}, b AS (SELECT element_id, {BARE} AS code FROM cur WHERE {IS_FUNCTION} AND raw_code IS NOT NULL), e AS (SELECT element_id, unnest(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(code, '{q(p)}') THEN '{k}' END" for k, p in [*EFFECTS.items(), ("own state", OWN_STATE)]) + "], lambda x: x IS NOT NULL)) AS effect FROM b) SELECT element_id, effect FROM e")
def side_effects(spark: SparkSession, d: str) -> DataFrame:
    """What each function acts on besides its result, outside comments and texts."""
    rows = current_elements(spark, d, "element_id", "language", "raw_code", types=FUNCTIONS)
    code = rows.select("element_id", C.bare_code(F.col("raw_code"), F.col("language")).alias("c"))
    found = F.array_compact(F.array(*[F.when(F.col("c").rlike(p), F.lit(k)) for k, p in [*EFFECTS.items(), ("own state", OWN_STATE)]]))
    return code.select("element_id", F.explode(found).alias("effect"))


@R.query("purity", f"WITH {CUR}, e AS ({R.sql['side_effects'].replace('WITH ' + CUR + ', ', 'WITH ')}) SELECT CASE WHEN e.element_id IS NULL THEN 'pure' WHEN bool_and(effect = 'own state') THEN 'own state' ELSE 'impure' END AS level, c.element_id FROM cur c LEFT JOIN e ON e.element_id = c.element_id WHERE c.{IS_FUNCTION} GROUP BY c.element_id, e.element_id")
def purity(spark: SparkSession, d: str) -> DataFrame:
    """``pure``, ``own state`` if only the object's own fields are changed, else ``impure``."""
    every = current_elements(spark, d, "element_id", types=FUNCTIONS)
    told = side_effects(spark, d).groupBy("element_id").agg(F.bool_and(F.col("effect") == "own state").alias("own"))
    level = F.when(F.col("own").isNull(), "pure").when(F.col("own"), "own state").otherwise("impure")
    return every.join(told, "element_id", "left").select("element_id", level.alias("level"))


CALL_KINDS = f"""b AS (SELECT element_id, {BARE} AS code FROM cur WHERE {IS_FUNCTION} AND raw_code IS NOT NULL), c AS (SELECT DISTINCT element_id, unnest(regexp_extract_all(code, '{q(resolve.CALL)}')) AS c FROM b),
 k AS (SELECT DISTINCT element_id, regexp_extract(c, '{q(resolve.CALL)}', 1) AS receiver, regexp_extract(c, '{q(resolve.CALL)}', 2) AS callee FROM c)"""
#: Names that languages bring along; our own choice.
BUILT_IN = "print len range str int float list dict set tuple enumerate zip map filter sorted sum min max any all isinstance count strlen implode explode parseInt parseFloat String Number Array Object Math JSON console System Some Ok Err Vec Box".split()


def call_kind(receiver: Column, callee: Column) -> Column:
    first = F.substring(callee, 1, 1)
    return (
        F.when(receiver.isin("self", "this", "cls", "static"), "own method").when(receiver.isin("super()", "super", "parent"), "base method").when(receiver.isin(*BUILT_IN) | ((receiver == "") & callee.isin(*BUILT_IN)), "built in")
        .when((receiver == "") & first.rlike("[A-Z]"), "constructor").when(receiver.rlike("^[A-Z]"), "static method").when(receiver != "", "method").otherwise("function")
    )


@R.query("call_kinds", f"WITH {CUR}, {CALL_KINDS} SELECT CASE WHEN receiver IN ('self', 'this', 'cls', 'static') THEN 'own method' WHEN receiver IN ('super()', 'super', 'parent') THEN 'base method' WHEN receiver IN ({', '.join(repr(b) for b in BUILT_IN)}) OR receiver = '' AND callee IN ({', '.join(repr(b) for b in BUILT_IN)}) THEN 'built in' WHEN receiver = '' AND regexp_matches(callee, '^[A-Z]') THEN 'constructor' WHEN regexp_matches(receiver, '^[A-Z]') THEN 'static method' WHEN receiver <> '' THEN 'method' ELSE 'function' END AS kind, count(*) AS n FROM k WHERE callee NOT IN ({', '.join(repr(b) for b in resolve._KEYWORDS)}) GROUP BY 1")
def call_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Calls by what they are called on, outside comments and texts."""
    rows = current_elements(spark, d, "element_id", "repository", "username", "relative_path", "parent_id", "language", "raw_code", types=FUNCTIONS)
    found = resolve.calls(rows.withColumn("raw_code", C.bare_code(F.col("raw_code"), F.col("language"))))
    return found.groupBy(call_kind(F.coalesce("receiver", F.lit("")), F.col("callee")).alias("kind")).agg(F.count("*").alias("n"))


# --- design patterns: weights of what a class has ------------------------------------------------------

MEMBERS = f"""m AS (SELECT parent_id AS element_id, count(*) FILTER ({IS_FUNCTION}) AS n_methods, count(*) FILTER (element_type IN ('variable', 'constant') AND name IN ('_instance', 'instance', '_singleton', '_shared_instance')) AS kept, count(*) FILTER ({IS_FUNCTION} AND name IN ('get_instance', 'getInstance', 'instance', 'shared', 'default')) AS gets, count(*) FILTER ({IS_FUNCTION} AND name = '__new__') AS news, count(*) FILTER ({IS_FUNCTION} AND name = 'build') AS builds, count(*) FILTER ({IS_FUNCTION} AND starts_with(name, 'with_')) AS withs,
 count(*) FILTER ({IS_FUNCTION} AND starts_with(name, 'set_')) AS sets, count(*) FILTER ({IS_FUNCTION} AND starts_with(name, 'add_')) AS adds, count(*) FILTER ({IS_FUNCTION} AND regexp_matches(name, '^([Cc]reate|[Mm]ake|[Bb]uild|[Ff]rom_|[Nn]ew_)')) AS makes, count(*) FILTER ({IS_FUNCTION} AND regexp_matches(lower(name), 'get|find|save|update|delete|create|add|remove')) AS cruds, count(*) FILTER ({IS_FUNCTION} AND regexp_matches(name, '^(find_by|get_by)')) AS finds FROM cur WHERE parent_id IS NOT NULL GROUP BY 1)"""
SCORES_SQL = """least(1.0, CASE WHEN kept > 0 THEN 0.4 ELSE 0 END + CASE WHEN gets > 0 THEN 0.4 ELSE 0 END + CASE WHEN news > 0 THEN 0.3 ELSE 0 END) AS singleton, least(1.0, CASE WHEN builds > 0 THEN 0.3 ELSE 0 END + CASE WHEN ends_with(c.name, 'Builder') THEN 0.3 ELSE 0 END + CASE WHEN withs >= 2 THEN 0.3 ELSE 0 END + CASE WHEN sets >= 2 THEN 0.2 ELSE 0 END + CASE WHEN adds >= 2 THEN 0.2 ELSE 0 END) AS builder,
 least(1.0, CASE WHEN contains(lower(c.name), 'factory') THEN 0.3 ELSE 0 END + CASE WHEN makes > 0 THEN 0.3 ELSE 0 END + CASE WHEN makes >= 2 THEN 0.3 ELSE 0 END + CASE WHEN makes >= 3 THEN 0.1 ELSE 0 END) AS factory, CASE WHEN contains(c.name, 'Repo') THEN 0.3 ELSE 0 END + CASE WHEN cruds >= 2 THEN 0.4 ELSE 0 END + CASE WHEN finds > 0 THEN 0.3 ELSE 0 END AS repository_like"""


@R.query("class_patterns", f"WITH {CUR}, {MEMBERS}, s AS (SELECT c.element_id, {SCORES_SQL} FROM cur c LEFT JOIN m ON m.element_id = c.element_id WHERE c.element_type = 'class') SELECT element_id, CAST(singleton AS DOUBLE) AS singleton, CAST(builder AS DOUBLE) AS builder, CAST(factory AS DOUBLE) AS factory, CAST(repository_like AS DOUBLE) AS repository_like FROM s WHERE greatest(singleton, builder, factory, repository_like) >= 0.3")
def class_patterns(spark: SparkSession, d: str) -> DataFrame:
    """How much each class looks like a singleton, builder, factory or repository, from 0.3 on.

    What a class has is counted by its id before it meets the class, so one with most members is no hot key.
    """
    rows = current_elements(spark, d, "parent_id", "name", "element_type", types=("variable", "constant", *FUNCTIONS)).where(F.col("parent_id").isNotNull())
    f, name = F.col("element_type").isin(*FUNCTIONS), F.col("name")
    n = lambda cond: F.count_if(cond)
    m = rows.groupBy(F.col("parent_id").alias("element_id")).agg(
        n(~f & name.isin("_instance", "instance", "_singleton", "_shared_instance")).alias("kept"), n(f & name.isin("get_instance", "getInstance", "instance", "shared", "default")).alias("gets"), n(f & (name == "__new__")).alias("news"), n(f & (name == "build")).alias("builds"),
        n(f & name.startswith("with_")).alias("withs"), n(f & name.startswith("set_")).alias("sets"), n(f & name.startswith("add_")).alias("adds"), n(f & name.rlike("^([Cc]reate|[Mm]ake|[Bb]uild|[Ff]rom_|[Nn]ew_)")).alias("makes"),
        n(f & F.lower("name").rlike("get|find|save|update|delete|create|add|remove")).alias("cruds"), n(f & name.rlike("^(find_by|get_by)")).alias("finds"),
    )
    c = current_elements(spark, d, "element_id", "name", types=("class",)).join(m, "element_id", "left")
    w = lambda cond, x: F.when(cond, F.lit(x)).otherwise(0.0)
    one = F.lit(1.0)
    singleton = F.least(one, w(F.col("kept") > 0, 0.4) + w(F.col("gets") > 0, 0.4) + w(F.col("news") > 0, 0.3))
    builder = F.least(one, w(F.col("builds") > 0, 0.3) + w(name.endswith("Builder"), 0.3) + w(F.col("withs") >= 2, 0.3) + w(F.col("sets") >= 2, 0.2) + w(F.col("adds") >= 2, 0.2))
    factory = F.least(one, w(F.contains(F.lower("name"), F.lit("factory")), 0.3) + w(F.col("makes") > 0, 0.3) + w(F.col("makes") >= 2, 0.3) + w(F.col("makes") >= 3, 0.1))
    repo = w(F.contains("name", F.lit("Repo")), 0.3) + w(F.col("cruds") >= 2, 0.4) + w(F.col("finds") > 0, 0.3)
    out = c.select("element_id", singleton.alias("singleton"), builder.alias("builder"), factory.alias("factory"), repo.alias("repository_like"))
    return out.where(F.greatest("singleton", "builder", "factory", "repository_like") >= 0.3)

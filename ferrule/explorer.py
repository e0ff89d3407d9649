"""The questions of the tool surface, with their parameters, over one folder of tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions import code as C
from ferrule.functions import text as T
from ferrule.operators import graphs, rules, search
from ferrule.plans import extraction, graph, scalars, statistics
from ferrule.sources.tables import current_elements, newest_files, table

FUNCTIONS = ("function", "method")


class Explorer:
    """Every method gives a DataFrame and takes the limits that its caller wants, if any.

    ``username`` shows a user's rows together with those of ``main``; None shows all. Nulls never match
    a filter; unknown names and ids give no rows.
    """

    def __init__(self, spark: SparkSession, folder: str, scope: str | None = None, repository: str | None = None, username: str | None = None) -> None:
        self.spark, self.folder = spark, folder
        self.scope, self.repository, self.username = scope, repository, username

    def _mine(self, df: DataFrame) -> DataFrame:
        for column, value in (("scope", self.scope), ("repository", self.repository)):
            if value is not None:
                df = df.where(F.col(column) == value)
        return df.where(F.col("username").isin(self.username, "main")) if self.username else df

    @cached_property
    def elements(self) -> DataFrame:
        return self._mine(current_elements(self.spark, self.folder, *table(self.spark, self.folder, "code_elements").columns))

    @cached_property
    def files(self) -> DataFrame:
        return self._mine(newest_files(self.spark, self.folder, *table(self.spark, self.folder, "file_states").columns)).where(~F.coalesce("is_deleted", F.lit(False)))

    @cached_property
    def calls(self) -> DataFrame:
        return extraction.resolve_calls(self.spark, self.folder)

    # --- lookups ------------------------------------------------------------------------------------

    def get_element(self, id_or_hash: str) -> DataFrame:
        """By element_id, by its SHA-256 or by a prefix of that; a prefix of two elements is an error."""
        if ":" in id_or_hash or len(id_or_hash) > 64 or any(c not in "0123456789abcdefABCDEF" for c in id_or_hash):
            return self.elements.where(F.col("element_id") == id_or_hash)
        found = self.elements.where(F.sha2("element_id", 256).startswith(id_or_hash.lower()))
        if len(found.select("element_id").limit(2).collect()) > 1:
            raise ValueError(f"more than one element has a hash that begins with {id_or_hash}")
        return found

    def batch_get_elements(self, ids: list[str]) -> DataFrame:
        """In the order of ``ids``, with null columns for unknown ones."""
        wanted = self.spark.createDataFrame(list(enumerate(ids)), "place int, element_id string")
        return wanted.join(self.elements, "element_id", "left").orderBy("place")

    def get_children(self, element_id: str) -> DataFrame:
        return self.elements.where(F.col("parent_id") == element_id).orderBy(F.col("line_start").asc_nulls_last(), "row_id")

    def get_context(self, element_id: str) -> DataFrame:
        """``relation`` (self, parent, sibling, child, file) and the element."""
        own = self.elements.where(F.col("element_id") == element_id).select(F.col("element_id").alias("own"), F.col("parent_id").alias("up"), F.col("repository").alias("r"), F.col("username").alias("u"), F.col("relative_path").alias("p"))
        e = self.elements
        same_file = (e["repository"] == own["r"]) & (e["username"] == own["u"]) & (e["relative_path"] == own["p"])
        relation = F.when(F.col("element_id") == F.col("own"), "self").when(F.col("element_id") == F.col("up"), "parent").when(F.col("parent_id") == F.col("own"), "child").when(F.col("parent_id") == F.col("up"), "sibling").when(same_file & (F.col("element_type") == "file"), "file")
        return e.join(F.broadcast(own)).withColumn("relation", relation).where(F.col("relation").isNotNull()).drop("own", "up", "r", "u", "p")  # one row is broadcast

    def get_file_structure(self, relative_path: str) -> DataFrame:
        return self.elements.where((F.col("relative_path") == relative_path) & (F.col("element_type") != "file")).orderBy("line_start", "row_id")

    def list_repos(self) -> DataFrame:
        return statistics.repo_stats(self.spark, self.folder)

    def get_repo_stats(self) -> DataFrame:
        return self.elements.groupBy("element_type", "language").agg(F.count("*").alias("n"))

    # --- search -------------------------------------------------------------------------------------

    def pattern_search(self, pattern: str, mode: str = "regexp", slop: int = 5, glob: str | None = None, include_tests: bool = False) -> DataFrame:
        """Elements whose code matches as a whole field: ``regexp``, ``wildcard`` or ``proximity``."""
        code: Column = F.col("raw_code")
        short = F.length(code) <= search.KEYWORD_LIMIT
        match mode:
            case "regexp":
                hit = code.rlike(pattern) & short
            case "wildcard":
                hit = search.wildcard(code, f"*{pattern}*")
            case "proximity":
                hit = search.proximity(code, pattern.lower().split(), slop)
            case _:
                raise ValueError("mode must be regexp, wildcard or proximity")
        rows = self.elements.where(hit)
        if glob:
            rows = rows.where(search.glob(F.col("relative_path"), glob))
        return rows if include_tests else rows.where(~F.coalesce("is_test", F.lit(False)))

    def find_files(self, pattern: str) -> DataFrame:
        return self.files.where(search.glob(F.col("relative_path"), pattern))

    def search_text(self, query: str, limit: int = 20) -> DataFrame:
        """BM25 over the words of the name, the docstring and the signature, the best field counting."""
        rows = self.elements.withColumn("name_text", T.humanize_name(F.col("name")))
        found = search.best_fields(rows, "element_id", {"name_text": 3.0, "docstring": 1.0, "signature": 2.0}, query.lower().split())
        return found.orderBy(F.col("score").desc(), "element_id").limit(limit)

    def search_vector(self, vector: list[float], field: str = "summary_embedding", least: float = 0.3, limit: int = 20) -> DataFrame:
        q = F.array(*[F.lit(float(x)) for x in vector])
        rows = self.elements.where(F.size(field) == len(vector)).select("element_id", search.cosine(F.col(field), q).alias("score"))
        return rows.where((F.col("score") >= least) & ~F.isnan("score")).orderBy(F.col("score").desc(), "element_id").limit(limit)

    def find_similar(self, element_id: str, field: str = "summary_embedding", limit: int = 10, same_repository: bool = False) -> DataFrame:
        own = self.elements.where(F.col("element_id") == element_id).select(F.col(field).alias("q"), F.col("repository").alias("r"))
        rows = self.elements.where((F.col("element_id") != element_id) & F.col(field).isNotNull()).join(F.broadcast(own))
        if same_repository:
            rows = rows.where(F.col("repository") == F.col("r"))
        scored = rows.select("element_id", F.round(search.cosine(F.col(field), F.col("q")), 3).alias("similarity"))
        return scored.where(~F.isnan("similarity")).orderBy(F.col("similarity").desc(), "element_id").limit(limit)

    # --- calls and imports --------------------------------------------------------------------------

    def find_callers(self, element_id: str) -> DataFrame:
        return self.elements.join(self.calls.where(F.col("target") == element_id).select("element_id").distinct(), "element_id", "left_semi")

    def get_call_graph(self, element_id: str) -> DataFrame:
        """``direction, other, how``: who calls it, and whom it calls."""
        c = self.calls
        return c.where(F.col("target") == element_id).select(F.lit("caller").alias("direction"), F.col("element_id").alias("other"), "how").union(c.where(F.col("element_id") == element_id).select(F.lit("callee"), "target", "how")).distinct()

    def find_call_chain(self, element_id: str, direction: str = "callees", max_depth: int = 5) -> DataFrame:
        a, b = ("element_id", "target") if direction == "callees" else ("target", "element_id")
        edges = self.calls.select(F.col(a).alias("src"), F.col(b).alias("dst"))
        return graphs.chain(edges, self.spark.createDataFrame([(element_id,)], "id string"), min(10, max(1, max_depth)))

    def find_dead_code(self) -> DataFrame:
        return self.elements.join(extraction.dead_code(self.spark, self.folder), "element_id", "left_semi")

    def find_entry_points(self) -> DataFrame:
        return graph.entry_points(self.spark, self.folder).join(self.elements.select("element_id"), "element_id", "left_semi")

    def find_usages(self, name: str) -> DataFrame:
        """Elements whose code has the name as a whole word, but for its definitions."""
        word = F.concat(F.lit(r"(?<!\w)"), F.lit("\\Q" + name.replace("\\E", "") + "\\E"), F.lit(r"(?!\w)"))
        return self.elements.where((F.col("element_type") != "file") & (F.col("name") != name) & F.regexp_like("raw_code", word))

    def find_implementations(self, class_name: str) -> DataFrame:
        return self.elements.where((F.col("element_type") == "class") & (F.col("name") != class_name) & F.regexp_like("signature", F.lit(rf"(?:extends|implements|\(|,)[^{{]*\b\Q{class_name}\E\b")))

    def find_dependencies(self, relative_path: str) -> DataFrame:
        inside = F.col("module").startswith(".") | F.col("module").startswith("crate")
        return graph.imports(self.spark, self.folder).where(F.col("relative_path") == relative_path).select("repository", "module", F.when(inside, "internal").otherwise("external").alias("kind")).distinct()

    def find_dependents(self, module: str) -> DataFrame:
        return graph.imports(self.spark, self.folder).where(F.col("module") == module).select("repository", "relative_path").distinct()

    def dependency_graph(self) -> DataFrame:
        return graph.imports(self.spark, self.folder).distinct()

    # --- quality ------------------------------------------------------------------------------------

    def find_complex_functions(self, least: int = 10, limit: int = 50) -> DataFrame:
        rows = self.elements.where(F.col("element_type").isin(*FUNCTIONS)).withColumn("complexity", C.complexity(F.col("raw_code"), F.col("language")))
        return rows.where(F.col("complexity") >= least).orderBy(F.col("complexity").desc(), "element_id").limit(limit)

    def find_undocumented(self, public_only: bool = True) -> DataFrame:
        rows = self.elements.where(F.col("element_type").isin(*FUNCTIONS) & (F.trim(F.coalesce("docstring", F.lit(""))) == ""))
        return rows.where(F.coalesce("visibility", F.lit("public")) == "public") if public_only else rows

    def find_security_issues(self, least: str = "info") -> DataFrame:
        found = rules.matches(self.elements.where(F.col("element_type").isin(*FUNCTIONS)), ["element_id"], "raw_code", rules.SECURITY)
        return found.where(F.col("score") >= rules.SEVERITY[least]).orderBy(F.col("score").desc(), "element_id", "line")

    def find_env_usage(self) -> DataFrame:
        return scalars.env_usage(self.spark, self.folder)

    def find_async_code(self) -> DataFrame:
        return self.elements.where("is_async")

    def list_patterns(self) -> DataFrame:
        return statistics.pattern_terms(self.spark, self.folder)

    def find_by_pattern(self, decorator: str) -> DataFrame:
        return self.elements.where(F.array_contains("decorators", decorator))

    def explain_element(self, element_id: str) -> DataFrame:
        """``relation, other``: parent, callers, callees and the three most similar elements."""
        calls = self.get_call_graph(element_id).select(F.col("direction").alias("relation"), "other")
        near = self.find_similar(element_id, limit=3).select(F.lit("similar").alias("relation"), F.col("element_id").alias("other"))
        up = self.elements.where(F.col("element_id") == element_id).select(F.lit("parent").alias("relation"), F.col("parent_id").alias("other"))
        return calls.union(near).union(up.where(F.col("other").isNotNull()))

"""Routes, commands, relationships, calls and text functions on small tables with known results."""

from pyspark.sql import functions as F

from ferrule.functions import code as C
from ferrule.functions import parsers
from ferrule.operators import relations, resolve, routes

DECORATED = "element_id string, repository string, username string, relative_path string, name string, language string, decorators array<string>, method int"


def decorated(spark, rows):
    return spark.createDataFrame([(f"e{k}", "r", "main", p, n, g, d, 0) for k, (p, n, g, d) in enumerate(rows)], DECORATED)


def test_http_routes(spark):
    rows = decorated(spark, [
        ("api/v1/users.py", "one", "python", ["router.get('/users/{user_id}', tags=['x'])", "cached"]), ("api/v1/users.py", "two", "python", ['app.route("/users", methods=["POST", \'PUT\'])']), ("api/v1/users.py", "three", "python", ["app.route('/users/all')"]),
        ("A.java", "four", "java", ['@GetMapping("/a")']), ("A.java", "five", "java", ['@RequestMapping(value = "/b", method = RequestMethod.POST)']), ("A.java", "six", "java", ["@GET", '@Path("/c")']),
        ("c.ts", "seven", "typescript", ["Get(':id')"]), ("d.rs", "eight", "rust", ['get("/d/{x}")']), ("e.py", "none", "python", ["router.get()", "retry(3)", "x.gets('/y')"]), ("e.py", "null", "python", None), ("e.py", None, None, [None, ""]),
    ])
    got = {(r["element_id"], r["method"], r["path"], tuple(r["path_params"]), r["framework"]) for r in routes.http_routes(rows).collect()}
    assert got == {
        ("e0", "GET", "/users/{user_id}", ("user_id",), "fastapi"), ("e1", "POST", "/users", (), "flask"), ("e1", "PUT", "/users", (), "flask"), ("e2", "GET", "/users/all", (), "flask"), ("e3", "GET", "/a", (), "spring"),
        ("e4", "POST", "/b", (), "spring"), ("e5", "GET", "/c", (), "jax-rs"), ("e6", "GET", ":id", ("id",), "nest"), ("e7", "GET", "/d/{x}", ("x",), "actix"),
    }
    tree = {(r["router"], r["common_prefix"], r["method"], r["url"]) for r in routes.route_tree(routes.http_routes(rows), rows, "/api/").collect()}
    assert ("users", "/users", "GET", "/api/users/{user_id}") in tree and ("c", "/:id", "GET", "/api/:id") in tree and ("d", "/d", "GET", "/api/d/{x}") in tree and ("A", "", "GET", "/api/a") in tree
    assert routes.http_routes(spark.createDataFrame([], DECORATED)).count() == 0
    names = spark.createDataFrame([("src/routes/repos.py",), ("x/web/__init__.py",), ("src/main.py",), ("app",)], "p string").select(routes.router_name(F.col("p"))).collect()
    assert [r[0] for r in names] == ["repos", "web", "main", "app"]


def test_command_tree(spark):
    rows = decorated(spark, [
        ("c.py", "main", "python", ["click.group()"]), ("c.py", "web", "python", ["main.group('web')"]), ("c.py", "serve", "python", ["web.command(name='run')", "click.option('--x')"]), ("c.py", "init", "python", ["main.command()"]),
        ("c.py", "lost", "python", ["nothing.command('l')"]), ("c.py", "a", "python", ["b.group()"]), ("c.py", "b", "python", ["a.group()"]), ("c.py", "x", "python", ["commander()"]), ("c.py", "y", "python", None),
    ])
    found = routes.commands(rows)
    assert {(r["name"], r["parent"], r["is_group"], r["command"]) for r in found.collect()} == {("main", None, True, "main"), ("web", "main", True, "web"), ("serve", "web", False, "run"), ("init", "main", False, "init"), ("lost", "nothing", False, "l"), ("a", "b", True, "a"), ("b", "a", True, "b")}
    got = {r["element_id"]: (r["depth"], r["full_command"]) for r in routes.command_tree(found, "tool").collect()}
    assert got == {"e0": (0, "tool"), "e1": (1, "tool web"), "e2": (2, "tool web run"), "e3": (1, "tool init"), "e4": (0, "tool l"), "e5": (None, None), "e6": (None, None)}
    assert routes.command_tree(routes.commands(spark.createDataFrame([], DECORATED))).count() == 0


def test_relationships(spark):
    import datetime as dt
    import hashlib

    day = dt.datetime(2024, 1, 1)
    rows = [("s", "r", "main", "a", "b", "calls", day, 1), ("s", "r", "ann", "a", "b", "calls", day, 2), ("s", "r", "main", "a", "c", "calls", day, 3), ("s", "r", "main", None, "c", "calls", day, 4), ("s", "r", "main", "a", "c", "calls", day, 3)]
    edges = relations.relationships(spark.createDataFrame(rows, "scope string, repository string, username string, source_hash string, target_hash string, relationship_type string, indexed_at timestamp_ntz, place int"))
    assert edges.count() == 4
    got = {r["relationship_key"]: (r["username"], r["priority"], r["relationship_id"]) for r in relations.collapsed(edges).collect()}
    assert got["s:r:a→b:calls"] == ("ann", 1, hashlib.sha256("s:r:ann:a→b:calls".encode()).hexdigest()[:12]) and got["s:r:a→c:calls"][:2] == ("main", 0) and len(got) == 2


FUNCTIONS = "element_id string, repository string, username string, relative_path string, parent_id string, element_type string, name string, signature string, raw_code string, target string"


def test_calls_are_resolved_pass_by_pass(spark):
    u = ("r", "main")
    rows = [
        ("f1", *u, "src/a.py", None, "function", "run", "def run(x, repo: Optional[db.Store]) -> Store", "def run(x, repo):\n  load()\n  help_me()\n  s = Store()\n  s.save()\n  repo.find()\n  t = make()\n  t.find()\n  star()\n  if (x):\n    pass\n", ""),
        ("f2", *u, "src/a.py", None, "function", "help_me", "def help_me()", "", ""), ("f3", *u, "src/b.py", None, "function", "load", "def load()", None, ""), ("f4", *u, "src/c.py", None, "function", "make", "def make() -> Store", "pass", ""),
        ("f5", *u, "src/d.py", None, "function", "only_one", "def only_one()", "only_one()\nhandler_client.send()", ""), ("f6", *u, "src/s.py", None, "function", "star", "def star()", "", ""), ("f7", *u, "src/e.py", None, "function", "go", "def go()", "only_one()", ""),
        ("s:r:main:src/store.py:class:Store:1", *u, "src/store.py", None, "class", "Store", "class Store(Base)", "", ""), ("m1", *u, "src/store.py", "s:r:main:src/store.py:class:Store:1", "method", "save", "def save(self)", "super().save()", ""),
        ("s:r:main:src/base.py:class:Base:1", *u, "src/base.py", None, "class", "Base", "class Base", "", ""), ("m2", *u, "src/base.py", "s:r:main:src/base.py:class:Base:1", "method", "save", "def save(self)", "", ""), ("m3", *u, "src/base.py", "s:r:main:src/base.py:class:Base:1", "method", "find", "def find(self)", "", ""),
        ("m4", *u, "src/http_client.py", "s:r:main:src/http_client.py:class:Sender:1", "method", "send", "def send(self)", "", ""), ("m5", *u, "tests/fixtures/handler_client.py", "s:r:main:tests/fixtures/h.py:class:HandlerClient:1", "method", "send", "def send(self)", "", ""),
        ("n", *u, None, None, None, None, None, None, ""),
    ]
    table = spark.createDataFrame(rows, FUNCTIONS)
    imports = spark.createDataFrame([("r", "main", "src/a.py", "load", "load", "src/i.py"), ("r", "main", "src/i.py", "load", "load", "src/b.py"), ("r", "main", "src/a.py", "*", "*", "src/s.py"), ("r", "main", "src/a.py", "gone", "gone", None)], "repository string, username string, relative_path string, name string, alias string, file string")
    bases = spark.createDataFrame([("r", "main", "Store", "Base", 0)], "repository string, username string, type string, base string, place int")
    functions = table.where("element_type in ('function', 'method')").select("element_id", "repository", "username", "relative_path", "parent_id", "signature", "raw_code")
    got = {(r["element_id"], r["receiver"], r["callee"]): (r["target"], r["how"]) for r in resolve.resolved(functions, table.drop("raw_code"), imports, bases).collect()}
    assert got == {
        ("f1", None, "load"): ("f3", "import"), ("f1", None, "star"): ("f6", "import"), ("f1", None, "help_me"): ("f2", "same_file"), ("f1", None, "Store"): ("s:r:main:src/store.py:class:Store:1", "unique_name"), ("f1", "s", "save"): ("m1", "constructor"),
        ("f1", "repo", "find"): ("m3", "annotation"), ("f1", "t", "find"): ("m3", "return_type"), ("f1", None, "make"): ("f4", "unique_name"), ("f7", None, "only_one"): ("f5", "unique_name"), ("m1", "super()", "save"): ("m2", "super"), ("f5", "handler_client", "send"): ("m4", "affinity"),
    }
    empty = table.where("false")
    assert resolve.resolved(functions.where("false"), empty.drop("raw_code"), imports.where("false"), bases.where("false")).count() == 0


def test_affinity_ladder(spark):
    rows = [("repo", "Repository", "x.py", False), ("search", "SearchRepository", "x.py", False), ("search", "ESSearch", "x.py", False), ("es_repo", "ElasticRepo", "x.py", False), ("client", "", "a/client_x.py", False), ("client", None, "http_client.py", False), ("my_client", "", "http_client.py", False), ("ab", "Abc", "ab.py", False), ("self", "Zed", "q.py", True), ("x", None, None, None)]
    got = spark.createDataFrame(rows, "r string, c string, p string, s boolean").select(resolve.affinity(F.col("r"), F.col("c"), F.col("p"), F.col("s"))).collect()
    assert [r[0] for r in got] == [1.0, 1.0, 0.8, 0.7, 0.6, 0.5, 0.4, 0.0, 1.0, 0.0]
    types = spark.createDataFrame([("Optional[db.Repository]",), ("Union[Repository, None]",), ("list[str]",), ("Repository | None",), ("a.b.C",)], "t string").select(resolve.base_type(F.col("t"))).collect()
    assert [r[0] for r in types] == ["Repository", "Repository", "list", "Repository", "C"]


def test_code_functions(spark):
    one = lambda *cols: spark.range(1).select(*cols).first()
    code = "def f(a):\n    '''if and or'''\n    # for while\n    if a and b:  # or\n        x = \"if else for\"\n    elif c:\n        pass\n"
    assert one(C.complexity(F.lit(code), F.lit("python")), C.complexity(F.lit("if (a && b) { /* if */ c('for') } // while"), F.lit("java")), C.complexity(F.lit(None).cast("string"), F.lit("java")), C.complexity(F.lit("if"), F.lit("cobol"))) == (4, 3, 1, 1)
    paths = ("a/./b/../c", "../x", "a/../../b", "x")
    assert tuple(one(*[C.normalized_path(F.lit(p)) for p in paths])) == ("a/c", "../x", "../b", "x")
    assert tuple(one(*[C.format_bytes(F.lit(x)) for x in (0, 1023, 1024, 1280, 5 << 30)])) == ("0.0 B", "1023.0 B", "1.0 KB", "1.2 KB", "5.0 GB")
    assert one(C.clean_label(F.lit('"Label: Search & Ranking"')))[0] == "search__ranking" and one(C.clean_label(F.lit("x" * 80)))[0] == "x" * 50
    assert one(C.description(F.lit("Reads it.\n  All of it.\n\nArgs:\n  x: no\n")))[0] == "Reads it. All of it." and one(C.description(F.lit("")))[0] == ""
    assert one(C.fitted(F.lit("aaaa\nbbbb\ncccc"), 8, 1))[0] == "aaaa\n... (context truncated)" and one(C.fitted(F.lit("aa"), 8, 1))[0] == "aa"
    assert one(C.without_thoughts(F.lit("<think>a\nb</think> yes <think>open")))[0] == "yes" and C.quoted_pattern("a.b[c]") == r"a\.b\[c\]"
    assert one(C.unit_vector(F.array(F.lit(3.0), F.lit(4.0))), C.unit_vector(F.array(F.lit(0.0)))) == ([0.6, 0.8], [0.0])
    rows = spark.createDataFrame([("test_x", None, "python"), ("x", ["pytest.fixture"], "python"), ("x", ["test"], "rust"), ("shouldWork", [], "java"), ("test_x", [], "php"), (None, None, None)], "n string, d array<string>, g string")
    assert [r[0] for r in rows.select(C.is_test_element(F.col("n"), F.col("d"), F.col("g"))).collect()] == [True, True, True, True, False, False]


def test_imports_of_all_languages():
    ts = "import a, { b, type C as d } from './x';\nimport * as e from \"y\";\nimport 'z';\n// import no from 'no';\nconst { f, g: h } = require('w');\n"
    assert set(parsers.imports(ts, "typescript")) == {("./x", "b", "b", 1), ("./x", "C", "d", 1), ("./x", "default", "a", 1), ("y", "*", "e", 2), ("z", "", "", 3), ("w", "f", "f", 5), ("w", "g", "h", 5)}
    assert parsers.imports("import java.util.List;\nimport static a.B.*;\n", "java") == [("java.util", "List", "List", 1), ("a.B", "*", "*", 2)]
    assert parsers.imports("<?php\nuse A\\B\\C;\nuse D\\E as F;\n", "php") == [("A\\B", "C", "C", 2), ("D", "E", "F", 3)]
    assert parsers.imports("use a::b::{c, d as e};\npub use f::g;\n", "rust") == [("a::b", "c", "c", 1), ("a::b", "d", "e", 1), ("f", "g", "g", 2)]
    assert parsers.imports("from a import b as c\n", "python") == [("a", "b", "c", 1)] and parsers.imports(None, "java") == [] and parsers.imports("x", "cobol") == []


def test_all_parts_of_components_and_documents():
    parts = parsers.component_parts("<script>a()</script><template><p>x</p></template><script setup>b()</script><style>.c{}</style>")
    assert parts["script"] == "a()\nb()" and parts["template"] == "<p>x</p>" and parts["style"] == ".c{}"
    assert parsers.css_rules(".a, .b { color: red; margin: 0 }\n@media x { .c { top: 1px } }") == [(".a, .b", "color, margin", 1), (".c", "top", 2)]
    assert [k for k, _ in parsers.mapping_keys("a:\n  b: 1\nc: 2\n", "yaml")] == ["a", "a.b", "c"] and [k for k, _ in parsers.mapping_keys("[a]\nx = 1\n[[b.c]]\n", "toml")] == ["a", "b.c"]
    assert parsers.html_outline("<h2 id=t>A</h2><p class='x y'>b <a href='u'>c</a></p><script>no</script>") == ("## A\nb [u] c", ["x", "y"], ["t"])
    assert parsers.dockerfile_instructions("FROM a\n# no\nRUN x \\\n  y\n") == [("FROM a", 1), ("RUN x \\", 3)]

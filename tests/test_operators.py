"""Core operators on hand-made rows: nulls, ties, repeated rows, empty tables, clashing columns, skew."""

import datetime as dt
import random

from pyspark.sql import functions as F

from ferrule.functions import parsers
from ferrule.functions import text as T
from ferrule.functions import tiers
from ferrule.operators import changes, graphs, hierarchy, rules, search, skew
from ferrule.sources import discovery
from ferrule.sources.store import Store
from ferrule.sources.tables import latest_per_key

DAY = dt.datetime(2024, 1, 1)
ROWS = "key_field string, key_value string, size long, at timestamp_ntz, tie long"


def test_keyed_totals_match_brute_force_under_skew(spark):
    rng = random.Random(3)
    rows = []
    for i in range(4000):
        key = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None, ""])
        at = None if rng.random() < 0.05 else DAY + dt.timedelta(seconds=rng.randrange(5000))
        rows.append(("k", key, None if rng.random() < 0.1 else rng.randrange(100), at, i))
    got = {r["key_value"]: r for r in skew.keyed_totals(spark.createDataFrame(rows, ROWS), 7).collect()}
    for key in ("hot", "a", "b", None, ""):
        own = [r for r in rows if r[1] == key]
        times = sorted(r[3] for r in own if r[3])
        g = got[key]
        assert (g["n_rows"], g["total_size"]) == (len(own), sum(r[2] or 0 for r in own))
        assert (g["first_at"], g["last_at"]) == (times[0], times[-1])
        assert g["widest_gap_us"] == max(int((b - a).total_seconds() * 1e6) for a, b in zip(times, times[1:]))


def test_keyed_totals_of_nothing_and_of_rows_without_time(spark):
    assert skew.keyed_totals(spark.createDataFrame([], ROWS)).count() == 0
    r = skew.keyed_totals(spark.createDataFrame([("k", "x", None, None, None)] * 3, ROWS)).collect()
    assert [(x["n_rows"], x["total_size"], x["first_at"], x["widest_gap_us"]) for x in r] == [(3, 0, None, None)]


def test_heavy_keys(spark):
    rows = spark.createDataFrame([("k", "big", 1, DAY, i) for i in range(60)] + [("k", f"s{i}", 1, DAY, i) for i in range(40)], ROWS)
    assert [r["key_value"] for r in skew.heavy_keys(skew.keyed_totals(rows), 0.05).collect()] == ["big"]


NODES = "id long, element_id string, name string, parent_id string, extra string, n long, state string"


def brute(parents):
    out = {}
    for e in parents:
        path, x = [], e
        while x is not None and x not in path:
            path.append(x)
            x = parents[x] if parents[x] in parents else None
        out[e] = None if x is not None else path[::-1]
    return out


def nodes(spark, parents):
    return spark.createDataFrame([(i, e, e.upper(), p, "x", 1, "leaf") for i, (e, p) in enumerate(parents.items())], NODES)


def test_hierarchies_match_a_walk(spark):
    rng = random.Random(5)
    parents = {f"c{i}": f"c{i - 1}" if i else None for i in range(40)}  # a long chain
    parents |= {f"t{i}": rng.choice([f"t{rng.randrange(i)}" if i else None, "c39", "gone", None]) for i in range(120)}
    parents |= {"l0": "l2", "l1": "l0", "l2": "l1", "self": "self", "u0": "u1", "u1": "u0", "below": "l1", "below2": "below", "hang": "self"}
    want = brute(parents)
    ids = {e: i for i, e in enumerate(parents)}
    got = {r["element_id"]: r for r in hierarchy.hierarchies(nodes(spark, parents)).collect()}
    assert len(got) == len(parents)
    for e, path in want.items():
        r = got[e]
        if path is None:
            assert r["root_id"] is None and r["path"] is None and (r["in_loop"] or r["below_loop"])
            assert r["in_loop"] == (e in {"l0", "l1", "l2", "self", "u0", "u1"})
        else:
            assert (r["depth"], r["path"], r["root_id"]) == (len(path) - 1, "/".join(x.upper() for x in path), ids[path[0]])
            assert r["ancestors"] == [ids[x] for x in path[:-1]]
    found = {r["element_id"] for r in hierarchy.looped_nodes(nodes(spark, parents)).collect()}
    assert found == {e for e, p in want.items() if p is None}
    pairs = hierarchy.descendant_pairs(hierarchy.hierarchies(nodes(spark, parents))).count()
    assert pairs == sum(len(p) - 1 for p in want.values() if p)


def test_hierarchies_of_nothing_and_of_loops_only(spark):
    empty = spark.createDataFrame([], NODES)
    assert hierarchy.hierarchies(empty).count() == 0 and hierarchy.looped_nodes(empty).count() == 0
    assert hierarchy.looped_nodes(nodes(spark, {"a": "b", "b": "a"})).count() == 2
    assert hierarchy.looped_nodes(nodes(spark, {"a": None})).count() == 0


def test_latest_per_key_breaks_ties_and_keeps_null_keys(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 1, 7), ("a", None, 9), (None, 2, 1), (None, 2, 2), ("b", None, 3)], "k string, t int, id int")
    assert {(r["k"], r["id"]) for r in latest_per_key(rows, ["k"], ["t", "id"]).collect()} == {("a", 7), (None, 2), ("b", 3)}


def test_changes(spark):
    f = "path string, file_hash string, is_deleted boolean"
    new = spark.createDataFrame([("a", "1", False), ("b", "2", False), ("c", None, False)], f)
    old = spark.createDataFrame([("b", "9", False), ("c", None, False), ("d", "4", False)], f)
    assert {tuple(r) for r in changes.compare_main(new, old, ["path"]).collect()} == {("a", "new"), ("b", "modified"), ("c", "unchanged"), ("d", "deleted")}
    user = spark.createDataFrame([("b", "9", False), ("d", "4", True), ("x", "1", False), ("c", "5", False)], f)
    assert {(r["path"], r["change"]) for r in changes.compare_user(user, old, ["path"]).collect()} == {("b", "same_as_main"), ("d", "deleted_by_user"), ("x", "new"), ("c", "modified")}


def test_store_keeps_snapshots(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    s.upsert("t", rows, ["id"])
    s.upsert("t", spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), ["id"])
    s.delete("t", spark.createDataFrame([(1,)], "id int"), ["id"])
    s.update("t", spark.createDataFrame([(3, "z")], "id int, v string"), ["id"], ["v"])
    assert {tuple(r) for r in s.read("t").collect()} == {(2, "c"), (3, "z")}
    assert {tuple(r) for r in s.read("t", 1).collect()} == {(1, "a"), (2, "b")}
    assert s.versions("t") == [1, 2, 3, 4]


def test_graphs(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 1), (None, 1), (1, 2)], "src long, dst long")
    assert {tuple(r) for r in graphs.chain(e, spark.createDataFrame([(1,)], "id long"), 2).collect()} == {(1, 0), (2, 1), (3, 2)}
    assert {r["id"] for r in graphs.cycle_nodes(e).collect()} == {1, 2, 3}
    x = spark.createDataFrame([("f", 1, 1, 100), ("f", 2, 5, 90), ("f", 3, 10, 20), ("f", 4, 10, 20), ("f", 5, 200, 210), ("f", 6, None, 3), ("g", 7, 12, 13)], "file string, id long, first int, last int")
    assert {tuple(r) for r in graphs.tightest_parent(x, ["file"], 8).collect()} == {(2, 1), (3, 2), (4, 3)}
    c = spark.createDataFrame([(["b", "c", "a"],)], "x array<string>").select(graphs.normalized_cycle(F.col("x")).alias("x")).first()["x"]
    assert c == ["a", "b", "c"]


def test_text_functions(spark):
    names = ["parseHTMLContent", "test_parse_html", "__init__", "_x", "MAX_SIZE", "databases", "classes", "ies"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r["n"]: (r["h"], r["t"], r["v"]) for r in df.select("n", T.humanize_name(F.col("n")).alias("h"), T.normalize_term(F.col("n")).alias("t"), T.visibility(F.col("n")).alias("v")).collect()}
    assert got["parseHTMLContent"][0] == "parse html content" and got["test_parse_html"][0] == "test parse html" and got["MAX_SIZE"][0] == "max size"
    assert (got["databases"][1], got["classes"][1], got["ies"][1]) == ("databas", "class", "ies")
    assert (got["__init__"][2], got["_x"][2]) == ("public", "protected")
    t = spark.range(1).select(*[tiers.tier_above(F.lit(x)).alias(f"t{x}") for x in (0, 1024, 99_999)]).first()
    assert tuple(t) == (1024, 2048, 32768)


def test_proximity_and_globs(spark):
    df = spark.createDataFrame([("alpha x beta",), ("beta alpha",), ("alpha a b c d e f beta",), (None,), ("",)], "t string")
    assert [r[0] for r in df.where(search.proximity(F.col("t"), ["alpha", "beta"], 2)).collect()] == ["alpha x beta", "beta alpha"]
    paths = spark.createDataFrame([("src/a.py",), ("a.py",), ("src/x/b_1.ts",)], "p string")
    assert [r[0] for r in paths.where(search.glob(F.col("p"), "a.py")).collect()] == ["src/a.py"]
    assert [r[0] for r in paths.where(search.glob(F.col("p"), "src/**_1*")).collect()] == ["src/x/b_1.ts"]


def test_rules(spark):
    df = spark.createDataFrame([(1, "x = 1\npassword = 'abc12345'\n# password = 'abc12345'\neval(x)\npassword = os.environ['abc12345']"), (2, None), (3, "")], "id int, code string")
    assert {(r["line"], r["kind"], r["severity"]) for r in rules.matches(df, ["id"], "code", rules.SECURITY).collect()} == {(2, "secret", "high"), (4, "code from text", "high")}


def test_parsers():
    py = parsers.python_elements("import os\n\n@deco\nclass A(B):\n    '''Doc.'''\n    async def f(self, x: int) -> int:\n        return g(x) + self.h()\n\nLIMIT = 3\n")
    assert [(e.kind, e.name, e.line_start, e.parent) for e in py] == [("class", "A", 3, ""), ("method", "f", 6, "A"), ("constant", "LIMIT", 9, "")]
    assert py[1].is_async and py[1].calls == ["g", "self.h"] and py[0].docstring == "Doc." and parsers.python_elements("def f(:") == []
    ts = parsers.brace_elements("export class A {\n    private run(x: number): void {\n        go(x);\n    }\n}\nfunction go(x) {\n    // class No {\n    return 1;\n}\n", "typescript")
    assert [(e.kind, e.name, e.line_start, e.line_end) for e in ts] == [("class", "A", 1, 5), ("method", "run", 2, 4), ("function", "go", 6, 9)] and ts[1].calls == ["go"]
    rs = parsers.brace_elements("pub mod m {\n    pub fn f(a: i64) -> i64 {\n        a\n    }\n}\n", "rust")
    assert [(e.kind, e.name, e.parent) for e in rs] == [("class", "m", ""), ("method", "f", "m")]
    assert parsers.python_imports("from . import a as b\nimport c.d\n") == [(".", "a", "b", 1), ("c.d", "", "c.d", 2)]
    assert parsers.markdown_sections("# A\nx\n## B\n```\n# no\n```\n# C") == [(1, "A", 1, 6), (2, "B", 3, 6), (1, "C", 7, 7)]
    text, classes, ids = parsers.html_outline("<h1 id='t'>Hi</h1><p class='a b'>One <script>x</script>two</p>")
    assert text.startswith("# Hi") and classes == ["a", "b"] and ids == ["t"] and "x" not in text
    assert parsers.css_rules("/* c */\n.a, .b { color: red; top: 0 }\n@media x { p { margin: 1 } }") == [(".a, .b", "color, top", 2), ("p", "margin", 3)]
    assert parsers.mapping_keys("a:\n  b: 1\n  c:\n    d: 2\ne: 3", "yaml") == [("a", 1), ("a.b", 2), ("a.c", 3), ("a.c.d", 4), ("e", 5)]
    assert parsers.mapping_keys("[x]\na = 1\n[y.z]\n", "toml") == [("x", 1), ("y.z", 3)]
    assert parsers.dockerfile_instructions("FROM a\nRUN b \\\n  c\n# d\nCMD " + "e" * 90)[1:] == [("RUN b \\", 2), ("CMD " + "e" * 73 + "...", 5)]
    assert parsers.component_parts("<template><p/></template><script>let a</script>") == {"script": "let a", "template": "<p/>"}
    assert "{{" not in parsers.template_text("<p>{{ x }}</p>{% if y %}") and parsers.elements(None, "python") == []


def test_discovery(spark, tmp_path):
    for p, t in {"a.py": "x = 1\n", "b/run": "#!/usr/bin/env python3\n", "b/v.blade.php": "<p>", "node_modules/x.js": "1", ".hidden/y.py": "", "c/Dockerfile": "FROM a", "skip.log": "z"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    rows = {r["relative_path"]: r for r in discovery.discover(spark, str(tmp_path), files=["*.log"]).collect()}
    assert {p: r["language"] for p, r in rows.items()} == {"a.py": "python", "b/run": "python", "b/v.blade.php": "blade", "c/Dockerfile": "dockerfile"}
    assert rows["a.py"]["line_count"] == 1 and len(rows["a.py"]["file_hash"]) == 64


def test_signatures_are_whole():
    from ferrule.functions import parsers

    params = ", ".join(f"parameter_{i}" for i in range(60))
    (e,) = parsers.elements(f"function f({params}) {{\n  return 1;\n}}\n", "javascript")
    assert e.signature == f"function f({params})"


def test_kmeans_is_fitted_on_all_rows(spark):
    """Every centre is the mean of its rows, above the size at which a sample was taken, too."""
    import numpy as np

    from ferrule.operators.clusters import spherical_kmeans

    g = np.random.default_rng(6)
    v = g.normal(size=(21_500, 4)) + 3 * np.eye(4)[g.integers(0, 4, 21_500)]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")
    got = spherical_kmeans(rows, 4, rounds=200).toPandas().sort_values("id")
    c = np.stack([v[got["cluster"] == j].sum(axis=0) for j in range(4)])
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    assert np.allclose(got["similarity"], (v * c[got["cluster"]]).sum(axis=1), atol=1e-9)
    assert spherical_kmeans(rows.where("id < 0"), 4).count() == 0

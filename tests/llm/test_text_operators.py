"""Splitting, documentation pairs, syntax, hand-written sources, packing, leaks and endings."""

import random
from collections import Counter

import pytest

from ferrule.llm import docpairs, endings, handwritten, leaks, packing, split, syntax

# --- 1 -----------------------------------------------------------------------------------------------


def test_pieces_are_small_overlap_and_join_again():
    rng = random.Random(1)
    for _ in range(1500):
        text = "".join(rng.choice("ab \n\t#{};é\r\U0001f600") for _ in range(rng.randint(0, 300)))
        at = split.pieces(text, 40, 10)
        parts = [text[a:b] for a, b in at]
        assert split.joined(parts, 10) == text and all(len(p) <= 40 for p in parts)
        assert all(at[k][0] == at[k - 1][1] - 10 for k in range(1, len(at)))


def test_pieces_are_cut_between_functions():
    text = "".join(f"def f{i}(x):\n" + "".join(f"    y{k} = x + {k}\n" for k in range(6)) + "\n" for i in range(40))
    cuts = split.cut_points(text, 600, 60)
    assert len(cuts) > 5 and all(text[c:].startswith("def f") for c in cuts[1:])


def test_pieces_follow_markup_lists_and_headings():
    item = "<li>" + "word " * 12 + "<b>x</b></li>"
    line = "<ul>" + item * 100 + "</ul>"
    assert all(line[:c].endswith("</li>") for c in split.cut_points(line, 600, 60)[1:])
    html = "<div>\n" + "".join(f"<section>\n<p>{'text ' * 30}</p>\n<p>{'more ' * 20}</p>\n</section>\n" for _ in range(20)) + "</div>\n"
    assert all(html[c:].startswith(("<section>", "</div>")) for c in split.cut_points(html, 800, 60)[1:])
    text = "".join(f"## Part {i}\n\n" + "Some words stand here.\n" * 4 + "\n- one\n- two\n\n" for i in range(30))
    assert all(text[c:].startswith("## ") for c in split.cut_points(text, 700, 60)[1:])
    far = "x" * 6000 + " " + "y" * 9000
    assert 6001 in split.cut_points(far)
    code = "# a note\ndef f():\n" + "    call(1, 2)\n" * 30 + "\n"
    assert all((code * 9)[c:].startswith("# a note") for c in split.cut_points(code * 9, 1000, 50)[1:])


def test_split_oversized(spark):
    rows = [("a", "x" * 100, 1), ("b", "line\n" * 3000, 2), ("b", "line\n" * 3000, 2), ("c", None, 3), ("d", "", 4), (None, "y" * 20000, 5)]
    got = split.split_oversized(spark.createDataFrame(rows, "element_id string, raw_code string, n_pieces int")).collect()
    by = Counter(r["element_id"] for r in got)
    assert by["a"] == 1 and by["d"] == 1 and by["c"] == 0 and by["b"] == 4 and by[None] == 3
    assert max(len(r["piece"]) for r in got) <= split.LIMIT and all(r["stop"] - r["start"] == len(r["piece"]) for r in got)
    assert split.split_oversized(spark.createDataFrame([], "element_id string, raw_code string")).count() == 0


# --- 3 -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("doc", "name", "good"),
    [
        ("Reads the whole file into memory.", "load", True), ("TODO", "x", False), ("Fetch the adapter parser.", "_fetch_adapter_parser", False), ("Loads all rows of it.", "load_rows", True), ("", "x", False), (None, "x", False),
        ("Insert the description of this function here", "x", False), ("No description provided for this function.", "x", False), ("@param a the first of all\n@return the result", "x", False), ("Args:\n    a: the first of all things\n    b: another\n", "x", False),
        ("/**\n * Blocks until the shard settles.\n * @param x what\n */", "f", True), ("/// # Arguments\n/// * `a` - the one thing to use", "f", False), ("Auto-generated method stub", "f", False), ("Der Knoten lädt niemals einen leeren Eintrag.", "f", True), (":param a: one two three four five", "f", False),
        ("Add a description of the caller to every row.", "f", False), ("Adds all the missing rows again.", "f", True),
    ],
)
def test_worthwhile(doc, name, good):
    assert docpairs.worthwhile(doc, name) is good


def test_python_docstrings():
    assert docpairs.python_docstring('@deco(1)\nasync def f(a, b="):", *, c=(1, 2)) -> dict[str, int]:\n    """One."""\n    return 1') == "One."
    assert docpairs.python_docstring("def f(\n    a,  # it's a comment\n):\n    # no\n    r'''Two'''\n") == "Two"
    assert docpairs.python_docstring("def f(a):\n    x = '''no'''\n") is None and docpairs.python_docstring("class A:\n    '''no'''") is None
    assert docpairs.python_docstring("def f():\n    '''a''' + b\n") is None


def test_pairs_above():
    ts = "/** File. */\n\nimport x;\n/** One. */\n@Deco({a: ')'})\nexport async function f(a) {\n  const s = '/** no */';\n}\nclass A {\n  /**\n   * Two.\n   */\n  private g(x: number): void {}\n  // plain\n  h() {}\n}\n"
    assert [(n, a, h, d.split()[1] if "Two" not in d else "Two.") for n, a, h, d in docpairs.pairs_above(ts, "typescript")] == [("f", 5, 6, "One."), ("g", 13, 13, "Two.")]
    rs = "/// One.\n/// More.\n#[inline]\npub fn f() {}\n//// no\nfn g() {}\n"
    assert [(n, a, h) for n, a, h, _ in docpairs.pairs_above(rs, "rust")] == [("f", 3, 4)]
    assert docpairs.pairs_above("/** open", "java") == [] and docpairs.pairs_above("x", "cobol") == []


def test_documented_functions(spark):
    f = "element_id string, file_key string, language string, name string, signature string, docstring string, raw_code string, line_start int, comment string"
    fns = [
        ("1", "k", "java", "run", "s", None, "void run() {}", 3, "x"), ("2", "k", "java", "go", "s", "Says what it does here.", "c", 9, "x"), ("3", "p", "python", "f", "s", "  ", "def f():\n    '''Gives all of the rows.'''", 1, "x"),
        ("4", None, None, None, None, None, None, None, None), ("5", "k", "java", "no", "s", " \n", None, 8, "x"),
    ]
    files = [("k", "java", "class A {\n  /** Runs until nothing is left. */\n  void run() {}\n}", 1), ("z", None, None, 1)]
    got = docpairs.documented_functions(spark.createDataFrame(fns, f), spark.createDataFrame(files, "file_key string, language string, text string, line_start int")).collect()
    assert {r["element_id"]: r["description"] for r in got} == {"1": "Runs until nothing is left.", "2": "Says what it does here.", "3": "Gives all of the rows."}
    assert docpairs.documented_functions(spark.createDataFrame([], f), spark.createDataFrame([], "file_key string, language string, text string")).count() == 0


# --- 4 -----------------------------------------------------------------------------------------------

BODY = "\n".join(f"def handle_{w}(x):\n    y = compute(x, {i})\n    return y if y > {i} else None\n" for i, w in enumerate("red green blue black white pink grey brown".split()))


@pytest.mark.parametrize(
    ("text", "path", "kind"),
    [
        ("# Code generated by wirecast. DO NOT EDIT.\n" + BODY, "a.py", "generated"), ("# Please do not edit without asking the owners.\n" + BODY, "a.py", None), ("# Writes the banner 'DO NOT EDIT' into files.\n" + BODY, "a.py", None), (BODY + "\n# @generated\n", "a.py", "generated"),
        ("x = 'do not edit'\n" + BODY, "a.py", None), ("T = [\n" + "    1, 2, 3, 4, 5, 6,\n" * 40 + "]\n", "t.py", "data"), ("function a(b,c){if(b)return c;b.push(c);}" * 40, "x.js", "minified"), ("# lib v1.2.0 - (c) the lib contributors\n" + BODY, "a.py", "licensed"),
        ("", "a.py", None), (None, "a.py", None), ("# empty on purpose", "a.py", None), ("".join(f"def get_{i}(m):\n    return m[{i}]\n\n" for i in range(12)), "a.py", "generated"), (BODY, "a_pb2.py", "generated"), (BODY, None, None),
    ],
)
def test_kinds(text, path, kind):
    assert handwritten.kind(text, path) == kind


def test_not_handwritten(spark):
    lib = BODY.replace("compute", "render").replace("handle", "paint")
    rows = [(f"r{i}", "main", f"x{i}/lib.py", "python", lib + "\n" * i, "k") for i in range(4)]
    rows += [("r9", "main", "src/patched.py", "python", "# fix\n" + lib.replace("return y if y > 3", "return y if y >= 3"), "k"), ("r1", "main", "src/own.py", "python", BODY, "k"), ("r2", "main", "e.py", "python", "", "k"), ("r3", "main", None, None, None, None), ("r3", "main", "c.toml", "toml", "a = 1\n" * 60, "k")]
    rows += [(f"q{i}", "main", "m/__init__.py", "python", "# package marker", "k") for i in range(5)]
    got = {(r["repository"], r["kind"]) for r in handwritten.not_handwritten(spark.createDataFrame(rows, "repository string, username string, relative_path string, language string, text string, kind string")).collect()}
    assert got == {(f"r{i}", "vendored") for i in range(4)} | {("r9", "vendored")}
    empty = spark.createDataFrame([], "repository string, username string, relative_path string, language string, text string")
    assert handwritten.not_handwritten(empty).count() == 0


def test_headers_and_merkle_hashes(spark):
    late = "".join(f"# line {i} of a long licence\n" for i in range(120)) + "# Code generated by wirecast. DO NOT EDIT.\n" + BODY
    assert handwritten.kind(late, "a.py") == "generated"
    rows = [(r, "main", p, x) for r in ("a", "b") for p, x in (("lib/x/1.py", "p"), ("lib/x/2.py", "q"), ("lib/y/3.py", "r"))]
    rows += [("c", "main", "lib/x/1.py", "p"), ("c", "main", "lib/x/2.py", "q"), ("c", "main", "lib/y/3.py", "other"), ("d", "main", "top.py", "p"), ("d", "main", None, "p")]
    got = {(r["repository"], r["folder"]): (r["subtree"], r["n"]) for r in handwritten.subtree_hashes(spark.createDataFrame(rows, "repository string, username string, relative_path string, digest string")).collect()}
    assert got["a", "lib"] == got["b", "lib"] != got["c", "lib"] and got["a", "lib/x"] == got["c", "lib/x"] and got["a", "lib"][1] == 3 and ("d", "") not in got
    texts = ["\n".join(f"def {w}_{k}(x):\n    return x + {k} * {w}(x)\n" for w in "red green blue black white".split()) for k in range(3)]
    rows = [(r, "main", f"shared/m{k}.py", "python", t) for r in ("a", "b") for k, t in enumerate(texts)] + [("c", "main", "own.py", "python", BODY), ("d", "main", "own.py", "python", BODY)]
    found = handwritten.not_handwritten(spark.createDataFrame(rows, "repository string, username string, relative_path string, language string, text string")).collect()
    assert {(r["repository"], r["kind"]) for r in found} == {("a", "vendored"), ("b", "vendored")} and len(found) == 6


# --- 5 -----------------------------------------------------------------------------------------------

GOOD = [
    ("javascript", "import { log } from './x';\n// it's (fine\nconst r = /[/\"]+/g.test(a) ? `a ${b({c: '}'})}` : a / b / c;\nlet x = 1\nlet y = 2\nclass A extends B { get v() { return this.#p } static async *g() {} }\nlabel: for (const k of m) { continue label }\n"),
    ("typescript", "export const A: Record<string, number> = {};\nabstract class C<T> implements D { private readonly x?: number; constructor(public y: string) { super() } f(a?: T): a is T { return a! } }\ntype U = keyof typeof A | 'x';\ndeclare module 'm' { export default function f(x: number): void; }\n"),
    ("php", "<h1>it's (</h1>\n<?php\nnamespace A\\B;\nuse X\\Y as Z;\n$s = <<<EOT\nit's {\nEOT;\nfunction f(?int $a, string ...$r): ?array { return match(true) { $a > 1 => ['k' => \"v$a\"], default => null }; }\n// done ?>\n}} text"),
    ("php", "no tags ( at all <<<<<<< x"), ("java", 'package a.b;\nimport static x.Y.*;\n@Anno({"a", "b"})\npublic final class C<T extends D> implements E {\n  int[] v = {1, 2};\n  String s = """\n  a "quoted" {\n  """;\n  <R> R f(final int a) throws X { for (int i : v) { g(i); } return (R) null; }\n  enum K { A, B }\n}\n'),
    ("rust", "use a::{b, c};\n#[derive(Debug)]\npub struct S<'a> { x: &'a str }\nimpl<'a> S<'a> { fn f(&self) -> char { let r = r#\"a \"b\" {\"#; println!(\"{} {}\", 'x', '\\''); '{' } }\n/* a /* nested */ b */\nmacro_rules! m { ($x:expr) => { $x }; }\nconst N: u8 = b'a';\n"),
    ("python", "def f():\n    '''(('''\n    return [1, 2]\n"), ("javascript", ""), ("cobol", "((("), ("toml", "[[["), ("typescript", "/*\n=======\n*/\nlet a = `\n>>>>>>> x\n`;\n"),
]
BAD = [
    ("javascript", "function f() {\n  return 1;\n"), ("javascript", "let note = 'open\n"), ("javascript", "f(a;\n"), ("javascript", "<<<<<<< a\nx\n=======\ny\n>>>>>>> b\n"), ("javascript", "const x: number = 1;\n"), ("javascript", "function f(a: string) {}\n"), ("javascript", "import os\nfrom .a import b\n"),
    ("typescript", "<!DOCTYPE html>\n<html><p>Some words here</p></html>\n"), ("typescript", "def f(x):\n    return x\n"), ("typescript", "package a.b;\n\npublic class C {}\n"), ("typescript", "let s = `open\n"), ("typescript", "/* open\n"), ("typescript", "a(\x00)\n"), ("php", "<?php\n$a = f(1, [;\n"), ("php", "<?php\nfunction f() {\n"), ("php", "<?php\n$s = 'open;\n"),
    ("java", "import { log } from './x';\n"), ("java", "public class A { int f() { return 1 } }\n"), ("java", "def f():\n    pass\n"), ("java", 'class A { String s = "open;\n}\n'), ("rust", "package a;\n"), ("rust", "fn f() -> i64 {\n    1\n"), ("rust", "import os\n"), ("python", "def f(:\n"), ("python", "x = 'open\n"), ("python", "a\x00"),
]


GOOD += [
    ("javascript", "for (const k in m) { if (k) f(); else g(); }\nfor (let i = 0, n = 3; i < n; i++) {}\nfor (;;) { break }\nswitch (a) { case (1): return_(); case f(x): { g() } default: }\nconst {typeof: t, in: u} = a; export * from 'x'; class Q { *g() { yield* h(); } static delete = 1 }\n"),
    ("javascript", "switch (a) {\ncase (1): return {b: 1};\n}\nx = a ? (b) : c\n"), ("javascript", "function f() {\n  return\n  if (a) b()\n}\nlet y = a\n  ? b : c, z = -1 * -2 + +3;\n"),
    ("typescript", "type A = | 'x' | 'y';\ninterface B { new (): C; of?: number; a: string }\nlet f = (a?: T): void => {}; const g = <T,>(x: T) => x as const;\nswitch (a) { case 1: }\nlet c = new Map<string, Array<number>>();\n"),
    ("php", "<?php\nforeach ($a as $k => $v) { $f = new class { public function g() {} }; $x = $o::class; $y = &$z; }\nfor ($i = 0, $j = 1; $i < 3; $i++) {}\nif ($a): echo 1; else: echo 2; endif;\nfor (;;):\n break; endfor;\n"),
    ("java", "class A {\n  void f() { for (int i = 0; i < 3; i++) {} for (String s : t) {} for (;;) { return; } Class<?> c = A.class; int x = -1 * -2; List<? extends B> l = a -> { return switch (b) { case 1 -> 2; default -> 3; }; }; }\n}\n"),
    ("rust", "fn f(x: &mut u8) -> i32 { let a = *x as i32; let b = 1_000u64 + 0xFFu8 as u64; let c = &&a; let g = || 1; let h = |x: i32| -> i32 { x }; if a == *x && !b {} for i in 0..=3 {} match a { 1 => *x, _ => return 2 } }\n"),
]
BAD += [
    ("javascript", "let x = 1 +* 2;"), ("javascript", "else { x(); }"), ("javascript", "function f() {\n  return = 4;\n}\n"), ("javascript", "return = 4;"), ("javascript", "return return;"), ("java", "class A { void f() { for (int i=0; i<3) {} } }"), ("php", "<?php foreach ($a as) {}"), ("php", "<?php class { }"),
    ("typescript", "interface A { a: }"), ("rust", "fn f() { let 1x = 2; }"), ("javascript", "for (let i = 0; i < 3) {}"), ("rust", "struct { a: u8 }"), ("rust", "struct A { a: }"), ("java", "class A { int f() { return * 2; } }"), ("python", "x = " + "(" * 150 + ")" * 149),
]


@pytest.mark.parametrize(("language", "text"), GOOD)
@pytest.mark.parametrize("size", [syntax.CHUNK, 20])
def test_valid(language, text, size):
    assert syntax.is_valid(text, language, size)


@pytest.mark.parametrize(("language", "text"), BAD)
@pytest.mark.parametrize("size", [syntax.CHUNK, 20])
def test_invalid(language, text, size):
    assert not syntax.is_valid(text, language, size)


SPANNING = [
    ("php", "<?php\n$a = 1;\n$s = <<<EOT\nit's {\n;\n}\nEOT;\n$n = <<<'X'\n\"(\n;\nX;\nf();\n?>\n<p>it's;\n<?php\ng();\n"),
    ("rust", "use a;\nconst S: &str = r#\"\n\"quoted\";\n{ ' \"\n\"#;\n/* a\n/* b;\n*/\n c { ;\n*/\nfn f() {\n  g();\n}\nmacro_rules! m {\n  ($x:expr) => { $x };\n}\nfn h() {}\n"),
    ("javascript", "let a = `\n${b.map(x => `\n{ ${x} ' ;\n`)}\n( ;\n`;\nfunction f() {\n  return 1;\n}\nf();\n/x{;/.test(a);\nlet c = d\n/ e / g;\n/* ;\n{ */\n/[{]/.test(c);\nf();\n"),
    ("java", "import a.B;\nclass A {\n  String s = \"\"\"\n  x { ;\n  }\n  \"\"\";\n  int f() {\n    return 1;\n  }\n}\n"),
]


@pytest.mark.parametrize(("language", "text"), SPANNING)
def test_a_long_text_is_judged_as_a_short_one(language, text):
    lines = text.splitlines(keepends=True)
    for size in range(1, len(text)):
        assert "".join(syntax.cut_chunks(text, language, size)) == text
        assert syntax.is_valid(text, language, size)
    for i in range(len(lines)):  # also without a line
        less = "".join(lines[:i] + lines[i + 1 :])
        assert syntax.is_valid(less, language, 1) == syntax.is_valid(less, language)
    assert len(syntax.cut_chunks(text * (1 if language in ("java", "php") else 3), language, 1)) > 1


@pytest.mark.parametrize(("language", "text"), GOOD + BAD)
def test_size_changes_no_verdict(language, text):
    assert {syntax.is_valid(text, language, n) for n in range(1, len(text) + 2)} == {syntax.is_valid(text, language)}


@pytest.mark.parametrize(
    ("language", "text", "whole"),
    [
        ("javascript", "f();\nconst a =\n", False), ("typescript", "export const a: A =", False), ("javascript", "f(a) &&\n", False), ("typescript", "import", False), ("typescript", "const a = ['x'] as const", True), ("javascript", "let b = a.new", True), ("javascript", "f() // =\n", True),
        ("java", "package a;\nimport java.util", False), ("java", "package a;\n// end", True), ("rust", "fn f() {}\nuse foo::", False), ("rust", "#![no_std]\n", True), ("php", "<?php\nf();\n$a = 1", False), ("php", "<?php f() ?>\n", True), ("php", "<?php\n// none", True),
    ],
)
def test_a_text_ends_behind_a_whole_statement(language, text, whole):
    assert syntax.is_valid(text, language) == whole == syntax.is_valid(text, language, 1)


def test_combining_is_associative():
    text = "function f(a) {\n  /* x {\n  y */ return `a\n ${b}\n`;\n}\n)]\n{\n"
    lines = text.splitlines(keepends=True)
    for i in range(1, len(lines)):
        for j in range(i + 1, len(lines)):
            a, b, c = "".join(lines[:i]), "".join(lines[i:j]), "".join(lines[j:])
            sa = syntax.summarize(a, "javascript", "code")
            sb = syntax.summarize(b, "javascript", sa.end)
            sc = syntax.summarize(c, "javascript", sb.end)
            assert syntax.combine(syntax.combine(sa, sb), sc) == syntax.combine(sa, syntax.combine(sb, sc))


def test_validity(spark):
    long_ = "function f(a) {\n  return a;\n}\n" * 40
    rows = [(1, "javascript", long_, 0), (2, "javascript", long_ + "{", 0), (3, "python", "x = 1", 0), (4, None, "((", 0), (5, "java", None, 0), (6, "rust", "", 0), (7, "typescript", "/*" + long_, 0)]
    got = dict(tuple(r) for r in syntax.validity(spark.createDataFrame(rows, "id long, language string, text string, idx int"), 100).collect())
    assert got == {1: True, 2: False, 3: True, 4: True, 5: True, 6: True, 7: False}
    assert syntax.validity(spark.createDataFrame([], "id long, language string, text string")).count() == 0


def test_validity_of_toml(spark):
    """Neither depth nor digits nor length decide."""
    good = ["[a]\nx = 1\r\n[[b.c]]\n", "\ufeffa = 1", "a = " + "[" * 3000 + "]" * 3000, "a = " + "9" * 5000, "# none", "", None]
    bad = ["[[[", "a = [1, 2", 'a = "x\n', "<<<<<<< a\nx = 1\n", "a = 1 # \x00", "a = 1\na = 2\n", "a = " + "[" * 3000 + "]" * 2999, "a = " + "9" * 5000 + "\nb ="]
    rows = [(i, "toml", t) for i, t in enumerate(good + bad)]
    got = dict(tuple(r) for r in syntax.validity(spark.createDataFrame(rows, "id long, language string, text string"), 100).collect())
    assert got == {i: i < len(good) for i in range(len(rows))}


# --- 8 -----------------------------------------------------------------------------------------------


def best_fit(items, capacity):
    room = []
    for s in sorted(items, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= s]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= s
        else:
            room.append(capacity - s)
    return len(room)


def test_plan_is_whole_and_no_worse_than_best_fit():
    rng = random.Random(2)
    for _ in range(300):
        capacity = rng.choice([10, 50, 100])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 60))]
        runs, n = packing.plan(Counter(items), capacity)
        used, seen = Counter(), Counter()
        for r in runs:
            seen[r.size] += r.n
            for k in range(r.n):
                used[r.container + k // r.each] += r.size
        assert seen == Counter(items) and len(used) == n and max(used.values(), default=0) <= capacity
        assert n <= best_fit(items, capacity) + 1
        for size in set(items):
            at = 0
            for r in sorted((r for r in runs if r.size == size), key=lambda r: r.rank):
                assert r.rank == at
                at += r.n


def test_pack(spark):
    rng = random.Random(4)
    sizes = [(i, 7 if rng.random() < 0.5 else rng.randint(1, 60)) for i in range(400)] + [(1000, 131), (1001, 0), (1002, None), (1003, 50)]
    got = packing.pack(spark.createDataFrame([(a, b, "x") for a, b in sizes], "doc_id long, n_tokens long, container string"), 50).collect()
    used, parts = Counter(), Counter()
    for r in got:
        parts[r["doc_id"]] += r["n_tokens"]
        if r["container"] is None:
            assert r["n_tokens"] == 0
        else:
            used[r["container"]] += r["n_tokens"]
    assert parts == Counter({a: b or 0 for a, b in sizes}) and max(used.values()) <= 50
    whole = Counter(r["doc_id"] for r in got)
    assert all(whole[a] == max(1, -(-(b or 0) // 50)) for a, b in sizes)
    assert len(used) <= -(-sum(used.values()) // 50) + 3
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long"), 50).count() == 0


def test_token_counts(spark):
    rows = spark.createDataFrame([(1, "Hello world, hello!"), (2, None), (3, ""), (4, "é" * 1000)], "doc_id long, text string")
    got = dict(tuple(r) for r in packing.token_counts(rows).collect())
    assert got[1] == 5 and got[2] == got[3] == 0 and got[4] >= 500


# --- 9 -----------------------------------------------------------------------------------------------


def test_words_are_what_is_left_without_layout():
    assert leaks.words("A<b>c</b>_d\\n**E**&amp;ﬁx​y\n# > z <a href='q w'>k</a> 1<2 and 3>2") == "a c d e fix y z k 1 2 and 3 2".split()
    assert leaks.words(None) == [] and leaks.words("…—") == []


@pytest.mark.parametrize("block", [leaks.BLOCK, 400])
def test_leaks_match_brute_force(spark, monkeypatch, block):
    """In one pass and in several; no text of the documents may be broadcast."""
    monkeypatch.setattr(leaks, "BLOCK", block)
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 40))), "s") for i in range(12)]
    docs = []
    for i in range(60):
        ws = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        part = rng.choice(items)[1].split()
        n = rng.randint(8, 16)
        k = rng.randint(0, max(0, len(part) - n))
        at = rng.randint(0, len(ws))
        docs.append((i, rng.choice([" ", "\n> ", "_", " <i> ", "\\n"]).join(ws[:at] + part[k : k + n] + ws[at:]), "x"))
    docs += [(900, None, "x"), (901, "", "x"), (902, docs[0][1], "x"), (903, "w1", "x")]
    items += [(99, None, "s"), (98, "w1 w2", "s")]
    want = set()
    for d, t, _ in docs:
        dw = leaks.words(t)
        grams = {tuple(dw[k : k + 12]) for k in range(len(dw) - 11)}
        for i, x, _ in items:
            iw = leaks.words(x)
            if any(tuple(iw[k : k + 12]) in grams for k in range(len(iw) - 11)):
                want.add((d, i))
    got = leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string, h string"), spark.createDataFrame(items, "item_id long, text string, n string"))
    assert {tuple(r) for r in got.collect()} == want and want
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert 1 <= plan.count("BroadcastHashJoin") <= len(leaks._blocks(spark.createDataFrame(items, "item_id long, text string, n string")))
    assert leaks.leaks(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string, n string")).count() == 0


# --- 10 ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("All is said.", "complete"), ("It stops in the mid", "cut"), ("It stops [...]", "cut"), ("Code:\n```\nx = 1", "cut"), ("Code:\n```\nx = 1\n```", "complete"), ("Done.\n\nSigned-off-by: Ann", "complete"), ("Done. https://a.example/bcd", "complete"), ("Done. https://a.exam", "open"), ("List:\n\n- one\n- two", "open"), ("Done.\n\nBruno", "open"),
        ("Done.\n\nWenn", "open"), ("Done. Thanks\nOttoline", "open"), ("See https://a.example/" + "b/cde" * 300, "complete"), ("See [it](https://a.example/" + "b" * 900 + ")", "complete"), ("Write to " + "a" * 400 + "@b.example", "complete"), ("More in the next part...", "complete"), ("More in the next…", "open"), ("The pending walker must...", "cut"), ("A table.\n\n| a | 1 |", "complete"), (None, "complete"), ("", "complete"), ("Is it?\n", "complete"), ("She said \"no.\"", "complete"), ("broken \ufffd", "cut"), ("Done. Refs: #12", "complete"),
    ],
)
def test_endings(text, want):
    assert endings.ending(text) == want


def test_words_that_open_sentences_are_no_signatures(spark):
    rows = [(i, "s", f"Older rows go first. Nobody minds {i}. Bruno waits.", 0) for i in range(8)] + [(10 + i, "s", "All is done.\n\nBruno", 0) for i in range(4)]
    rows += [(20, "a", "All is done.\n\nOlde", 0), (21, "b", "All is done.\n\nNobody", 0), (22, "c", "All is done.\n\nZebedee", 0)]
    got = {r["doc_id"]: (r["is_cut"], r["route"]) for r in endings.truncated(spark.createDataFrame(rows, "doc_id long, source string, text string, word int")).collect()}
    assert {i for i, (c, _) in got.items() if c} == {20, 21} and all(got[i][1] == "word" for i in (10, 20, 21, 22))


def test_lengths():
    import html
    import json

    for t in ("", "plain", "a\r\nb\nc\t\x01\"\\\\<&'>", "é\U0001f600\u2028x\n"):
        got = dict(zip(endings.MEASURES, endings.lengths(t)))
        crlf = t.replace("\r\n", "\n").replace("\n", "\r\n")
        want = {"chars": len(t), "bytes": len(t.encode()), "utf16": len(t.encode("utf-16-le")) // 2, "json": len(json.dumps(t, ensure_ascii=False)) - 2, "json_bytes": len(json.dumps(t, ensure_ascii=False).encode()) - 2, "json_ascii": len(json.dumps(t)) - 2, "crlf": len(crlf), "crlf_bytes": len(crlf.encode()), "lf": len(t.replace("\r\n", "\n"))}
        want["entities"] = len(html.escape(t).replace("&#x27;", "&#39;"))
        want["entities_bytes"] = len(html.escape(t).replace("&#x27;", "&#39;").encode())
        assert got == want


def test_truncated(spark):
    rng = random.Random(8)
    rows = []
    for i in range(200):
        text = " ".join(rng.choice(["the plan is long", "we wait for it", "nobody knows", "“quoted” & co"]) for _ in range(40)) + "."
        n = rng.randint(40, 400)
        rows.append((i, "capped" if i % 2 else "free", text[:120] if i % 2 else text[:n] + "end.", 1))
    rows += [(900, None, None, 1), (901, None, "", 1), (902, "capped", "Fine.\n\nAnn", 1)]
    rows.append((903, "capped", ("x" * 113) + ".\n\nBruno"[:7], 1))
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, ending int")
    got = {r["doc_id"]: r for r in endings.truncated(df).collect()}
    assert all(got[i]["is_cut"] for i in range(1, 200, 2)) and not any(got[i]["is_cut"] for i in range(0, 200, 2))
    assert not got[900]["is_cut"] and not got[901]["is_cut"] and not got[902]["is_cut"] and len(got) == len(rows)
    limits = {(r["source"], r["measure"], r["at_limit"]) for r in endings.limits(endings.measured(df)).collect()}
    assert ("capped", "chars", 120) in limits and not any(s == "free" for s, _, _ in limits)
    assert endings.truncated(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0

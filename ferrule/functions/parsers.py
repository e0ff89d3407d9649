"""Parsers from source text to elements, imports, calls and sections, one text at a time."""

from __future__ import annotations

import ast
import json
import re
import tomllib
import warnings
from html.parser import HTMLParser
from typing import NamedTuple


class Element(NamedTuple):
    kind: str
    name: str
    line_start: int
    line_end: int
    parent: str
    signature: str
    docstring: str | None
    decorators: list[str]
    is_async: bool
    calls: list[str]


# --- Python: the syntax tree -------------------------------------------------------------------------


def _callee(node: ast.expr) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        base = _callee(node.value)
        return f"{base}.{node.attr}" if base else node.attr
    return None


def _calls(node: ast.AST) -> list[str]:
    out: list[str] = []
    for x in ast.walk(node):
        if isinstance(x, ast.Call) and (name := _callee(x.func)):
            out.append(name)
    return list(dict.fromkeys(out))


def python_elements(text: str) -> list[Element]:
    """Classes, functions, methods and module constants; a text that doesn't parse has none."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text.removeprefix("﻿"))
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[Element] = []
    todo: list[tuple[ast.AST, str, bool]] = [(tree, "", False)]
    while todo:
        node, parent, in_class = todo.pop()
        for x in getattr(node, "body", []):
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(x, ast.ClassDef)
                kind = "class" if is_class else "method" if in_class else "function"
                head = ", ".join(ast.unparse(b) for b in x.bases) if is_class else ast.unparse(x.args)
                back = "" if is_class or x.returns is None else f" -> {ast.unparse(x.returns)}"
                first = min([x.lineno, *[d.lineno for d in x.decorator_list]])
                out.append(Element(kind, x.name, first, x.end_lineno or x.lineno, parent, f"{x.name}({head}){back}", ast.get_docstring(x), [ast.unparse(d) for d in x.decorator_list], isinstance(x, ast.AsyncFunctionDef), [] if is_class else _calls(x)))
                todo.append((x, f"{parent}.{x.name}".lstrip("."), is_class))
            elif isinstance(x, (ast.Assign, ast.AnnAssign)) and node is tree:
                for t in x.targets if isinstance(x, ast.Assign) else [x.target]:
                    if isinstance(t, ast.Name):
                        out.append(Element("constant" if t.id.isupper() else "variable", t.id, x.lineno, x.end_lineno or x.lineno, "", t.id, None, [], False, []))
    return sorted(out, key=lambda e: (e.line_start, e.name))


def python_imports(text: str) -> list[tuple[str, str, str, int]]:
    """``module, name, alias, line`` of each imported name."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text.removeprefix("﻿"))
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    for x in ast.walk(tree):
        if isinstance(x, ast.Import):
            out += [(a.name, "", a.asname or a.name, x.lineno) for a in x.names]
        elif isinstance(x, ast.ImportFrom):
            out += [("." * x.level + (x.module or ""), a.name, a.asname or a.name, x.lineno) for a in x.names]
    return sorted(out, key=lambda r: (r[3], r[1]))


#: One import of a name each: module, name, alias.
_SCRIPT_IMPORT = re.compile(r"^[ \t]*(?:import|export)\s+(?:type\s+)?([^'\";]*?)\s*(?:from\s*)?['\"]([^'\"\n]+)['\"]", re.M)
_REQUIRE = re.compile(r"(?:const|let|var)\s+(\{[^}]*\}|[\w$]+)\s*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)")
_DOTTED_IMPORT = {
    "java": re.compile(r"^[ \t]*import\s+(?:static\s+)?([\w.]+?)\.(\w+|\*)\s*()?;", re.M), "php": re.compile(r"^[ \t]*use\s+(?:function\s+|const\s+)?\\?([\w\\]+?)\\(\w+)(?:\s+as\s+(\w+))?\s*;", re.M),
    "rust": re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+([\w:]+?)::(\w+|\*|\{[^;]*\})(?:\s+as\s+(\w+))?\s*;", re.M),
}


def _named(listed: str) -> list[tuple[str, str]]:
    """Name and alias of ``{a, b as c}``."""
    out = []
    for part in listed.strip("{} \n\t").split(","):
        m = re.match(r"\s*(?:type\s+)?([\w$*]+)(?:\s*(?:\bas\b|:)\s*([\w$]+))?\s*$", part)
        if m:
            out.append((m[1], m[2] or m[1]))
    return out


def imports(text: str | None, language: str | None) -> list[tuple[str, str, str, int]]:
    """``module, name, alias, line`` of each imported name; whole modules have no name. Null texts and other languages have none."""
    if not text:
        return []
    if language == "python":
        return python_imports(text)
    blank = _SKIP_COMMENTS.sub(lambda m: m[0] if m[0][0] not in "/" else re.sub(r"[^\n]", " ", m[0]), text)
    line = lambda at: blank.count("\n", 0, at) + 1
    out: list[tuple[str, str, str, int]] = []
    if language in ("javascript", "typescript"):
        for m in _SCRIPT_IMPORT.finditer(blank):
            head, module, at = m[1].strip(), m[2], line(m.start() + len(m[0]) - len(m[0].lstrip()))
            braces = re.search(r"\{[^}]*\}", head)
            rest = (head[: braces.start()] + head[braces.end() :] if braces else head).strip(" ,")
            star = re.match(r"\*(?:\s+as\s+([\w$]+))?", rest)
            if star:
                out.append((module, "*", star[1] or "*", at))
            elif rest:
                out.append((module, "default", rest.split(",")[0].strip(), at))
            out += [(module, n, a, at) for n, a in (_named(braces[0]) if braces else [])]
            if not head:
                out.append((module, "", "", at))
        for m in _REQUIRE.finditer(blank):
            names = _named(m[1]) if m[1].startswith("{") else [("", m[1])]
            out += [(m[2], n, a, line(m.start())) for n, a in names]
    elif language in _DOTTED_IMPORT:
        for m in _DOTTED_IMPORT[language].finditer(blank):
            names = _named(m[2]) if m[2].startswith("{") else [(m[2], m[3] or m[2])]
            out += [(m[1], n, a, line(m.start() + len(m[0]) - len(m[0].lstrip()))) for n, a in names]
    return sorted(out, key=lambda r: (r[3], r[1]))


# --- languages with braces: headers by pattern, ends by matching brackets ------------------------------

_MOD = r"(?:(?:public|private|protected|static|final|abstract|async|export|default|override|readonly|synchronized|pub(?:\([^)]*\))?|unsafe|const|extern)\s+)*"
HEADERS = {
    "javascript": rf"(?P<c>{_MOD}(?:class|interface|enum|namespace)\s+(?P<cn>[\w$]+))|(?P<f>{_MOD}function\s*\*?\s*(?P<fn>[\w$]+)\s*(?:<[^>(]*>)?\()|(?P<m>^[ \t]+{_MOD}(?:get\s+|set\s+)?(?P<mn>#?[\w$]+)\s*\([^;{{}}]*\)\s*(?::[^{{;=]+)?\{{)",
    "php": rf"(?P<c>{_MOD}(?:class|interface|trait|enum)\s+(?P<cn>\w+))|(?P<f>{_MOD}function\s+&?(?P<fn>\w+)\s*\()",
    "java": rf"(?P<c>{_MOD}(?:class|interface|enum|record)\s+(?P<cn>\w+))|(?P<f>^[ \t]+{_MOD}(?:<[^>]*>\s*)?[\w.$]+(?:<[^(;]*>)?(?:\[\])*\s+(?P<fn>\w+)\s*\([^;{{}}]*\)[^;{{}}]*\{{)",
    "rust": rf"(?P<c>{_MOD}(?:struct|enum|trait|mod|impl)\s+(?P<cn>\w+))|(?P<f>{_MOD}fn\s+(?P<fn>\w+))",
    "bash": r"(?P<f>^\s*(?:function\s+)?(?P<fn>[\w-]+)\s*\(\s*\)\s*\{)",
}
HEADERS["typescript"] = HEADERS["javascript"]
_NOT_METHODS = {"if", "for", "while", "switch", "catch", "function", "return", "new", "else", "do", "try", "match", "foreach"}
_SKIP = re.compile(r"/\*[\s\S]*?\*/|//[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`")
_SKIP_COMMENTS = _SKIP
_COMPILED = {k: re.compile(v, re.M) for k, v in HEADERS.items()}
_CALL = re.compile(r"(?<![\w.$])(?:\$this->|self\.|this\.)?([A-Za-z_$][\w$.]*(?:(?:::|->|\.)\w+)*)\s*\(")


def brace_elements(text: str, language: str) -> list[Element]:
    """Classes, functions and methods; comments and strings are blanked out before the search."""
    if language not in _COMPILED:
        return []
    blank = _SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    ends: dict[int, int] = {}
    stack: list[int] = []
    for m in re.finditer(r"[{}]", blank):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            ends[stack.pop()] = m.start()
    out, open_ = [], []
    for m in _COMPILED[language].finditer(blank):
        g = m.groupdict()
        name = g.get("cn") or g.get("fn") or g.get("mn")
        if name in _NOT_METHODS:
            continue
        brace = blank.find("{", m.start() if not m[0].endswith("{") else m.end() - 1)
        semi = blank.find(";", m.end())
        end = ends.get(brace, m.end()) if brace >= 0 and not (0 <= semi < brace and not g.get("m")) else m.end()
        at = m.start() + len(m[0]) - len(m[0].lstrip())
        while open_ and open_[-1][1] < at:
            open_.pop()
        is_class = bool(g.get("cn"))
        kind = "class" if is_class else "method" if (open_ and open_[-1][2]) or g.get("mn") else "function"
        line = text.count("\n", 0, at) + 1
        body = blank[m.end() : end]
        calls = [] if is_class else [c for c in dict.fromkeys(_CALL.findall(body)) if c.split(".")[0] not in _NOT_METHODS]
        head = text[at : brace if brace > at else m.end()].strip()
        out.append(Element(kind, name, line, text.count("\n", 0, end) + 1, ".".join(o[0] for o in open_), re.sub(r"\s+", " ", head), None, [], bool(re.search(r"\basync\b", m[0])), calls))
        open_.append((name, end, is_class))
    return out


# --- documents and configuration -----------------------------------------------------------------------


def markdown_sections(text: str) -> list[tuple[int, str, int, int]]:
    """``level, title, first line, last line``; a section ends before the next heading of its level or above."""
    lines = text.split("\n")
    heads, fence = [], False
    for i, x in enumerate(lines, 1):
        if x.lstrip().startswith(("```", "~~~")):
            fence = not fence
        m = None if fence else re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", x)
        if m:
            heads.append((len(m[1]), m[2], i))
    last = len(lines)
    return [(lv, t, a, next((b - 1 for lw, _, b in heads[k + 1 :] if lw <= lv), last)) for k, (lv, t, a) in enumerate(heads)]


class _Html(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.classes: dict[str, None] = {}
        self.ids: dict[str, None] = {}

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        for c in (a.get("class") or "").split():
            self.classes[c] = None
        if a.get("id"):
            self.ids[a["id"]] = None
        if tag in ("script", "style"):
            self.skip += 1
        elif re.fullmatch(r"h[1-6]", tag):
            self.out.append("\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag in ("p", "div", "br", "tr", "section", "form", "ul", "ol", "table"):
            self.out.append("\n")
        elif tag == "a" and a.get("href"):
            self.out.append(f"[{a['href']}] ")
        elif tag == "img":
            self.out.append(f"![{a.get('alt') or ''}]")

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.skip:
            self.skip -= 1

    def handle_data(self, data):
        if not self.skip:
            self.out.append(re.sub(r"\s+", " ", data))


def html_outline(text: str) -> tuple[str, list[str], list[str]]:
    """The text as markdown, and the classes and ids in order."""
    p = _Html()
    p.feed(text)
    p.close()
    body = re.sub(r"[ \t]*\n\s*", "\n", "".join(p.out)).strip()
    return body, list(p.classes), list(p.ids)


TEMPLATES = [r"\{#[\s\S]*?#\}", r"\{%-?[\s\S]*?-?%\}", r"\{\{[\s\S]*?\}\}", r"<%[\s\S]*?%>", r"\{!![\s\S]*?!!\}", r"^\s*@\w+(?:\([^)]*\))?", r"<\?(?:php|=)[\s\S]*?\?>"]


def template_text(text: str) -> str:
    """HTML without the tags of template languages."""
    for t in TEMPLATES:
        text = re.sub(t, " ", text, flags=re.M)
    return text


def component_parts(text: str) -> dict[str, str]:
    """Script, style and markup of a single-file component; several of a kind are joined."""
    out = {}
    for tag in ("script", "style", "template"):
        found = re.findall(rf"<{tag}\b[^>]*>([\s\S]*?)</{tag}>", text)
        if found:
            out[tag] = "\n".join(found)
    if "template" not in out:
        out["template"] = re.sub(r"<(script|style)\b[\s\S]*?</\1>", "", text).strip()
    return out


def css_rules(text: str) -> list[tuple[str, str, int]]:
    """``selector, properties, line`` of the rules; at-rules are entered."""
    blank = re.sub(r"/\*[\s\S]*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    out = []
    for m in re.finditer(r"([^{}@;]+)\{([^{}]*)\}", blank):
        names = [p.split(":")[0].strip() for p in m[2].split(";") if ":" in p]
        at = m.start() + len(m[1]) - len(m[1].lstrip())
        out.append((re.sub(r"\s+", " ", m[1].strip()), ", ".join(names), blank.count("\n", 0, at) + 1))
    return out


def mapping_keys(text: str, language: str) -> list[tuple[str, int]]:
    """Dotted keys with their line, of YAML (by indentation), JSON or TOML."""
    if language == "toml":
        try:
            tomllib.loads(text)
        except tomllib.TOMLDecodeError:
            return []
        return [(m[1].strip(), text.count("\n", 0, m.start(1)) + 1) for m in re.finditer(r"^\s*\[+([^\]\n]+)\]+", text, re.M)]
    if language == "json":
        try:
            data = json.loads(text)
        except ValueError:
            return []
        return [(k, 1) for k in data] if isinstance(data, dict) else []
    out, path = [], []
    for i, x in enumerate(text.split("\n"), 1):
        m = re.match(r"(\s*)(?:- )?([\w.$-]+|\"[^\"]+\"|'[^']+'):(?:\s|$)", x)
        if m and not x.lstrip().startswith("#"):
            depth = len(m[1])
            path = [p for p in path if p[0] < depth] + [(depth, m[2].strip("\"'"))]
            out.append((".".join(p[1] for p in path), i))
    return out


def dockerfile_instructions(text: str) -> list[tuple[str, int]]:
    """Instructions by their first line, cut at 77 characters."""
    out, open_ = [], False
    for i, x in enumerate(text.split("\n"), 1):
        s = x.strip()
        if s and not s.startswith("#") and not open_:
            out.append((s if len(s) <= 77 else s[:77] + "...", i))
        open_ = s.endswith("\\")
    return out


def elements(text: str | None, language: str | None) -> list[Element]:
    """Elements of a text in a known language; null texts and unknown languages have none."""
    if not text:
        return []
    if language == "python":
        return python_elements(text)
    if language in ("vue", "svelte"):
        return brace_elements(component_parts(text).get("script", ""), "typescript")
    return brace_elements(text, language or "")

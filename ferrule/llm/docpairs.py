"""Functions paired with their documentation (problem 3).

A small packrat parser runs parsing-expression grammars over source text: every rule is tried at most
once at an offset, and what it matched is kept with its offsets. The terminals are whole comments,
strings and header lines, and the grammar is tried only at offsets where a documentation comment or a
function header begins, so that the cost is linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- parsing expressions: each takes (parser, offset) and returns (end, value) or None -------------


class Parser:
    """Packrat state of one text."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.memo: dict[tuple[int, int], tuple[int, object] | None] = {}


Expr = Callable[[Parser, int], "tuple[int, object] | None"]


def rule(e: Expr) -> Expr:
    """Memoises an expression by offset."""
    key = id(e)

    def f(p: Parser, i: int):
        k = (key, i)
        if k not in p.memo:
            p.memo[k] = e(p, i)
        return p.memo[k]

    return f


def term(pattern: str, flags: int = 0) -> Expr:
    match = re.compile(pattern, flags).match

    def f(p: Parser, i: int):
        m = match(p.text, i)
        return (m.end(), m) if m else None

    return f


def seq(*es: Expr) -> Expr:
    def f(p: Parser, i: int):
        out = []
        for e in es:
            r = e(p, i)
            if r is None:
                return None
            i = r[0]
            out.append(r[1])
        return i, out

    return f


def first(*es: Expr) -> Expr:
    def f(p: Parser, i: int):
        for e in es:
            r = e(p, i)
            if r is not None:
                return r
        return None

    return f


def many(e: Expr) -> Expr:
    def f(p: Parser, i: int):
        out = []
        while (r := e(p, i)) is not None and r[0] > i:
            i = r[0]
            out.append(r[1])
        return i, out

    return f


def action(e: Expr, f: Callable) -> Expr:
    def g(p: Parser, i: int):
        r = e(p, i)
        return (r[0], f(p, i, r[0], r[1])) if r is not None else None

    return g


# --- grammars --------------------------------------------------------------------------------------

_BLANK = term(r"[ \t]*\r?\n|[ \t]+")
_NO_GAP = term(r"[ \t]*\r?\n(?![ \t]*\r?\n)|[ \t]+")  # a blank line parts a comment from what is below it
_BALANCED = r"\((?:[^()\"']|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))*\)"
_ATTRIBUTE = {
    "java": term(rf"@[\w.]+(?:[ \t]*{_BALANCED})?"),
    "php": term(r"\#\[(?:[^\[\]]|\[[^\[\]]*\])*\]"),
    "rust": term(r"\#!?\[(?:[^\[\]]|\[[^\[\]]*\])*\]"),
}
_ATTRIBUTE["javascript"] = _ATTRIBUTE["typescript"] = term(rf"@[\w.]+(?:{_BALANCED})?")
_BLOCK_DOC = term(r"/\*\*(?!/)[\s\S]*?\*/")
_LINE_DOC = term(r"///(?!/)[^\n]*")
_LINE_DOCS = seq(_LINE_DOC, many(seq(term(r"\r?\n[ \t]*"), _LINE_DOC)))
_MODIFIERS = r"(?:(?:public|private|protected|internal|static|final|abstract|async|export|default|override|readonly|synchronized|native|const|unsafe|extern(?:[ \t]+\"[^\"]*\")?|pub(?:\([^)]*\))?)[ \t]+)*"
_HEADER = {
    "javascript": term(rf"{_MODIFIERS}(?:function\b[ \t]*\*?[ \t]*(?P<n>[\w$]+)|(?:const|let|var)[ \t]+(?P<v>[\w$]+)[^\n=]*=|(?:get[ \t]+|set[ \t]+|\*[ \t]*)?(?P<m>#?[\w$]+)[ \t]*(?:<[^\n(]*>)?\()"),
    "php": term(rf"{_MODIFIERS}function\b[ \t]*&?[ \t]*(?P<n>\w+)"),
    "java": term(rf"{_MODIFIERS}(?:<[^\n(]*>[ \t]*)?(?:[\w.$]+(?:<[^\n(]*>)?(?:\[\])*[ \t]+)?(?P<n>[\w$]+)[ \t]*\("),
    "rust": term(rf"{_MODIFIERS}fn[ \t]+(?P<n>(?:r\#)?\w+)"),
}
_HEADER["typescript"] = _HEADER["javascript"]


def _name(p: Parser, i: int, j: int, m: re.Match) -> tuple[str, int]:
    return next(g for g in m.groups() if g is not None), i


def _docs(p: Parser, i: int, j: int, v: object) -> str:
    return p.text[i:j]


def _pair_rule(language: str) -> Expr:
    """pair <- documentation (blank / attribute)* header"""
    doc = rule(action(first(_BLOCK_DOC, _LINE_DOCS), _docs))
    header = rule(action(_HEADER[language], _name))
    between = many(first(_NO_GAP, rule(_ATTRIBUTE[language])))
    return rule(action(seq(doc, between, header), lambda p, i, j, v: (v[2][0], v[2][1], v[0], v[1])))


_PAIR = {g: _pair_rule(g) for g in _HEADER}
#: What a scan passes over; a string can't hide a comment, nor a comment a string.
_SCAN = {
    g: re.compile(r"(?P<doc>/\*\*(?!/)|///(?!/))|/\*[\s\S]*?\*/|//[^\n]*|\"(?:[^\"\\\n]|\\[\s\S])*\"" + ("" if g == "rust" else r"|'(?:[^'\\\n]|\\[\s\S])*'") + (r"|`(?:[^`\\]|\\[\s\S])*`" if g in ("javascript", "typescript") else ""))
    for g in _HEADER
}


def pairs_above(text: str, language: str) -> list[tuple[str, int, int, str]]:
    """``name, first line, header line, comment`` of the functions that a documentation comment stands above.

    The first line is that of the first attribute, or else of the header; lines count from 1.
    """
    if language not in _PAIR:
        return []
    p, out, i = Parser(text), [], 0
    scan, pair = _SCAN[language], _PAIR[language]
    line, upto = 1, 0
    while m := scan.search(text, i):
        if m.lastgroup != "doc":
            i = m.end()
            continue
        r = pair(p, m.start())
        if r is None:
            if text.startswith("/**", m.start()):
                end = text.find("*/", m.start() + 3)
                i = end + 2 if end >= 0 else len(text)
            else:
                end = _LINE_DOCS(p, m.start())
                i = max(end[0] if end else 0, m.end())
            continue
        name, header_at, doc, _ = r[1]
        after = m.start() + len(doc)
        begin = after + len(text[after:header_at]) - len(text[after:header_at].lstrip())
        line, upto = line + text.count("\n", upto, begin), begin
        out.append((name, line, line + text.count("\n", begin, header_at), doc))
        i = r[0]
    return out


_PY_DECORATOR = term(r"@[^\n]*(?:\n|$)")
_PY_COMMENT = term(r"\#[^\n]*")
_PY_ARGS = r"\((?:[^()\[\]{}\"'#]|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|\#[^\n]*|[\[\]{}]|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))*\)"
_PY_HEADER = term(rf"(?:async[ \t]+)?def[ \t]+(?P<n>\w+)[ \t]*(?:\[[^\]]*\])?[ \t]*{_PY_ARGS}[ \t]*(?:->[^\n]*?)?:(?=[ \t]*(?:\#|\r?\n|\"|'|[rRuU]+[\"']))")
_PY_STRING = term(r"[rRuU]{0,2}(?:\"\"\"(?P<a>(?:[^\\]|\\[\s\S])*?)\"\"\"|'''(?P<b>(?:[^\\]|\\[\s\S])*?)'''|\"(?P<c>(?:[^\"\\\n]|\\[\s\S])*)\"|'(?P<d>(?:[^'\\\n]|\\[\s\S])*)')(?=[ \t]*(?:\r?\n|$|;|\#))")
_PY_FUNCTION = rule(
    action(
        seq(many(first(_BLANK, _PY_COMMENT, rule(_PY_DECORATOR))), rule(_PY_HEADER), many(first(_BLANK, _PY_COMMENT)), rule(_PY_STRING)),
        lambda p, i, j, v: next(g for g in v[3].groups() if g is not None),
    )
)


def python_docstring(code: str) -> str | None:
    """The string literal that opens the body of the function at the begin of ``code``."""
    r = _PY_FUNCTION(Parser(code), 0)
    return r[1] if r else None


# --- whether a description says something ------------------------------------------------------------

ARTICLES = {"a", "an", "the", "der", "die", "das", "den", "dem", "des", "ein", "eine", "einen", "einem", "einer", "le", "la", "les", "l", "un", "une", "des", "el", "los", "las", "una", "lo"}
_SIGNS = re.compile(r"^[ \t]*(?:/\*\*?|\*/|\*(?!/)|///?!?|//!)?[ \t]?", re.M)
_FIELD = re.compile(r"[ \t]*(?:[@\\](?:param|arg|argument|return|returns|throws|exception|raises|type|rtype|see|since|author|template|var|deprecated|yields?)\b|:(?:param|parameter|arg|argument|key|keyword|type|returns?|rtype|raises?|except|exception|yields?|ytype|var|ivar|cvar)\b[^:\n]*:|@\w+)", re.I)
_SECTION = re.compile(r"[ \t]*(?:#+[ \t]*)?(?:args|arguments|parameters|params|parameter|other parameters|returns?|return value|yields?|raises|throws|exceptions|errors|panics|safety|attributes|keyword args|keyword arguments|argumente|rückgabe|paramètres|retour|parámetros|devuelve)[ \t]*:?[ \t]*$", re.I)
_INLINE_SECTION = re.compile(r"[ \t]*(?:args|arguments|parameters|params|returns?|yields?|raises|throws):[ \t]+\S", re.I)
_WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
_NAME_PART = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+|[^\W\dA-Za-z_]+")
#: Fixed patterns of texts that merely stand in for a description.
_STAND_IN = re.compile(
    r"""^\W*(?:
      (?:todo|fixme|xxx|tbd|tba|wip|hack|placeholder|n/?a|none|dummy)\b
    | (?:please\s+)?(?:add|insert|write|put|enter|provide|fill\s+in|type|give)\s+(?:(?:a|an|the|your|some|proper|real|short|brief|better|missing|meaningful|useful|function|method)\s+)*(?:description|documentation|docs?|docstring|doc\s+comment|summary|text|comment)s?\b
    | (?:no|without|missing|lacks?|needs?)\s+(?:(?:a|an|any|proper|further|some|more|the|real)\s+)*(?:description|documentation|docs?|docstring|summary|comment)s?\b
    | (?:description|documentation|docs?|docstring|summary|comment)s?\s+(?:(?:of|for)\s+(?:this|the)\s+\w+\s+)?(?:(?:is|are|was|to\s+be|will\s+be|goes|comes?|still|not|yet|left|has|have|been)\s+)*(?:written|added|provided|here|missing|pending|follows?|later|available|done|completed|supplied|filled|tbd|todo|needed|empty|blank)\b
    | (?:this|the)\s+(?:function|method|description|documentation|docstring|comment)\s+(?:(?:is|has|was|still|not|yet|to\s+be|needs?|a|no|to|be)\s+)*(?:undocumented|documented|documentation|description|described|written)\b
    | (?:this\s+is\s+an?\s+|an?\s+)?(?:auto(?:matically)?[\s\-]*generated|generated)\s+(?:(?:method|function|class|constructor|catch|code|doc|docs|documentation|docstring|description)\s*)*(?:stub|block|comment|docstring|documentation|description|body)\b
    | (?:to\s+be\s+(?:documented|described|written|done|completed|determined|added))\b
    | (?:undocumented|not\s+(?:yet\s+)?(?:documented|described|written))\b
    | (?:lorem\s+ipsum)\b
    | (?:beschreibung|dokumentation)\s+(?:folgt|fehlt|ergänzen|hier)\b | (?:keine|hier)\s+(?:beschreibung|dokumentation)\b
    | (?:description|documentation)\s+(?:à|manquante|a\s+venir)\b | (?:aucune|pas\s+de)\s+(?:description|documentation)\b
    | (?:descripción|documentación)\s+(?:pendiente|por)\b | (?:sin|falta)\s+(?:la\s+)?(?:descripción|documentación)\b
    )""",
    re.I | re.X,
)


def prose(doc: str) -> str:
    """The description without comment signs and without what is said on parameters and results."""
    text = doc.strip()
    if text.startswith("/*"):
        text = re.sub(r"\*+/\s*$", "", text)
    out, section = [], None
    for line in text.replace("\r\n", "\n").split("\n"):
        body = _SIGNS.sub("", line, count=1).rstrip()
        if section is not None:
            blank = not body.strip()
            depth = len(body) - len(body.lstrip())
            if blank:
                section = (section[0], True)
                continue
            item = re.match(r"\s*(?:[*\-+]|`?[\w$.*]+`?(?:\s*\([^)]*\))?\s*(?::|--|–| - ))", body) is not None
            if section[1] and depth <= section[0] and not item:
                section = None
            elif re.match(r"[ \t]*[-=~]{3,}$", body) or depth > section[0] or item or not section[1]:
                continue
            else:
                section = None
        if _FIELD.match(body):
            section = (10_000, False)
            continue
        if _SECTION.match(body):
            section = (len(body) - len(body.lstrip()), False)
            continue
        if _INLINE_SECTION.match(body):
            continue
        out.append(body)
    return "\n".join(out).strip()


def name_words(name: str) -> set[str]:
    return {w.lower() for w in _NAME_PART.findall(name or "")}


def worthwhile(doc: str | None, name: str | None) -> bool:
    """Whether a documentation says something: four words, more than the name, not a stand-in."""
    if not doc or not doc.strip():
        return False
    text = prose(doc)
    words = [w.lower() for w in _WORD.findall(text) if any(c.isalpha() for c in w)]
    if len(words) < 4 or _STAND_IN.match(text):
        return False
    own = name_words(name or "")
    rest = [w for w in words if w not in ARTICLES]
    return not all(part in own for w in rest for part in re.split(r"['’\-]", w))


# --- Spark -------------------------------------------------------------------------------------------


def _file_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, lines, names, docs = [], [], [], []
        for k, g, t in zip(*(b.column(i).to_pylist() for i in range(3))):
            for name, line, header, doc in pairs_above(t, g):
                for at in {line, header}:
                    keys.append(k)
                    lines.append(at)
                    names.append(name)
                    docs.append(doc)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(lines, pa.int32()), pa.array(names, pa.string()), pa.array(docs, pa.string())], names=["file_key", "line_start", "found_name", "comment"])


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
        out: dict[str, list] = {"element_id": [], "language": [], "name": [], "signature": [], "code": [], "description": []}
        for e, g, n, s, d, c, above in zip(*(cols[k] for k in ("element_id", "language", "name", "signature", "docstring", "raw_code", "comment"))):
            doc = d if d and d.strip() else python_docstring(c) if g == "python" and c else above
            if worthwhile(doc, n):
                for k, v in zip(out, (e, g, n, s, c, prose(doc))):
                    out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.string()) for v in out.values()], names=list(out))


def documented_functions(functions: DataFrame, files: DataFrame) -> DataFrame:
    """Pairs of code and description, one for each function with worthwhile documentation.

    ``functions``: ``element_id, file_key, language, name, signature, docstring, raw_code, line_start``;
    ``files``: ``file_key, language, text``, one row for each key. The documentation is the docstring,
    or else the string that opens a Python body, or else the ``/** */`` or ``///`` comment above the
    function in its file. Each file is parsed once where it lies and only its pairs travel, to the
    functions that lack a docstring, by file and line; so a file with a third of all functions is no
    group. Null names, codes and lines are allowed and match nothing; empty tables give no rows.
    """
    functions = functions.select("element_id", "file_key", "language", "name", "signature", "docstring", "raw_code", "line_start")
    lacks = (F.col("docstring").isNull() | F.trim(F.regexp_replace("docstring", r"\s", " ")).eqNullSafe("")) & (F.col("language") != "python")
    lacks = F.coalesce(lacks, F.lit(False))
    comments = (
        files.where(F.col("language").isin(*_PAIR) & (F.contains("text", F.lit("/**")) | F.contains("text", F.lit("///"))))
        .select("file_key", "language", "text")
        .mapInArrow(_file_pairs, "file_key string, line_start int, found_name string, comment string")
        .dropDuplicates(["file_key", "line_start", "found_name"])
    )
    above = functions.where(lacks).join(comments.withColumnRenamed("found_name", "name"), ["file_key", "line_start", "name"], "left")
    cols = ["element_id", "language", "name", "signature", "docstring", "raw_code", "comment"]
    whole = above.select(*cols).unionByName(functions.where(~lacks).withColumn("comment", F.lit(None).cast("string")).select(*cols))
    return whole.mapInArrow(_judge, "element_id string, language string, name string, signature string, code string, description string")

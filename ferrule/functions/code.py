"""Column functions on code, documentation, paths and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Comments and texts by language, which rules on code must not see. They are tried in this order.
_DOUBLE, _SINGLE, _TICK = r'"(?:[^"\\\n]|\\.)*"', r"'(?:[^'\\\n]|\\.)*'", r"`(?:[^`\\]|\\.)*`"
_SLASHES = r"//[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/"
HIDDEN = {
    "python": r'"""(?:[^"\\]|\\.|"[^"]|""[^"])*"""|' + r"'''(?:[^'\\]|\\.|'[^']|''[^'])*'''|" + rf"{_DOUBLE}|{_SINGLE}|#[^\n]*",
    "javascript": rf"{_SLASHES}|{_DOUBLE}|{_SINGLE}|{_TICK}",
    "php": rf"{_SLASHES}|#[^\n]*|{_DOUBLE}|{_SINGLE}",
    "java": rf"{_SLASHES}|{_DOUBLE}|{_SINGLE}",
    "rust": rf"{_SLASHES}|{_DOUBLE}|'(?:[^'\\\n]|\\.)'",
}
HIDDEN["typescript"] = HIDDEN["javascript"]
#: What adds a path through a function, by language.
_COMMON = r"\b(?:if|for|while|case|catch)\b|&&|\|\|"
BRANCHES = {
    "python": r"\b(?:if|elif|for|while|except|case|and|or)\b", "javascript": _COMMON + r"|\?\?", "php": r"\b(?:if|elseif|for|foreach|while|case|catch|and|or|xor)\b|&&|\|\||\?\?", "java": _COMMON, "rust": r"\b(?:if|for|while|loop)\b|=>|&&|\|\|",
}
BRANCHES["typescript"] = BRANCHES["javascript"]
COMMENT_START = {"python": "#", "javascript": "//", "typescript": "//", "java": "//", "rust": "//", "php": "(?://|#)", "toml": "#"}


def by_language(language: Column, make, otherwise: Column, table: dict[str, str]) -> Column:
    out = otherwise
    for k, v in table.items():
        out = F.when(language == k, make(v)).otherwise(out)
    return out


def bare_code(code: Column, language: Column) -> Column:
    """Code without comments and texts; of other languages as it is."""
    return by_language(language, lambda p: F.regexp_replace(code, "(?s)" + p, " "), code, HIDDEN)


def complexity(code: Column, language: Column) -> Column:
    """1 and one more for each branch and boolean operator outside comments and texts; null code has 1."""
    bare = bare_code(code, language)
    return F.lit(1) + F.coalesce(by_language(language, lambda p: F.regexp_count(bare, F.lit(p)), F.lit(0), BRANCHES), F.lit(0))


def bare_sql(code: str = "raw_code", language: str = "language") -> str:
    cases = " ".join(f"WHEN '{k}' THEN regexp_replace({code}, '(?s){p.replace(chr(39), chr(39) * 2)}', ' ', 'g')" for k, p in HIDDEN.items())
    return f"CASE {language} {cases} ELSE {code} END"


def complexity_sql() -> str:
    cases = " ".join(f"WHEN '{k}' THEN len(regexp_extract_all({bare_sql()}, '{p}'))" for k, p in BRANCHES.items())
    return f"1 + coalesce(CASE language {cases} ELSE 0 END, 0)"


def is_test_element(name: Column, decorators: Column, language: Column) -> Column:
    """By name and decorators; scripts and PHP are told by path only."""
    has = lambda p: F.coalesce(F.exists(decorators, lambda x: x.rlike(p)), F.lit(False))
    return F.coalesce(
        F.when(language == "python", name.startswith("test_") | has("^(pytest|unittest)")).when(language == "rust", has(r"^(test|cfg\(test\))$"))
        .when(language == "java", has("^@(Test|ParameterizedTest|RepeatedTest)$") | name.startswith("test") | name.startswith("should")),
        F.lit(False),
    )


SECTIONS = r"^\s*(Args|Arguments|Parameters|Returns?|Yields|Raises|Throws|Examples?|Notes?|Attributes)\s*:|^\s*[:@](param|type|returns?|rtype|raises?|throws)\b|^\s*#+\s*(Arguments|Returns|Examples|Panics|Errors)"


def description(docstring: Column) -> Column:
    """The lines before the first section, without blank ones, joined by blanks."""
    lines = F.split(docstring, "\r?\n")
    head = F.array_position(F.transform(lines, lambda x: x.rlike(SECTIONS)), True)
    kept = F.when(head > 0, F.slice(lines, 1, head.cast("int") - 1)).otherwise(lines)
    return F.array_join(F.filter(F.transform(kept, lambda x: F.trim(F.regexp_replace(x, r"\s", " "))), lambda x: x != ""), " ")


def fitted(text: Column, max_tokens: int, chars_per_token: int = 2) -> Column:
    """The text, or its first lines that fit three quarters of the budget and a mark that it was cut."""
    budget = int(max_tokens * 0.75)
    size = lambda x: F.floor(F.length(x) / chars_per_token)
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("lines"))

    def step(s: Column, x: Column) -> Column:
        fits = ~s["full"] & (s["used"] + size(x) <= budget)
        return F.struct(F.when(fits, s["used"] + size(x)).otherwise(s["used"]).alias("used"), (~fits).alias("full"), F.when(fits, F.array_append(s["lines"], x)).otherwise(s["lines"]).alias("lines"))

    cut = F.aggregate(F.split(text, "\n"), start, step)
    return F.when(size(text) <= budget, text).otherwise(F.array_join(F.array_append(cut["lines"], F.lit("... (context truncated)")), "\n"))


def clean_label(raw: Column) -> Column:
    """Lower-cased, without quotes and lead-ins, blanks as underscores, letters, digits and underscores only, 50 at most."""
    t = F.regexp_replace(F.lower(F.trim(raw)), "^[\"']+|[\"']+$", "")
    for lead in ("label:", "the label is", "this cluster is about"):
        t = F.when(t.startswith(lead), F.trim(F.substr(t, F.lit(len(lead) + 1)))).otherwise(t)
    return F.substring(F.regexp_replace(F.regexp_replace(t, " ", "_"), r"[^\p{L}\p{N}_]", ""), 1, 50)


def normalized_path(path: Column) -> Column:
    """A path without ``.`` and, where something stands before them, ``..``."""
    def step(kept: Column, part: Column) -> Column:
        up = (F.size(kept) > 0) & (F.element_at(kept, -1) != "..")
        return F.when(part == ".", kept).when((part == "..") & up, F.slice(kept, 1, F.size(kept) - 1)).otherwise(F.array_append(kept, part))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def format_bytes(size: Column) -> Column:
    """``1.5 KB`` and its like, halves to the even digit."""
    out = F.concat(F.bround(size / 1024.0**5, 1).cast("string"), F.lit(" PB"))
    for k, unit in reversed(list(enumerate("B KB MB GB TB".split()))):
        out = F.when(size < 1024.0 ** (k + 1), F.concat(F.bround(size / 1024.0**k, 1).cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def unit_vector(v: Column) -> Column:
    """Divided by its length; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def without_thoughts(text: Column) -> Column:
    """A model's answer without ``<think>`` blocks, also one that never ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*$", ""))


def quoted_pattern(name: str) -> str:
    """A name with the signs of patterns escaped."""
    return "".join("\\" + c if c in r'\.?+*|{}[]()"~@&#<>^$-/' else c for c in name)

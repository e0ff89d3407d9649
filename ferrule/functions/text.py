"""Column functions on names, code and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Lower-cased word tokens; null text gives null."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def humanize_name(name: Column) -> Column:
    """Words of a snake-case or camel-case identifier, lower-cased and parted by blanks."""
    spaced = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "_+", " "), r"([A-Z]+)([A-Z][a-z])", "$1 $2"), r"([a-z0-9])([A-Z])", "$1 $2")
    return F.trim(F.lower(F.regexp_replace(spaced, r"\s+", " ")))


def normalize_term(name: Column) -> Column:
    """Lower-cased singular by ordered suffix rules (the order is fixed: ``databases`` gives ``databas``)."""
    t = F.lower(F.trim(name))
    n = F.length(t)

    def less(k: int) -> Column:
        return F.substr(t, F.lit(1), n - k)

    return (
        F.when(t.rlike("(us|is)$"), t).when(t.endswith("ies") & (n > 4), F.concat(less(3), F.lit("y"))).when(t.endswith("ies"), t).when(t.endswith("sses"), less(2))
        .when(t.rlike("(xes|ches|shes)$"), less(2)).when(t.endswith("ses") & (n > 4), less(2)).when(t.endswith("s") & (n > 3) & ~t.endswith("ss"), less(1)).otherwise(t)
    )


def visibility(name: Column) -> Column:
    """By leading underscores: dunder names are public."""
    return F.when(name.startswith("__") & name.endswith("__"), "public").when(name.startswith("__"), "private").when(name.startswith("_"), "protected").otherwise("public")


# Path patterns of test code by language.
TEST_PATHS = {
    "python": r"(^|/)tests?/|(^|/)test_[^/]*\.py$|_test\.py$|(^|/)conftest\.py$",
    "javascript": r"(^|/)(__tests__|tests?)/|\.(test|spec)\.[jt]sx?$",
    "typescript": r"(^|/)(__tests__|tests?)/|\.(test|spec)\.[jt]sx?$",
    "php": r"(^|/)[Tt]ests?/|Test\.php$",
    "rust": r"(^|/)tests/|_test\.rs$",
    "java": r"(^|/)src/test/|(^|/)tests?/|Tests?\.java$",
}


def is_test_path(path: Column, language: Column) -> Column:
    out = F.lit(False)
    for k, p in TEST_PATHS.items():
        out = F.when(language == k, path.rlike(p)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def code_lines(code: Column) -> Column:
    """Number of lines that aren't blank; null code has none."""
    return F.coalesce(F.size(F.filter(F.split(code, "\n"), lambda x: F.length(F.trim(F.regexp_replace(x, r"[\t\r]", " "))) > 0)), F.lit(0))


def docstring_coverage(docstring: Column, has_params: Column, has_return: Column) -> Column:
    """0 without text; else 0.5, and 0.25 each if parameters and result are told of or don't exist."""
    told = docstring.rlike(r"(?m)^\s*(Args|Arguments|Parameters)\s*:?|@param\b|:param\b|^\s*#\s*Arguments")
    told_return = docstring.rlike(r"(?m)^\s*(Returns?|Yields)\s*:?|@returns?\b|:returns?:|^\s*#\s*Returns")
    return F.when(docstring.isNull() | (F.trim(F.regexp_replace(docstring, r"\s", " ")) == ""), F.lit(0.0)).otherwise(
        F.lit(0.5) + F.when(~has_params | told, 0.25).otherwise(0.0) + F.when(~has_return | told_return, 0.25).otherwise(0.0)
    )


def element_id(*parts: Column) -> Column:
    """Parts joined by colons, null as empty."""
    return F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def content_hash(code: Column, docstring: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(code, F.lit("")), F.coalesce(docstring, F.lit(""))), 256)


#: Names that say nothing of what they hold, and names of objects that a program is built around; our own choice.
THROWAWAY = "tmp temp foo bar baz buf obj val arr ret res result data item items value values element line text key idx index output input args".split()
FRAMEWORK = "app server router api client session db database engine connection cache queue logger config settings".split()
#: A statement that gives a name the result of one call, and nothing else.
ONE_CALL = r"^\s*(?:(?:const|let|var|final|static|pub|private|public)\s+)*\$?\w+\s*(?::[^=\n]*)?=\s*(?:await\s+)?[\w.:]+\([^\n]*\)\s*;?\s*$"
_INFRA = "^(?:" + "|".join(FRAMEWORK) + ")(?:_|$)|_(?:" + "|".join(FRAMEWORK) + ")$"


def drop_reason(name: Column, code: Column) -> Column:
    """Why a variable is of no interest, empty if it is kept: the first of these rules that holds."""
    low = F.lower(name)
    constant = name.rlike("[A-Z]") & (name == F.upper(name)) & (F.length(name) > 1)
    short_call = (F.length(name) <= 4) & (name == low) & F.coalesce(code.rlike(ONE_CALL), F.lit(False))
    return (
        F.when(name.isNull(), "no_name").when(constant | name.rlike("^__.*__$") | low.rlike(_INFRA), "").when(F.length(name) == 1, "single_letter").when(low.isin(*THROWAWAY), "throwaway_name").when(short_call, "short_call_result").otherwise("")
    )


def drop_reason_sql() -> str:
    return (
        f"CASE WHEN name IS NULL THEN 'no_name' WHEN regexp_matches(name, '[A-Z]') AND name = upper(name) AND length(name) > 1 OR regexp_matches(name, '^__.*__$') OR regexp_matches(lower(name), '{_INFRA}') THEN '' WHEN length(name) = 1 THEN 'single_letter'"
        f" WHEN lower(name) IN ({', '.join(repr(w) for w in THROWAWAY)}) THEN 'throwaway_name' WHEN length(name) <= 4 AND name = lower(name) AND coalesce(regexp_matches(raw_code, '{ONE_CALL}'), false) THEN 'short_call_result' ELSE '' END"
    )

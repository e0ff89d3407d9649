"""Rules on the lines of texts: a bounded table of patterns against exploded lines."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    kind: str
    pattern: str
    severity: str


# What a line of code may do wrong; our own patterns, which Java's and RE2's engines read alike.
_CALL = r"\s*\("
SECURITY = [
    Rule("secret", r"(?i)\b\w*(?:passw(?:or)?d|passphrase|secret|api_?key|access_?key|auth_?token)\w*\b\s*(?::\s*\w+\s*)?(?:=>?|:)\s*[\"'][^\"'\s]{6,}[\"']", "high"),
    Rule("secret", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "critical"),
    Rule("secret", r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abpr]-[A-Za-z0-9-]{10,})", "critical"),
    Rule("secret", r"(?i)\b[a-z]+://[^/\s:@\"']+:[^/\s:@\"']+@", "high"),
    Rule("query from parts", r"(?i)[\"'](?:select|insert|update|delete)\b[^\"']*[\"']\s*(?:\+|\.\s*\$|%\s*[\w(])", "high"),
    Rule("query from parts", r"(?i)\bf[\"'](?:select|insert|update|delete)\b[^\"']*\{", "high"),
    Rule("query from parts", r"(?i)`(?:select|insert|update|delete)\b[^`]*\$\{", "high"),
    Rule("shell", r"\bos\.(?:system|popen)" + _CALL, "high"),
    Rule("shell", r"\bshell\s*=\s*True\b", "high"),
    Rule("shell", r"\b(?:shell_exec|passthru|proc_open)" + _CALL, "high"),
    Rule("shell", r"\bchild_process\b|\bRuntime\.getRuntime\(\)\.exec" + _CALL, "medium"),
    Rule("code from text", r"(?:^|[^.\w])(?:eval|exec)\s*\(\s*[^\"'\s)]", "high"),
    Rule("code from text", r"\bnew\s+Function" + _CALL, "high"),
    Rule("loading objects", r"\b(?:pickle|cPickle|dill|marshal)\.loads?" + _CALL, "high"),
    Rule("loading objects", r"\byaml\.load\s*\((?:[^)]*\bLoader\b)?[^)S]*\)", "medium"),
    Rule("loading objects", r"\bunserialize" + _CALL + r"|\bnew\s+ObjectInputStream\b", "high"),
    Rule("markup from text", r"\.innerHTML\s*\+?=|\bdangerouslySetInnerHTML\b|\bdocument\.write" + _CALL, "medium"),
    Rule("weak hash", r"(?i)\b(?:md5|sha1)" + _CALL + r"|getInstance\(\s*\"(?:MD5|SHA-?1)\"", "medium"),
    Rule("weak cipher", r"\b(?:DES|RC4|ARC4|Blowfish)\b.*(?:new|Cipher|cipher)|\bMODE_ECB\b|/ECB/", "high"),
    Rule("guessable numbers", r"\brandom\.(?:random|randint|choice)" + _CALL + r"|\bMath\.random" + _CALL + r"|\b(?:mt_)?rand" + _CALL, "info"),
    Rule("unchecked certificate", r"\bverify\s*=\s*False\b|\brejectUnauthorized\s*:\s*false\b|\bCURLOPT_SSL_VERIFYPEER\b.*(?:false|0)", "high"),
    Rule("open to all", r"\bchmod\s*\(.*0?o?777\b|[\"']0\.0\.0\.0[\"']|Access-Control-Allow-Origin.*\*", "medium"),
    Rule("path from parts", r"\b(?:open|fopen|readFile(?:Sync)?|file_get_contents)\s*\(\s*(?:f[\"'].*\{|[\"'][^\"']*[\"']\s*[.+]|`.*\$\{)", "medium"),
    Rule("temporary file", r"\b(?:mktemp|tempnam|tmpnam)" + _CALL, "low"),
    Rule("left from debugging", r"\bdebugger\b\s*;|\b(?:pdb|ipdb)\.set_trace" + _CALL + r"|\bbreakpoint\(\)|\bvar_dump" + _CALL + r"|\bdbg!" + _CALL, "medium"),
    Rule("left from debugging", r"\bconsole\.(?:log|debug)" + _CALL + r"|\bSystem\.out\.print(?:ln)?" + _CALL, "low"),
    Rule("unsafe memory", r"\bunsafe\s*\{|\bmem::transmute\b", "medium"),
    Rule("panic", r"\.unwrap\(\)|\bpanic!" + _CALL, "info"),
    Rule("swallowed error", r"^\s*except\s*:|\bcatch\s*(?:\([^)]*\))?\s*\{\s*\}", "low"),
]
#: A secret that is none: read from elsewhere, or a stand-in.
HARMLESS = {"secret": r"(?i)\b(?:getenv|environ|process\.env|config|settings|example|placeholder|changeme|dummy|your[_-])|[\"'](?:x+|\*+|<[^>]*>|\$\{[^}]*\})[\"']"}
SEVERITY = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}


def lines(df: DataFrame, text: str) -> DataFrame:
    """A row for each line with ``line`` (from 1) and ``content``; null texts have none."""
    return df.select("*", F.posexplode(F.split(text, "\r?\n")).alias("__at", "content")).withColumn("line", F.col("__at") + 1).drop("__at", text)


def matches(df: DataFrame, key: list[str], text: str, rules: list[Rule]) -> DataFrame:
    """``key, line, kind, severity``: one row for each line and kind, of the most severe rule that matches.

    The rules become one expression on each line, so there is no join and no row for what doesn't match.
    """
    def hit(r: Rule) -> Column:
        found = F.col("content").rlike(r.pattern)
        return found & ~F.col("content").rlike(HARMLESS[r.kind]) if r.kind in HARMLESS else found

    hits = F.array_compact(F.array(*[F.when(hit(r), F.struct(F.lit(r.kind).alias("kind"), F.lit(SEVERITY[r.severity]).alias("score"))) for r in rules]))
    rows = lines(df.select(*key, text), text).where(~F.col("content").rlike(r"^\s*(#|//|\*)")).select(*key, "line", F.explode(hits).alias("h"))
    name = F.element_at(F.create_map(*[F.lit(x) for k, v in SEVERITY.items() for x in (v, k)]), F.col("score"))
    return rows.groupBy(*key, "line", F.col("h.kind").alias("kind")).agg(F.max("h.score").alias("score")).withColumn("severity", name)


# A marker in a comment with who is asked, how urgent it is, and what is to be done; our own pattern.
MARKERS = ["TODO", "FIXME", "HACK", "XXX", "BUG", "NOTE", "OPTIMIZE"]
TODO = r"(?:#|//|/\*|\*|--|<!--)\s*@?(" + "|".join(MARKERS) + r")\b(?:\s*[(\[]@?(\w+)[)\]])?\s*(!*)\s*[:-]?\s*(.*?)\s*(?:\*/|-->)?\s*$"

"""Files of a source tree as a table: walk, exclusions, language, hash, size and lines."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Languages by compound extension, extension, file name and interpreter.
COMPOUND = {".blade.php": "blade", ".d.ts": "typescript", ".html.twig": "twig", ".html.erb": "erb"}
EXTENSIONS = {
    "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "php": "php", "rs": "rust", "java": "java",
    "sh": "bash", "bash": "bash", "css": "css", "scss": "scss", "html": "html", "htm": "html", "md": "markdown", "vue": "vue", "svelte": "svelte", "yml": "yaml", "yaml": "yaml", "toml": "toml", "txt": "text",
}
NAMES = {"dockerfile": "dockerfile", "makefile": "makefile"}
INTERPRETERS = {"python": "python", "node": "javascript", "bash": "bash", "sh": "bash", "php": "php"}
EXCLUDED_DIRS = [".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", "target", ".idea"]


def language_of(path: Column, first_line: Column) -> Column:
    """First of compound extension, extension, name and interpreter that tells; null if none does."""
    low = F.lower(path)
    out = F.lit(None).cast("string")
    for k, v in INTERPRETERS.items():
        out = F.when(first_line.rlike(rf"^#!.*\b{k}[\d.]*(\s|$)"), v).otherwise(out)
    name = F.element_at(F.split(low, "/"), -1)
    for k, v in NAMES.items():
        out = F.when(name == k, v).otherwise(out)
    for k, v in EXTENSIONS.items():
        out = F.when(name.endswith(f".{k}"), v).otherwise(out)
    for k, v in COMPOUND.items():
        out = F.when(name.endswith(k), v).otherwise(out)
    return out


def excluded(path: Column, directories: list[str], files: list[str]) -> Column:
    """Whether a folder of the path, or its file name, matches one of the patterns, or is hidden."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    name = F.element_at(parts, -1)
    out = F.exists(dirs, lambda x: x.startswith(".")) | name.startswith(".")
    for p in directories:
        out = out | F.exists(dirs, _like(p))
    for p in files:
        out = out | name.rlike(f"^(?:{_regex(p)})$")
    return out


def _regex(pattern: str) -> str:
    return re.sub(r"\\[zZ]$", "", fnmatch.translate(pattern)).replace("(?s:", "(?:")


def _like(pattern: str):
    r = f"^(?:{_regex(pattern)})$"
    return lambda x: x.rlike(r)


def discover(spark: SparkSession, root: str, directories: list[str] | None = None, files: list[str] | None = None) -> DataFrame:
    """``relative_path, language, file_hash, file_size, line_count, text`` of the files below ``root``.

    The files are listed and read by Spark's own source; exclusion patterns are merged with the usual
    ones. Files that aren't text in UTF-8 keep their hash and have text null. An empty folder gives no rows.
    """
    base = root.rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    path = F.regexp_replace(F.col("path"), r"^.*?" + re.escape(base.split("://")[-1]) + "/", "")
    dirs = list(dict.fromkeys([*EXCLUDED_DIRS, *(directories or [])]))
    text = F.try_validate_utf8(F.col("content").cast("string")) if hasattr(F, "try_validate_utf8") else F.col("content").cast("string")
    rows = rows.select(path.alias("relative_path"), F.sha2("content", 256).alias("file_hash"), F.col("length").alias("file_size"), text.alias("text")).where(~excluded(F.col("relative_path"), dirs, files or []))
    first = F.substring_index("text", "\n", 1)
    lines = F.when(F.col("text").isNotNull(), F.length("text") - F.length(F.translate("text", "\n", "")) + F.when(F.col("text").endswith("\n") | (F.col("text") == ""), 0).otherwise(1))
    return rows.select("relative_path", language_of(F.col("relative_path"), F.coalesce(first, F.lit(""))).alias("language"), "file_hash", "file_size", lines.cast("int").alias("line_count"), "text")


def languages(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("n_files"), F.sum("line_count").alias("n_lines"))

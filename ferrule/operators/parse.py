"""Parsing of file texts into rows, where the texts lie."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ferrule.functions import parsers

ELEMENTS = "file_id long, kind string, name string, line_start int, line_end int, parent string, signature string, docstring string, decorators array<string>, is_async boolean, calls array<string>"


def _rows(schema: pa.Schema, make):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[] for _ in schema]
            for i, g, t in zip(*(b.column(k).to_pylist() for k in range(3))):
                for row in make(t, g):
                    for col, v in zip(out, (i, *row)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return run


_STR = pa.string()
_ELEMENT = pa.schema([("file_id", pa.int64()), ("kind", _STR), ("name", _STR), ("line_start", pa.int32()), ("line_end", pa.int32()), ("parent", _STR), ("signature", _STR), ("docstring", _STR), ("decorators", pa.list_(_STR)), ("is_async", pa.bool_()), ("calls", pa.list_(_STR))])
_IMPORT = pa.schema([("file_id", pa.int64()), ("module", _STR), ("name", _STR), ("alias", _STR), ("line", pa.int32())])
_SECTION = pa.schema([("file_id", pa.int64()), ("level", pa.int32()), ("title", _STR), ("first_line", pa.int32()), ("last_line", pa.int32())])


def parsed_elements(files: DataFrame) -> DataFrame:
    """Elements of ``file_id, language, text``; texts that don't parse give none."""
    return files.select("file_id", "language", "text").mapInArrow(_rows(_ELEMENT, lambda t, g: parsers.elements(t, g)), ELEMENTS)


def parsed_imports(files: DataFrame) -> DataFrame:
    """Imported names of ``file_id, language, text``, in all languages that are parsed here."""
    return files.select("file_id", "language", "text").mapInArrow(_rows(_IMPORT, lambda t, g: parsers.imports(t, g)), "file_id long, module string, name string, alias string, line int")


def sections(texts: DataFrame) -> DataFrame:
    """Sections of markdown texts (``file_id, language, text``)."""
    return texts.select("file_id", "language", "text").mapInArrow(_rows(_SECTION, lambda t, g: parsers.markdown_sections(t or "")), "file_id long, level int, title string, first_line int, last_line int")

"""Splitting oversized texts at natural boundaries (problem 1).

The lines of a text form a structure tree: headings, list items, paragraphs, nested markup and indentation
open subtrees, and comments, decorators and blank lines belong to what follows them. Only a subtree that is
too large is descended into, down to lines and, in a line that is too long, to nested elements, statements,
sentences, arguments and words. What comes out is merged bottom-up: neighbours that the deepest subtrees part
first, then their parents' children, as long as they are within the limit together.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 8191
OVERLAP = 200
#: A piece that is filled less is filled up from the next one.
LEAST_FILL = 0.25

_LINE = re.compile(r"[^\n]*\n|[^\n]+")
_HEADING = re.compile(r"(#{1,6})[ \t]+\S")
_ITEM = re.compile(r"[ \t]*(?:[-*+•]|\d+[.)])[ \t]+\S")
_CODE = re.compile(r".*[;{}:,()]\s*$|\s*(?:def|class|import|from|return|@)\b")
_STICKY = re.compile(r"[ \t]*(?://|#(?!!)|/?\*|@|--|\"\"\"|\'\'\')")
_CLOSER = re.compile(r"[ \t]*(?:[)\]}]|</|end\b|else\b|elif\b|except\b|finally\b|catch\b)")
_TAG = re.compile(r"<(/?)([A-Za-z][\w:-]*)(?:\s[^<>]*?)?(/?)>")
# Elements of HTML that are never closed.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Places inside a line, the best first: behind elements, statements, sentences, arguments, words.
_INSIDE = [_TAG, re.compile(r"[;{}]"), re.compile(r"[.!?。][ \t]"), re.compile(r"[,)\]]"), re.compile(r"\s")]
#: Boundaries inside lines lie below all boundaries between lines.
_BELOW_LINES = 1 << 20


class _Lines:
    def __init__(self, text: str) -> None:
        self.text = text
        self.at = [m.start() for m in _LINE.finditer(text)] + [len(text)]
        self.level: list[int | None] = []
        self.sticky: list[bool] = []
        self.closer: list[bool] = []
        heads = [x for x in _LINE.findall(text) if x.strip()]
        code = sum(_CODE.match(x) is not None for x in heads)
        prose = any(map(_HEADING.match, heads)) and code < 0.2 * len(heads)
        markup = sum(x.lstrip().startswith("<") for x in heads) >= 0.25 * len(heads)
        fence, open_, above = False, 0, True  # above: nothing but a blank line stands above
        for a, b in zip(self.at, self.at[1:]):
            line = text[a:b]
            body = line.lstrip(" \t")
            self.sticky.append(not prose and not markup and _STICKY.match(line) is not None)
            self.closer.append(_CLOSER.match(line) is not None)
            if body.startswith("```"):
                fence = not fence
            head = line[: len(line) - len(body)]
            indent = len(head.expandtabs(4)) if "\t" in head else len(head)
            if not body.strip():
                self.level.append(None)
            elif markup:
                before = open_
                for m in _TAG.finditer(line):
                    if m[2].lower() not in _VOID and not m[3]:
                        open_ = max(0, open_ - 1) if m[1] else open_ + 1
                self.level.append(min(before, open_) if self.closer[-1] else before)
            elif prose and not fence and _HEADING.match(line):
                self.level.append(len(_HEADING.match(line)[1]) - 10)
            elif prose:  # paragraphs, their lines and list items
                self.level.append(indent + (1 if _ITEM.match(line) else 0 if above else 2))
            else:
                self.level.append(indent)
            above = not body.strip()

    def children(self, i: int, j: int) -> list[tuple[int, int]]:
        """Sibling subtrees of lines i..j: each begins at a line of the least level."""
        known = [x for x, closes in zip(self.level[i:j], self.closer[i:j]) if x is not None and not closes] or [x for x in self.level[i:j] if x is not None]
        if not known:
            return [(k, k + 1) for k in range(i, j)]
        least = min(known)
        starts = [i]
        sticky = None  # first of the comment lines just above
        seen = False
        for k in range(i, j):
            x = self.level[k]
            if x is None:
                sticky = k + 1
                continue
            if x != least or self.closer[k]:
                if not (sticky is not None and self.sticky[k]):
                    sticky = None
                continue
            begin = sticky if sticky is not None and sticky <= k else k
            if seen and begin > starts[-1]:
                starts.append(begin)
            seen = True
            if not self.sticky[k]:
                sticky = None
            elif sticky is None:
                sticky = k
        if len(starts) == 1 and j - i > 1:  # a header and what is below it
            rest = next((k for k in range(i + 1, j) if self.level[k] is not None and self.level[k] > least), i + 1)
            starts.append(rest if rest > i else i + 1)
        return list(zip(starts, [*starts[1:], j]))


def _units(text: str, lines: _Lines, room: int) -> tuple[list[int], list[int]]:
    """Where the units begin that the text is descended into, and how deep the boundary before each lies."""
    starts, depths = [], []
    todo = [(0, len(lines.at) - 1, 0, 0)]
    while todo:
        i, j, depth, before = todo.pop()
        a, b = lines.at[i], lines.at[j]
        if b - a <= room:
            starts.append(a)
            depths.append(before)
        elif j - i > 1:
            parts = lines.children(i, j)
            todo.extend((p, q, depth + 1, depth + 1 if k else before) for k, (p, q) in reversed(list(enumerate(parts))))
        else:
            for at, d in _inside(text, a, b, room):
                starts.append(at)
                depths.append(d if at > a else before)
    return starts, depths


def _inside(text: str, a: int, b: int, room: int) -> list[tuple[int, int]]:
    """The parts of one line that is too long: where each begins, and how deep; only parts that are too long are cut further."""
    parts = [(a, _BELOW_LINES)]
    for rank, pattern in enumerate(_INSIDE):
        ends = [x for x, _ in parts[1:]] + [b]
        if all(y - x <= room for (x, _), y in zip(parts, ends)):
            return parts
        out: list[tuple[int, int]] = []
        for (x, d), y in zip(parts, ends):
            out.append((x, d))
            if y - x <= room:
                continue
            nested = 0
            for m in pattern.finditer(text, x, y):
                if pattern is _TAG:
                    closes = bool(m[1])
                    if not m[3] and m[2].lower() not in _VOID:
                        nested = max(0, nested - 1) if closes else nested + 1
                    if not closes and not m[3]:
                        continue
                elif m[0] in "{}":
                    nested = max(0, nested - 1) if m[0] == "}" else nested + 1
                if x < m.end() < y and not (text[m.end() - 1] == "\r" and text[m.end()] == "\n"):
                    out.append((m.end(), _BELOW_LINES * (rank + 1) + min(nested, _BELOW_LINES - 1)))
        parts = out
    forced: list[tuple[int, int]] = []
    for (x, d), y in zip(parts, [x for x, _ in parts[1:]] + [b]):
        forced.append((x, d))
        while y - x > room:
            x += room - (text[x + room - 1 : x + room + 1] == "\r\n")
            forced.append((x, _BELOW_LINES * (len(_INSIDE) + 1)))
    return forced


def cut_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """Where the pieces' own parts begin, the first at 0; each part is at most ``limit - overlap`` long."""
    if not 0 <= overlap * 4 <= limit:
        raise ValueError("overlap must be at most a quarter of limit")
    room = limit - overlap
    if len(text) <= limit:
        return [0]
    starts, depths = _units(text, _Lines(text), room)
    n = len(starts)
    end = [*starts[1:], len(text)]
    first, last = list(range(n)), list(range(n))  # of the group that a unit is the first, or last, of: its other end
    joined = [False] * n
    for k in sorted(range(1, n), key=lambda k: (-depths[k], k)):  # the deepest boundary first
        p, q = first[k - 1], last[k]
        if end[q] - starts[p] <= room:
            joined[k] = True
            last[p], first[q] = q, p
    groups = [k for k in range(n) if not joined[k]]
    return _filled(text, starts, depths, [starts[k] for k in groups], room, max(overlap, int(room * LEAST_FILL)))


def _filled(text: str, starts: list[int], depths: list[int], cuts: list[int], room: int, least: int) -> list[int]:
    """Moves the end of pieces that are filled too little to a later boundary: the highest, and of equal ones the last."""
    out = [0]
    ends = [*cuts[1:], len(text)]
    for k, end in enumerate(ends[:-1]):
        begin = out[-1]
        if end <= begin or ends[k + 1] - begin <= room:
            continue
        if end - begin < least:
            lo, hi = bisect.bisect_left(starts, begin + least), bisect.bisect_right(starts, begin + room)
            if lo < hi:
                end = starts[min(range(lo, hi), key=lambda i: (depths[i], -i))]
            else:
                inner = [x for x in _inside(text, begin, min(len(text), begin + room), least) if x[0] >= begin + least]
                end = min(inner, key=lambda x: (x[1], -x[0]))[0] if inner else begin + room
        out.append(end)
    while len(text) - out[-1] > room:
        out.append(out[-1] + room)
    return out


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Ranges of the pieces: each but the first begins with the last ``overlap`` characters before it."""
    cuts = cut_points(text, limit, overlap)
    return [(max(0, a - overlap) if k else 0, b) for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(text)]))]


def joined(parts: list[str], overlap: int = OVERLAP) -> str:
    """The text again."""
    return parts[0] + "".join(p[overlap:] for p in parts[1:]) if parts else ""


def split_oversized(rows: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of at most ``limit`` code points of ``element_id, raw_code``.

    Result: ``element_id, piece_no, n_pieces, start, stop, piece``. Texts within the limit, also empty
    ones, are one piece and never leave the JVM; null texts give no piece. Each row is split by itself:
    no shuffle, and repeated rows give repeated pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for e, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = pieces(t, limit, overlap)
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([e] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array([n] * n, pa.int32()), pa.array([x for x, _ in at], pa.int64()), pa.array([y for _, y in at], pa.int64()), pa.array([t[x:y] for x, y in at], pa.string())],
                    names=["element_id", "piece_no", "n_pieces", "start", "stop", "piece"],
                )

    rows = rows.select("element_id", "raw_code")
    size = F.length("raw_code")
    small = rows.where(size <= limit).select(
        "element_id", F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).cast("long").alias("start"), size.cast("long").alias("stop"), F.col("raw_code").alias("piece")
    )
    return rows.where(size > limit).mapInArrow(run, "element_id string, piece_no int, n_pieces int, start long, stop long, piece string").unionByName(small)
